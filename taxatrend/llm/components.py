"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), as joins and minima.

Each round is written to the shared folder, so the lineage stays short and a lost executor costs a task. No list of a
node's neighbours is ever gathered: a node's smallest neighbour is an aggregate, joined back to its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatrend.llm.common import written


def _star(both: DataFrame) -> DataFrame:
    """Links (u, v) with u's smallest neighbour or itself as m."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u")


def large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    s = _star(down)
    return s.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(s.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (two columns of one type) -> (node, root): every node that has a link, with its component's smallest node."""
    a, b = links.columns
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    before = None
    while True:
        e = written(small_star(large_star(e)), "components")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    # At rest every link goes from a node to its root.
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
