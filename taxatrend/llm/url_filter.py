"""URL filters by a temporal join: dated list entries become validity intervals, captures meet those active when fetched.

Native expressions only. Captures are reduced to different (host, day) pairs before anything is joined, so a host with a
third of all captures costs as many rows as it was fetched on different days; verdicts come back by host and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxatrend.llm.common import fresh, quoted

#: The lower-cased host of a URL with a scheme, without user and port: fixed pattern.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """Lower-cased host; null where there is none."""
    h = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(h != "", h)


def validity(entries: DataFrame) -> DataFrame:
    """``entries`` (list, key, action add or remove, day) -> intervals (list, key, since, until): active from ``since`` to before ``until``.

    Of several entries of a key on one day a removal counts; an entry ends at the key's next entry, the last stays open
    (until null). After this reduction a key has at most one entry a day. Entries with a null in any column take no part.
    """
    known = entries.select("list", F.lower("key").alias("key"), "action", "day").dropna().filter(F.col("action").isin("add", "remove"))
    daily = known.groupBy("list", "key", "day").agg(F.max(F.col("action") == "remove").alias("removed"))
    following = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return daily.withColumn("until", following).filter(~F.col("removed")).select("list", "key", F.col("day").alias("since"), "until")


def suffixes(h: Column) -> Column:
    """The host and every parent domain: a.b.c, b.c, c."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetch_day", block: str = "block", allow: str = "allow") -> DataFrame:
    """``captures`` with host, blocked_by, allowed_by (the most specific active key of each list, or null) and kept.

    A capture is kept unless a blocking entry is active on its day; an allowing entry that is at least as specific lifts
    the block. Without a host or a day nothing matches and the capture is kept. All rows and columns stay; columns of
    these four names are replaced. Repeated captures each get the same verdict.
    """
    names = ["host", "blocked_by", "allowed_by", "kept"]
    base = captures.select(*[quoted(c) for c in captures.columns if c not in names]).withColumn("host", host(quoted(url_col)))
    h, d = fresh(base, "verdict_host", "verdict_day")
    asked = base.select(F.col("host").alias(h), quoted(day_col).alias(d)).dropna().distinct()
    active = validity(entries)
    met = asked.select(h, d, F.explode(suffixes(F.col(h))).alias("key")).join(active, "key").filter((F.col(d) >= F.col("since")) & (F.col("until").isNull() | (F.col(d) < F.col("until"))))
    longest = lambda name: F.max(F.when(F.col("list") == name, F.struct(F.length("key").alias("n"), F.col("key"))))["key"]
    verdicts = met.groupBy(h, d).agg(longest(block).alias("blocked_by"), longest(allow).alias("allowed_by"))
    out = base.join(verdicts, (F.col("host") == F.col(h)) & (quoted(day_col) == F.col(d)), "left").drop(h, d)
    lifted = F.coalesce(F.length("allowed_by") >= F.length("blocked_by"), F.lit(False))
    return out.withColumn("kept", F.col("blocked_by").isNull() | lifted)
