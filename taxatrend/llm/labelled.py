"""Bounded samples of labelled documents, drawn the same way whatever the order of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatrend.llm.common import quoted, whole_text


def held_out(doc_id) -> F.Column:
    """The fold never learnt from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, exclude=None) -> DataFrame:
    """At most ``per_class`` documents of each class (doc_id, text, label 0 or 1, and the other columns of ``docs``).

    The ids with the smallest hashes are taken; only their rows of ``docs`` move. A document labelled twice counts as 1
    if any label says so; null labels, null ids and rows with ``exclude(doc_id)`` true take no part.
    """
    given = labels.filter(quoted(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(quoted(label)) >= 1).cast("int").alias("y"))
    if exclude is not None:
        given = given.filter(~exclude(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    # 2 * per_class ids at most: small enough to send to every task.
    chosen = given.filter("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(given.filter("y = 0").orderBy(order, "doc_id").limit(per_class))
    return docs.join(F.broadcast(chosen.withColumnRenamed("y", "sampled_label")), "doc_id").withColumn("text", whole_text(F.col("text")))
