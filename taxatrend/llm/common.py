"""What the operators share: written tables in the cluster's shared folder, safe column names, per-worker models."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from taxatrend.workspace import shared_root

#: Rows of one Arrow batch; texts of 100,000 characters then still give batches of tens of megabytes.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a worker's memory is bounded by few texts, or by one that is longer. The session keeps these settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under spark.checkpoint.dir and read again: cuts the lineage, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for helpers that clash with none of ``df``'s, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    """The column of that exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def map_arrow(df: DataFrame, read, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` for columns of any name (dots, clashes): batches go in and come out by position."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = [f"c{i}" for i in range(len(schema.fields))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in read(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names)
        task_ended()

    inner = StructType([StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, inner).toDF(*schema.names)


#: Models and tables of this Python worker, kept between tasks; how many tasks have ended since each was last used, and how many may.
KEPT: dict = {}
UNUSED: dict = {}
IDLE_TASKS = 4


def kept(key, build):
    """``build()`` once per Python worker, as long as its tasks use it."""
    UNUSED[key] = 0
    if key not in KEPT:
        KEPT[key] = build()
    return KEPT[key]


def task_ended() -> None:
    """Drop what the last tasks of this worker did not use: a worker outlives the operator that filled it, and all that it keeps adds up."""
    for key in list(KEPT):
        UNUSED[key] = UNUSED.get(key, 0) + 1
        if UNUSED[key] > IDLE_TASKS:
            del KEPT[key], UNUSED[key]
