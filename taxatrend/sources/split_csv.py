"""Quoted CSV read in byte ranges: one large file feeds many tasks, though its records may hold line breaks.

Spark splits a text file at line ends. Whether a line end lies within quotes depends on all quotes before it, so one pass counts the
quotes of every range, a running sum over a file's ranges says which of them begin within quotes, and a second
pass puts lines together to records. What a range leaves open, or goes on with, meets over the ranges' order: two rows a range at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records of one batch handed on.
ROWS = 4096


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines, and the byte at which their range begins."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def ranges_within_quotes(lines: DataFrame) -> DataFrame:
    """(file, block, within): whether the range begins within quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("within"))


def put_together(lines: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(file, block, number, head, open, record): records of a range, and the parts of those that cross its borders.

    ``head``: the record began in an earlier range; ``open``: it goes on in a later one. ``number`` counts within the range.
    """

    def begins_within(file: str, block: int) -> bool:
        blocks, within = known.get(file, (np.empty(0, np.int64), None))
        at = int(np.searchsorted(blocks, block))
        if at == len(blocks) or blocks[at] != block:
            raise RuntimeError(f"the byte ranges of {file} changed between the two passes: read it again")
        return bool(within[at])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place, number, head, inside, held = None, 0, False, False, []

        def emit(is_open: bool) -> None:
            nonlocal number, head, held
            out.append((*place, number, head, is_open, "\n".join(held)))
            number, head, held = number + 1, False, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "number", "head", "open", "record"])
            out.clear()
            return batch

        for b in batches:
            for value, file, block in zip(*[c.to_pylist() for c in b.columns]):
                if (file, block) != place:
                    if held:
                        emit(True)
                    place, number = (file, block), 0
                    head = inside = begins_within(file, block)
                held.append(value)
                if value.count('"') % 2:
                    inside = not inside
                if not inside:
                    emit(False)
            if len(out) >= ROWS:
                yield flush()
        if held:
            emit(True)
        yield flush()

    return lines.mapInArrow(read, "file string, block bigint, number bigint, head boolean, open boolean, record string")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, record): the text of every record of the quoted CSV files at ``path``, ``pos`` rising in file order.

    Quotes stand only around fields, doubled within them. Empty lines between records are left out, so is the carriage return at a record's end and the
    mark at a file's beginning. The driver holds nine bytes for each byte range.
    """
    lines = file_lines(spark, path)
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    listed = ranges_within_quotes(lines).toArrow().to_pandas().sort_values(["file", "block"])  # one row for each byte range
    for file, part in listed.groupby("file"):
        known[file] = (part["block"].to_numpy(), part["within"].to_numpy())
    parts = put_together(lines, known)
    whole = parts.filter("NOT head AND NOT open").select("file", (F.col("block") + F.col("number")).alias("pos"), "record")
    order = Window.partitionBy("file").orderBy("block", "number")
    crossing = parts.filter("head OR open").withColumn("nth", F.count_if(~F.col("head")).over(order))
    piece = F.struct("block", "number", "record")
    joined = crossing.groupBy("file", "nth").agg(F.array_sort(F.collect_list(piece)).alias("p")).select(
        "file", (F.col("p")[0]["block"] + F.col("p")[0]["number"]).alias("pos"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")
    )
    text = F.regexp_replace("record", r"^\x{FEFF}|\r$", "")
    return whole.unionByName(joined).withColumn("record", text).filter("record <> ''")
