"""Global row numbers and running sums in an order, without a window over the whole or over a hot group.

Rows are dealt by ranges of the order, so a long group lies in many ranges. Each range numbers its own runs of equal
groups; what the first run of a range continues is known from one summary row per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taxatrend.llm.common import map_arrow, written


def changes(b: pa.RecordBatch, at: list[int]) -> np.ndarray:
    """Whether each row but the first differs from the row before it in the columns ``at``; nulls are equal."""
    out = np.zeros(max(b.num_rows - 1, 0), bool)
    for i in at:
        c = b.column(i)
        x, y = c.slice(0, len(out)), c.slice(1)
        gone = np.asarray(pc.xor(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False), bool)
        out |= gone | np.asarray(pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False), bool)
    return out


def numbered(rows: DataFrame, group: list[str], order: list[str], amount: str | None = None, name: str = "numbered") -> DataFrame:
    """``rows`` (written) with ``number``, from 0 within each group in the order, and ``before``, the sum of ``amount`` over the rows before.

    Nulls come first and are equal. Rows equal in group and order may swap numbers. An order that leaves many rows equal needs a last
    column that tells them apart, or they meet in one task, which streams them.
    """
    by = [*group, *[c for c in order if c not in group]]
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("number bigint, before bigint, run bigint, part int").fields])
    keys = [rows.columns.index(c) for c in group]
    value = rows.columns.index(amount) if amount else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, run, number, total = TaskContext.get().partitionId(), None, -1, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            first = tuple(b.column(i)[0].as_py() for i in keys)
            fresh = np.concatenate([[run < 0 or first != last], changes(b, keys)])
            if fresh[0]:
                number = total = 0
            size = np.zeros(n, np.int64) if value is None else pc.fill_null(b.column(value).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            runs = run + np.cumsum(fresh)
            # Counted from the batch's start; a run that begins within the batch counts from its own first row.
            starts = np.flatnonzero(fresh)
            own = np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]])))
            sums = np.cumsum(size) - size
            begun = np.cumsum(fresh) > 0
            numbers = np.arange(n) - own + np.where(begun, 0, number)
            befores = sums - sums[own] + np.where(begun, 0, total)
            last, run = tuple(b.column(i)[n - 1].as_py() for i in keys), int(runs[-1])
            number, total = int(numbers[-1]) + 1, int(befores[-1] + size[-1])
            extra = [pa.array(numbers, pa.int64()), pa.array(befores, pa.int64()), pa.array(runs, pa.int64()), pa.array(np.full(n, part), pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], schema.names)

    own = written(map_arrow(rows.repartitionByRange(*by).sortWithinPartitions(*by), read, schema), name)
    tail = F.struct("number", (F.col("before") + (F.coalesce(F.col(amount).cast("bigint"), F.lit(0)) if amount else F.lit(0))).alias("sum"))
    key = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    ends = own.groupBy("part").agg(
        F.min_by(key, "run").alias("first"), F.max_by(key, "run").alias("last"), F.max("run").alias("runs"),
        F.max_by(tail, F.struct("run", "number")).alias("end"),
    )
    carried, before, rows_held, held = [], None, 0, 0
    for r in sorted(ends.collect(), key=lambda r: r.part):
        more = (rows_held, held) if before is not None and r["first"] == before else (0, 0)
        carried.append((r.part, *more))
        goes_on = more if r.runs == 0 else (0, 0)
        before, rows_held, held = r["last"], r.end.number + 1 + goes_on[0], r.end.sum + goes_on[1]
    known = rows.sparkSession.createDataFrame(carried, "part int, more_rows bigint, more bigint")
    continued = lambda c: F.when(F.col("run") == 0, F.coalesce(c, F.lit(0))).otherwise(0)
    return own.join(F.broadcast(known), "part", "left").select(
        *rows.columns, (F.col("number") + continued(F.col("more_rows"))).alias("number"), (F.col("before") + continued(F.col("more"))).alias("before"),
    )
