"""Exact top-k inner products by the three-phase uniform threshold algorithm.

The score of a pair is the sum of its parts over a few slices of the dimensions. Vectors are packed into blocks, and
queries meet candidates block by block. First every block gathers, for each query and slice, the list of the k best part
scores, and reports the k-th best total among the listed rows: the largest report is a cutoff that k rows reach. In the
second phase the cutoff goes out with the queries, and a block collects the rows with a part of at least cutoff / slices
in some slice; no other row can reach the cutoff. Bounds prune these, the third phase resolves what is left exactly.

Memory does not grow with the table: a block has a bounded number of cells in the smallest type that holds them, a bounded
number of blocks meets in a task, and a task keeps only the k best of each query over the blocks it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxatrend.llm.common import configure, map_arrow, quoted, written

SLICES = 4
QUERY_ROWS, CANDIDATE_ROWS = 256, 8192
#: Components of a block, unless a single vector has more; blocks of candidates in a partition, about; query blocks whose best rows a task holds.
CELLS, MEETING, HELD = 1 << 18, 64, 32
BLOCK = "ids array<bigint>, cutoffs array<double>, dims int, kind string, cells binary"
WIDTH = 5


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors without null, null components or non-finite ones, as doubles."""
    v = quoted(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(quoted(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~odd)


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """``vectors`` (vec_id, v, cutoff) in blocks of up to ``rows``: integer components, in order of vec_id within a block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, float, np.ndarray]] = []
        dims = 0

        def block() -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])
            cells = np.zeros((len(held), dims))  # a shorter vector has zeros beyond its end
            for r, (_, _, x) in enumerate(held):
                cells[r, : len(x)] = x
            kind = compact(cells)
            arrays = [pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[r[1] for r in held]], pa.list_(pa.float64())), pa.array([dims], pa.int32()), pa.array([kind]), pa.array([cells.astype(kind).tobytes()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["ids", "cutoffs", "dims", "kind", "cells"])

        for b in batches:
            flat = np.floor(64.0 * b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float))
            ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
            for i, cutoff, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), np.split(flat, ends[:-1])):
                if held and (len(held) == rows or (len(held) + 1) * max(dims, len(x)) > CELLS):
                    yield block()
                    dims = 0
                held.append((i, cutoff, x))
                dims = max(dims, len(x))
        if held:
            yield block()

    return map_arrow(vectors, read, BLOCK)


def compact(cells: np.ndarray) -> str:
    """The smallest type that holds whole numbers exactly."""
    least, most = cells.min(initial=0), cells.max(initial=0)
    return next((k for k in ("int8", "int16", "int32") if np.iinfo(k).min <= least and most <= np.iinfo(k).max), "float64")


def unpacked(b: pa.RecordBatch, r: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, cutoffs = (b.column(first + i)[r].values.to_numpy(zero_copy_only=False) for i in (0, 1))
    cells = np.frombuffer(b.column(first + 4)[r].as_py(), b.column(first + 3)[r].as_py()).reshape(len(ids), b.column(first + 2)[r].as_py())
    return ids, cutoffs, cells.astype(float)


def part_scores(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Part scores by slice, exact: single precision while all sums stay below 2^24, double up to 2^53, else refused."""
    dims = min(q.shape[1], c.shape[1])
    q, c = q[:, :dims], c[:, :dims]
    reach = float(np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(dims, 1)
    if reach >= 2**53:
        raise ValueError("components too large for exact sums")
    kind = np.float32 if reach < 2**24 else float
    q, c = q.astype(kind), c.astype(kind)
    cuts = [dims * j // SLICES for j in range(SLICES + 1)]
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:])]


def reports(pairs: DataFrame, k: int) -> DataFrame:
    """Phase one: (query_id, cutoff): for each query the k-th best total of the rows in the lists of a task's blocks, the largest of all tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by a query block's first id: its ids and their k best totals so far

        def told() -> Iterator[pa.RecordBatch]:
            for ids, totals in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(totals.min(axis=1))], ["query_id", "cutoff"])
            best.clear()

        for b in batches:
            for r in range(b.num_rows):
                qid, _, q = unpacked(b, r, 0)
                cid, _, c = unpacked(b, r, WIDTH)
                parts = part_scores(q, c)
                own = qid[:, None] == cid[None, :]
                total = sum(parts)
                listed = np.zeros(total.shape, bool)
                rows = np.arange(len(qid))[:, None]
                for p in parts:
                    if p.shape[1] > k:
                        listed[rows, np.argpartition(-p, k, axis=1)[:, : k + 1]] = True  # one more, for the query's own row
                    else:
                        listed[:] = True
                if int(qid[0]) not in best and len(best) == HELD:
                    yield from told()
                _, before = best.get(int(qid[0]), (qid, np.full((len(qid), k), -np.inf)))
                reached = np.concatenate([np.where(listed & ~own, total, -np.inf), before], axis=1)
                best[int(qid[0])] = qid, -np.partition(-reached, k - 1, axis=1)[:, :k].astype(float)
        yield from told()

    return map_arrow(pairs, read, "query_id bigint, cutoff double").groupBy("query_id").agg(F.max("cutoff").alias("cutoff"))


def foremost(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[best], ids[best], score[best]


def resolved(pairs: DataFrame, k: int) -> DataFrame:
    """Phases two and three: (query_id, vec_id, score): at most k rows of a task's blocks that reach the query's cutoff."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # by a query block's first id: its ids, and place, vec_id and score of the best rows so far

        def told() -> Iterator[pa.RecordBatch]:
            for ids, (rows, found, score) in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(found), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])
            best.clear()

        for b in batches:
            for r in range(b.num_rows):
                qid, cutoff, q = unpacked(b, r, 0)
                cid, _, c = unpacked(b, r, WIDTH)
                parts = part_scores(q, c)
                share = (cutoff / SLICES)[:, None]
                bound, met = np.zeros(parts[0].shape), np.zeros(parts[0].shape, bool)
                for p in parts:
                    enough = p >= share
                    met |= enough
                    bound += np.where(enough, p, share)  # a part not collected is below its share
                open_ = met & (bound >= cutoff[:, None]) & (qid[:, None] != cid[None, :])
                rows, cols = np.nonzero(open_)
                score = sum(p[rows, cols].astype(float) for p in parts)
                sure = score >= cutoff[rows]
                found = foremost(rows[sure], cid[cols[sure]], score[sure], k)
                if int(qid[0]) not in best and len(best) == HELD:
                    yield from told()
                if int(qid[0]) in best:
                    found = foremost(*map(np.concatenate, zip(best[int(qid[0])][1], found)), k)
                best[int(qid[0])] = qid, found
        yield from told()

    return map_arrow(pairs, read, "query_id bigint, vec_id bigint, score bigint")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k rows of highest integer inner product: query_id, rank from 1, vec_id, score.

    Components become floor(64 x). Candidates are all rows of ``vectors`` but those with the query's own id; rows that
    repeat an id each count, queries that repeat an id are one, with the least of its vectors by components in order. Ties go to the smaller vec_id. A shorter vector counts as
    zero beyond its end. Vectors that are null or hold null or non-finite components take no part; with fewer than k
    candidates all are listed. Extra columns are ignored.
    """
    spark = configure(vectors.sparkSession)
    unknown = F.lit(float("-inf")).alias("cutoff")
    blocks = written(pack(usable(vectors, id_col, vector_col).select("vec_id", "v", unknown), CANDIDATE_ROWS), "search-candidates")
    dealt = blocks.count()
    dealt = max(-(-dealt // MEETING), min(dealt, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)  # a join holds a partition of the candidates in memory
    asked = written(usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "search-queries")
    names = lambda df, s: df.toDF(*[f"{s}{i}" for i in range(WIDTH)])
    meet = lambda q: names(q, "q").crossJoin(names(blocks, "c").repartition(dealt))  # noqa: E731  blocks of the stated query set against blocks of all rows
    first = written(pack(asked.select("vec_id", "v", unknown), QUERY_ROWS), "search-query-blocks")
    cutoffs = reports(meet(first), k)
    known = asked.join(cutoffs, asked.vec_id == cutoffs.query_id).select("vec_id", "v", "cutoff")
    second = written(pack(known, QUERY_ROWS), "search-query-blocks")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return resolved(meet(second), k).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
