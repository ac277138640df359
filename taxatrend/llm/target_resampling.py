"""Target-distribution importance resampling: documents drawn in proportion to how much they look like a target text.

Hashed word runs are counted over the raw and the target texts; the log ratio of a bucket is its gain, and the floored
mean of a document's gains, looked up in one array, is its weight. A Gumbel key from a hash of the id turns "the highest
scores" into a draw without replacement in proportion to the weights.

The cutoff score is found exactly by weighted median-of-medians selection: every task reports how many of its keys lie on
either side of a pivot and a median of each side; the median of these, weighted by the tasks' remaining sizes, is the next
pivot, and every round drops a guaranteed share of what remains (an eighth, as a task's median is itself the median of
its batches' medians; about half in practice). Only the winners are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatrend.llm.common import configure, kept, map_arrow, quoted, written
from taxatrend.llm.numbering import numbered

BUCKETS, RUN, LEAST_WORDS, DRAWN_PERCENT = 10_000, 1, 20, 10
#: Remaining keys up to this number are sorted in place of a further round.
FEW = 1_000
#: Words whose bucket a worker remembers; beyond it the memory starts anew, with the same buckets.
REMEMBERED = 500_000

#: A-Z lower-cased, word bytes as they are (in UTF-8 every byte of a character beyond ASCII is one), all others a blank.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """Feature in UTF-8 -> its bucket, computed when first met."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: bytes | None, run: int, table: Buckets) -> tuple[np.ndarray, int]:
    """The buckets of all runs of 1 to ``run`` words, repeats included, and the number of words."""
    words = text.translate(TO_WORDS).split() if text else []
    found = [table[w] for w in words]
    for n in range(2, run + 1):
        found += [table[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return np.array(found, np.int64), len(words)


def as_bytes(b: pa.RecordBatch, at: int) -> list[bytes | None]:
    return b.column(at).cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, run: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows of ``texts`` (one column); every task sends at most one row a bucket."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = np.zeros(buckets, np.int64), kept(("buckets", buckets), lambda: Buckets(buckets))
        for b in batches:
            for text in as_bytes(b, 0):
                total += np.bincount(features(text, run, table)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = map_arrow(texts, read, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) for every bucket, with one added to each count."""
    s, t, k = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([floor(1000 * log((float(y + 1) * (s + k)) / (float(x + 1) * (t + k)))) for x, y in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, run: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of ``docs`` (doc_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(("buckets", len(gains)), lambda: Buckets(len(gains)))
        for b in batches:
            found = [features(t, run, table) for t in as_bytes(b, 1)]
            sizes = [len(f) for f, _ in found]
            weights = [int(gains[f].sum()) // len(f) if len(f) else 0 for f, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (sizes, [w for _, w in found], weights)]], ["doc_id", "n_features", "n_words", "weight"])

    return map_arrow(docs, read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features bigint, n_words bigint, weight bigint")


def gumbel(id_text: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for the document's own uniform u."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def median_row(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The (weighted) median of the rows in lexicographic order, and the weight of all."""
    order = np.lexsort(rows.T[::-1])
    sums = np.cumsum(np.ones(len(rows), np.int64) if weights is None else weights[order])
    return rows[order[np.searchsorted(sums, (int(sums[-1]) + 1) // 2)]], int(sums[-1])


def sides(rows: np.ndarray, pivot: list[int]) -> np.ndarray:
    """-1, 0 or 1 for rows before, at or after the pivot."""
    out = np.zeros(len(rows), np.int8)
    for c, p in zip(rows.T[::-1], pivot[::-1]):
        out = np.where(c == p, out, np.where(c < p, -1, 1)).astype(np.int8)
    return out


def between(columns: list[str], low: list[int] | None, high: list[int] | None) -> Column:
    """Rows strictly after ``low`` and strictly before ``high`` in lexicographic order."""

    def beyond(bound: list[int], up: bool) -> Column:
        found = F.lit(False)
        for c, v in reversed(list(zip(columns, bound))):
            found = ((F.col(c) > v) if up else (F.col(c) < v)) | ((F.col(c) == v) & found)
        return found

    keep = F.lit(True)
    if low is not None:
        keep = keep & beyond(low, True)
    return keep & beyond(high, False) if high is not None else keep


def kth_row(rows: DataFrame, columns: list[str], k: int) -> list[int]:
    """The k-th smallest row (from 1) of ``rows`` (written) by ``columns``, integers without nulls; ``rows`` has k or more.

    No task holds more than a batch of rows and the medians of its batches; the driver sees three numbers and two
    medians of each task. What remains is written anew whenever it has shrunk to a quarter.
    """
    kind = ", ".join(["side tinyint", "n bigint", *[f"k{i} bigint" for i in range(len(columns))]])
    rows = rows.select(*columns)

    def split(pivot: list[int] | None):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}
            for b in batches:
                a = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
                side = np.ones(len(a), np.int8) if pivot is None else sides(a, pivot)
                for s in np.unique(side).tolist():
                    found.setdefault(s, []).append(median_row(a[side == s]))
            out = []
            for s, medians in found.items():
                m, n = median_row(np.array([r for r, _ in medians]), np.array([w for _, w in medians]))
                out.append([s, n, *m.tolist()])
            columns_out = list(zip(*out)) if out else [[] for _ in range(2 + len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int8() if i == 0 else pa.int64()) for i, c in enumerate(columns_out)], [str(i) for i in range(len(columns_out))])

        return read

    def reported(pivot: list[int] | None) -> dict[int, tuple[int, list[int]]]:
        got = np.array([list(r) for r in map_arrow(rows, split(pivot), kind).collect()], np.int64).reshape(-1, 2 + len(columns))
        return {s: (int(part[:, 1].sum()), median_row(part[:, 2:], part[:, 1])[0].tolist()) for s in (-1, 0, 1) if len(part := got[got[:, 0] == s])}

    size, pivot = reported(None)[1]
    stored = size
    while size > FEW:
        state = reported(pivot)
        less, same = state.get(-1, (0, None))[0], state.get(0, (0, None))[0]
        if less < k <= less + same:
            return pivot
        if k <= less:
            rows, (size, pivot) = rows.filter(between(columns, None, pivot)), state[-1]
        else:
            rows, k = rows.filter(between(columns, pivot, None)), k - less - same
            size, pivot = state[1]
        if size * 4 <= stored:
            rows, stored = written(rows, "resample-left"), size
    left = np.array([list(r) for r in rows.collect()], np.int64)
    return left[np.lexsort(left.T[::-1])[k - 1]].tolist()


def resample(
    docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = 2024,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (from 1, null if not drawn).

    Of the rows with ``least_words`` words or more, the floor of ``percent`` in a hundred with the highest scores is drawn; ties go to the smaller
    id, a null id last, then to fewer features. Ids are integers. Null and empty texts have no features and weight 0. Rows that repeat an id share its random
    number and count each; of rows equal in everything as many are drawn as the cutoff leaves room for. Empty tables: an
    empty target is counted as such, an empty ``docs`` gives no rows. Texts are read whole, whatever their length; extra columns are ignored.
    """
    configure(docs.sparkSession)
    plain = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    raw = bucket_counts(plain.select("text"), run, buckets)
    gains = bucket_gains(raw, bucket_counts(target.select(quoted(target_col).cast("string").alias("text")), run, buckets))
    keyed = weighed(plain, gains, run).withColumn("score", F.col("weight") + gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed))
    # Keys in rising order: best score first, then ids, none last; ``row`` tells rows apart that are equal otherwise.
    keyed = written(keyed.withColumn("row", F.monotonically_increasing_id()).withColumn("enters", F.col("n_words") >= least_words), "resample-scored")
    columns = ["down", "no_id", "id", "n_features", "row"]
    keys = [(-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("bigint").alias("no_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id")]
    rated = keyed.select("*", *keys)
    drawn = keyed.filter("enters").count() * percent // 100
    result = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return rated.select(*result, F.lit(None).cast("bigint").alias("rank"))
    cut = kth_row(written(rated.filter("enters").select(*columns), "resample-keys"), columns, drawn)
    wins = F.col("enters") & ~between(columns, cut, None)
    ranked = numbered(rated.filter(wins).select(*result, *columns[:3], "row"), [], [*columns[:3], "n_features", "row"], name="resample-winners")
    losers = rated.filter(~wins).select(*result, F.lit(None).cast("bigint").alias("rank"))
    return losers.unionByName(ranked.select(*result, (F.col("number") + 1).alias("rank")))
