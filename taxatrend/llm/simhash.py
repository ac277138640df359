"""SimHash near-duplicate groups with pigeonring filtering.

``fingerprints`` reads whole texts once. ``links`` finds all pairs of fingerprints within a few bits: the 64 bits are
split into five segments on a ring. If two fingerprints differ in at most t bits, then from some segment on every chain
of l consecutive segments differs in at most l * t / 5 bits (for t = 2: none in the first two segments, at most one in
three or four). The first two segments make an equi-join key of 25 or 26 bits, the rest of the chain prunes before the
full Hamming check. A bucket with many different fingerprints is not paired: its members meet at their one-bit
neighbours, of which each has at most 41, and two members of a bucket are within two bits just if they share such a
meeting point. Work per fingerprint is bounded either way, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatrend.llm.common import configure, map_arrow, quoted, whole_text, written
from taxatrend.llm.components import components

SEED = 42
#: First bits of the five segments, and their widths.
STARTS = [0, 13, 26, 39, 52]
WIDTHS = [13, 13, 13, 13, 12]
#: Different fingerprints a bucket may hold before its members meet at their neighbours instead of in pairs.
PAIRED = 48
MAX_BITS = 2


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text's words, A-Z lower-cased, repeats included; a shorter text is one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and just the six ASCII white-space bytes
    if not w:
        return np.empty(0, np.uint64)
    parts = [w] if len(w) < words else zip(*[w[i:] for i in range(words)])
    return np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in parts], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes; 0 without hashes. As a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        rows = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp (bigint). Null text counts as empty; no word gives fingerprint zero."""
    configure(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("doc_id"), whole_text(quoted(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint_of(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(rows, read, f"doc_id {kind}, fp bigint")


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, STARTS[i % 5]).bitwiseAND(F.lit((1 << WIDTHS[i % 5]) - 1).cast("long"))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segment_masks(i: int, n: int) -> int:
    """Bits of the chain of n segments from the i-th on, as a signed long."""
    m = 0
    for k in range(n):
        m |= ((1 << WIDTHS[(i + k) % 5]) - 1) << STARTS[(i + k) % 5]
    return m - (1 << 64) if m >> 63 else m


def within_budget(a: Column, b: Column, start: Column) -> Column:
    """The chain test from segment ``start`` on for two bits: budgets 0, 0, 1, 1, 2 (l * 2 / 5, rounded down)."""
    diff = a.bitwiseXOR(b)
    masks = {n: F.element_at(F.array(*[F.lit(segment_masks(i, n)).cast("long") for i in range(5)]), start + 1) for n in (3, 4)}
    chain = lambda n: F.bit_count(diff.bitwiseAND(masks[n])) <= n * MAX_BITS // 5
    return chain(3) & chain(4) & (F.bit_count(diff) <= MAX_BITS)


def links(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp, all different) -> links (a, b) between fingerprints within two bits.

    In buckets of up to PAIRED members every such pair is listed; in larger ones every member is linked, at each meeting
    point, to the smallest member that meets there. The connected groups are the same.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftleft(segment(F.col("fp"), i), 13).bitwiseOR(segment(F.col("fp"), i + 1)).alias("key")) for i in range(5)])).alias("k")
    bucketed = nodes.select("fp", keys).select("fp", "k.i", "k.key")
    crowded = bucketed.groupBy("i", "key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(bucketed.join(crowded, ["i", "key"]), "simhash-buckets")
    few = shared.filter(F.col("members") <= PAIRED)
    a, b = few.select("i", "key", F.col("fp").alias("a")), few.select("i", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["i", "key"]).filter(F.col("a") < F.col("b")).filter(within_budget(F.col("a"), F.col("b"), F.col("i"))).select("a", "b")
    # Bits outside the bucket's own two segments: a flip of any of them keeps the bucket.
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(bit - (1 << 64) if bit >> 63 else bit).cast("long") for bit in free_bits(i)]) for i in range(5)])
    meeting = shared.filter(F.col("members") > PAIRED).select(
        "i", "fp", F.explode(F.transform(F.element_at(flips, F.col("i") + 1), lambda x: F.col("fp").bitwiseXOR(x))).alias("z")
    )
    met = meeting.groupBy("i", "z").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)  # at most 41: z and its neighbours
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter(F.col("a") != F.col("b"))
    return pairs.unionByName(stars).distinct()


def free_bits(i: int) -> list[int]:
    own = segment_masks(i, 2) & ((1 << 64) - 1)
    return [1 << p for p in range(64) if not own >> p & 1]


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """``fps`` (doc_id, fp) -> doc_id, fp, component_id: the smallest doc_id reachable over links of at most two bits.

    Rows with equal fingerprints are one node, so copies never meet in pairs. A null doc_id takes part in its group and
    is its component_id only if the group has no other.
    """
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    groups = components(written(links(nodes.select("fp")), "simhash-links"))
    rooted = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-groups")
    return fps.join(named, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id. Extra columns are ignored; an empty table gives none."""
    fps = written(fingerprints(docs, id_col, text_col, words), "simhash-fps")
    return fingerprint_groups(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
