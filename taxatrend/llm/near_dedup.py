"""Near-duplicate documents: five-word shingles shared to 0.8 or more, found by SimHash fingerprints.

At a similarity of 0.8 the fingerprints of whole documents differ in about ten of 64 bits, too many for an equi-join. So
each document also has SimHash fingerprints of a few samples of its shingles (the three with the smallest hashes in each
of eight orders): near copies agree in at least one of eight with a probability of 0.997 at similarity 0.8, more above.
Documents that agree in one, and those whose whole fingerprints are linked at two bits, are candidates. Where many
documents agree in a sample, they meet a few of it, and those still in different groups meet over prefixes of their rarest
shingles, which miss no similar pair. All fingerprints are of the different shingles, as the similarity is. Sizes prune candidates, which loses none; the exact similarity of the
shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxatrend.llm import simhash
from taxatrend.llm.common import configure, fresh, map_arrow, quoted, whole_text, written
from taxatrend.llm.components import components
from taxatrend.llm.exact_dedup import split_by_filter

WORDS, SIMILARITY = 5, 0.8
ORDERS, SAMPLED = 8, 3
MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * g + 1)) % (1 << 64) | 1 for g in range(ORDERS)], np.uint64)
#: Candidates that agree in a sample meet in pairs up to this number; beyond it each meets the HUBS of the sample, and then all others that are not yet in its group over rare shingles.
PAIRED, HUBS = 48, 6
#: Shingles are ordered by the counts of so many slots; longs of parity bits, a power of two.
SLOTS, PARITY = 1 << 20, 8


def sketch(text: str, words: int) -> tuple[int, int, list[int], int]:
    """Number of different shingles, whole fingerprint, one fingerprint for each sample, and a hash of the set."""
    u = np.unique(simhash.shingle_hashes(text, words))
    samples = []
    for m in MULTIPLIERS:
        with np.errstate(over="ignore"):
            mixed = u * m
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.argpartition(mixed, SAMPLED)[:SAMPLED] if len(u) > SAMPLED else slice(None)
        # A sample's shingles are hashed anew, as the small hashes of one order share their high bits.
        samples.append(simhash.fingerprint_of(mixed[least] * np.uint64(0x94D049BB133111EB)))
    return len(u), simhash.fingerprint_of(u), samples, xxhash.xxh64_intdigest(u.astype("<u8").tobytes()) - (1 << 63)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64())), pa.array([f[3] for f in found], pa.int64())],
                ["doc_id", "size", "fp", "samples", "shingle_key"],
            )

    return map_arrow(docs, read, f"doc_id {kind}, size bigint, fp bigint, samples array<bigint>, shingle_key bigint")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): the different shingles, as the low 32 bits of their hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(simhash.shingle_hashes(t, words).astype(np.uint32)).view(np.int32) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *sets]), pa.int32()))], ["doc_id", "shingles"])

    return map_arrow(docs, read, f"doc_id {kind}, shingles array<int>")


def may_be_similar(similarity: float) -> Column:
    """Whether the sizes of a and b allow the similarity."""
    return F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * F.lit(similarity)


def candidates(sketched: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Different pairs (a, b), a < b, that may be similar, and the documents (doc_id) of crowded samples.

    In a crowded sample only HUBS members are paired with all others. This joins most of a family of near copies, so that
    ``links_between`` has little left to find; it stands for no pair that is not met.
    """
    one = sketched.select("doc_id", "size", "shingle_key", F.posexplode("samples").alias("g", "sample"))
    crowded = one.groupBy("g", "sample").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(one.join(crowded, ["g", "sample"]), "near-buckets")
    side = lambda df, s: df.select("g", "sample", F.col("doc_id").alias(s), F.col("size").alias(f"{s}_size"))
    few, many = shared.filter(F.col("members") <= PAIRED), shared.filter(F.col("members") > PAIRED)
    rank = F.row_number().over(Window.partitionBy("g", "sample").orderBy(F.xxhash64("g", "doc_id"), "doc_id"))
    hubs = written(many.withColumn("rank", rank).filter(F.col("rank") <= HUBS).drop("rank"), "near-hubs")
    pairs = side(few, "a").join(side(few, "b"), ["g", "sample"]).filter(F.col("a") < F.col("b"))
    to_hubs = side(many, "a").join(side(hubs, "b"), ["g", "sample"]).filter(F.col("a") != F.col("b"))
    met = pairs.unionByName(to_hubs).filter(may_be_similar(similarity)).select("a", "b")
    # Whole fingerprints linked at two bits: each fingerprint stands for its smallest id, to which its others are linked.
    nodes = written(sketched.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), "near-nodes")
    by_fp = simhash.links(nodes.select("fp")).toDF("x", "y")
    first = nodes.select("fp", "first")
    linked = by_fp.join(first.toDF("x", "a"), "x").join(first.toDF("y", "b"), "y").select("a", "b")
    same = sketched.join(nodes.filter("members > 1").select("fp", "first"), "fp").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    # Equal shingle sets are linked to the smallest id, which alone meets others in place of a crowded sample.
    sets = written(sketched.groupBy("shingle_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), "near-equal")
    equal = sketched.join(sets.filter("members > 1"), "shingle_key").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    every = met.unionByName(linked).unionByName(same).unionByName(equal).filter("a != b")
    alone = many.select("shingle_key").distinct().join(sets, "shingle_key").select(F.col("first").alias("doc_id")).distinct()
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), alone


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of the ``wanted`` documents (doc_id, written); only their texts move."""
    asked, _ = split_by_filter(docs, "doc_id", wanted)
    return written(written(shingle_sets(asked.join(wanted, "doc_id", "left_semi").select(docs.columns), words), "near-sets").dropDuplicates(["doc_id"]), "near-one-set")


def verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b; written) whose shingle sets are similar."""
    wanted = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near-wanted")
    sets = sets_of(docs, wanted, words)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - common
    return both.filter((whole == 0) | (common >= whole * F.lit(similarity))).select("a", "b")


def slots(shingles: np.ndarray) -> np.ndarray:
    return shingles.view(np.uint32) & np.uint32(SLOTS - 1)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur in ``sets``; at most SLOTS numbers, however many shingles there are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(slots(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)), minlength=SLOTS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)], pa.int64()), pa.array(total[at[k : k + (1 << 16)]], pa.int64())], ["slot", "n"])

    found = map_arrow(sets, read, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefixes(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(shingle, doc_id, place, size, short): the rarest shingles of each set, in one order for all, by which any similar set is met.

    Two sets that overlap in o shingles have the first common one, in any order, at a place of at most size - o in each.
    At the similarity o is at least similarity * size of the larger set, and 2 * similarity / (1 + similarity) * size of
    the smaller: its places, the ``short`` prefix, are fewer. Shingles alone in their slot are in no other set.
    """
    kind = sets.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts = [], []
            for at, shingles in enumerate(b.column(1)):
                u = shingles.values.to_numpy(zero_copy_only=False).astype(np.int32)
                often = counts[slots(u)]
                order = np.lexsort((u, often))[: int((1 - similarity) * len(u) + 1e-6) + 1]
                place = np.flatnonzero(often[order] > 1)
                short = place <= int((1 - similarity) / (1 + similarity) * len(u) + 1e-6)
                ids.append(np.full(len(place), at))
                parts.append((u[order[place]], place, np.full(len(place), len(u)), short))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0)] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            shingle, place, size, short = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)]
            owner = b.column(0).take(pa.array(np.concatenate(ids) if ids else np.empty(0, int), pa.int64()))
            yield pa.RecordBatch.from_arrays([shingle, owner, place, size, short], ["shingle", "doc_id", "place", "size", "short"])

    return map_arrow(sets, read, f"shingle int, doc_id {kind}, place bigint, size bigint, short boolean")


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY longs whose bits say of each of as many bins whether it holds an odd number of the shingles.

    Two sets' bits differ only where a shingle is in one of them alone, so they differ in at most as many bits as the sets in shingles.
    """
    mixed = shingles.view(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - 6 - PARITY.bit_length() + 1)
    odd = np.bincount(mixed, minlength=64 * PARITY).astype(np.uint64) & np.uint64(1)
    return (odd.reshape(PARITY, 64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def parities(sets: DataFrame) -> DataFrame:
    """(doc_id, p0, p1, ...) of ``sets``."""
    kind = sets.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([parity(x.values.to_numpy(zero_copy_only=False).astype(np.int32)) for x in b.column(1)], np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in found.T]], ["doc_id", *[f"p{i}" for i in range(PARITY)]])

    return map_arrow(sets, read, ", ".join([f"doc_id {kind}", *[f"p{i} bigint" for i in range(PARITY)]]))


def side_of(postings: DataFrame, s: str) -> DataFrame:
    return postings.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in postings.columns if c not in ("shingle", "short")])


def possible(similarity: float) -> Column:
    """Whether postings a and b, of different groups, may be of similar sets: by sizes, by what can still be common after the two places, and by parities."""
    both = F.col("a_size") + F.col("b_size")
    overlap = both * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    apart = sum((F.bit_count(F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}"))) for i in range(PARITY)), F.lit(0))
    room = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) >= overlap
    return (F.col("a_root") != F.col("b_root")) & may_be_similar(similarity) & room & (apart <= both * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6))


def mixed_only(postings: DataFrame) -> DataFrame:
    """Postings of shingles that members of several groups share."""
    several = postings.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("shingle")
    return postings.join(several, "shingle")


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct()


def links_between(docs: DataFrame, members: DataFrame, links: DataFrame, words: int, similarity: float) -> list[DataFrame]:
    """More links (a, b) among ``members`` (doc_id, written), in different groups of ``links``: with both, the groups are those of all similar pairs.

    Members meet over their rarest shingles. In each round all that share a shingle meet one of them, first the one with most shared
    shingles, which is what variants have been made of, then others; what is linked is one group from then on. Rounds go on while
    they join a tenth of the groups left, and cost a row for each posting. Then all pairs of different groups meet that may be similar.
    """
    sets = written(sets_of(docs, members, words), "near-crowd")
    roots = written(components(links), "near-roots").toDF("doc_id", "root")
    posted = prefixes(sets, slot_counts(sets), similarity).join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    left = written(mixed_only(written(posted, "near-postings")).join(parities(sets), "doc_id"), "near-mixed")
    found: list[DataFrame] = []
    while True:
        turn, apart = len(found), left.select("root").distinct().count()
        if apart < 2:
            return found
        shared = left.groupBy("doc_id").agg(F.count("*").alias("shared"))
        rank = F.struct("shared", "doc_id") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "doc_id"), "doc_id")
        ranked = left.join(shared, "doc_id") if turn == 0 else left
        columns = [c for c in left.columns if c not in ("shingle", "short")]
        hubs = ranked.groupBy("shingle").agg(F.max_by(F.struct(*columns), rank).alias("hub")).select("shingle", "hub.*")
        met = side_of(left, "a").join(side_of(hubs, "b"), "shingle").filter(possible(similarity))
        links = written(verified(docs, written(in_order(met), "near-hub-pairs"), words, similarity), "near-hub-links")
        known = left.select("doc_id", "root").distinct()
        between = links.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select("x", "y")
        merged = written(components(written(between, "near-contracted")), "near-merged").toDF("root", "into")
        joins = merged.filter("root != into").count()
        if joins:
            found.append(links)
            left = left.join(merged, "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into").select(left.columns)
            left = written(mixed_only(written(left, "near-postings")), "near-mixed")
        if joins * 10 < apart:
            break
    met = side_of(left, "a").join(side_of(left.filter("short"), "b"), "shingle").filter("a_doc_id != b_doc_id AND b_size <= a_size").filter(possible(similarity))
    return [*found, written(verified(docs, written(in_order(met), "near-between"), words, similarity), "near-more")]


def similar_pairs(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of ``docs`` (doc_id, text) whose shingle sets have the Jaccard similarity or more.

    Of the members of crowded samples only as many pairs are given as join their groups.
    """
    sketched = written(sketches(docs, words), "near-sketches")
    pairs, crowd = candidates(sketched, similarity)
    links = verified(docs, written(pairs, "near-pairs"), words, similarity)
    crowd = written(crowd, "near-crowded")
    if crowd.isEmpty():
        return links
    links = written(links, "near-met")
    for more in links_between(docs, crowd, links, words, similarity):
        links = links.unionByName(more)
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document with a link: doc_id, component_id (smallest id of its group), links (pairs found with it).

    Links are verified exactly, so no document is grouped wrongly; a pair that agrees in no sample (three in a thousand
    at the threshold, fewer above) can be missed. Documents with fewer words
    are one shingle; those without any word are all alike. Null text counts as empty, a null id takes no part, rows that
    repeat an id are told apart by nothing. Extra columns are ignored.
    """
    configure(docs.sparkSession)
    plain = docs.select(quoted(id_col).alias("doc_id"), whole_text(quoted(text_col)).alias("text")).filter(F.col("doc_id").isNotNull())
    pairs = written(similar_pairs(plain, words, similarity), "near-links")
    groups = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return groups.join(degree, "node").select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"), "links")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, less every document with a smaller id in its group."""
    (gone,) = fresh(docs, "gone")
    out = near_groups(docs, id_col, text_col, words, similarity).filter("doc_id != component_id").select(F.col("doc_id").alias(gone))
    listed = written(out, "near-gone")
    maybe, staying = split_by_filter(docs, id_col, listed)
    return staying.unionByName(maybe.join(listed, quoted(id_col) == F.col(gone), "left_anti"))
