"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in an order of hashes, form a line of words that is cut into blocks of so many words. A
source's target is a number of words, hence of blocks: whole passes over all its blocks and a part of a last one, whose
last block is cut to the word. All blocks drawn are split among the output shards: a node of the tree knows how many
blocks of every source its shards hold, and its left half draws its own from these without replacement, by the
multivariate hypergeometric law, so that every shard's quotas are those of a uniform shuffle and add up exactly.
Blocks are drawn in the order of a keyed permutation, computed for each block by itself; a shard takes the next so many
of every source, which makes its draws disjoint from all others, and orders them by a hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taxatrend.llm.common import configure, map_arrow, quoted, whole_text, written
from taxatrend.llm.numbering import numbered

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words of a block, blocks of an output shard, and shards that one step of the tree gives a node at most.
BLOCK, SHARD, FAN = 512, 4096, 256
#: numpy draws from fewer blocks than this; more are drawn in runs of blocks first.
LARGEST = 500_000_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed_bits(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(block: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each block, 0 to n - 1, in the permutation of its key: a Feistel network over the next power of four, walked until below n."""
    half = (np.frexp(np.maximum(n - 1, 1).astype(float))[1] + 1) // 2
    shift, mask = half.astype(np.uint64), ((np.uint64(1) << half.astype(np.uint64)) - np.uint64(1))
    key, out = key.astype(np.int64).view(np.uint64), block.astype(np.int64).view(np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift[walking], out[walking] & mask[walking]
        for step in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mixed_bits(right + key[walking] * np.uint64(2 * step + 3)) & mask[walking])
        out[walking] = (left << shift[walking]) | right
        walking = walking[out[walking] >= n[walking].astype(np.uint64)]
    return out.astype(np.int64)


def pass_key(source_key: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed_bits(source_key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (turn.astype(np.uint64) + np.uint64(seed + 1))).view(np.int64)


def draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` blocks drawn without replacement are of each kind."""
    total = int(counts.sum())
    if total < LARGEST:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    # Runs of blocks are drawn whole, then single blocks of what is over; a run is broken up where those do not suffice.
    unit = total // (LARGEST // 2) + 1
    runs, single = counts // unit, counts % unit
    while (rest := n - (taken := min(n // unit, int(runs.sum()))) * unit) > int(single.sum()):
        broken = draw(rng, runs, 1)
        runs, single = runs - broken, single + broken * unit
    return draw(rng, runs, taken) * unit + draw(rng, single, rest)


def capacity(first: int, shards: int, blocks: int, of: int) -> int:
    """Blocks in the ``shards`` from ``first`` on, when ``blocks`` are dealt evenly to ``of`` shards."""
    return shards * (blocks // of) + max(0, min(shards, blocks % of - first))


def split_node(first: int, shards: int, counts: np.ndarray, starts: np.ndarray, blocks: int, of: int, fan: int, seed: int) -> list[tuple]:
    """The node's descendants, ``fan`` at most: (first shard, shards, blocks of every source, where these begin among the source's draws)."""
    if shards == 1 or fan == 1:
        return [(first, shards, counts, starts)]
    half = shards // 2
    left = draw(np.random.default_rng([seed, first, shards]), counts, capacity(first, half, blocks, of))
    return split_node(first, half, left, starts, blocks, of, fan // 2, seed) + split_node(first + half, shards - half, counts - left, starts + left, blocks, of, fan // 2, seed)


def split_quotas(quotas: DataFrame, blocks: int, of: int, fan: int = FAN, seed: int = 0) -> DataFrame:
    """``quotas`` (source_no from 0 without gaps, quota) -> (shard, source_no, start, n), n > 0, for ``of`` shards.

    Every step expands all nodes at once, each in its own row. A row holds one number for every source, so the memory of a task grows with
    the number of sources alone: eight megabytes for a million.
    """
    kind = "first bigint, shards bigint, counts array<bigint>, starts array<bigint>"
    listed = F.transform(F.array_sort(F.collect_list(F.struct("source_no", "quota"))), lambda s: s["quota"])
    nodes = quotas.agg(listed.alias("counts")).select(F.lit(0).cast("bigint").alias("first"), F.lit(of).cast("bigint").alias("shards"), "counts", F.transform("counts", lambda c: F.lit(0).cast("bigint")).alias("starts"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                made = split_node(row[0], row[1], np.array(row[2], np.int64), np.array(row[3], np.int64), blocks, of, fan, seed)
                for at in range(0, len(made), 64):
                    part = list(zip(*made[at : at + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])], ["first", "shards", "counts", "starts"])

    widest = of
    while widest > 1:
        nodes, widest = written(map_arrow(nodes.repartition("first"), read, kind), "mix-nodes"), -(-widest // fan)
    each = F.explode(F.arrays_zip("counts", "starts", F.sequence(F.lit(0), F.size("counts") - 1).alias("source_no"))).alias("e")
    return nodes.filter(F.size("counts") > 0).select(F.col("first").alias("shard"), each).select("shard", F.col("e.source_no").cast("bigint").alias("source_no"), F.col("e.starts").alias("start"), F.col("e.counts").alias("n")).filter("n > 0")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources`` (source_size, weight; written) with ``target``: shares of ``share`` times all words by weight, none above ``most`` times its source.

    What is cut off is shared again by weight until no source is above; every round is one sum over the sources.
    """
    limit = F.col("source_size") * F.lit(most)
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.sum("weight")).first()
    left, by, known = total * share, weights, 0
    own = lambda: (F.lit(left) * F.col("weight") / F.lit(by)) if by else F.lit(0.0)
    while True:
        full = (own() > limit) if by else F.lit(True)
        n, held, rest = sources.agg(F.sum(full.cast("int")), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if not n or n <= known:
            break
        left, by, known = total * share - held, rest or 0.0, n
    return sources.withColumn("target", F.when(full, limit).otherwise(own()) if known else own())


def drawn_blocks(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """``sources`` with ``blocks`` of the source, ``passes`` over all of them, ``more`` blocks of the next pass, the words ``last`` of its last one, and ``quota``, all blocks drawn."""
    wanted = F.floor(F.col("target") + 0.5)
    some = F.col("source_size") > 0
    plain = sources.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("rest", F.when(some, wanted % F.col("source_size")).otherwise(0))
    plain = plain.withColumn("passes", F.when(some, ((wanted - F.col("rest")) / F.col("source_size")).cast("bigint")).otherwise(0))
    at = {c: plain.columns.index(c) for c in ("source_key", "source_size", "blocks", "passes", "rest")}
    schema = StructType([*plain.schema.fields, *StructType.fromDDL("more bigint, last bigint").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, size, n, passes, rest = (b.column(at[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in at)
            some = n > 0
            place = np.zeros(len(n), np.int64)
            place[some] = permuted(n[some] - 1, n[some], pass_key(key[some], passes[some], seed))
            missing = n * block - size  # words that the source's last block lacks
            more = -(-rest // block)
            more = np.where(some & (place < more), -(-(rest + missing) // block), more)
            before = np.maximum(more - 1, 0)
            last = rest - (before * block - np.where(place < before, missing, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(more), pa.array(np.where(more > 0, last, 0))], schema.names)

    return map_arrow(plain, read, schema).withColumn("quota", F.col("passes") * F.col("blocks") + F.col("more"))


def cut_pieces(lines: DataFrame, block: int, seed: int) -> DataFrame:
    """``lines`` (row, doc_id, source, text_key, at, size, and the columns of the row's source) -> drawn pieces: (source_no, row, doc_id, source, text_key, at, draw, first_word, words)."""
    names = ["source_no", "row", "at", "size", "source_key", "blocks", "passes", "more", "last"]
    own = ["doc_id", "source", "text_key"]
    schema = StructType([*lines.select(*own).schema.fields, *StructType.fromDDL("source_no bigint, row bigint, at bigint, draw bigint, first_word bigint, words bigint").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_rows = {n: b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, n in enumerate(names)}
            # A very long document gives many pieces: rows are taken together up to about a million of these.
            spans = np.where(all_rows["size"] > 0, (all_rows["at"] + all_rows["size"] - 1) // block - all_rows["at"] // block + 1, 0) * (all_rows["passes"] + 1)
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(np.cumsum(spans) // 1_000_000)) + 1):
                c = {n: v[part] for n, v in all_rows.items()}
                count = np.where(c["size"] > 0, (c["at"] + c["size"] - 1) // block - c["at"] // block + 1, 0) * (c["passes"] + 1)
                of = np.repeat(np.arange(len(part)), count)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                c = {n: v[of] for n, v in c.items()}
                turn, number = nth % (c["passes"] + 1), c["at"] // block + nth // (c["passes"] + 1)
                place = permuted(number, c["blocks"], pass_key(c["source_key"], turn, seed))
                end = (number + 1) * block
                partial = turn == c["passes"]
                end = np.where(partial & (place == c["more"] - 1), number * block + c["last"], end)
                start, end = np.maximum(number * block, c["at"]), np.minimum(end, c["at"] + c["size"])
                taken = (~partial | (place < c["more"])) & (end > start)
                out = [c["source_no"], c["row"], c["at"], turn * c["blocks"] + place, start - c["at"], end - start]
                kept_rows = pa.array(part[of[taken]], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(len(names) + i).take(kept_rows) for i in range(len(own))], *[pa.array(x[taken], pa.int64()) for x in out]], schema.names)

    return map_arrow(lines.select(*names, *own), read, schema)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block: int = BLOCK, shard: int = SHARD, fan: int = FAN, seed: int = 2024,
) -> tuple[DataFrame, DataFrame]:
    """Documents and the pieces of them that the mix takes; both are the same in every run, however the table's rows lie.

    The documents: row (a number), doc_id, source, text_key, size (words), source_size, target (of its source, words).
    The pieces: shard, place (from 0 within its shard), source_no, draw, row, doc_id, source, text_key, first_word, words. A shard has ``shard`` blocks of ``block`` words at most.

    Sources in the order of code points, null last, have the ``weights`` in turn; they share ``share`` times all words, none beyond ``most`` times
    its own. A source's pieces add up to its target, rounded. Null and empty texts have no words and no pieces; a null id
    is an id like any other; rows repeated whole are documents of their own. An empty table gives two empty ones. Extra columns are ignored.
    """
    configure(docs.sparkSession)
    text = whole_text(quoted(text_col))
    plain = docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"), F.xxhash64(F.lit(seed), text).alias("text_key"))
    rows = written(plain.withColumn("order", F.xxhash64("text_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    lines = numbered(rows, ["source"], ["order", "doc_id", "text_key", "size", "row"], "size", "mix-lines").withColumnRenamed("before", "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sums = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull().cast("int")), "mix-sums")
    sources = numbered(sums, [], ["none", "source"], name="mix-numbers").select("source", "source_size", F.col("number").alias("source_no"), weight.alias("weight"), F.xxhash64("source").alias("source_key"))
    sources = written(drawn_blocks(targets(written(sources, "mix-sources"), share, most), block, seed), "mix-quotas")
    blocks = sources.agg(F.sum("quota")).first()[0] or 0
    of = max(1, -(-blocks // shard))
    quotas = split_quotas(sources.select("source_no", "quota"), blocks, of, fan, seed)
    known = sources.withColumnRenamed("source", "its")
    docs_out = lines.join(known, F.col("source").eqNullSafe(F.col("its")))
    pieces = cut_pieces(docs_out, block, seed)
    # A shard's draws of a source are an interval; intervals and draws meet in stretches of the mean interval's length.
    step = sources.select("source_no", F.greatest(F.ceil(F.col("quota") / of), F.lit(1)).alias("step"))
    over = lambda c: (c - c % F.col("step")) / F.col("step")
    ranges = quotas.join(step, "source_no").withColumn("stretch", F.explode(F.sequence(over(F.col("start")).cast("bigint"), over(F.col("start") + F.col("n") - 1).cast("bigint")))).drop("step")
    dealt = pieces.join(step, "source_no").withColumn("stretch", over(F.col("draw")).cast("bigint")).drop("step").join(ranges, ["source_no", "stretch"])
    dealt = dealt.filter((F.col("draw") >= F.col("start")) & (F.col("draw") < F.col("start") + F.col("n"))).drop("stretch", "start", "n")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "source_no", "draw"), "source_no", "draw", "at")
    placed = dealt.withColumn("place", (F.row_number().over(shuffled) - 1).cast("bigint"))
    out = written(placed.select("shard", "place", "source_no", "draw", "row", "doc_id", "source", "text_key", "first_word", "words"), "mix-pieces")
    return docs_out.select("row", "doc_id", "source", "text_key", "size", "source_size", "target"), out


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """``documents`` of :func:`mix` with ``taken`` (words, repeats counted), ``pieces`` and ``shards`` that hold some of them."""
    sums = pieces.groupBy("row", "shard").agg(F.sum("words").alias("words"), F.count("*").alias("n")).groupBy("row").agg(F.sum("words").alias("taken"), F.sum("n").alias("pieces"), F.count("*").alias("shards"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return documents.join(sums, "row", "left").select(*documents.columns, *[zero(F.col(c)).alias(c) for c in ("taken", "pieces", "shards")])


def word_chunks(text: str, words: int) -> list[str]:
    """The text from its first word on, cut before every ``words``-th word."""
    starts = [m.start() for m in WORD.finditer(text)][::words]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def mixed_texts(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, seed: int = 2024) -> DataFrame:
    """(shard, place, doc_id, source, first_word, words, text): the pieces of :func:`mix` with their texts, blanks between words as they are.

    Texts are cut into chunks of ``block`` words first, of which a piece meets two at most, so a long text is not repeated for all its pieces.
    """
    text = whole_text(quoted(text_col))
    plain = docs.select(quoted(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(seed), text).alias("text_key"))
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [word_chunks(t, block) for t in b.column(1).to_pylist()]
            of = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), pa.array([k for c in cut for k in range(len(c))], pa.int64()), pa.array([t for c in cut for t in c], pa.string())], ["id", "key", "chunk", "chunk_text"])

    # Copies of a document are one text here; each has its own pieces.
    asked = pieces.select("doc_id", "text_key").distinct().withColumnsRenamed({"doc_id": "i", "text_key": "k"})
    one = plain.join(asked, plain.doc_id.eqNullSafe(F.col("i")) & (plain.text_key == F.col("k")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    chunks = map_arrow(one, read, f"id {kind}, key bigint, chunk bigint, chunk_text string")
    first, last = F.col("first_word"), F.col("first_word") + F.col("words") - 1
    over = lambda c: ((c - c % block) / block).cast("bigint")
    wanted = pieces.withColumn("chunk", F.explode(F.sequence(over(first), over(last))))
    met = wanted.join(chunks, wanted.doc_id.eqNullSafe(F.col("id")) & (wanted.text_key == F.col("key")) & (wanted.chunk == chunks.chunk)).drop(chunks.chunk)
    skip, stop = F.greatest(first - F.col("chunk") * block, F.lit(0)), F.least(last - F.col("chunk") * block + 1, F.lit(block))
    both = met.withColumn("part", cut_words(F.col("chunk_text"), skip, stop)).groupBy("shard", "place", "doc_id", "source", "first_word", "words").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    return both.select("shard", "place", "doc_id", "source", "first_word", "words", F.regexp_replace(F.array_join(F.col("parts.part"), ""), r"[\x20\x09-\x0D]+$", "").alias("text"))


def cut_words(text: Column, skip: Column, stop: Column) -> Column:
    """Words ``skip`` to ``stop`` (exclusive) of a chunk, each with the blanks after it."""
    each = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    return F.array_join(F.slice(each, skip.cast("int") + 1, (stop - skip).cast("int")), "")
