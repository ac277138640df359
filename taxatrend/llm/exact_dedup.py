"""Exact deduplication: two passes over a Bloom filter of fixed size, native expressions only.

The first pass hashes every normalised text and counts hits of filter slots; slots hit more than once make the second
filter. In the second pass a row whose slots are all in it is possibly repeated and goes to the shuffles that decide;
every other row is known to be unique and passes straight through. The filter's size has a fixed upper bound, whatever
the input, so that it can be broadcast; a full filter sends more rows to the exact shuffles and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatrend.llm.common import fresh, quoted, whole_text, written

#: Filter slots per row, and the largest filter: 2^24 slots per hash function, 16 bytes for every 64 of them.
SLOTS_PER_ROW = 16
MAX_SLOT_BITS = 24


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 after each run of ASCII white space became one space; null counts as empty."""
    return F.sha2(F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " "), 256)


def slot_bits(rows: int, limit: int = MAX_SLOT_BITS) -> int:
    return max(10, min(limit, (max(rows, 1) * SLOTS_PER_ROW - 1).bit_length()))


def slots(digest: Column, bits: int) -> list[Column]:
    """The row's slot for each of the two hash functions: disjoint bits of one 64-bit hash."""
    h = F.xxhash64(digest)
    mask = F.lit((1 << bits) - 1).cast("long")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def repeated_slots(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """(f, word, hit): for hash function f, the slots hit more than once, 64 to a word. At most 2 * 2^bits / 64 rows."""
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), s.alias("slot")) for f, s in enumerate(slots(quoted(digest), bits))])).alias("s")
    twice = digests.select(both).select("s.f", "s.slot").groupBy("f", "slot").agg(F.count("*").alias("n")).filter("n > 1")
    return words_of(twice)


def words_of(slots_hit: DataFrame) -> DataFrame:
    bit = F.expr("shiftleft(1L, int(slot % 64))")
    return slots_hit.groupBy("f", F.expr("slot div 64").alias("word")).agg(F.bit_or(bit).alias("hit"))


def split_by_filter(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose key may be in ``keys`` (one column, written), and rows whose key is surely not.

    The same filter of bounded size as above, here of all keys: only the first part, little more than the matches, need
    be shuffled to meet them.
    """
    (k,), (flag,) = keys.columns, fresh(df, "may_match")
    bits = slot_bits(keys.count())
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), s.alias("slot")) for f, s in enumerate(slots(quoted(k), bits))])).alias("s")
    filters = written(words_of(keys.select(both).select("s.f", "s.slot")), "key-filter")
    flagged = with_suspicion(df, key, filters, bits, flag)
    return flagged.filter(F.col(flag)).drop(flag), flagged.filter(~F.col(flag)).drop(flag)


def with_suspicion(df: DataFrame, digest: str, filters: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add ``flag``: true where both slots of the row are in the filter. ``filters`` is broadcast: its size is bounded."""
    names = fresh(df, "w0", "w1", "h0", "h1")
    out, hits = df, []
    for f, s in enumerate(slots(quoted(digest), bits)):
        word, hit = names[f], names[2 + f]
        part = filters.filter(F.col("f") == f).select(F.col("word").alias(word), F.col("hit").alias(hit))
        out = out.join(F.broadcast(part), F.shiftright(s, 6) == F.col(word), "left")
        at = s.bitwiseAND(F.lit(63).cast("long")).cast("int")
        hits.append(F.coalesce(F.call_function("shiftrightunsigned", F.col(hit), at).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False)))
    return out.withColumn(flag, hits[0] & hits[1]).drop(*names)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256; only possibly repeated hashes shuffle.

    Of equal texts the row with the smallest id stays. Null text counts as empty, which is a text like any other.
    Every row gives a row and counts, those that repeat another whole included; rows that repeat the id and text of the one that stays are kept
    with it, as they are that document. An id with two texts is in two groups. A null id ranks after all others and stays only if its whole group has none.
    Extra columns are ignored. An empty table gives an empty table.
    """
    keys = written(docs.select(quoted(id_col).alias("doc_id"), text_digest(quoted(text_col)).alias("text_sha256")), "dedup-keys")
    bits = slot_bits(keys.count())
    filters = written(repeated_slots(keys, "text_sha256", bits), "dedup-filter")
    flagged = with_suspicion(keys, "text_sha256", filters, bits, "suspect")
    one = F.lit(1).cast("long")
    alone = flagged.filter(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # Only texts that do repeat are met again; their groups are written, so that a group of any size can be split over tasks.
    suspects = flagged.filter("suspect")
    repeated = suspects.groupBy("text_sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    groups = written(repeated, "dedup-groups")
    keep = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("keep_id")
    met = suspects.join(groups, "text_sha256", "left").select("doc_id", keep, F.coalesce("rows", one).alias("group_size"), "text_sha256")
    return alone.unionByName(met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, less every row whose text an earlier id already has.

    Rows that no other can equal pass straight through with their texts; of the others only (digest, id) is grouped,
    and texts move for possibly repeated rows alone. Rows that repeat the id and text of the row that stays are one
    document: one of them stays. Null texts and ids as in :func:`exact_groups`.
    """
    digest, flag, keep = fresh(docs, "digest", "suspect", "keep")
    fat = docs.withColumn(digest, text_digest(quoted(text_col)))
    keys = written(fat.select(quoted(digest).alias("d"), quoted(id_col).alias("i")), "dedup-keys")
    bits = slot_bits(keys.count())
    filters = written(repeated_slots(keys, "d", bits), "dedup-filter")
    flagged = with_suspicion(fat, digest, filters, bits, flag)
    alone = flagged.filter(~F.col(flag)).drop(digest, flag)
    met = with_suspicion(keys, "d", filters, bits, "s").filter("s").groupBy("d").agg(F.min("i").alias(keep)).withColumnRenamed("d", digest)
    staying = flagged.filter(F.col(flag)).drop(flag).join(met, digest).filter(quoted(id_col).eqNullSafe(F.col(keep)))
    return alone.unionByName(staying.dropDuplicates([digest]).drop(digest, keep))
