"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

Documents become pieces (only those longer than a sequence are cut). Pieces are dealt by hash to shards of bounded size;
a shard places its pieces, longest first, each into the open bin whose gap makes the sum over gaps of the squared number
of open bins with that gap smallest. Bins that a shard leaves open beyond a small gap are opened again and their pieces
packed with those of other shards, until one shard is left: what remains partly filled is then a few bins in all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from taxatrend.llm.chunk_table import ChunkTable
from taxatrend.llm.common import configure, fresh, kept, map_arrow, quoted, whole_text, written

CAPACITY = 4096
END_ID = 1
#: Pieces that a shard packs at once, on average.
SHARD_PIECES = 20_000
#: A bin with a larger gap is opened again in the next round, where it can still be filled.
OPEN_GAP = 64

#: Latin-1 letters, numbers and white space as Unicode has them: fixed values of the tokenizer's split.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
#: Latin-1 without control characters and odd spaces: here lower-casing and normal forms act on each character alone, and
#: white space is that of ASCII.
PLAIN = re.compile("[\t-\r -~¡-¬®-ÿ]*")
SPECIAL = "<|"
ENDS = frozenset(".,;:!?")
RAW = "\0"
#: Different words, and different parts of words, that a worker holds before it starts anew; both tables together take about 100 MB.
WORDS = 100_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Ids of white-space separated words, as the tokenizer gives them for a whole text.

    Its split never crosses white space, so words are independent. Words of plain texts are lower-cased and their parts go
    straight to the tokenizer's model, each distinct part once; words of any other text go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.parts: dict[str, list[int]] = {}
        self.table = ChunkTable(self._encode, WORDS)

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            alphabet = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(alphabet)]
            if len(self.parts) >= WORDS:
                self.parts.clear()
            if len(part) < 100:
                self.parts[part] = ids
        return ids

    def _encode(self, words: list[str]) -> list[list[int]]:
        part, found = self._part, []
        for w in words:
            if w.isalpha():
                found.append(part(w))
            elif w[:1] == RAW:
                found.append(self.tokenizer.encode(w[1:], add_special_tokens=False).ids)
            elif w and w[-1] in ENDS and w[:-1].isalpha():
                found.append(part(w[:-1]) + part(w[-1]))
            else:
                found.append([i for p in SPLIT.findall(w) for i in part(p)])
        return found

    @staticmethod
    def words(text: str) -> list[str]:
        """Lower-cased words of a plain text, or marked words of any other."""
        return text.lower().split() if PLAIN.fullmatch(text) and SPECIAL not in text else [RAW + w for w in re.split("[\t-\r ]+", text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        rows = self.table.lookup(self.words(t) for t in texts)
        flat, counts = self.table.gather(np.concatenate(rows) if rows else np.empty(0, np.int64))
        words = np.cumsum([len(r) for r in rows], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])[words] if len(rows) else np.empty(0, np.int64)
        return flat, np.diff(ends, prepend=0)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if kept, ids (array<int>).

    A document is its ids and one end id; null text counts as empty (the end id alone). A document longer than
    ``capacity`` is cut into pieces of ``capacity``, the last may be shorter. Rows that repeat an id, or have none, are documents of their own. Extra columns are ignored.
    """
    configure(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("doc_id"), whole_text(quoted(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words", tokenizer), lambda: Words(tokenizer))
        for b in batches:
            flat, counts = words.encode(b.column(1).to_pylist())
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            row, piece, start, length, crc, at = [], [], [], [], [], []
            begin = 0
            for r, end in enumerate(ends.tolist()):
                for s in range(0, end - begin, capacity):
                    n = min(capacity, end - begin - s)
                    row.append(r), piece.append(s // capacity), start.append(s), length.append(n), at.append(begin + s)
                    crc.append(zlib.crc32(flat[begin + s : begin + s + n].tobytes()))
                begin = end
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array([*at, len(flat)], pa.int32()), pa.array(flat.astype(np.int32), pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(rows, read, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each length, in the given order, by the sum-of-squares rule.

    Placing s into a bin of gap h takes the bin from count n[h] to count n[h - s]: the sum of squares changes by
    2 * (n[h - s] - n[h]) + 2, or 1 - 2 * n[h] for a bin that becomes full; a new bin adds 2 * n[capacity - s] + 1.
    Of equal changes the smallest gap wins, a new bin last.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        if s >= capacity:
            bins[k], places[k], made = made, 0, made + 1
            continue
        have = n[s:capacity]
        change = np.where(have > 0, 2 * (n[: capacity - s] - have) + 2, np.iinfo(np.int64).max)
        if have[0]:
            change[0] = 1 - 2 * have[0]
        h = int(change.argmin())
        if have[h] and change[h] <= 2 * n[capacity - s] + 1:
            gap = s + h
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[k], places[k] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            n[gap - s] += 1
    return bins, places


def placer(level: int, capacity: int, order: list[str]):
    """The packing of one shard: sequence, place and the gap that is left in the sequence."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["length"].max() > capacity:
            raise ValueError("a piece is longer than a sequence")
        pdf = pdf.sort_values(["length", "doc_id", "piece", *order], ascending=[False, True, True, *[True] * len(order)], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, places = sum_of_squares(lengths, capacity)
        first = (level << 56) | (int(pdf["shard"].iloc[0]) << 32)  # shards and levels never share a number
        pdf["sequence_id"], pdf["offset"] = first + bins, places
        pdf["gap_left"] = capacity - np.bincount(bins, lengths).astype(np.int64)[bins]
        return pdf.drop(columns="shard")

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with ``sequence_id`` and ``offset``: gapless from 0 in every sequence.

    Of equal lengths the smaller doc_id and piece is placed first, null ids last; rows that repeat an id, or have none, are pieces of their own, dealt to
    shards by the row they are. A piece of the full length fills a sequence alone. A length beyond ``capacity`` raises. An empty table stays empty.

    Of a level's sequences those are opened again that have a gap of over OPEN_GAP and into which the shortest piece of them all would fit: where no two pieces
    fit together, nothing moves on, and no shard grows by it.
    """
    kind = pieces.schema
    (row,) = fresh(pieces, "packed_row")
    left, done, level = written(pieces.withColumn(row, F.monotonically_increasing_id()), "packing-pieces"), [], 0
    out = StructType([*left.schema.fields, *[StructField(c, LongType()) for c in ("sequence_id", "offset", "gap_left")]])
    total = left.count()
    while total:
        shards = max(1, -(-total // shard_pieces))
        if shards >= 1 << 24:
            raise ValueError("more than 2^24 shards: raise shard_pieces")
        shard = F.pmod(F.xxhash64(row, F.lit(level)), F.lit(shards)).alias("shard")
        placed = written(left.select("*", shard).groupBy("shard").applyInPandas(placer(level, capacity, [row]), out), "packing-level")
        loose = F.col("gap_left") > OPEN_GAP
        shortest = placed.filter(loose).agg(F.min("length")).first()[0] if shards > 1 else None
        again = loose & (F.col("gap_left") >= shortest) if shortest is not None else F.lit(False)
        done.append(placed.filter(~again).select(*kind.names, "sequence_id", "offset"))
        left = placed.filter(again).select(*kind.names, row)
        before, total, level = total, left.count(), level + 1
        if total > 0.9 * before:  # little is won: twice the pieces a shard, half the shards
            shard_pieces *= 2
    if not done:
        return pieces.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).limit(0)
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    return packed


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack: one row per piece with its sequence and place, and its ids if kept."""
    return pack(tokenise(docs, tokenizer, capacity, END_ID, id_col, text_col, keep_ids), capacity)
