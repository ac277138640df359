"""SentencePiece and packing against the libraries on whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxatrend.llm import common, packing, sentencepiece_codec
from taxatrend.llm.chunk_table import ChunkTable
from taxatrend.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  ", "   x", " a  b ", "▁", "▁▁x ▁", "a▁b", "x ", "\t a\n\n b", "é" * 5, "日本 語", "\0 a\0", "<s> </s>", "<unk> x", "a" * 30000 + " b",
    "\U0001F600 x", "İstanbul ΑΣ Σ", "it's don'T I'LL", "\xa0a b \x85 c", "<|endoftext|> x<|startoftext|>", "é x ́y", "²³ ½ª", "\x1c\x1d a", "ﬁ", "﻿ x", "Dup", "Dup", "w " * 9000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    letters = " ▁aé'sT<|>endoftext日\t\n.́Σ²1\x00\xa0"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return spark.createDataFrame([(i, t, [9], "x", i) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, shard string, `text_to_encode` int")


def test_encode_as_the_library(odd):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in sentencepiece_codec.encode(odd, PIECES).collect()}
    for r in odd.collect():
        want = m.encode(r.text or "", add_eos=True)
        assert (got[r.doc_id].ids, got[r.doc_id].decoded, got[r.doc_id].shard) == (want, m.decode(want), "x")
    assert sentencepiece_codec.encode(odd, PIECES, add_eos=False).filter("doc_id = 1").first().ids == []


def test_decode(odd):
    coded = sentencepiece_codec.encode(odd, PIECES)
    again = sentencepiece_codec.decode(coded.withColumnRenamed("decoded", "first"), PIECES)
    assert again.filter("first != decoded or decoded is null").count() == 0


def test_small_table_starts_anew():
    c = sentencepiece_codec.Codec(PIECES)
    c.table.entries = 2
    for texts in (["a b c d e"], ["c a x  y"], [""], ["b b é"]):
        flat, ends, decoded = c.encode(texts, False)
        assert (flat.tolist(), decoded) == (c.model.encode(texts[0]), texts)


def test_chunk_table_grows():
    t = ChunkTable(lambda chunks: [[int(c)] * (int(c) % 3) for c in chunks])
    rows = t.lookup([[str(i) for i in range(40000)], ["7", "8"], []])
    ids, counts = t.gather(rows[1])
    assert ids.tolist() == [7, 8, 8] and counts.tolist() == [1, 2] and len(rows[2]) == 0


def test_digests(spark):
    got = {r.doc_id: r for r in QUERIES["op1_sentencepiece"](spark, "/root/testdata/sf0.001").collect()}
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = m.encode(d.text or "", add_eos=True), got[d.doc_id]
        want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)


def check_packing(rows, docs, capacity):
    t = Tokenizer.from_file(WORDS)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {d.doc_id for d in docs}
    total = 0
    for d in docs:
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        want = [(k, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity)) for x in [ids[s : s + capacity]]]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[d.doc_id]) == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_packing_of_odd_texts(odd):
    rows = packing.packed_documents(odd, WORDS, capacity=64, keep_ids=True).collect()
    bins, least = check_packing(rows, odd.collect(), 64)
    assert bins <= 1.02 * least + 1
    assert all(len(r.ids) == r.length for r in rows)


def test_packing_over_several_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(packing.tokenise(docs, WORDS, keep_ids=False), shard_pieces=100).collect()
    bins, least = check_packing(rows, docs.collect(), 4096)
    assert bins <= 1.03 * least + 1


def test_packing_of_rows_without_or_with_one_id(spark):
    """Rows that share an id, or have none, are dealt over all shards, and each is a piece."""
    rows = [(None, 0, 0, 100 + i % 50, 7) for i in range(2000)] + [(5, 0, 0, 100 + i % 50, 7) for i in range(2000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    got = packing.pack(pieces, 4096, shard_pieces=250).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == sorted((r[0] or 0, r[3]) for r in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(bins) <= 1.02 * sum(r[3] for r in rows) / 4096 + 2
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    shards = {(s >> 32) & 0xFFFFFF for s in bins if s >> 56 == 0}
    assert len(shards) >= 14


def test_pieces_that_do_not_fit_together_move_on_nowhere(spark):
    pieces = spark.range(6000).select("id", F.lit(0).alias("piece"), (F.lit(2100) + F.col("id") * 7919 % 1800).alias("length")).withColumnRenamed("id", "doc_id")
    got = packing.pack(pieces, 4096, shard_pieces=500).collect()
    assert len({r.sequence_id for r in got}) == 6000 and {r.sequence_id >> 56 for r in got} == {0}


def test_packing_of_nothing(spark, odd):
    assert packing.packed_documents(odd.filter("doc_id < 0"), WORDS).columns[-2:] == ["sequence_id", "offset"]
    assert packing.packed_documents(odd.filter("doc_id < 0"), WORDS).count() == 0
    assert sentencepiece_codec.encode(odd.filter("doc_id < 0"), PIECES).count() == 0


def test_sum_of_squares_by_hand():
    bins, places = packing.sum_of_squares(np.array([6, 6, 4, 4, 10, 3]), 10)
    assert bins.tolist() == [0, 1, 1, 0, 2, 3] and places.tolist() == [0, 0, 6, 6, 0, 0]


def test_word_tables_of_a_worker_are_bounded():
    letters = "abcdefghijklmnopqrst"
    name = lambda n: "".join(letters[n // 20**k % 20] for k in range(5))
    words = packing.Words(WORDS)
    for at in range(0, 300_000, 30_000):
        texts = [" ".join(name(n) + "." * (n % 2) for n in range(at + k, at + k + 3000)) for k in range(0, 30_000, 3000)]
        ids, counts = words.encode(texts)
        assert len(words.parts) <= packing.WORDS and len(words.table.rows) <= packing.WORDS + 30_000
    again, sizes = packing.Words(WORDS).encode(texts)
    assert np.array_equal(ids, again) and np.array_equal(counts, sizes)


def test_a_worker_drops_what_its_tasks_no_longer_use(monkeypatch):
    monkeypatch.setattr(common, "KEPT", {})
    monkeypatch.setattr(common, "UNUSED", {})
    common.kept("of an earlier operator", dict)
    for n in range(10):
        assert common.kept("used", list) is common.kept("used", dict)
        common.task_ended()
        assert ("of an earlier operator" in common.KEPT) == (n < common.IDLE_TASKS)
    assert list(common.KEPT) == ["used"]
