"""Mixing: targets by rounds of resharing, draws without overlap, quotas of the shards, texts of the pieces."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from taxatrend.llm import source_mixing
from taxatrend.llm.source_mixing import draw, mix, mixed_texts, permuted, taken_words


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        by = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / by > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / by for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
        left = share * sum(sizes.values()) - sum(out.values())
        if not free:
            return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [(i, None if i % 17 == 0 else "".join(f"w{i}.{k}" + rng.choice([" ", "\n\t ", "  "]) for k in range(rng.choice([0, 1, 3, 30, 300, 2000 if i % 9 == 0 else 7]))), rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(250)]
    return made + [made[3]] * 30 + [(None, "x y z", "one"), (None, "x y z", "one"), (900, "", "none"), (901, None, "none"), (3, "other text " * 40, "a"), (950, "word " * 30_000, "a")]


@pytest.mark.parametrize("block, shard", [(16, 8), (100, 3)])
def test_mix(spark, rows, block, shard):
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, source string, target string, place int")
    docs, pieces = mix(df.repartition(5), block=block, shard=shard, fan=4)
    docs, pieces = docs.cache(), pieces.cache()
    listed, cut = docs.collect(), pieces.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in listed) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    for r in listed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    taken = Counter()
    for p in cut:
        taken[p.source] += p.words
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())
    # No word is drawn more often than its source's passes, and a pass is a partition of its source's blocks.
    size = {r.row: r.size for r in listed}
    often = defaultdict(Counter)
    for p in cut:
        assert 0 <= p.first_word and p.first_word + p.words <= size[p.row] and p.words <= block
        often[p.row].update(range(p.first_word, p.first_word + p.words))
    assert all(max(c.values()) <= 2 for c in often.values())
    for s, t in want.items():
        if t == sizes[s]:
            assert all(set(often[r.row].values()) <= {1} for r in listed if r.source == s)
        if t == 2 * sizes[s]:
            assert all(list(often[r.row].values()) == [2] * r.size for r in listed if r.source == s)
    # Shards hold equally many blocks, each of them whole; places run from 0.
    blocks, places = defaultdict(set), defaultdict(list)
    for p in cut:
        blocks[p.shard].add((p.source_no, p.draw))
        places[p.shard].append(p.place)
    counts = [len(b) for b in blocks.values()]
    assert max(counts) - min(counts) <= 1 and max(counts) <= shard
    assert len(set().union(*blocks.values())) == sum(counts)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # The same again from other partitions.
    again = taken_words(*mix(df.repartition(2, "source"), block=block, shard=shard, fan=4)).collect()
    once = taken_words(docs, pieces).collect()
    assert Counter((r.doc_id, r.size, r.target, r.taken, r.pieces) for r in once) == Counter((r.doc_id, r.size, r.target, r.taken, r.pieces) for r in again)
    # Texts of the pieces are the words they name.
    words = {(i, s, len((t or "").split())): (t or "").split() for i, t, s in rows}
    by = {(r.row): words[r.doc_id, r.source, r.size] for r in listed}
    text = {(t.shard, t.place): t.text for t in mixed_texts(df, pieces, block=block).collect()}
    assert len(text) == len(cut)
    for p in cut:
        assert text[p.shard, p.place].split() == by[p.row][p.first_word : p.first_word + p.words]


def test_empty(spark):
    docs, pieces = mix(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert docs.count() == pieces.count() == 0
    docs, pieces = mix(spark.createDataFrame([(1, None, "a"), (2, " \t", None)], "doc_id long, text string, source string"))
    assert [(r.size, r.target, r.taken) for r in taken_words(docs, pieces).collect()] == [(0, 0.0, 0)] * 2


def test_permutation():
    for n in (1, 2, 3, 16, 17, 1000):
        places = permuted(np.arange(n), np.full(n, n), np.full(n, -12345))
        assert sorted(places.tolist()) == list(range(n))
    assert permuted(np.arange(50), np.full(50, 50), np.full(50, 1)).tolist() != permuted(np.arange(50), np.full(50, 50), np.full(50, 2)).tolist()


def test_draws(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(source_mixing, "LARGEST", 100)
    total = np.zeros(3)
    for _ in range(400):
        counts = np.array([500, 300, 7])
        got = draw(rng, counts, 403)
        assert got.sum() == 403 and (got <= counts).all() and (got >= 0).all()
        total += got
    assert np.allclose(total / 400, counts * 403 / 807, rtol=0.1)
