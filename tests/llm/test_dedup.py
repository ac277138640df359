"""Exact and SimHash deduplication against brute force, with nulls, ties, repeats and clashing columns."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from taxatrend.llm import simhash
from taxatrend.llm.components import components
from taxatrend.llm.exact_dedup import drop_exact, exact_groups


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [
        (5, "a  b\tc", "x"), (3, "a b c", "y"), (9, None, None), (8, "", "z"), (None, "a b c", "n"), (7, "lone", None), (7, "lone", None),
        (1, "w " * 60000, "long"), (2, "W " * 60000, "long"), (4, "ä \x0b b", "u"), (6, "ä b", "u"),
    ]
    return spark.createDataFrame([(i, t, s, True, 1) for i, t, s in rows], "doc_id long, text string, `digest` string, suspect boolean, `a.b` int")


def test_exact_groups(odd_docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(odd_docs).collect()}
    assert got == {
        (5, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (9, 8, 2, False), (8, 8, 2, True), (7, 7, 2, True),
        (1, 1, 1, True), (2, 2, 1, True), (4, 4, 2, True), (6, 4, 2, False),
    }


def test_every_row_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, "b"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df).collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (1, 1, 1, True), (None, None, 2, True), (None, None, 2, True)], key=repr)


def test_drop_exact_keeps_columns(odd_docs):
    kept = drop_exact(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 8]


def test_full_filter_changes_nothing(odd_docs, monkeypatch):
    import taxatrend.llm.exact_dedup as m

    want = sorted(map(str, exact_groups(odd_docs).collect()))
    monkeypatch.setattr(m, "slot_bits", lambda rows: 1)
    assert sorted(map(str, exact_groups(odd_docs).collect())) == want


def test_empty(spark, odd_docs):
    none = odd_docs.filter("doc_id > 100")
    assert exact_groups(none).count() == drop_exact(none).count() == simhash.simhash_groups(none).count() == 0


def brute_fp(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """fps: {id: fp} -> {id: smallest id reachable}."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints(odd_docs):
    got = {(r.doc_id, r.fingerprint) for r in simhash.simhash_groups(odd_docs).collect()}
    assert got == {(r.doc_id, f"{brute_fp(r.text):016x}") for r in odd_docs.collect()}


@pytest.mark.parametrize("paired", [2, 48])
def test_groups_against_brute_force(spark, monkeypatch, paired):
    rng = random.Random(5)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {}
    for i in range(700):
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps[i] = x
    fps |= {i: rng.getrandbits(64) for i in range(700, 760)} | {760: 0, 761: 1, 762: (1 << 64) - 1}
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()]
    got = {r.doc_id: r.component_id for r in simhash.fingerprint_groups(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    assert got == brute_groups(fps)


def test_components_of_a_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_chain_test_misses_no_pair(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 2)):
            b ^= 1 << rng.randrange(64)
        rows.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    df = spark.createDataFrame(rows, "a long, b long")
    starts = [
        (simhash.segment(F.col("a"), i) == simhash.segment(F.col("b"), i)) & (simhash.segment(F.col("a"), i + 1) == simhash.segment(F.col("b"), i + 1))
        & simhash.within_budget(F.col("a"), F.col("b"), F.lit(i))
        for i in range(5)
    ]
    some = starts[0]
    for s in starts[1:]:
        some = some | s
    assert df.filter(~some).count() == 0
