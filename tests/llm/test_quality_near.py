"""Quality, near duplicates and the pipeline: held-out accuracy, brute force, defined cases."""

import random

import numpy as np
import pytest

from taxatrend.llm import near_dedup, quality
from taxatrend.llm.logistic import area_under_curve
from taxatrend.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_separates_held_out_rows(spark):
    import zlib

    scores = {r.doc_id: r.score for r in QUERIES["op6_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(scores) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert area_under_curve(np.array([scores[i] for i in held]), np.array([labels[i] for i in held])) > 0.98
    assert min(scores[i] for i in labels if labels[i]) > max(scores[i] for i in labels if not labels[i]) or np.mean([scores[i] >= 0.5 for i in labels if labels[i]]) > 0.98


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    content, metadata = np.c_[y + rng.normal(size=4000) * 0.25], np.c_[y + rng.normal(size=4000) * 0.35]
    given = np.full(4000, -1)
    given[:60] = y[:60]
    m = quality.co_train(content, metadata, given)
    a, b, both = m.scores(content, metadata)
    area = lambda s: area_under_curve(s[60:], y[60:])
    assert area(both) > max(area(a), area(b)) - 1e-4 and area(both) > 0.995
    useless = quality.co_train(content, rng.normal(size=(4000, 1)), given)
    assert area(useless.scores(content, rng.normal(size=(4000, 1)))[2]) > 0.98


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (3, "x " * 50_000, "en", "s", 5, 3), (3, "x " * 50_000, "en", "s", 5, 3), (4, "A fine text. " * 3, "en", None, None, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `score` int")


def test_quality_of_odd_rows(spark, odd):
    m = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = quality.score(odd, m).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].content_score == rows[1].content_score
    none = quality.train(odd, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score(odd.drop("lang", "source", "n_chars"), none).collect()} == {none.prior}
    assert quality.score(odd.filter("doc_id > 9"), m).count() == 0


def test_kept_rows_have_their_own_scores(spark, odd):
    m = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    own = odd.withColumnRenamed("lang", "content_score").withColumnRenamed("source", "a.b")
    kept = quality.keep_good(own, m, least=0.0)
    assert kept.columns == own.columns and sorted(map(str, kept.collect())) == sorted(map(str, own.collect()))
    assert quality.keep_good(own, m, least=1.01).count() == 0


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(texts, least=0.8):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    like = lambda a, b: not (a | b) or len(a & b) >= least * len(a | b)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if like(sets[a], sets[b])}


def near_copies(n, group, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts, base = {}, []
    for i in range(n):
        if i % group == 0:
            base = [word() for _ in range(rng.randint(3, 300))]
        w = list(base)
        for _ in range(rng.randint(0, max(1, len(w) // 60))):
            w[rng.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    return texts


@pytest.mark.parametrize("group", [6, 150])
def test_near_pairs_against_brute_force(spark, group):
    texts = near_copies(600, group) | {700: None, 701: " ", 702: "one two", 703: "One  two", 704: "w " * 40_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    got = {(r.a, r.b) for r in near_dedup.similar_pairs(docs.na.fill(""), 5, 0.8).collect()}
    assert got <= want
    if group == 6:
        assert len(got) >= 0.99 * len(want)
    # Groups are whole even where not all pairs are met.
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(want):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    linked = {i for p in want for i in p}
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    same = sum(groups.get(i) == top(i) for i in linked)
    assert same >= 0.99 * len(linked) and set(groups) <= linked


def star(variants, n=400, changed=8, seed=2):
    """An original and variants that each change it in other places: near copies of it, but not of one another."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(n)]
    texts = {0: " ".join(base)}
    for v in range(1, variants + 1):
        w = list(base)
        for i in rng.sample(range(0, n, 5), changed):
            w[i] = f"v{v}x{i}"
        texts[v] = " ".join(w)
    return texts


def family(members, n=300, shared=0.8, seed=3):
    """Texts that share one long passage; every second is a near copy of the one before it."""
    rng = random.Random(seed)
    passage, texts = [f"p{i}" for i in range(int(n * shared))], {}
    for m in range(members):
        own = [f"o{m // 2}x{i}" for i in range(n - len(passage))]
        if m % 2:
            own[rng.randrange(len(own))] = f"c{m}"
        texts[m] = " ".join(passage + own)
    return texts


@pytest.mark.parametrize("texts", [star(150), family(160)], ids=["star", "family"])
def test_crowded_samples_lose_no_link(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert len(texts) / 2 <= len(want) < len(texts)
    samples = {i: near_dedup.sketch(t, 5)[2] for i, t in texts.items()}
    unmet = {(a, b) for a, b in want if not any(x == y for x, y in zip(samples[a], samples[b]))}  # three in a thousand agree in no sample
    assert len(unmet) <= 1
    assert want - unmet <= {(r.a, r.b) for r in near_dedup.similar_pairs(docs).collect()} <= want


def chain(members, n=120, seed=4):
    """Every text changes one word of the one before it."""
    rng = random.Random(seed)
    w, texts = [f"w{i}" for i in range(n)], {}
    for m in range(members):
        w = list(w)
        w[rng.randrange(n)] = f"c{m}"
        texts[m] = " ".join(w)
    return texts


def sixty(members, seed=6):
    """Texts of sixty words that each change one or two words of one original: many pairs lie about the threshold."""
    rng = random.Random(seed)
    texts = {}
    for m in range(members):
        w = [f"w{i}" for i in range(60)]
        for i in rng.sample(range(60), 1 + m % 2):
            w[i] = f"v{m}x{i}"
        texts[m] = " ".join(w)
    return texts


def tops(pairs, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(pairs):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("make", [sixty, star, chain, family])
def test_candidates_of_a_family_grow_in_proportion(spark, monkeypatch, make):
    met, keep = {}, near_dedup.written

    def counting(df, name):
        out = keep(df, name)
        if name in ("near-pairs", "near-hub-pairs", "near-between"):
            met[members] = met.get(members, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counting)
    for members in (150, 600):
        texts = make(members)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {(r.a, r.b) for r in near_dedup.similar_pairs(docs).collect()}
        want = brute(texts)
        assert got <= want
        alone = sum(x != y for x, y in zip(tops(got, texts).values(), tops(want, texts).values()))
        assert alone <= 0.01 * members  # texts that agree with their like in no sample
    # Up to 48 that agree in a sample meet in pairs, beyond it each meets six: at most 48 a text and sample order.
    assert met[600] <= 48 * 600 and met[600] <= 8 * met[150]


def test_parities_differ_at_most_where_sets_do():
    rng = np.random.default_rng(1)
    for n in (1, 50, 5000):
        x = rng.integers(-(2**31), 2**31, n).astype(np.int32)
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(-(2**31), 2**31, n // 3 + 1).astype(np.int32)]))
        x = np.unique(x)
        bits = sum(bin(int(a) & (2**64 - 1)).count("1") for a in near_dedup.parity(x) ^ near_dedup.parity(y))
        assert bits <= len(np.setxor1d(x, y)) and (near_dedup.parity(x) == near_dedup.parity(x[::-1])).all()


def test_near_pairs_with_a_repeated_passage(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    texts = {}
    for k in range(12):
        body, passage = " ".join(word() for _ in range(150)), " ".join(word() for _ in range(8)) + " "
        texts |= {2 * k: f"{body} {passage}", 2 * k + 1: f"{body} {passage * 500}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert want == {(2 * k, 2 * k + 1) for k in range(12)}
    assert {(r.a, r.b) for r in near_dedup.similar_pairs(docs).collect()} == want


def test_drop_near_keeps_columns_and_odd_rows(spark, odd):
    clash = odd.withColumnRenamed("score", "gone").withColumnRenamed("source", "a.b")
    kept = near_dedup.drop_near(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 4]
    assert near_dedup.drop_near(clash.filter("doc_id > 9")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for _, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    left = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 for i in left) and all(len(r.text) == r.n_chars for r in left.values())
    whole = p.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == set(left) and len({(r.sequence_id, r.offset) for r in whole}) == len(whole)
