"""Toxicity: held-out separation, defined cases, and labels that never leak into held-out rows."""

import random

import numpy as np
import pytest

from taxatrend.llm import toxicity
from taxatrend.llm.labelled import held_out
from taxatrend.llm.logistic import area_under_curve, fit


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    stems = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    bad = ["blockhead", "gnarfle", "vexous"]
    docs, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(30, 90))]
        toxic = int(i % 3 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), "en", 0.5))
        labels.append((i, None, toxic))
    docs += [(1000, None, None, 0.1), (1001, "", "x", 0.2), (1002, "ok " * 80000, "x", 0.3), (5, docs[5][1], "en", 0.5)]
    labels += [(5, 1, None), (None, 1, 1), (2000, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_separates_held_out_rows(made):
    docs, labels = made
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    y = np.array([r.doc_id % 3 == 0 for r in held])
    assert len(held) > 100 and area_under_curve(np.array([r.score for r in held]), y) > 0.97
    none = {r.score for r in rows if r.doc_id in (1000, 1001)}
    assert len(none) == 1 and none.pop() < 0.5


def test_held_out_labels_change_nothing(made):
    docs, labels = made
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a.toxic, a.ordinary, a.base) == (b.toxic, b.ordinary, b.base) and np.array_equal(a.calibration.weights, b.calibration.weights)


def test_scores_against_windows_compressed_one_by_one(made):
    """The score of a text, from each of its windows compressed by itself with either dictionary."""
    import zstandard

    docs, labels = made
    m = toxicity.train(docs, labels)

    def lengths(own, window):
        d = zstandard.ZstdCompressionDict(own + m.base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress(window))

    for r in toxicity.score(docs.filter("doc_id < 40"), m).join(docs.select("doc_id", "text"), "doc_id").collect():
        ws = r.text.lower().encode().split()
        g = np.array([lengths(m.ordinary, x) - lengths(m.toxic, x) for x in (b" " + b" ".join(ws[i : i + 10]) + b" " for i in range(0, len(ws), 10))])
        shares = [((g >= a) & ((g < b) | (b == 1000) & (g <= b))).mean() for a, b in zip(toxicity.EDGES, toxicity.EDGES[1:])]
        x = np.array([*shares, g.max(), np.sort(g)[-3:].mean(), g.mean(), (g >= 3).mean(), np.log1p(len(g)), np.log1p((g >= 4).sum())])
        z = np.clip((x - m.calibration.mean) / m.calibration.scale, -30, 30)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z @ m.calibration.weights[:-1] + m.calibration.weights[-1], -30, 30)))) < 1e-9


def test_long_texts_are_calibrated_whole(spark):
    """Texts of over 4,000 words with one toxic stretch anywhere in them are told from those without."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(2, 5))) for _ in range(80)]
    docs, labels = [], []
    for i in range(160):
        n = 6000 if i % 4 == 0 else 120
        w = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 2))) for _ in range(n)]
        toxic = int(i % 8 in (0, 1, 2))
        at = rng.randrange(len(w) - 60)
        if toxic:
            w[at : at + 40] = [rng.choice(["blockhead", "gnarfle", "vexous", *stems[:4]]) for _ in range(40)]
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    long = [r for r in rows if r.doc_id % 4 == 0]
    y = np.array([r.doc_id % 8 == 0 for r in long])
    assert area_under_curve(np.array([r.score for r in long]), y) > 0.97
    assert np.mean([r.predicted == k for r, k in zip(long, y)]) > 0.9


def test_too_few_labels(made):
    docs, labels = made
    m = toxicity.train(docs, labels.filter("toxic = 0"))
    assert m.calibration is None and {r.score for r in toxicity.score(docs, m).collect()} == {0.0}
    assert toxicity.score(docs.filter("doc_id < 0"), m).count() == 0


def test_logistic_and_area():
    x = np.c_[np.arange(100.0), np.ones(100)]
    m = fit(x, (x[:, 0] > 50).astype(float))
    assert area_under_curve(m.probability(x), x[:, 0] > 50) == 1 and area_under_curve(np.array([1, 1.0]), np.array([0, 1])) == 0.5
