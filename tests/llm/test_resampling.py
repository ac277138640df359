"""Resampling against a plain computation, and the exact selection of a rank."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from taxatrend.llm import target_resampling
from taxatrend.llm.target_resampling import kth_row, resample


def plain(docs, target, run=1, least=20, percent=10):
    def buckets(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in range(1, run + 1) for i in range(len(words) - n + 1)], len(words)

    found = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in buckets(x)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for i, f, words in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    enter = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = [(r, k) for k, r in enumerate(enter[: len(enter) * percent // 100], 1)]
    out = Counter((*r[:4], k) for r, k in ranks)
    out.update((Counter((*r[:4], None) for r in rows) - Counter((*r[:4], None) for r, _ in ranks)).elements())
    return out


@pytest.mark.parametrize("run, few", [(1, 1000), (2, 3)])
def test_against_plain(spark, monkeypatch, run, few):
    monkeypatch.setattr(target_resampling, "FEW", few)
    rng = random.Random(run)
    words = ["the", "The", "été", "Ünique", "x1", "naïve", "end.", "a-b", "日本", "q", "_z"]
    docs = [(i if i % 11 else None, " ".join(rng.choices(words[: 3 + i % 9], k=rng.choice([0, 5, 19, 20, 40, 200])))) for i in range(300)]
    docs += [(7, docs[7][1])] * 40 + [(900, None), (901, ""), (902, "..."), (903, "word " * 50_000), (7, "another text " * 30)]
    target = ["the naïve q", None, "x1 x1 end"]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, score int, weight string").repartition(7)
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), run=run)
    assert Counter(map(tuple, got.collect())) == plain(docs, target, run)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert resample(docs, one).count() == 0
    assert [r.rank for r in resample(one, docs).collect()] == [None]


@pytest.mark.parametrize("few", [1, 50])
def test_selection(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(target_resampling, "FEW", few)
    spark.range(3000).repartition(9).select((F.col("id") * 7919 % 5).alias("a"), (F.col("id") * 104729 % 40 - 20).alias("b")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    listed = sorted([r.a, r.b] for r in rows.collect())
    for k in (1, 2, 1499, 1500, 2999, 3000):
        assert kth_row(rows, ["a", "b"], k) == listed[k - 1]
