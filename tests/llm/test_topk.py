"""Exact search against brute force: ties, repeats, odd vectors, small and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxatrend.llm import topk_search


def brute(queries, vectors, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    q64 = lambda v: [int(np.floor(64.0 * float(x))) for x in v]
    rows = [(i, q64(v)) for i, v in vectors if ok(v)]
    out = set()
    for i, v in dict((i, q64(v)) for i, v in queries if ok(v)).items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("scale,blocks", [(1.0, (7, 50)), (300.0, (256, 8192)), (0.02, (64, 31))])
def test_against_brute_force(spark, monkeypatch, scale, blocks):
    monkeypatch.setattr(topk_search, "QUERY_ROWS", blocks[0])
    monkeypatch.setattr(topk_search, "CANDIDATE_ROWS", blocks[1])
    rng = np.random.default_rng(3)
    made = (rng.normal(size=(400, 10)) * scale).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(made)] + [(500 + i, made[40]) for i in range(60)]
    rows += [(600, None), (620, [1.0, None] + [0.0] * 8), (640, [float("nan")] * 10), (660, [float("inf")] * 10), (680, []), (700, [1.0]), (399, made[399])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cutoff int, query_id string")
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(df.filter("vec_id % 20 = 0"), df, 20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(queries, rows, 20)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(df.filter("vec_id = 0"), df, 5).collect()] == [(0, 1, 1, 64 * 32 - 128 * 64)]
    assert topk_search.top_k(df.filter("vec_id > 5"), df, 5).count() == topk_search.top_k(df, df.filter("vec_id > 5"), 5).count() == 0


def test_parts_add_up():
    q, c = np.arange(6.0).reshape(2, 3), np.arange(9.0).reshape(3, 3)
    assert np.array_equal(sum(topk_search.part_scores(q, c)), q @ c.T)
    with pytest.raises(ValueError):
        topk_search.part_scores(np.full((1, 2), 2.0**30), np.full((1, 2), 2.0**30))


def test_queries_that_repeat_an_id(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [0.5, 9.0]), (0, [0.25, 2.0]), (0, [0.25, 1.0])], "vec_id long, embedding array<double>")
    for q in (queries, queries.orderBy("embedding"), queries.orderBy(F.desc("embedding"))):
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(topk_search.top_k(q, vectors, 2).collect(), key=lambda r: r.rank)] == [(0, 1, 2, 64 * 64), (0, 2, 1, 16 * 64)]


def test_blocks_and_tasks_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.uniform(-1, 1, size=(6000, 64)).tolist())], "vec_id long, embedding array<double>")
    plain = topk_search.usable(df, "vec_id", "embedding").withColumn("cutoff", F.lit(float("-inf"))).coalesce(1)
    blocks = topk_search.pack(plain, 8192)
    assert blocks.agg(F.max(F.length("cells")), F.sum(F.size("ids"))).first() == (1 << 18, 6000)
    # Without a cutoff every row is resolved; a task still gives the k best of a query over all its blocks, whichever side comes first.
    asked = topk_search.pack(plain.filter("vec_id < 40"), 8)
    names = lambda d, s: d.toDF(*[f"{s}{i}" for i in range(len(d.columns))])
    for held in (2, 32):
        monkeypatch.setattr(topk_search, "HELD", held)
        pairs = names(F.broadcast(asked), "q").crossJoin(names(blocks, "c"))
        n = topk_search.resolved(pairs, 5).groupBy("query_id").count().agg(F.min("count"), F.max("count")).first()
        assert n == ((5, 5) if held == 32 else (10, 10)) and topk_search.resolved(pairs, 5).select("query_id").distinct().count() == 40


@pytest.mark.parametrize("size,kind", [(2.0, "int16"), (600.0, "int32"), (1e9, "float64"), (-2.0, "int8")])
def test_smallest_type(size, kind):
    assert topk_search.compact(np.array([[64.0 * size, 1.0]])) == kind
