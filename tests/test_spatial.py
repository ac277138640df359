import math
import random

import numpy as np
import pytest

from taxatrend.operators.hull import area_km2, extent_km2, hull, outer_points
from taxatrend.operators.nearest import nearest_earlier


def test_hull_of_hulls_is_the_hull():
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(500, 2))
    whole = {tuple(p) for p in hull(pts)}
    parts = np.concatenate([hull(pts[i::7]) for i in range(7)])
    assert {tuple(p) for p in hull(parts)} == whole
    # Every point lies on the inner side of every edge.
    h = hull(pts)
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        assert ((b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0]) > -1e-12).all()


def test_degenerate_hulls_have_no_area():
    assert area_km2(hull(np.array([[1.0, 1.0]]))) == 0
    assert area_km2(hull(np.array([[1.0, 1.0], [2.0, 2.0]]))) == 0
    assert area_km2(hull(np.array([[1.0, 1.0], [2.0, 2.0], [3.0, 3.0], [2.0, 2.0]]))) == pytest.approx(0, abs=1e-9)


def test_no_vertex_is_cut_away(spark):
    rng = np.random.default_rng(6)
    pts = [("round", float(x), float(y)) for x, y in rng.normal(size=(4000, 2))] + [("line", float(i), 2.0 * i) for i in range(50)] + [("spot", 1.0, 1.0)] * 3 + [(None, 0.0, 0.0), (None, 1.0, 0.0), (None, 0.0, 1.0)]
    df = spark.createDataFrame(pts, "k string, lon double, lat double")
    left = outer_points(df, ["k"]).collect()
    by = {k: np.array([(r.lon, r.lat) for r in left if r.k == k]) for k in ("round", "line", "spot", None)}
    assert len(by["round"]) < 1000 and len(by["spot"]) == 3 and len(by[None]) == 3
    for k in by:
        whole = np.array([(x, y) for n, x, y in pts if n == k])
        assert {tuple(p) for p in hull(whole)} == {tuple(p) for p in hull(by[k])}
    assert {r.k for r in extent_km2(df, ["k"]).collect()} == set(by)


def test_area_of_a_degree_square():
    # One degree square on the equator of WGS84 is 12308.8 km2 between parallels.
    square = np.array([[0, -0.5], [1, -0.5], [1, 0.5], [0, 0.5]], dtype=float)
    assert area_km2(square) == pytest.approx(12308.8, rel=1e-3)


def test_extent_over_partitions(spark):
    rng = np.random.default_rng(2)
    pts = [(f"T{i % 3}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, -10, size=(900, 2)))]
    pts += [("solo", 1.0, 1.0), ("solo", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "k string, lon double, lat double").repartition(5)
    got = {r["k"]: r["eoo_km2"] for r in extent_km2(df, ["k"]).collect()}
    for k in ("T0", "T1", "T2"):
        assert got[k] == pytest.approx(area_km2(hull(np.array([p[1:] for p in pts if p[0] == k]))), rel=1e-12)
    assert got["solo"] == 0


@pytest.mark.parametrize("leaf", [1000, 100, 7, 1])
def test_nearest_equals_brute_force(spark, leaf):
    rnd = random.Random(leaf)
    pts = [("A", 140 + rnd.gauss(0, 0.05), -30 + rnd.gauss(0, 0.05)) for _ in range(300)]  # one crowded place
    pts += [("A", rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(60)] + [("B", rnd.uniform(110, 150), rnd.uniform(-40, -10)) for _ in range(50)]
    qs = [(k, rnd.uniform(110, 155), rnd.uniform(-45, -8)) for k in "AB" for _ in range(40)] + [pts[0], ("C", 1.0, 1.0), ("A", -170.0, 80.0)]
    ddl = "k string, lon double, lat double"
    got = {(r["k"], r["lon"], r["lat"]): r["nearest_km"] for r in nearest_earlier(spark.createDataFrame(qs, ddl), spark.createDataFrame(pts, ddl), "k", leaf).collect()}
    assert ("C", 1.0, 1.0) not in got and len(got) == len(qs) - 1
    for k, x, y in qs:
        if k != "C":
            _, px, py = min(((p[1] - x) ** 2 + (p[2] - y) ** 2, p[1], p[2]) for p in pts if p[0] == k)
            # Haversine on a mean sphere is within 0.6 % of the ellipsoid.
            a = math.sin(math.radians(py - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(py)) * math.sin(math.radians(px - x) / 2) ** 2
            assert got[(k, x, y)] == pytest.approx(2 * 6371.0 * math.asin(math.sqrt(min(1, a))), rel=6e-3, abs=1e-6)


def test_each_key_splits_by_its_own_count(spark, monkeypatch):
    """A crowded place is split where it is crowded; the points of others are leaves at once and are not touched again."""
    from taxatrend.operators import nearest

    rows, keep = {}, nearest.written_once

    def counting(df, name):
        out = keep(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(nearest, "written_once", counting)
    pts = [("A", 140 + i * 1e-3, -30.0) for i in range(400)] + [("B", 140 + i * 1e-3, -30.0) for i in range(90)] + [("A", 10.0 + i, 40.0) for i in range(30)]
    df = spark.createDataFrame(pts, "k string, lon double, lat double")
    got = nearest_earlier(df, df, "k", 100)
    assert got.count() == len(pts) and {r.nearest_km for r in got.collect()} == {0.0}
    # All points; then those of the one crowded cell, and again those of the 16th of a degree cells that are still crowded.
    assert rows["points"] == [520] and rows["points-left"][0] == 400 and sum(rows["points-left"]) <= 800
