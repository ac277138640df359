import hashlib
import hmac
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from taxatrend.functions import geo, stats, text, timefn
from taxatrend.functions.hashing import pseudonym
from taxatrend.functions.numeric import close, fixed, sig3, text_number
from taxatrend.operators.co_movement import bh_adjust


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_rounding(spark):
    assert one(spark, fixed(F.lit(-0.0015), 3), fixed(F.lit(2.345), 2), fixed(F.lit(float("nan")), 2), sig3(F.lit(0.0123456))) == (-0.002, 2.35, None, 0.0123)


def test_text_numbers(spark):
    got = one(spark, *[text_number(F.lit(s)) for s in (" 12 ", "1e3", "1d", "NaN", "", "abc", "-.5")])
    assert got == (12.0, 1000.0, None, None, None, None, -0.5)


def test_close_has_a_floor(spark):
    assert one(spark, close(F.lit(10.001), F.lit(10.0), 0), close(F.lit(10.01), F.lit(10.0), 0), close(F.lit(None), F.lit(1.0))) == (True, False, False)


@pytest.mark.parametrize("value,band", [(None, "absent"), ("  ", "absent"), ("0", "trivial"), (", K2", "trivial"), ("ab", "trivial"), ("seen here", "short"), ("Looks strong and healthy", "substantive")])
def test_text_bands(spark, value, band):
    assert one(spark, text.text_band(F.lit(value).cast("string"))) == (band,)


def test_pseudonym_is_hmac(spark):
    want = "obs_" + hmac.new(b"salt", "jané doe".encode(), hashlib.sha256).hexdigest()[:16]
    assert one(spark, pseudonym(F.lit("  JANÉ Doe "), "salt"), pseudonym(F.lit("  "), "salt")) == (want, None)


def test_local_day_crosses_midnight(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    got = one(spark, *[timefn.local_day(ts(s)).cast("string") for s in ("2020-06-01 14:30:00", "2020-06-01 00:00:00")])
    assert got == ("2020-06-02", "2020-06-01")


def test_instants_from_text(spark):
    got = one(spark, *[timefn.text_instant(F.lit(s)).cast("string") for s in ("0", "2020-01-02T03:04:05Z", "2020-01-02", "nonsense")])
    assert got == ("1970-01-01 00:00:00", "2020-01-02 03:04:05", "2020-01-02 00:00:00", None)


def test_grid_cell_rounds_half_away_from_zero(spark):
    assert [str(x) for x in one(spark, geo.tenth_degree(F.lit(-33.85)), geo.tenth_degree(F.lit(0.04)))] == ["-33.9", "0.0"]


def test_public_coordinates(spark):
    p = spark.range(1).select(geo.public_coordinates(F.lit(-33.855), F.lit(151.204)).alias("p")).select("p.*").first()
    assert (p.latitude, p.longitude, p.fuzzed, p.approx_metres) == (-33.85, 151.2, True, 1113)


def test_albers_origin_and_area(spark):
    x, y = geo.albers(F.lit(132.0), F.lit(0.0))
    assert one(spark, x, y) == (0.0, 0.0)
    # A small square keeps its area on the ellipsoid.
    d = 1e-4
    corners = [one(spark, *geo.albers(F.lit(145.0 + a * d), F.lit(-30.0 + b * d))) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(corners, corners[1:] + corners[:1]))) / 2
    e2, s = geo.GRS80_F * (2 - geo.GRS80_F), math.sin(math.radians(-30 + d / 2))
    w = 1 - e2 * s * s
    true = geo.A**2 * (1 - e2) / w**2 * math.cos(math.radians(-30 + d / 2)) * math.radians(d) ** 2
    assert area == pytest.approx(true, rel=1e-4)


def test_geodesic(spark):
    km = lambda *a: one(spark, geo.geodesic_km(*[F.lit(float(v)) for v in a]))[0]
    assert km(150, 0, 151, 0) == pytest.approx(111.3195, abs=1e-3)  # a degree of the equator
    assert km(150, -30, 150, -31) == pytest.approx(110.86, abs=0.02)  # a degree of the meridian there
    assert km(150, -30, 150, -30) == 0.0


@pytest.mark.parametrize("k,n,p", [(0, 5, 0.3), (3, 5, 0.3), (5, 5, 0.3), (2, 5, 0.0), (2, 5, 1.0), (40, 300, 0.12), (6, 5, 0.3)])
def test_binomial_tail(spark, k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert one(spark, stats.binomial_upper_tail(F.lit(k), F.lit(n), F.lit(p)))[0] == pytest.approx(want, rel=1e-9)


def test_bh_matches_the_step_up_rule(spark):
    ps = [0.2, 0.01, 0.04, 0.04, 0.9, 0.03]
    got = {r["k"]: r["q"] for r in bh_adjust(spark.createDataFrame([(i, p, "f") for i, p in enumerate(ps)], "k int, p double, f string"), "p", "f").collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    want, low = {}, 1.0
    for r in range(len(ps) - 1, -1, -1):
        low = min(low, ps[order[r]] * len(ps) / (r + 1))
        want[order[r]] = low
    assert got == pytest.approx(want)


def tail_by_ratios(k, n, p):
    """P(X >= k) from ratios of neighbouring terms, out from the mode, so that nothing is large or cancels."""
    mode = min(n, int((n + 1) * p))
    up, t = {mode: 1.0}, 1.0
    for i in range(mode, n):
        t *= (n - i) / (i + 1) * p / (1 - p)
        if t < 1e-300:
            break
        up[i + 1] = t
    t = 1.0
    for i in range(mode, 0, -1):
        t *= i / (n - i + 1) * (1 - p) / p
        if t < 1e-300:
            break
        up[i - 1] = t
    return math.fsum(v for i, v in up.items() if i >= k) / math.fsum(up.values())


def test_binomial_tail_for_any_size(spark):
    rng = random.Random(4)
    cases = [(1, 1, 0.3), (5, 5, 0.5), (1, 10**6, 1e-6), (500_900, 10**6, 0.5), (3, 10**6, 1e-6), (999_000, 10**6, 0.999)]
    for _ in range(250):
        n = int(10 ** rng.uniform(0, 6))
        p = rng.choice([rng.uniform(0.001, 0.999), rng.uniform(1, 20) / (n + 20)])
        mid = n * p + rng.uniform(-6, 6) * (n * p * (1 - p)) ** 0.5
        cases.append((min(n, max(1, round(mid))), n, p))
    df = spark.createDataFrame(cases, "k int, n int, p double")
    for r in df.select("k", "n", "p", stats.binomial_upper_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect():
        want = tail_by_ratios(r.k, r.n, r.p)
        assert r.t == pytest.approx(want, abs=1e-9) and r.t == pytest.approx(want, rel=1e-7, abs=1e-280), (r, want)


def test_adjusted_values_with_ties_and_gaps(spark):
    rng = random.Random(6)
    rows = [(f, rng.choice([0.01, 0.01, 1.0, None, rng.random()]), i) for f in ("a", None) for i in range(3000)] + [("one", 0.04, 0), ("none", None, 0)]
    df = spark.createDataFrame(rows, "f string, p double, i int")
    got = {(r.f, r.i): r.q for r in bh_adjust(df, "p", "f").collect()}
    assert len(got) == len(rows)
    for f in {r[0] for r in rows}:
        ranked = sorted((p, i) for g, p, i in rows if g == f and p is not None)
        least = 1.0
        for rank in range(len(ranked), 0, -1):
            p, i = ranked[rank - 1]
            least = min(least, p * len(ranked) / rank)
            assert got[f, i] == pytest.approx(least)
        assert all(got[f, i] is None for g, p, i in rows if g == f and p is None)


def test_medians_by_selection(spark):
    from taxatrend.operators.coverage import exact_median

    rng = random.Random(9)
    groups = {"even": [rng.random() for _ in range(3000)], "odd": [rng.choice([1.0, 2.0, 7.5]) for _ in range(2001)], "two": [1.0, 4.0], "one": [3.0], None: [rng.gauss(0, 1e6) for _ in range(30_000)], "none": [None]}
    df = spark.createDataFrame([(g, v) for g, all_ in groups.items() for v in all_], "g string, v double").repartition(6)
    got = {r.g: r.m for r in exact_median(df, ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(all_) for g, all_ in groups.items() if g != "none"}
