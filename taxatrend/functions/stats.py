"""Probability and interval expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Points of the quadrature, and the lengths of decay that it covers: e^-40 is left out.
NODES, REACH = 64, 40.0
#: Up to here the error of Stirling's formula comes from a table, beyond it from its series.
TABLED = 16


def stirling_error(n: Column) -> Column:
    """ln n! less Stirling's formula."""
    table = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) if i else 0.0) for i in range(TABLED)])
    n2 = n * n
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - F.lit(1 / 1188) / n2) / n2) / n2) / n2) / n
    return F.when(n < TABLED, F.get(table, F.least(n, F.lit(TABLED - 1)).cast("int"))).otherwise(series)


def deviance(x: Column, m: Column) -> Column:
    """x ln(x / m) + m - x, without cancellation where x is near m."""
    v = (x - m) / (x + m)
    v2 = v * v
    terms = F.lit(0.0)
    for j in range(12, 0, -1):
        terms = (terms + F.lit(1 / (2 * j + 1))) * v2
    near = (x - m) * v + 2 * x * v * terms
    return F.when(F.abs(x - m) < F.lit(0.1) * (x + m), near).otherwise(F.when(x > 0, x * F.ln(F.when(x > 0, x / m).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0)) + m - x)


def binomial_term(k: Column, n: Column, p: Column) -> Column:
    """P(X = k) for X ~ Binomial(n, p), 0 < p < 1, by the saddle-point form: exact to rounding for any n."""
    rest = n - k
    inside = F.sqrt(n / (F.lit(2 * math.pi) * k * rest)) * F.exp(stirling_error(n) - stirling_error(k) - stirling_error(rest) - deviance(k, n * p) - deviance(rest, n * (1 - p)))
    return F.when(k <= 0, F.exp(n * F.log1p(-p))).when(rest <= 0, F.exp(n * F.ln(p))).otherwise(inside)


def binomial_upper_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), in a fixed number of steps for any n.

    The tail is the incomplete beta integral of a = k, b = n - k + 1 up to p. Its density, known at p from one binomial term, is integrated
    away from p by Gauss and Legendre's rule over as many lengths of decay as matter, on the side where it falls.
    """
    k, n, p = k.cast("double"), n.cast("double"), p.cast("double")
    # Guarded copies keep the generic branch defined on rows the CASE answers directly.
    kk = F.greatest(F.least(k, n), F.lit(1.0))
    nn = F.greatest(n, F.lit(1.0))
    pp = F.when((p > 0) & (p < 1), p).otherwise(F.lit(0.5))
    a, b = kk, nn - kk + 1
    mean = a / (a + b)
    spread = F.sqrt(a * b / (a + b + 1)) / (a + b)
    slope = F.abs((a - 1) / pp - (b - 1) / (1 - pp))
    below = pp < mean
    length = F.least(F.when(below, pp).otherwise(1 - pp), F.lit(REACH) * F.when(slope * spread > 1, 1 / F.greatest(slope, F.lit(1e-300))).otherwise(spread))
    density = binomial_term(kk, nn, pp) * kk / pp
    way = F.when(below, F.lit(-1.0)).otherwise(F.lit(1.0))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    rule = F.array(*[F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(points, weights)])

    def step(total: Column, node: Column) -> Column:
        move = way * length * node["x"]
        fall = (a - 1) * F.log1p(move / pp) + (b - 1) * F.log1p(-move / (1 - pp))
        return total + node["w"] * F.exp(fall)

    part = F.aggregate(rule, F.lit(0.0), step) * length * density
    tail = F.when(below, F.least(part, F.lit(1.0))).otherwise(F.greatest(1 - part, F.lit(0.0)))
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0)).otherwise(tail)


def log_interval(x: Column, variance: Column, z: float) -> tuple[Column, Column]:
    """x * exp(-/+ z * sqrt(variance)); null for a non-positive estimate or a negative variance."""
    se = F.sqrt(F.when(variance >= 0, variance))
    ok = (x > 0) & se.isNotNull()
    return F.when(ok, x * F.exp(F.lit(-z) * se)), F.when(ok, x * F.exp(F.lit(z) * se))
