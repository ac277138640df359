"""Extent of occurrence: area of the convex hull of a group's points.

The one operator with no built-in equivalent. The hull of partial hulls is the hull, so each task reduces its
share of a group to hull vertices, and a last round joins the few vertices that remain. No task ever holds a
whole group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatrend.functions.geo import WGS84_F, A

E2 = WGS84_F * (2 - WGS84_F)
#: Twice the area, in square degrees, below which three points count as collinear: rounding of coordinates makes no vertex.
FLAT = 1e-9

# Workers get these functions with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def hull(points: np.ndarray) -> np.ndarray:
    """Hull vertices of (n, 2) points, counter-clockwise, collinear points dropped."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    # Points outside the box spanned by neither extreme can be skipped only by the chain itself; within
    # one x, however, only the lowest and highest can be vertices.
    first = np.r_[True, pts[1:, 0] != pts[:-1, 0]]
    last = np.r_[first[1:], True]
    pts = pts[first | last]

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) > FLAT:
                    break
                out.pop()
            out.append(q)
        return out

    lower, upper = chain(pts), chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def authalic(lat_deg: np.ndarray) -> np.ndarray:
    """Authalic latitude in radians on WGS84."""
    e = np.sqrt(E2)

    def q(s):
        return (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(e * s) / e)

    return np.arcsin(np.clip(q(np.sin(np.radians(lat_deg))) / q(1.0), -1, 1))


def authalic_radius_km() -> float:
    e = np.sqrt(E2)
    q1 = (1 - E2) * (1 / (1 - E2) + np.arctanh(e) / e)
    return A / 1000 * np.sqrt(q1 / 2)


def area_km2(vertices: np.ndarray) -> float:
    """Area of a polygon of (lon, lat) degrees on the ellipsoid: great-circle edges on the sphere of equal
    area. Edges differ from geodesics to first order in flattening; area error stays under 0.1 %."""
    if len(vertices) < 3:
        return 0.0
    lam, t = np.radians(vertices[:, 0]), np.tan(authalic(vertices[:, 1]) / 2)
    dlam = np.roll(lam, -1) - lam
    t2 = np.roll(t, -1)
    excess = 2 * np.arctan2(np.tan(dlam / 2) * (t + t2), 1 + t * t2)
    return float(abs(excess.sum()) * authalic_radius_km() ** 2)


def outer_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, lon, lat) less those inside the polygon of a group's extremes in eight directions, which are no hull vertices.

    The extremes are one row of aggregates a group; most points of a spread-out group go here, before Python sees any.
    """
    lon, lat, at = F.col("lon"), F.col("lat"), F.struct("lon", "lat")
    # Counter-clockwise from the south; ties go to one of the extremes, which is enough.
    ways = [(-lat), (lon - lat), lon, (lon + lat), lat, (lat - lon), (-lon), (-lon - lat)]
    corners = points.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.max_by(at, F.struct(w, at)).alias(f"c{i}") for i, w in enumerate(ways)])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside, some = F.lit(True), F.lit(False)
    for i in range(len(ways)):
        a, b = F.col(f"c{i}"), F.col(f"c{(i + 1) % len(ways)}")
        turn = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        inside, some = inside & ((a == b) | (turn > FLAT)), some | (a != b)
    return points.join(corners, same).filter(~(inside & some)).select(points.columns)


def extent_km2(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points``: keys, lon, lat -> keys, eoo_km2."""
    types = dict(points.dtypes)
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)

    # Of the points on one meridian only the southernmost and northernmost can be hull vertices. Grouping by
    # longitude also spreads a group that holds most rows over all partitions.
    extremes = points.groupBy(*keys, "lon").agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    candidates = outer_points(extremes.select(*keys, "lon", F.explode(F.array_distinct(F.array("south", "north"))).alias("lat")), keys)

    def reduce_groups(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(codes, kind="stable")
        xy = pdf[["lon", "lat"]].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        hulls = [hull(part) for part in np.split(xy, starts[1:])]
        out = pdf[keys].iloc[np.repeat(order[starts], [len(h) for h in hulls])].reset_index(drop=True)
        out[["lon", "lat"]] = np.concatenate(hulls)
        return out

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Batches fold into the vertices kept so far, so memory follows the groups, not the rows.
        kept: pd.DataFrame | None = None
        for pdf in batches:
            if len(pdf):
                kept = reduce_groups(pdf if kept is None else pd.concat([kept, pdf]))
        if kept is not None:
            yield kept

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].head(1).copy()
        out["eoo_km2"] = area_km2(hull(pdf[["lon", "lat"]].to_numpy()))
        return out

    # The last round meets the vertices of one group from every partition: partitions times some tens of rows.
    vertices = candidates.mapInPandas(local, f"{key_ddl}, lon double, lat double")
    return vertices.groupBy(*keys).applyInPandas(measure, f"{key_ddl}, eoo_km2 double")
