"""Nearest earlier point of the same key: exact, without comparing all pairs of a key.

Earlier points lie in a tree of nested degree cells, which splits each key and each cell by its own count: a crowded cell has children, any
other is a leaf, however crowded its neighbours are. A cell has a bounding box and one actual point. Queries descend from the coarsest
cells: a cell is opened only if its box lies no further than the nearest actual point known so far. Every level is one equi-join on
(key, cell), made of the points of crowded cells alone, so a key that holds a third of all rows is spread over its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatrend.functions.geo import geodesic_km
from taxatrend.workspace import written_once

#: Cell sizes in degrees, coarse to fine; each is 16 of the next.
LEVELS = [16.0 / 16**i for i in range(6)]
#: A cell with more distinct points is split, down to the finest level.
LEAF_POINTS = 512


def _cells(size: float) -> list[Column]:
    return [F.floor((F.col("lon") + 180.0) / size), F.floor((F.col("lat") + 90.0) / size)]


def _names(level: int) -> list[str]:
    return [f"cx{level}", f"cy{level}"]


def _square(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _bounds(c: Column) -> Column:
    """Grid position of a cell, and how near its points can be (``lb``) and one of them surely is (``ub``)."""
    qlon, qlat, none = F.col("qlon"), F.col("qlat"), F.lit(0.0)
    lower = _square(F.greatest(c["x0"] - qlon, qlon - c["x1"], none), F.greatest(c["y0"] - qlat, qlat - c["y1"], none))
    upper = _square(c["rep"]["lon"] - qlon, c["rep"]["lat"] - qlat)
    return F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"), c["leaf"].alias("leaf"), lower.alias("lb"), upper.alias("ub"))


def _prune(cells: Column) -> Column:
    """Cells that may hold the nearest point, given all cells in the array."""
    best = F.array_min(F.transform(cells, lambda c: c["ub"]))
    # The bound is bound once as an array of one, not worked out again for every cell.
    return F.flatten(F.transform(F.array(best), lambda b: F.filter(cells, lambda c: c["lb"] <= b)))


def nearest_earlier(
    queries: DataFrame, points: DataFrame, key: str, leaf_points: int = LEAF_POINTS, levels: list[float] = LEVELS
) -> DataFrame:
    """``queries`` and ``points``: key, lon, lat. Returns each distinct query (key, lon, lat) that has a point
    with ``nearest_km``: the point nearest in planar degrees, measured on the ellipsoid. Of points equally near
    in degrees the one first by longitude, then latitude, is measured. Ends at the finest level, whose leaves may be larger."""
    # Both are read several times, so they are worked out once.
    q = written_once(queries.select(key, F.col("lon").alias("qlon"), F.col("lat").alias("qlat")).distinct(), "queries")
    left = written_once(points.join(q.select(key).distinct(), key, "left_semi").select(key, "lon", "lat").distinct(), "points")
    lon, lat, qkey = F.col("lon"), F.col("lat"), [key, "qlon", "qlat"]
    frontier, reached, placed = q, [], []
    for lv, size in enumerate(levels):
        last = lv == len(levels) - 1
        at = left.select(key, "lon", "lat", *[c.alias(n) for c, n in zip(_cells(size), ("cx", "cy"))])
        cells = at.groupBy(key, "cx", "cy").agg(
            F.min(lon).alias("x0"), F.max(lon).alias("x1"), F.min(lat).alias("y0"), F.max(lat).alias("y1"), F.min(F.struct("lon", "lat")).alias("rep"),
            (F.lit(last) | (F.count("*") <= leaf_points)).alias("leaf"),
        )
        cells = written_once(cells, "cells")
        # A cell's occupied children in one row: 256 at most, or a key's coarsest cells.
        up = [F.floor(F.col(c) / 16).alias(n) for c, n in zip(("cx", "cy"), _names(lv - 1))] if lv else []
        child = F.struct("cx", "cy", "x0", "x1", "y0", "y1", "rep", "leaf")
        families = cells.groupBy(key, *up).agg(F.collect_list(child).alias("children"))
        opened = frontier.join(families, [key, *(_names(lv - 1) if lv else [])])
        local = opened.select(*qkey, F.transform("children", _bounds).alias("cells")).select(*qkey, _prune(F.col("cells")).alias("cells"))
        if lv:
            local = local.groupBy(*qkey).agg(F.flatten(F.collect_list("cells")).alias("cells")).select(*qkey, _prune(F.col("cells")).alias("cells"))
        found = written_once(local.select(*qkey, F.explode("cells").alias("c")).select(*qkey, F.lit(lv).alias("level"), "c.*"), "cells-reached")
        reached.append(found)
        leaves = cells.filter("leaf").select(key, "cx", "cy")
        placed.append(at.join(leaves, [key, "cx", "cy"], "left_semi").select(key, F.lit(lv).alias("level"), "cx", "cy", "lon", "lat"))
        crowded = cells.filter("NOT leaf").select(key, "cx", "cy")
        if crowded.isEmpty():
            break
        left = written_once(at.join(crowded, [key, "cx", "cy"], "left_semi").select(key, "lon", "lat"), "points-left")
        frontier = found.filter("NOT leaf").select(*qkey, *[F.col(c).alias(n) for c, n in zip(("cx", "cy"), _names(lv))])
    every, points_in = reduce(DataFrame.unionByName, reached), reduce(DataFrame.unionByName, placed)
    # A leaf met early may lie beyond a point that a later level brought into view.
    best = every.groupBy(*qkey).agg(F.min("ub").alias("best")) if len(reached) > 1 else None
    wanted = every.filter("leaf") if best is None else every.filter("leaf").join(best, qkey).filter("lb <= best")
    near = wanted.select(*qkey, "level", "cx", "cy").join(points_in, [key, "level", "cx", "cy"]).groupBy(*qkey).agg(
        F.min(F.struct(_square(lon - F.col("qlon"), lat - F.col("qlat")).alias("d2"), "lon", "lat")).alias("p")
    )
    return near.select(
        key, F.col("qlon").alias("lon"), F.col("qlat").alias("lat"),
        geodesic_km(F.col("qlon"), F.col("qlat"), F.col("p.lon"), F.col("p.lat")).alias("nearest_km"),
    )
