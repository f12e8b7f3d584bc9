"""Convex outlines of grains: hull, narrowest and widest extent, smallest enclosing circle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTLINE = "hull_area double, min_bound double, min_angle double, max_bound double, max_angle double, circle_r double, circle_x double, circle_y double"

#: A corner this share of the radius outside a circle counts as on it.
TOLERANCE = 1e-9


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _hull(points: list[tuple[float, float]]) -> np.ndarray:
    """Corners of the convex hull of sorted points, without those inside an edge."""
    halves = []
    for path in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for p in path:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


def _through(corners: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the circle through two opposite points or three points."""
    if len(corners) == 2:
        x, y = corners.mean(axis=0)
    else:
        b, c = corners[1] - corners[0], corners[2] - corners[0]
        solved = np.linalg.solve(np.array([b, c]), np.array([b @ b, c @ c]) / 2)
        x, y = corners[0] + solved
    return float(x), float(y), float(np.hypot(*(corners[0] - (x, y))))


def _circle(hull: np.ndarray) -> tuple[float, float, float]:
    """The smallest circle around the corners: the farthest one outside enters until none is."""
    support = hull[[0, len(hull) // 2]]
    while True:
        x, y, r = _through(support)
        away = np.hypot(hull[:, 0] - x, hull[:, 1] - y)
        far = int(away.argmax())
        if away[far] <= r * (1 + TOLERANCE):
            return x, y, r
        # The new circle passes the entering corner: the smallest that holds the support too.
        held = np.vstack([support, hull[far]])
        pairs = [held[[i, len(held) - 1]] for i in range(len(held) - 1)]
        triples = [held[[i, j, len(held) - 1]] for i in range(len(held) - 1) for j in range(i)]
        found = []
        for chosen in pairs + triples:
            if len(chosen) == 3 and abs(_turn(*chosen)) < TOLERANCE:
                continue
            cx, cy, cr = _through(chosen)
            if (np.hypot(held[:, 0] - cx, held[:, 1] - cy) <= cr * (1 + TOLERANCE)).all():
                found.append((cr, chosen))
        support = min(found, key=lambda f: f[0])[1]


def _outline(points) -> tuple:
    hull = _hull(sorted((p["x"], p["y"]) for p in points))
    edges = np.roll(hull, -1, axis=0) - hull
    area = float((hull[:, 0] * np.roll(hull[:, 1], -1) - np.roll(hull[:, 0], -1) * hull[:, 1]).sum() / 2)
    narrow, wide = (math.inf, 0.0), (-1.0, 0.0)
    for corner, edge in zip(hull, edges):
        offset = hull - corner
        width = float(np.abs(offset[:, 0] * edge[1] - offset[:, 1] * edge[0]).max() / np.hypot(*edge))
        # The extent is measured across the edge; angles turn from the x axis towards smaller rows.
        narrow = min(narrow, (width, math.atan2(edge[0], edge[1])), key=lambda v: v[0])
        length = np.hypot(offset[:, 0], offset[:, 1])
        far = int(length.argmax())
        wide = max(wide, (float(length[far]), math.atan2(-offset[far, 1], offset[far, 0])), key=lambda v: v[0])
    x, y, r = _circle(hull)
    return area, narrow[0], narrow[1] % math.pi, wide[0], wide[1] % math.pi, r, x, y


def _outlines(points: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTLINE.split(", ")]
    return pd.DataFrame([_outline(p) for p in points], columns=names, dtype="float64")


def outlines(grains: DataFrame) -> DataFrame:
    """``field_id, grain`` and the convex outline of the grain's pixels, each a unit square:

    ``hull_area``; ``min_bound, max_bound`` with the angles ``min_angle, max_angle``
    (0 to pi, from the x axis towards smaller rows) of the narrowest and the widest
    extent; ``circle_r, circle_x, circle_y`` of the smallest enclosing circle.

    Only the outermost corners of each row of pixels leave the JVM, so a grain costs
    its height, not its area.
    """
    ends = grains.groupBy("field_id", "grain", "row").agg(F.min("col").alias("_a"), (F.max("col") + 1).alias("_b"))
    corners = ends.withColumn("y", F.explode(F.array("row", F.col("row") + 1)))
    outer = corners.groupBy("field_id", "grain", "y").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    end = F.explode(F.array(F.col("_a").cast("double"), F.col("_b").cast("double")))
    sides = outer.select("field_id", "grain", F.col("y").cast("double").alias("y"), end.alias("x"))
    listed = sides.groupBy("field_id", "grain").agg(F.collect_list(F.struct("x", "y")).alias("_p"))
    return listed.select("field_id", "grain", F.pandas_udf(_outlines, OUTLINE)("_p").alias("_o")).select("field_id", "grain", "_o.*")
