"""Distances of marked pixels from what is outside, and the discs inside grains.

Distances in a column come from windows down it; the least over a row's columns is found
in one pass over the row, so a task holds one row of pixels, and no distance is too long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.arithmetic import PLACE
from terrace.plans.lines import Line, map_lines


def _envelope(f: np.ndarray) -> np.ndarray:
    """Least of ``f[j] + (i - j)^2`` over all j, by the lower envelope of these parabolas; one pass there and one back."""
    known = np.flatnonzero(np.isfinite(f))
    if not len(known):
        return f
    tops, starts = [int(known[0])], [-np.inf]
    height = f.tolist()
    for j in known[1:].tolist():
        base = height[j] + j * j
        while True:
            i = tops[-1]
            cross = (base - height[i] - i * i) / (2 * (j - i))
            if cross > starts[-1]:
                break
            tops.pop()
            starts.pop()
        tops.append(j)
        starts.append(cross)
    at = np.arange(len(f))
    best = np.array(tops)[np.searchsorted(starts, at, side="right") - 1]
    return f[best] + (at - best) ** 2.0


def _stepwise(g: np.ndarray, steps) -> np.ndarray:
    """Least of ``steps(k, g)`` over the columns ``k`` to either side, until ``k`` is further than all distances found."""
    best, k = g.copy(), 1
    while k < len(g) and k < best.max():
        best[k:] = np.minimum(best[k:], steps(k, g[:-k]))
        best[:-k] = np.minimum(best[:-k], steps(k, g[k:]))
        k += 1
    return best


# Steps to a pixel that lies k columns and g rows away.
_STEPS = {
    "cityblock": lambda k, g: k + g,
    "chessboard": lambda k, g: np.maximum(k, g),
    "octagonal48": lambda k, g: np.maximum(np.maximum(k, g), np.ceil(2 * (k + g) / 3)),
    "octagonal84": lambda k, g: np.maximum(np.maximum(k, g), np.ceil((2 * (k + g) - 1) / 3)),
}
METRICS = ("euclidean", *_STEPS)


def distance_transform(mask: DataFrame, metric: str = "euclidean", from_border: bool = True) -> DataFrame:
    """``field_id, row, col, z``: distance of each marked pixel from the nearest unmarked one, 0 for those; in pixels.

    ``euclidean`` is exact. The others count steps over edges (``cityblock``), over
    edges and corners (``chessboard``), or both in turn (``octagonal48``, ``octagonal84``).
    With ``from_border`` all beyond the field is unmarked; without it a field with no
    unmarked pixel has infinite distances. Fields are whole rectangles of pixels.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    down, up = (Window.partitionBy("field_id", "col").orderBy(o) for o in (F.asc("row"), F.desc("row")))
    whole = Window.partitionBy("field_id", "col")
    free = F.when(F.coalesce(F.col("m") <= 0, F.lit(True)), F.col("row"))
    # Both looks are running ones: a frame that ends with the column is read again for each of its pixels.
    above, below = F.last(free, True).over(down), F.last(free, True).over(up)
    if from_border:
        above, below = F.coalesce(above, F.min("row").over(whole) - 1), F.coalesce(below, F.max("row").over(whole) + 1)
    away = F.least(F.col("row") - above, below - F.col("row")).cast("double")
    columns = mask.select(*PLACE, F.coalesce(away, F.lit(float("inf"))).alias("g"))

    def across(line: Line) -> Line:
        g = line["g"]
        if from_border:
            g = np.concatenate([[0.0], g, [0.0]])
        out = np.sqrt(_envelope(g * g)) if metric == "euclidean" else _stepwise(g, _STEPS[metric])
        return {"col": line["col"], "z": out[1:-1] if from_border else out}

    return map_lines(columns, ["field_id", "row"], ["col"], ["col", "g"], across, "col int, z double").select(*PLACE, "z")


def inscribed_discs(mask: DataFrame, grains: DataFrame) -> DataFrame:
    """``field_id, grain, radius, row, col``: the largest distance inside each grain and the first pixel, by rows, that has it."""
    inside = grains.join(distance_transform(mask), PLACE)
    best = F.max(F.struct("z", (-F.col("row")).alias("r"), (-F.col("col")).alias("c")))
    return inside.groupBy("field_id", "grain").agg(best.alias("b")).select("field_id", "grain", F.col("b.z").alias("radius"), (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"))


def grow_by_distance(mask: DataFrame, radius: float) -> DataFrame:
    """Pixels no further than ``radius`` from a marked one marked."""
    outside = distance_transform(mask.withColumn("m", (F.col("m") <= 0).cast("double")), from_border=False)
    return mask.join(outside.select(*PLACE, F.col("z").alias("_d")), PLACE).withColumn("m", (F.col("_d") <= radius).cast("double")).drop("_d")


def shrink_by_distance(mask: DataFrame, radius: float, from_border: bool = True) -> DataFrame:
    """Marked pixels no further than ``radius`` from an unmarked one unmarked."""
    inside = distance_transform(mask, from_border=from_border)
    return mask.join(inside.select(*PLACE, F.col("z").alias("_d")), PLACE).withColumn("m", (F.col("_d") > radius).cast("double")).drop("_d")
