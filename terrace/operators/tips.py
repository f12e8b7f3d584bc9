"""Probe tips: model shapes, and dilation and erosion of a surface by one."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.arithmetic import PLACE
from terrace.operators.filters import patches
from terrace.operators.geometry import extend
from terrace.plans.durable import durable


def paraboloid(size: int, curvature: float) -> list[float]:
    """Heights of a parabolic tip below its apex, row by row, for an odd ``size``."""
    r = size // 2
    return [-curvature * (x * x + y * y) / 2 for y in range(-r, r + 1) for x in range(-r, r + 1)]


def cone(size: int, slope: float) -> list[float]:
    r = size // 2
    return [-slope * math.hypot(x, y) for y in range(-r, r + 1) for x in range(-r, r + 1)]


def pyramid(size: int, slope: float) -> list[float]:
    """A four-sided tip."""
    r = size // 2
    return [-slope * max(abs(x), abs(y)) for y in range(-r, r + 1) for x in range(-r, r + 1)]


def _combined(field: DataFrame, tip: Sequence[float], sign: int) -> DataFrame:
    size = math.isqrt(len(tip))
    if size * size != len(tip) or size % 2 == 0:
        raise ValueError("the tip must be square, of an odd side")
    r = size // 2
    wide = patches(extend(field, r, r, r, r, "edge"), size, size).where(F.size("patch") == size * size)
    moved = wide.withColumns({"row": F.col("row") - r, "col": F.col("col") - r})
    values = [F.get("patch", F.lit(i)) + sign * float(h) for i, h in enumerate(tip)]
    return moved.select(*PLACE, (F.greatest(*values) if sign > 0 else F.least(*values)).alias("z"))


def dilate(field: DataFrame, tip: Sequence[float]) -> DataFrame:
    """The image that a tip makes of a surface; the border pixel repeats outside."""
    return _combined(field, tip, 1)


def erode(field: DataFrame, tip: Sequence[float]) -> DataFrame:
    """What of a surface can be told from its image."""
    return _combined(field, tip[::-1], -1)


def certain(image: DataFrame, tip: Sequence[float], tolerance: float = 1e-9) -> DataFrame:
    """``image`` with mask ``m`` of the pixels that dilating the eroded image gives again."""
    back = dilate(erode(image, tip), tip).select(*PLACE, F.col("z").alias("_b"))
    return image.join(back, PLACE).withColumn("m", (F.abs(F.col("z") - F.col("_b")) <= tolerance).cast("double")).drop("_b")


def blind_estimate(image: DataFrame, size: int, threshold: float = 0.0, rounds: int = 1000) -> list[float]:
    """Heights below its apex of the bluntest tip of an odd ``size`` that can have made ``image``, row by row.

    Every pixel of the image was touched by some part of the tip. So for a pixel and
    each part that can have touched it, the tip can reach no higher than the image around allows; the
    least of the greatest of these over all pixels bounds the tip, and rounds go on
    until no bound falls by more than ``threshold``, which is added to it. A round is one aggregation that
    sends a minimum for each of the tip's pixels. Pixels nearer than ``size`` to the border are left out;
    a smaller image bounds nothing and gives zeros.
    """
    if size % 2 == 0 or size < 1:
        raise ValueError("the tip must be of an odd side")
    wide, centre = 2 * size - 1, size // 2
    spots = durable(patches(image.select(*PLACE, "z"), wide, wide).where(F.size("patch") == wide * wide).select("patch"))
    tip = np.zeros((size, size))

    def bounds(tip: np.ndarray) -> DataFrame:
        def run(batches):
            least = np.full((size, size), np.inf)
            for batch in batches:
                values = np.asarray(batch.column(0).flatten()).reshape(-1, wide, wide)
                for at in range(0, len(values), 4096):
                    part = values[at : at + 4096]
                    here = part[:, size - 1, size - 1]
                    most = np.full((len(part), size, size), -np.inf)
                    for j in range(size):
                        for i in range(size):
                            touches = here - part[:, size - 1 + centre - j, size - 1 + centre - i] <= tip[j, i]
                            around = part[:, size - 1 - j : wide - j, size - 1 - i : wide - i]
                            most[touches] = np.maximum(most[touches], around[touches] + tip[j, i] - here[touches, None, None])
                    most[np.isneginf(most)] = np.inf
                    if len(most):
                        least = np.minimum(least, most.min(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(least.ravel())], ["k", "least"])

        return spots.mapInArrow(run, "k long, least double").groupBy("k").agg(F.min("least").alias("least"))

    for _ in range(rounds):
        found = {r["k"]: r["least"] for r in bounds(tip).collect()}  # one number for each of the tip's pixels
        least = np.array([found.get(k, np.inf) for k in range(size * size)]).reshape(size, size)
        lower = least < tip - threshold
        if not lower.any():
            break
        tip = np.where(lower, least + threshold, tip)
    return tip.ravel().tolist()
