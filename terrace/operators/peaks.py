"""Peaks of a field, one for each surrounding, and votes for circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators import grains, points
from terrace.operators.arithmetic import PLACE, per_field
from terrace.plans.durable import durable, written

_SHIFT = 31


def maxima(field: DataFrame, count: int = 10, skip: float = 1.0, threshold: float | None = None) -> DataFrame:
    """``field_id, rank, row, col, z, x, y``: the ``count`` highest peaks, none nearer than ``skip`` pixels to a higher one kept.

    Peaks are pixels above all eight neighbours, and above ``threshold`` if there is one. The higher goes
    first, of equal ones the first by rows; a peak that is taken strikes out all others no further than
    ``skip``. ``x`` and ``y`` are the column and row refined by a parabola through the neighbours.

    Each round takes all peaks that have no higher one left around them, which comes to
    the same as one after another.
    """
    found = grains.extrema(field)
    if threshold is not None:
        found = found.where(F.col("z") > threshold)
    name = F.shiftleft(F.col("row").cast("long"), _SHIFT) + F.col("col")
    spots = durable(found.select(F.col("field_id").alias("surface_id"), name.alias("pt_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "z"))
    height = lambda side: spots.select("surface_id", F.col("pt_id").alias(f"{side}_id"), F.col("z").alias(f"{side}_z"))
    key = ["surface_id", "pt_id"]
    pairs = points.within(spots, spots, skip).where("left_id != right_id").join(height("left"), ["surface_id", "left_id"]).join(height("right"), ["surface_id", "right_id"])
    over = durable(pairs.where("right_z > left_z or (right_z = left_z and right_id < left_id)").select("surface_id", F.col("left_id").alias("pt_id"), "right_id"))
    left, kept, turn = spots.select(*key), None, 0
    while True:
        alive = over.join(left.withColumnRenamed("pt_id", "right_id"), ["surface_id", "right_id"], "left_semi").select(*key).distinct()
        top = durable(left.join(alive, key, "left_anti"))
        if top.isEmpty():
            break
        kept = top if kept is None else kept.union(top)
        struck = over.join(top.withColumnRenamed("pt_id", "right_id"), ["surface_id", "right_id"], "left_semi").select(*key).distinct()
        turn += 1
        left = (written if turn % 4 == 0 else durable)(left.join(top, key, "left_anti").join(struck, key, "left_anti"))
    chosen = spots if kept is None else spots.join(kept, key, "left_semi")
    order = Window.partitionBy("surface_id").orderBy(F.desc("z"), "pt_id")
    best = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    best = best.select(F.col("surface_id").alias("field_id"), "rank", F.col("y").cast("int").alias("row"), F.col("x").cast("int").alias("col"), "z")
    across, down = Window.partitionBy("field_id", "row").orderBy("col"), Window.partitionBy("field_id", "col").orderBy("row")
    beside = field.select(*PLACE, *(of("z").over(w).alias(n) for n, of, w in (("_l", F.lag, across), ("_r", F.lead, across), ("_u", F.lag, down), ("_d", F.lead, down))))
    refined = lambda at, a, b: F.coalesce(F.col(at) + F.try_divide(F.col(a) - F.col(b), F.col(a) - 2 * F.col("z") + F.col(b)) / 2, F.col(at).cast("double"))
    near = best.join(beside, PLACE)
    return near.select("field_id", "rank", "row", "col", "z", refined("col", "_l", "_r").alias("x"), refined("row", "_u", "_d").alias("y"))


def ring(radius: int) -> list[tuple[int, int]]:
    """Steps (rows, columns) whose length rounds to ``radius``."""
    reach = range(-radius - 1, radius + 2)
    return [(r, c) for r in reach for c in reach if (2 * radius - 1) ** 2 <= 4 * (r * r + c * c) < (2 * radius + 1) ** 2 and radius > 0]


def hough_circles(mask: DataFrame, radius: int) -> DataFrame:
    """``field_id, row, col, z``: for every pixel how many marked ones lie on the circle of ``radius`` pixels around it.

    A marked pixel votes for the centres on its own ring; votes are summed before they are shuffled.
    """
    if radius < 1:
        raise ValueError("the radius must be at least one pixel")
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ring(radius)))
    sized = per_field(mask.select(*PLACE, "m"), F.max("row").alias("_h"), F.max("col").alias("_w"))
    votes = sized.where("m > 0").withColumn("_s", F.explode(steps))
    votes = votes.select("field_id", (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), "_h", "_w").where("row between 0 and _h and col between 0 and _w")
    counted = votes.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n"))
    return mask.select(*PLACE).join(counted, PLACE, "left").select(*PLACE, F.coalesce("_n", F.lit(0)).cast("double").alias("z"))
