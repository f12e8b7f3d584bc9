"""Masked pixels filled by the Laplace equation: each becomes the mean of its neighbours.

Grains of the mask do not touch, so each is a linear system of its own, whose right side
are the unmasked pixels around. Grains of up to ``LOCAL`` pixels are solved in one task
each. Larger ones stay spread over rows of pixels: conjugate gradients, whose sums are one
aggregation by grain and whose preconditioner solves each tile of the grain by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators import grains as grain_ops
from terrace.operators.arithmetic import PLACE
from terrace.plans.durable import durable, maybe_broadcast, written
from terrace.plans.lines import Line, map_lines

#: Pixels of a grain that one task may solve: eight arrays of so many doubles.
LOCAL = 1_000_000
TILE = 256
#: A solution's largest residual, as a share of the largest boundary value.
PRECISION = 1e-11
_DENSE = 150


def _neighbours(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of pixels that share an edge."""
    row, col = row.astype(np.int64), col.astype(np.int64)
    wide = int(col.max()) + 2
    key = row * wide + col
    order = np.argsort(key)
    ranked = key[order]
    pairs = []
    for step in (1, wide):
        at = np.searchsorted(ranked, key + step)
        hit = (at < len(key)) & (ranked[np.minimum(at, len(key) - 1)] == key + step)
        pairs.append((np.flatnonzero(hit), order[at[hit]]))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def solve_pixels(row: np.ndarray, col: np.ndarray, degree: np.ndarray, b: np.ndarray, precision: float = PRECISION) -> np.ndarray:
    """x with ``degree * x - sum of x at neighbours among these pixels = b``: directly if few, else by conjugate gradients."""
    n = len(b)
    if n == 1:
        return b / degree
    i, j = _neighbours(row, col)
    if n <= _DENSE:
        a = np.diag(degree.astype(float))
        a[i, j] = a[j, i] = -1.0
        return np.linalg.solve(a, b)

    def times(v: np.ndarray) -> np.ndarray:
        return degree * v - np.bincount(i, v[j], n) - np.bincount(j, v[i], n)

    x = np.zeros(n)
    r = b.astype(float)
    y = r / degree
    p, ry = y, r @ y
    least = precision * max(float(np.abs(b).max()), 1e-300)
    for _ in range(10 * n):
        if np.abs(r).max() <= least:
            break
        q = times(p)
        step = ry / (p @ q)
        x = x + step * p
        r = r - step * q
        y = r / degree
        ry, before = r @ y, ry
        p = y + (ry / before) * p
    return x


def _beside(value: Column, same: list[str]) -> list[Column]:
    """``value`` of the four pixels that share an edge, null where there is none."""
    across = Window.partitionBy("field_id", *same, "row").orderBy("col")
    down = Window.partitionBy("field_id", *same, "col").orderBy("row")
    out = []
    for order, place in ((across, "col"), (down, "row")):
        for step, of in ((-1, F.lag), (1, F.lead)):
            out.append(F.when(of(place).over(order) == F.col(place) + step, of(value).over(order)))
    return out


def _systems(field: DataFrame) -> DataFrame:
    """``field_id, grain, row, col, degree, b``: the equation of each marked pixel."""
    spots = field.select(*PLACE, "z", (F.col("m") > 0).alias("m"))
    four = _beside(F.struct(F.col("z").alias("z"), F.col("m").alias("m")), [])
    # Neighbours along rows and along columns in one select: two windows, two shuffles.
    around = spots.select(*PLACE, "m", *(c.alias(f"_{k}") for k, c in enumerate(four))).where("m")
    degree = sum((F.col(f"_{k}").isNotNull().cast("int") for k in range(4)), F.lit(0))
    b = sum((F.when(~F.col(f"_{k}.m"), F.col(f"_{k}.z")).otherwise(F.lit(0.0)) for k in range(1, 4)), F.when(~F.col("_0.m"), F.col("_0.z")).otherwise(F.lit(0.0)))
    return around.select(*PLACE, degree.alias("degree"), b.alias("b"), (sum((F.coalesce(~F.col(f"_{k}.m"), F.lit(False)).cast("int") for k in range(4)), F.lit(0))).alias("edges"))


def _totals(state: DataFrame) -> DataFrame:
    """By grain: the residual's product with its preconditioned self, and its largest value."""
    return state.groupBy("field_id", "grain").agg(F.sum(F.col("r") * F.col("y")).alias("rho"), F.max(F.abs("r")).alias("worst"))


def _by_tile(state: DataFrame, value: str, tile: int) -> DataFrame:
    """``state`` with ``y``: each tile's own system solved for the column ``value``."""
    dealt = state.withColumns({"_tr": F.expr(f"row div {tile}"), "_tc": F.expr(f"col div {tile}")})

    def solve(line: Line) -> Line:
        return {"row": line["row"], "col": line["col"], "y": solve_pixels(line["row"], line["col"], line["degree"], line[value], 1e-13)}

    keys = ["field_id", "grain", "_tr", "_tc"]
    solved = map_lines(dealt, keys, ["row", "col"], ["row", "col", "degree", value], solve, "row int, col int, y double")
    return state.join(solved.select("field_id", "grain", "row", "col", "y"), ["field_id", "grain", "row", "col"])


def _spread(system: DataFrame, tile: int, precision: float) -> DataFrame:
    """Preconditioned conjugate gradients over rows of pixels, all grains at once."""
    key = ["field_id", "grain"]
    scale = durable(system.groupBy(*key).agg((F.max(F.abs("b")) * precision).alias("least")))
    state = durable(_by_tile(system.select(*PLACE, "grain", "degree", F.lit(0.0).alias("x"), F.col("b").alias("r")), "r", tile).withColumn("p", F.col("y")))
    ends = durable(_totals(state).join(scale, key))
    for turn in range(100_000):
        if ends.where("worst > least").isEmpty():
            return state.select(*PLACE, "x")
        rho = maybe_broadcast(ends.select(*key, "rho"), 64)
        q = F.col("degree") * F.col("p") - sum((F.coalesce(c, F.lit(0.0)) for c in _beside(F.col("p"), ["grain"])), F.lit(0.0))
        state = durable(state.drop("y").withColumn("q", q))
        energy = durable(state.groupBy(*key).agg(F.sum(F.col("p") * F.col("q")).alias("energy")))
        step = energy.join(rho, key).select(*key, F.coalesce(F.try_divide("rho", "energy"), F.lit(0.0)).alias("step"))
        moved = state.join(maybe_broadcast(step, 64), key)
        moved = moved.withColumns({"x": F.col("x") + F.col("step") * F.col("p"), "r": F.col("r") - F.col("step") * F.col("q")}).drop("step", "q")
        state = durable(_by_tile(moved, "r", tile))
        if turn % 2 == 1:
            state = written(state)
        new = written(_totals(state).withColumnRenamed("rho", "new").join(rho, key).join(scale, key))
        ratio = maybe_broadcast(new.select(*key, F.coalesce(F.try_divide("new", "rho"), F.lit(0.0)).alias("ratio")), 64)
        state = state.join(ratio, key).withColumn("p", F.col("y") + F.col("ratio") * F.col("p")).drop("ratio")
        ends = new.select(*key, F.col("new").alias("rho"), "worst", "least")
    raise RuntimeError("the solution did not settle")


def fill(field: DataFrame, local: int = LOCAL, tile: int = TILE, precision: float = PRECISION) -> DataFrame:
    """``field_id, row, col, z``: marked pixels (``m > 0``) solved from the others, which stay.

    A pixel at the border has fewer neighbours, so the solution is flat across it. A grain
    that no unmarked pixel touches, which is a whole field, becomes 0. Pixels are joined
    over edges; an unmarked neighbour must have a value.
    """
    field = durable(field.select(*PLACE, "z", "m"))
    system = durable(grain_ops.number(field).join(_systems(field), PLACE))
    sizes = durable(system.groupBy("field_id", "grain").agg(F.count(F.lit(1)).alias("n"), F.sum("edges").alias("edges")).where("edges > 0"))
    key = ["field_id", "grain"]

    def solve(line: Line) -> Line:
        return {"row": line["row"], "col": line["col"], "x": solve_pixels(line["row"], line["col"], line["degree"], line["b"], precision)}

    few = system.join(maybe_broadcast(sizes.where(F.col("n") <= local).select(*key), 32), key)
    solved = map_lines(few, key, ["row", "col"], ["row", "col", "degree", "b"], solve, "row int, col int, x double").select(*PLACE, "x")
    large = sizes.where(F.col("n") > local).select(*key)
    if not large.isEmpty():
        solved = solved.union(_spread(written(system.join(maybe_broadcast(large, 32), key)), tile, precision))
    return field.join(solved, PLACE, "left").select(*PLACE, F.when(F.col("m") > 0, F.coalesce("x", F.lit(0.0))).otherwise(F.col("z")).alias("z"))
