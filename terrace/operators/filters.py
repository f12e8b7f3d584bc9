"""Filters over a window around each pixel.

Sums and extremes of rectangles go over rows and then over columns, two shuffles
whatever the window's size. Filters that need the values themselves gather the window's
patch the same way, in arrays no larger than the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.arithmetic import PLACE, per_field

# The usual 3 by 3 kernels, row by row.
KERNELS = {
    "sobel_x": (1, 0, -1, 2, 0, -2, 1, 0, -1),
    "sobel_y": (1, 2, 1, 0, 0, 0, -1, -2, -1),
    "prewitt_x": (1, 0, -1, 1, 0, -1, 1, 0, -1),
    "prewitt_y": (1, 1, 1, 0, 0, 0, -1, -1, -1),
    "laplace": (0, 1, 0, 1, -4, 1, 0, 1, 0),
}

# 5 by 5 kernels, row by row, with the number that divides them.
KERNELS_5 = {
    "laplace_gauss": ((1, -12, 3, -12, 1, -12, 78, 167, 78, -12, 3, 167, -902, 167, 3, -12, 78, 167, 78, -12, 1, -12, 3, -12, 1), 1),
    "dechecker": ((0, 1, -2, 1, 0, 1, -8, 16, -8, 1, -2, 16, 112, 16, -2, 1, -8, 16, -8, 1, 0, 1, -2, 1, 0), 144),
}


def _across(size: int):
    return Window.partitionBy("field_id", "row").orderBy("col").rowsBetween(-((size - 1) // 2), size // 2)


def _down(size: int):
    return Window.partitionBy("field_id", "col").orderBy("row").rowsBetween(-((size - 1) // 2), size // 2)


def mean(field: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """Mean of the window's pixels that are in the field."""
    height = height or width
    one = field.select(*PLACE, F.sum("z").over(_across(width)).alias("s"), F.count("z").over(_across(width)).alias("n"))
    return one.select(*PLACE, (F.sum("s").over(_down(height)) / F.sum("n").over(_down(height))).alias("z"))


def local_rms(field: DataFrame, size: int) -> DataFrame:
    """Standard deviation within the window."""
    centred = per_field(field, F.avg("z").alias("_mean")).select(*PLACE, (F.col("z") - F.col("_mean")).alias("z"))
    sums = {"s": F.sum("z"), "s2": F.sum(F.col("z") * F.col("z")), "n": F.count("z")}
    one = centred.select(*PLACE, *(c.over(_across(size)).alias(k) for k, c in sums.items()))
    s, s2, n = (F.sum(k).over(_down(size)) for k in ("s", "s2", "n"))
    return one.select(*PLACE, F.sqrt(F.greatest(s2 / n - (s / n) * (s / n), F.lit(0.0))).alias("z"))


def _extreme(field: DataFrame, size: int, of) -> DataFrame:
    one = field.select(*PLACE, of("z").over(_across(size)).alias("z"))
    return one.select(*PLACE, of("z").over(_down(size)).alias("z"))


def minimum(field: DataFrame, size: int) -> DataFrame:
    """Erosion by a square."""
    return _extreme(field, size, F.min)


def maximum(field: DataFrame, size: int) -> DataFrame:
    """Dilation by a square."""
    return _extreme(field, size, F.max)


def opening(field: DataFrame, size: int) -> DataFrame:
    return maximum(minimum(field, size), size)


def closing(field: DataFrame, size: int) -> DataFrame:
    return minimum(maximum(field, size), size)


def local_range(field: DataFrame, size: int) -> DataFrame:
    """Largest minus smallest value within the window."""
    low, high = F.min("z").over(_across(size)), F.max("z").over(_across(size))
    one = field.select(*PLACE, low.alias("low"), high.alias("high"))
    return one.select(*PLACE, (F.max("high").over(_down(size)) - F.min("low").over(_down(size))).alias("z"))


def patches(field: DataFrame, width: int, height: int) -> DataFrame:
    """``field`` with ``patch``, the window's values row by row; shorter at the border."""
    one = field.withColumn("_line", F.collect_list("z").over(_across(width)))
    return one.withColumn("patch", F.flatten(F.collect_list("_line").over(_down(height)))).drop("_line")


def _element(values: Column, at: Column) -> Column:
    return F.get(F.array_sort(values), at.cast("int"))


def median(field: DataFrame, size: int) -> DataFrame:
    """Upper median of the window's pixels that are in the field."""
    return patches(field, size, size).select(*PLACE, _element(F.col("patch"), F.floor(F.size("patch") / 2)).alias("z"))


def rank(field: DataFrame, size: int) -> DataFrame:
    """Part of the window below the pixel, equals counting half."""
    z, patch = F.col("z"), F.col("patch")
    below, upto = F.size(F.filter(patch, lambda v: v < z)), F.size(F.filter(patch, lambda v: v <= z))
    return patches(field, size, size).select(*PLACE, ((below + upto) / (2.0 * F.size("patch"))).alias("z"))


def conservative(field: DataFrame, size: int = 3) -> DataFrame:
    """Pixels outside the range of their neighbours moved to its end."""
    z, patch = F.col("z"), F.array_sort("patch")
    n = F.size("patch")
    low = F.when(z == F.get(patch, F.lit(0)), F.get(patch, F.lit(1))).otherwise(F.get(patch, F.lit(0)))
    high = F.when(z == F.get(patch, n - 1), F.get(patch, n - 2)).otherwise(F.get(patch, n - 1))
    return patches(field, size, size).select(*PLACE, F.when(n > 1, F.least(F.greatest(z, low), high)).otherwise(z).alias("z"))


def trimmed_mean(field: DataFrame, size: int, drop: int) -> DataFrame:
    """Mean of the window without its ``drop`` smallest and largest values; all of it where fewer would be left than one."""
    n = F.size("patch")
    kept = F.when(n > 2 * drop, F.slice(F.array_sort("patch"), F.lit(drop + 1), F.greatest(n - 2 * drop, F.lit(1)))).otherwise(F.col("patch"))
    return patches(field, size, size).withColumn("_kept", kept).select(*PLACE, (F.aggregate("_kept", F.lit(0.0), lambda a, v: a + v) / F.size("_kept")).alias("z"))


def _mirrored(of: Column, w: Window, at: str, before: int, after: int) -> list[Column]:
    """``of`` of the pixels from ``before`` places back to ``after`` places ahead in a line, mirrored at half samples."""
    reach = max(before, after)
    size = F.max(at).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1
    near = [F.lag(of, -k).over(w) if k < 0 else F.lead(of, k).over(w) if k else of for k in range(-reach, reach + 1)]
    out = []
    for k in range(-before, after + 1):
        turn = F.pmod(F.col(at) + k, 2 * size)
        # A mirrored place is no further away than the place itself.
        image = F.least(turn, 2 * size - 1 - turn) - F.col(at)
        own = (F.col(at) + k >= 0) & (F.col(at) + k < size)
        out.append(F.when(own, near[k + reach]).otherwise(F.get(F.array(*near), image + reach)) if k else of)
    return out


def convolved(field: DataFrame, kernels: dict[str, Sequence[float]], width: int, height: int) -> DataFrame:
    """``field_id, row, col`` and a column for each kernel, as ``convolve`` makes it: all from one gathering of the window.

    The window is gathered along rows, then along columns; an axis of one pixel is not gathered.
    """
    across = Window.partitionBy("field_id", "row").orderBy("col")
    down = Window.partitionBy("field_id", "col").orderBy("row")
    line = [F.col("z")] if width == 1 else _mirrored(F.col("z"), across, "col", (width - 1) // 2, width // 2)
    rows = field.select(*PLACE, F.array(*line).alias("_line"))
    whole = rows.select(*PLACE, F.array(*([F.col("_line")] if height == 1 else _mirrored(F.col("_line"), down, "row", (height - 1) // 2, height // 2))).alias("_lines"))
    value = lambda i: F.get(F.get("_lines", F.lit(i // width)), F.lit(i % width))
    terms = {name: sum((float(k) * value(i) for i, k in enumerate(kernel) if k), F.lit(0.0)) for name, kernel in kernels.items()}
    return whole.select(*PLACE, *(t.alias(name) for name, t in terms.items()))


def convolve(field: DataFrame, kernel: Sequence[float], width: int, height: int) -> DataFrame:
    """Sum of the kernel times the window, borders mirrored; the kernel is not flipped."""
    return convolved(field, {"z": kernel}, width, height)


def kernel3(field: DataFrame, name: str) -> DataFrame:
    """One of the named 3 by 3 kernels."""
    return convolve(field, KERNELS[name], 3, 3)


def kernel5(field: DataFrame, name: str) -> DataFrame:
    """One of the named 5 by 5 kernels: ``laplace_gauss`` for edges, ``dechecker`` against patterns of single pixels."""
    kernel, divisor = KERNELS_5[name]
    return convolve(field, [k / divisor for k in kernel], 5, 5)


def gradient(field: DataFrame, kind: str = "sobel") -> DataFrame:
    """Size of the gradient by Sobel's or Prewitt's kernels."""
    return total(field, f"{kind}_x", f"{kind}_y")


def gaussian(field: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing, cut at four sigma, borders mirrored; over rows, then over columns."""
    import math

    reach = max(1, math.ceil(4 * sigma))
    weights = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]
    return convolve(convolve(field, weights, len(weights), 1), weights, 1, len(weights))


def derivative(field: DataFrame, direction: str = "x", step: float = 1.0) -> DataFrame:
    """Central differences, one-sided at the border."""
    w = Window.partitionBy("field_id", "row").orderBy("col") if direction == "x" else Window.partitionBy("field_id", "col").orderBy("row")
    before, after = F.lag("z").over(w), F.lead("z").over(w)
    span = (F.when(before.isNull(), 0).otherwise(1) + F.when(after.isNull(), 0).otherwise(1)) * step
    return field.select(*PLACE, F.coalesce(F.try_divide(F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z")), span), F.lit(0.0)).alias("z"))


def slope(field: DataFrame) -> DataFrame:
    """``field_id, row, col, slope, direction`` by central differences, one-sided at the border; the direction points downhill."""
    x, y = derivative(field, "x").select(*PLACE, F.col("z").alias("_x")), derivative(field, "y").select(*PLACE, F.col("z").alias("_y"))
    return x.join(y, PLACE).select(*PLACE, F.hypot("_x", "_y").alias("slope"), F.atan2(-F.col("_y"), -F.col("_x")).alias("direction"))


def total(field: DataFrame, across: str, down: str) -> DataFrame:
    """Length of the two kernels' results, as ``prewitt_x`` and ``prewitt_y``."""
    both = convolved(field, {"_x": KERNELS[across], "_y": KERNELS[down]}, 3, 3)
    return both.select(*PLACE, F.hypot("_x", "_y").alias("z"))


def kuwahara(field: DataFrame) -> DataFrame:
    """Edge-keeping smoothing: the mean of that 3 by 3 square, of the four with the pixel at a corner, of least variance.

    The first of equal ones counts, in the order of rows and columns; pixels nearer than two to the border stay.
    """
    across = Window.partitionBy("field_id", "row").orderBy("col")
    down = Window.partitionBy("field_id", "col").orderBy("row")
    z = F.col("z")
    rows = field.withColumns({"_s": sum((F.lag("z", k).over(across) for k in (1, -1)), z), "_q": sum((F.lag(z * z, k).over(across) for k in (1, -1)), z * z)})
    squares = rows.withColumns({f"_{c}{c}": sum((F.lag(f"_{c}", k).over(down) for k in (1, -1)), F.col(f"_{c}")) for c in "sq"})
    square = F.struct((F.col("_qq") / 9 - (F.col("_ss") / 9) ** 2).alias("v"), (F.col("_ss") / 9).alias("m"))
    sides = squares.withColumn("_v", F.when(F.col("_ss").isNotNull(), square)).withColumns({"_l": F.lag("_v").over(across), "_r": F.lead("_v").over(across)})
    corners = sides.withColumns({"_a": F.lag("_l").over(down), "_b": F.lag("_r").over(down), "_c": F.lead("_l").over(down), "_d": F.lead("_r").over(down)})
    four = F.array(*(F.struct(F.col(f"_{c}.v").alias("v"), F.lit(i).alias("i"), F.col(f"_{c}.m").alias("m")) for i, c in enumerate("abcd")))
    full = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_c").isNotNull() & F.col("_d").isNotNull()
    return corners.select(*PLACE, F.when(full, F.array_min(four)["m"]).otherwise(z).alias("z"))
