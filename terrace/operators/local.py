"""What the square around each pixel looks like: its least-squares plane, and direction and roughness of that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.arithmetic import PLACE, per_field


def _span(at: str, last: str, before: int, after: int) -> tuple[Column, Column, Column]:
    """Mean place, variance of places and number of places, relative to a pixel, of the window as the field's edge cuts it."""
    low = F.greatest(F.lit(-before), -F.col(at))
    high = F.least(F.lit(after), F.col(last) - F.col(at))
    n = high - low + 1
    return (low + high) / 2, (n * n - 1) / 12, n.cast("double")


def _sums(axis: str, before: int, after: int, plain: dict[str, str], weighed: dict[str, str]) -> dict[str, Column]:
    """For each ``name: column`` the sum over the window along an axis, of the column or of it times its distance."""
    other = "row" if axis == "col" else "col"
    order = Window.partitionBy("field_id", other).orderBy(axis)
    zero = F.lit(0.0)

    def shifted(c: str, d: int) -> Column:
        return F.col(c) if d == 0 else F.coalesce(F.lead(c, d).over(order) if d > 0 else F.lag(c, -d).over(order), zero)

    steps = range(-before, after + 1)
    out = {name: sum((shifted(c, d) for d in steps), zero) for name, c in plain.items()}
    return out | {name: sum((float(d) * shifted(c, d) for d in steps if d), zero) for name, c in weighed.items()}


def planes(field: DataFrame, size: int) -> DataFrame:
    """``field_id, row, col, mean, bx, by, angle, slope, s0, s0_reduced``: the plane of the ``size`` by ``size`` square around each pixel.

    ``mean`` is the square's mean, ``bx`` and ``by`` are slopes along columns and rows, ``angle`` and ``slope`` the
    same as direction and steepness, ``s0`` the sum of squares that the plane leaves, ``s0_reduced`` that
    divided by the square of the plane's stretch. An even square reaches further right and down. Squares end at
    the field's edge; one of a single row or column has no slope along the other. All pixels must have
    values. The sums are two passes of windows, along rows and then along columns.
    """
    before, after = (size - 1) // 2, size // 2
    known = per_field(field.select(*PLACE, "z"), F.avg("z").alias("_mean"), F.max("col").alias("_w"), F.max("row").alias("_h"))
    known = known.withColumn("_z", F.col("z") - F.col("_mean")).withColumn("_zz", F.col("_z") * F.col("_z"))
    rows = known.withColumns(_sums("col", before, after, {"_s": "_z", "_q": "_zz"}, {"_t": "_z"}))
    both = rows.withColumns(_sums("row", before, after, {"_sum": "_s", "_squares": "_q", "_across": "_t"}, {"_down": "_s"}))
    (mx, vx, nx), (my, vy, ny) = _span("col", "_w", before, after), _span("row", "_h", before, after)
    n, none = nx * ny, F.lit(0.0)
    mean = F.col("_sum") / n
    bx = F.coalesce(F.try_divide(F.col("_across") / n - mx * mean, vx), none)
    by = F.coalesce(F.try_divide(F.col("_down") / n - my * mean, vy), none)
    fitted = both.select(*PLACE, "_mean", "_squares", n.alias("_n"), mean.alias("_m"), bx.alias("bx"), by.alias("by"), vx.alias("_vx"), vy.alias("_vy"))
    left = F.col("_squares") - F.col("_n") * (F.col("_m") ** 2 + F.col("bx") ** 2 * F.col("_vx") + F.col("by") ** 2 * F.col("_vy"))
    made = fitted.select(*PLACE, (F.col("_mean") + F.col("_m")).alias("mean"), "bx", "by", F.atan2("by", "bx").alias("angle"), F.hypot("bx", "by").alias("slope"), F.greatest(left, none).alias("s0"))
    return made.withColumn("s0_reduced", F.col("s0") / (1 + F.col("slope") ** 2))
