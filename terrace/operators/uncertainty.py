"""Uncertainties of what is computed from a field, from an uncertainty ``u`` of each pixel's value (independent ones)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.selection import Masking, Region, selected
from terrace.operators.arithmetic import PLACE, per_field
from terrace.operators.statistics import upper_median


def summary(field: DataFrame, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    """``field_id, u_min, u_max, u_mean, u_rms, u_median`` over the chosen pixels.

    An extreme and the median have the uncertainty of their pixel: the first in scan
    order of equal extremes, the least uncertain of equal middle values.
    """
    chosen = field.where(selected(region, masking)).select(*PLACE, "z", "u")
    known = per_field(chosen, F.avg("z").alias("mean"), F.stddev_pop("z").alias("rms"))
    scan = F.struct("row", "col")
    d = (F.col("z") - F.col("mean")) * F.col("u")
    first = known.groupBy("field_id").agg(
        F.min_by("u", F.struct("z", scan)).alias("u_min"),
        F.max_by("u", F.struct("z", -F.col("row"), -F.col("col"))).alias("u_max"),
        (F.sqrt(F.sum(F.col("u") * F.col("u"))) / F.count("u")).alias("u_mean"),
        F.try_divide(F.sqrt(F.sum(d * d)) / F.count("u"), F.first("rms")).alias("u_rms"),
    )
    middle = upper_median(chosen, ["field_id"])
    at = chosen.join(F.broadcast(middle) if middle.limit(1001).count() <= 1000 else middle, "field_id").where("z = median")
    return first.join(at.groupBy("field_id").agg(F.min("u").alias("u_median")), "field_id")


def derivative(field: DataFrame, direction: str = "x", step: float = 1.0) -> DataFrame:
    """The uncertainty of central differences, one-sided at the border, as ``z``."""
    part, order = ("row", "col") if direction == "x" else ("col", "row")
    line = Window.partitionBy("field_id", part).orderBy(order)
    before, after = F.lag("u").over(line), F.lead("u").over(line)
    span = (F.when(before.isNull(), 0).otherwise(1) + F.when(after.isNull(), 0).otherwise(1)) * step
    return field.select(*PLACE, F.try_divide(F.hypot(F.coalesce(after, F.col("u")), F.coalesce(before, F.col("u"))), span).alias("z"))


def cumulate(lines: DataFrame) -> DataFrame:
    """The uncertainty of a line's running sum: ``line_id, i, u``."""
    order = Window.partitionBy("line_id").orderBy("i")
    return lines.select("line_id", "i", F.sqrt(F.sum(F.col("u") * F.col("u")).over(order)).alias("u"))
