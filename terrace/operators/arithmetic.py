"""Pixel by pixel: scalar maps, arithmetic of two fields, compatibility, user expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import formulas
from terrace.functions.selection import Masking, Region, selected
from terrace.plans.durable import maybe_broadcast

PLACE = ["field_id", "row", "col"]


def combine(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Pixel-wise ``sum, subtract, multiply, divide, min, max, hypot`` of two fields of one shape; ``x / 0`` is null."""
    a, b = F.col("z"), F.col("_other")
    result = {
        "sum": a + b,
        "subtract": a - b,
        "multiply": a * b,
        "divide": F.try_divide(a, b),
        "min": F.least(a, b),
        "max": F.greatest(a, b),
        "hypot": F.hypot(a, b),
    }[how]
    return left.join(right.select(*PLACE, F.col("z").alias("_other")), PLACE).select(*PLACE, result.alias("z"))


def evaluate(operands: dict[str, DataFrame], expression: str) -> DataFrame:
    """A Spark SQL expression over several fields of one shape, named by the keys of ``operands``; ``x`` and ``y`` are column and row."""
    frames = iter(operands.items())
    name, first = next(frames)
    joined = first.select(*PLACE, F.col("z").alias(name))
    for name, frame in frames:
        joined = joined.join(frame.select(*PLACE, F.col("z").alias(name)), PLACE)
    bound = joined.withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    return bound.select(*PLACE, F.expr(expression).cast("double").alias("z"))


def calculate(operands: dict[str, DataFrame], formula: str) -> DataFrame:
    """A formula (``terrace.functions.formulas``) over several fields of one shape, named by the keys of ``operands``; ``x`` and ``y`` are column and row."""
    joined = None
    for name, frame in operands.items():
        own = frame.select(*PLACE, F.col("z").alias(name))
        joined = own if joined is None else joined.join(own, PLACE)
    values = {name: F.col(name) for name in operands} | {"x": F.col("col").cast("double"), "y": F.col("row").cast("double")}
    return joined.select(*PLACE, formulas.column(formula, values).cast("double").alias("z"))


def shapes(field: DataFrame) -> DataFrame:
    """``field_id, xres, yres`` of each field."""
    return field.groupBy("field_id").agg((F.max("col") + 1).alias("xres"), (F.max("row") + 1).alias("yres"))


def incompatibility(left: DataFrame, right: DataFrame, tolerance: float = 5e-6) -> DataFrame:
    """Bits of what differs between metadata rows ``field_id, xres, yres, xreal, yreal, unit_xy, unit_z``:
    1 resolution, 2 real size, 4 pixel size, 8 lateral unit, 16 value unit."""
    a, b = left.alias("a"), right.alias("b")

    def off(x: Column, y: Column) -> Column:
        return ~(F.abs(F.log(x / y)) <= tolerance)

    pixel = lambda t, d: F.col(f"{t}.{d}real") / F.col(f"{t}.{d}res")
    bits = {
        1: (F.col("a.xres") != F.col("b.xres")) | (F.col("a.yres") != F.col("b.yres")),
        2: off(F.col("a.xreal"), F.col("b.xreal")) | off(F.col("a.yreal"), F.col("b.yreal")),
        4: off(pixel("a", "x"), pixel("b", "x")) | off(pixel("a", "y"), pixel("b", "y")),
        8: F.col("a.unit_xy") != F.col("b.unit_xy"),
        16: F.col("a.unit_z") != F.col("b.unit_z"),
    }
    total = sum((F.when(test, bit).otherwise(0) for bit, test in bits.items()), F.lit(0))
    return a.join(b, "field_id").select("field_id", total.alias("flags"))


def _where(field: DataFrame, value: Column, region: Region | None, masking: Masking) -> DataFrame:
    return field.withColumn("z", F.when(selected(region, masking), value).otherwise(F.col("z")))


def add(field: DataFrame, value: float, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    return _where(field, F.col("z") + value, region, masking)


def multiply(field: DataFrame, value: float, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    return _where(field, F.col("z") * value, region, masking)


def fill(field: DataFrame, value: float = 0.0, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    """The constant in the region, or where the mask says; 0 clears."""
    return _where(field, F.lit(float(value)), region, masking)


def fill_ellipse(field: DataFrame, region: Region, value: float) -> DataFrame:
    return field.withColumn("z", F.when(region.ellipse(), float(value)).otherwise(F.col("z")))


def clamp(field: DataFrame, bottom: float, top: float, region: Region | None = None) -> DataFrame:
    """Values limited to a range; ``changed`` tells which were outside."""
    outside = selected(region) & ~F.col("z").between(bottom, top)
    return field.withColumn("changed", outside).withColumn("z", F.when(F.col("changed"), F.least(F.greatest(F.col("z"), F.lit(bottom)), F.lit(top))).otherwise(F.col("z")))


def threshold(field: DataFrame, at: float, bottom: float = 0.0, top: float = 1.0, region: Region | None = None) -> DataFrame:
    """``bottom`` below ``at``, ``top`` from it on."""
    return _where(field, F.when(F.col("z") < at, bottom).otherwise(top), region, Masking.IGNORE)


def per_field(field: DataFrame, *aggregates: Column, width: int = 64) -> DataFrame:
    """``field`` with aggregates of its whole field in each row; the aggregates are broadcast if few fields have them."""
    return field.join(maybe_broadcast(field.groupBy("field_id").agg(*aggregates), width), "field_id")


def renormalize(field: DataFrame, width: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Each field linearly mapped to ``offset .. offset + width``; a constant field becomes ``offset``."""
    known = per_field(field, F.min("z").alias("_low"), F.max("z").alias("_high"))
    part = F.coalesce(F.try_divide(F.col("z") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return known.withColumn("z", part * width + offset).drop("_low", "_high")


def invert_values(field: DataFrame) -> DataFrame:
    """Values reflected about their field's mean."""
    return per_field(field, F.avg("z").alias("_mean")).withColumn("z", 2 * F.col("_mean") - F.col("z")).drop("_mean")


def log_scale(field: DataFrame) -> DataFrame:
    """Logarithms of the values above the minimum, in thousandths of the range: what a logarithmic presentation shows."""
    known = per_field(field, F.min("z").alias("_low"), F.max("z").alias("_high"))
    part = F.try_divide(F.col("z") - F.col("_low"), F.col("_high") - F.col("_low"))
    return known.withColumn("z", F.log1p(1000.0 * F.coalesce(part, F.lit(0.0)))).drop("_low", "_high")


def to_volume(field: DataFrame, levels: int) -> DataFrame:
    """A volume ``brick_id, lev, row, col, w``: 1 up to the level that each pixel's height reaches between the extremes, 0 above."""
    known = per_field(field, F.min("z").alias("_low"), F.max("z").alias("_high"))
    reached = F.floor(F.coalesce(F.try_divide(F.col("z") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * (levels - 1))
    every = known.select(F.col("field_id").alias("brick_id"), "row", "col", reached.alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lev"))
    return every.select("brick_id", "lev", "row", "col", (F.col("lev") <= F.col("_r")).cast("double").alias("w"))


def layers_to_volume(fields: DataFrame, order: list) -> DataFrame:
    """Fields of one shape as the levels of one volume, in the order of their ids."""
    places = F.create_map(*(F.lit(v) for k, f in enumerate(order) for v in (f, k)))
    return fields.where(F.col("field_id").isin(*order)).select(F.lit(0).alias("brick_id"), places[F.col("field_id")].alias("lev"), "row", "col", F.col("z").alias("w"))
