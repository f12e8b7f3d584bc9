"""Seeded synthetic fields, made where their pixels live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def blank(spark: SparkSession, xres: int, yres: int, value: Column | float = 0.0, field_id: int = 0) -> DataFrame:
    """A field of ``value``, a constant or an expression over ``row`` and ``col``."""
    k = F.col("id")
    placed = spark.range(xres * yres).select(F.lit(field_id).alias("field_id"), F.floor(k / xres).cast("int").alias("row"), (k % xres).cast("int").alias("col"))
    return placed.withColumn("z", (F.lit(float(value)) if isinstance(value, (int, float)) else value).cast("double"))


def _uniform(seed: int, salt: str) -> Column:
    """A number in [0, 1) that depends on seed and place alone, whatever the partitions."""
    return F.pmod(F.xxhash64("field_id", "row", "col", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)


def white_noise(spark: SparkSession, xres: int, yres: int, rms: float = 1.0, seed: int = 0) -> DataFrame:
    """Normal noise, drawn by Box and Muller's rule."""
    radius = F.sqrt(-2 * F.log(1 - _uniform(seed, "r")))
    return blank(spark, xres, yres, 0.0).withColumn("z", rms * radius * F.cos(2 * F.pi() * _uniform(seed, "a")))


def waves(spark: SparkSession, xres: int, yres: int, period_x: float, period_y: float, height: float = 1.0) -> DataFrame:
    return blank(spark, xres, yres, height * F.sin(2 * F.pi() * F.col("col") / period_x) * F.sin(2 * F.pi() * F.col("row") / period_y))


def chessboard(spark: SparkSession, xres: int, yres: int, side: int, height: float = 1.0) -> DataFrame:
    return blank(spark, xres, yres, F.when((F.floor(F.col("col") / side) + F.floor(F.col("row") / side)) % 2 == 0, height).otherwise(0.0))


def steps(spark: SparkSession, xres: int, yres: int, width: int, height: float = 1.0) -> DataFrame:
    """A staircase along the rows."""
    return blank(spark, xres, yres, F.floor(F.col("col") / width) * height)


def spheres(spark: SparkSession, xres: int, yres: int, period: int, radius: float) -> DataFrame:
    """A lattice of caps."""
    d2 = sum((F.pow(F.pmod(F.col(c), F.lit(period)) - (period - 1) / 2, F.lit(2)) for c in ("col", "row")), F.lit(0.0))
    return blank(spark, xres, yres, F.sqrt(F.greatest(radius * radius - d2, F.lit(0.0))))
