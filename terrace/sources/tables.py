"""Array relations made of relational tables.

=========  ==========================================
field      ``field_id, row, col, z`` (a 2-D grid)
line       ``line_id, i, y`` (a 1-D grid)
brick      ``brick_id, lev, row, col, w`` (a 3-D grid)
points     ``surface_id, x, y, z`` (a point cloud)
curve      ``curve_id, i, x, y``
=========  ==========================================
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.operators import volume
from terrace.plans.indexing import row_index

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_width(n: int) -> int:
    """Columns of a field of ``n`` pixels: the largest divisor of n up to its root, so that all rows are whole.

    Where all of them are under an eighth of the root the width is the root, and what does not fill a
    row of pixels is left out.
    """
    root = math.isqrt(n)
    divisor = next((d for d in range(root, 0, -1) if n % d == 0), 1)
    return divisor if 8 * divisor >= root else max(1, round(n**0.5))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a nearly square field with a second operand ``q`` and a mask ``m``; its numbered rows are written once for a call."""
    rows = _read(spark, sf_dir, "lineitem").select(*KEY, "l_quantity", "l_discount")
    n = rows.count()
    width = grid_width(n)
    k = F.col("k")
    placed = row_index(rows, KEY).where(k < n // width * width)
    return placed.select(
        F.lit(0).alias("field_id"),
        F.floor(k / width).cast("int").alias("row"),
        (k % width).cast("int").alias("col"),
        F.col("l_extendedprice").alias("z"),
        F.col("l_quantity").alias("q"),
        F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("m"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a line for each user, in the order of time."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("line_id"), place.alias("i"), F.col("value").alias("y"))


def brick(spark: SparkSession, sf_dir: str, width: int = 25) -> DataFrame:
    """``embeddings`` as a volume: a vector is the profile at its row and column."""
    vectors = _read(spark, sf_dir, "embeddings")
    cells = vectors.select("vec_id", F.posexplode("embedding").alias("lev", "w"))
    row, col = F.floor(F.col("vec_id") / width).cast("int"), (F.col("vec_id") % width).cast("int")
    return cells.select(F.lit(0).alias("brick_id"), "lev", row.alias("row"), col.alias("col"), F.col("w").cast("double").alias("w"))


def profiles(spark: SparkSession, sf_dir: str, width: int = 25) -> DataFrame:
    """The profiles of ``brick``, ``brick_id, row, col, p``, read from the vectors as they stand.

    Only where an id stands twice are values dealt out to be brought together by pixel.
    """
    vectors = _read(spark, sf_dir, "embeddings")
    if not vectors.groupBy("vec_id").count().where("count > 1").isEmpty():
        return volume.profiles(brick(spark, sf_dir, width))
    row, col = F.floor(F.col("vec_id") / width).cast("int"), (F.col("vec_id") % width).cast("int")
    return vectors.where(F.size("embedding") > 0).select(F.lit(0).alias("brick_id"), row.alias("row"), col.alias("col"), F.col("embedding").alias("p"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a point cloud; many points share their place."""
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select(F.lit(0).alias("surface_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a curve for each priority: price over days since 1992."""
    orders = _read(spark, sf_dir, "orders")
    days = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double")
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")) - 1
    return orders.select(F.col("o_orderpriority").alias("curve_id"), place.alias("i"), days.alias("x"), F.col("o_totalprice").alias("y"))
