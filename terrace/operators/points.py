"""Point clouds ``surface_id, x, y, z``: levelling, merging, gridding, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.plans.durable import durable, maybe_broadcast


def extent(points: DataFrame) -> DataFrame:
    return points.groupBy("surface_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.count("z").alias("n"))


def merge_places(points: DataFrame) -> DataFrame:
    """Points of one place joined to their mean value."""
    return points.groupBy("surface_id", "x", "y").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))


def plane(points: DataFrame) -> DataFrame:
    """``surface_id, a, bx, by``: the least-squares plane."""
    means = points.groupBy("surface_id").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    joined = points.join(maybe_broadcast(means, 64), "surface_id")
    x, y, z = (F.col(c) - F.col(f"m{c}") for c in "xyz")
    sums = {"xx": x * x, "xy": x * y, "yy": y * y, "xz": x * z, "yz": y * z}
    s = joined.groupBy("surface_id").agg(*(F.sum(c).alias(k) for k, c in sums.items()), *(F.first(f"m{c}").alias(f"m{c}") for c in "xyz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda p: F.coalesce(F.try_divide(p, det), F.lit(0.0))
    both = s.withColumns({"bx": solve(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")), "by": solve(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"))})
    return both.select("surface_id", (F.col("mz") - F.col("bx") * F.col("mx") - F.col("by") * F.col("my")).alias("a"), "bx", "by")


def level(points: DataFrame) -> DataFrame:
    """Values less the fitted plane."""
    joined = points.join(maybe_broadcast(plane(points), 48), "surface_id")
    return joined.withColumn("z", F.col("z") - F.col("a") - F.col("bx") * F.col("x") - F.col("by") * F.col("y")).drop("a", "bx", "by")


def raster(points: DataFrame, xres: int, yres: int) -> DataFrame:
    """``field_id, row, col, z, n``: mean of the points in each cell of a grid over their extent; empty cells have no row."""
    known = points.join(maybe_broadcast(extent(points), 96), "surface_id")

    def cell(c: str, size: int):
        at = F.floor(F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")) * size)
        return F.coalesce(F.least(at, F.lit(size - 1)), F.lit(0)).cast("int")

    placed = known.select(F.col("surface_id").alias("field_id"), cell("y", yres).alias("row"), cell("x", xres).alias("col"), "z")
    return placed.groupBy("field_id", "row", "col").agg(F.avg("z").alias("z"), F.count("z").alias("n"))


def within(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """Pairs ``surface_id, left_id, right_id, distance`` of ``pt_id`` no further apart than ``distance``.

    Points meet by cells of that size: a left point looks in its own and the eight
    around, so pairs are found by an equality join.
    """
    return _within(left.withColumn("_r", F.lit(float(distance))), right.withColumn("_r", F.lit(float(distance))))


#: Pairs that one task compares, about, and tasks at most.
PAIRS, TASKS = 4_000_000, 20_000
#: Points on the right and on the left that meet in a block of a dense cell at most, about.
RIGHT, LEFT = 50_000, 10_000


def _within(left: DataFrame, right: DataFrame) -> DataFrame:
    """``within`` for distances ``_r`` of each cloud. The tasks are as many as the pairs in common cells ask for.

    The points of a dense cell are dealt into blocks by their hash, and each block on the left meets each on the right
    once: what a task holds has a bound, and one cell's pairs are spread over tasks.
    """
    cell = lambda c: F.floor(F.col(c) / F.col("_r"))
    near = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    keys = ["surface_id", "cx", "cy"]
    around = lambda df: df.withColumn("cx", F.explode(F.transform(near, lambda d: F.col("cx") + d))).withColumn("cy", F.explode(F.transform(near, lambda d: F.col("cy") + d)))
    a = left.select("surface_id", F.col("pt_id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), "_r", cell("x").alias("cx"), cell("y").alias("cy"))
    b = right.select("surface_id", F.col("pt_id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    asked = around(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))).groupBy(*keys).agg(F.sum("n").alias("n"))
    met = asked.join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
    parts = [F.ceil(F.col(c) / most).alias(name) for c, most, name in (("n", LEFT, "_is"), ("m", RIGHT, "_js"))]
    full = (F.col("n") > LEFT) | (F.col("m") > RIGHT)
    dense = met.where(full).select(*keys, *parts)
    pairs, cells, many = met.agg(F.sum(F.col("n") * F.col("m")), F.count(F.lit(1)), F.count_if(full)).first()
    a = around(a)
    if many:
        dense = durable(dense)
        blocks = lambda df, own, size, others, other, *of: (
            df.join(maybe_broadcast(dense, 64), keys, "left")
            .withColumn(own, F.coalesce(F.pmod(F.xxhash64(*of), F.col(size)), F.lit(0).cast("long")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(others), F.lit(1).cast("long")) - 1)))
            .drop("_is", "_js")
        )
        a, b = blocks(a, "_i", "_is", "_js", "_j", "left_id", "ax", "ay"), blocks(b, "_j", "_js", "_is", "_i", "right_id", "bx", "by")
        cells += dense.agg(F.sum(F.col("_is") * F.col("_js"))).first()[0] or 0
        keys = [*keys, "_i", "_j"]
    tasks = min((pairs or 0) // PAIRS + 1, max(cells, 1), TASKS)
    if tasks > 1:
        a, b = a.repartition(tasks, *keys), b.repartition(tasks, *keys)
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    close = (F.abs(dx) <= F.col("_r")) & (F.abs(dy) <= F.col("_r"))
    joined = a.join(b, keys).where(close).withColumn("distance", F.hypot(dx, dy))
    return joined.where(F.col("distance") <= F.col("_r")).select("surface_id", "left_id", "right_id", "distance")


def nearest(queries: DataFrame, points: DataFrame, distance: float, k: int = 1) -> DataFrame:
    """``surface_id, left_id, right_id, distance, rank``: the ``k`` nearest of ``points`` of each query, ties to the smaller id.

    ``distance`` is the largest radius searched first; a cloud begins with less where a smaller
    square would hold ``k`` places on average, so that a denser cloud compares no more pairs for a query. It
    doubles for the queries that have found fewer than ``k``, until they have them or all points of their
    cloud. Of points of one place the ``k`` of smallest id are enough. Null, NaN
    and infinite coordinates are near nothing: such points are never found, such queries have no rows.
    """
    usable = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    place = F.row_number().over(Window.partitionBy("surface_id", "x", "y").orderBy("pt_id"))
    queries, points = queries.where(usable), points.where(usable).select("surface_id", "pt_id", "x", "y")
    sizes = points.groupBy("surface_id").agg(F.count(F.lit(1)).alias("n"))
    points = durable(points.withColumn("_p", place).where(F.col("_p") <= k))
    rank = F.row_number().over(Window.partitionBy("surface_id", "left_id").orderBy("distance", "right_id"))
    spans = points.where("_p = 1").groupBy("surface_id").agg(*((F.max(c) - F.min(c)).alias(f"_{c}") for c in "xy"), F.count(F.lit(1)).alias("_n"))
    share = k / F.col("_n")
    side = F.when((F.col("_x") > 0) & (F.col("_y") > 0), F.sqrt(F.col("_x")) * F.sqrt(F.col("_y")) * F.sqrt(share)).otherwise(F.greatest("_x", "_y") * share)
    # At least so much that cells have numbers, wherever points and queries lie.
    away = points.select("surface_id", "x", "y").union(queries.select("surface_id", "x", "y")).groupBy("surface_id").agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("_away"))
    first = F.when(side > 0, F.greatest(F.least(side, F.lit(float(distance))), F.col("_away") * 1e-15)).otherwise(F.lit(float(distance)))
    sizes = durable(sizes.join(spans.join(away, "surface_id").select("surface_id", first.alias("_r")), "surface_id"))
    points = points.select("surface_id", "pt_id", "x", "y").join(maybe_broadcast(sizes.select("surface_id", "_r"), 32), "surface_id")
    todo = durable(queries.select("surface_id", "pt_id", "x", "y").join(maybe_broadcast(sizes, 40), "surface_id"))
    done = None
    while not todo.isEmpty():
        found = durable(_within(todo, points).withColumn("rank", rank).where(F.col("rank") <= k))
        counts = found.groupBy("surface_id", F.col("left_id").alias("pt_id")).agg(F.count(F.lit(1)).alias("has"))
        full = counts.join(todo.select("surface_id", "pt_id", "n"), ["surface_id", "pt_id"]).where(F.col("has") >= F.least(F.lit(k), "n")).select("surface_id", "pt_id")
        full = durable(full.distinct())
        part = found.join(full.withColumnRenamed("pt_id", "left_id"), ["surface_id", "left_id"], "left_semi")
        done = part if done is None else done.union(part)
        todo = durable(todo.join(full, ["surface_id", "pt_id"], "left_anti"))
        todo, points = (t.withColumn("_r", F.col("_r") * 2) for t in (todo, points))
    return done if done is not None else within(queries, points, distance).withColumn("rank", rank)


def zero_mean(points: DataFrame) -> DataFrame:
    """Values less their cloud's mean."""
    mean = points.groupBy("surface_id").agg(F.avg("z").alias("_mean"))
    return points.join(maybe_broadcast(mean, 32), "surface_id").withColumn("z", F.col("z") - F.col("_mean")).drop("_mean")


def fix_zero(points: DataFrame) -> DataFrame:
    """Values less their cloud's minimum."""
    low = points.groupBy("surface_id").agg(F.min("z").alias("_low"))
    return points.join(maybe_broadcast(low, 32), "surface_id").withColumn("z", F.col("z") - F.col("_low")).drop("_low")


def from_field(field: DataFrame, masked: bool = False) -> DataFrame:
    """The pixels, or the marked ones, as points at their centres."""
    chosen = field.where("m > 0") if masked else field
    return chosen.select(F.col("field_id").alias("surface_id"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), "z")
