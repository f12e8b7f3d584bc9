"""Numbers of a field, of its rows or columns, and of parts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.selection import Masking, Region, selected
from terrace.operators.arithmetic import per_field
from terrace.plans.durable import durable, maybe_broadcast

#: Values of one group that may be sorted in one task, at most.
SORTED_VALUES = 10_000
_BINS = 4096


def upper_median(df: DataFrame, keys: list[str], value: str = "z", sorted_values: int = SORTED_VALUES, bins_of: int = _BINS) -> DataFrame:
    """``keys`` and ``median``: element floor(n/2) of each group's sorted values, never an average.

    A group's values are counted in bins between its extremes; the bin that holds the
    element becomes the new range, until few values or one are left in it. Large
    groups are thus never sorted, nor brought to one task. A pass shuffles up to ``bins_of``
    rows of each group from each task, the last one up to ``sorted_values`` in all. Infinite values are set
    aside by their rank; nulls and NaN do not count.
    """
    data = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("_v"))
    size, endless = F.count(F.lit(1)), float("inf")
    finite = F.when(F.abs("_v") < endless, F.col("_v"))
    below, above = F.count_if(F.col("_v") == -endless).alias("below"), F.count_if(F.col("_v") == endless).alias("above")
    sizes = data.groupBy(*keys).agg(F.min(finite).alias("low"), F.max(finite).alias("high"), size.alias("n"), below, above).withColumn("rank", F.floor(F.col("n") / 2))
    edge = F.when(F.col("rank") < F.col("below"), -endless).when(F.col("rank") >= F.col("n") - F.col("above"), endless)
    sizes = durable(sizes.withColumn("edge", edge))
    done = sizes.where("edge is not null").select(*keys, F.col("edge").alias("median"))
    inner = F.col("n") - F.col("below") - F.col("above")
    todo = sizes.where("edge is null").select(*keys, "low", "high", inner.alias("n"), (F.col("rank") - F.col("below")).alias("rank"))
    while True:
        single = F.col("low") == F.col("high")
        done = done.union(todo.where(single).select(*keys, "low"))
        small = todo.where(~single & (F.col("n") <= sorted_values))
        inside = data.join(maybe_broadcast(small, 128), keys).where("_v between low and high")
        element = F.get(F.sort_array(F.collect_list("_v")), F.first("rank").cast("int"))
        done = durable(done.union(inside.groupBy(*keys).agg(element.alias("median"))))
        todo = durable(todo.where(~single & (F.col("n") > sorted_values)))
        if todo.isEmpty():
            return done
        inside = data.join(maybe_broadcast(todo, 128), keys).where("_v between low and high")
        half = lambda c: F.col(c) / 2  # noqa: E731  the range of two halves never overflows
        at = F.least(F.floor((half("_v") - half("low")) / (half("high") - half("low")) * bins_of), F.lit(bins_of - 1))
        bins = inside.groupBy(*keys, at.alias("bin")).agg(size.alias("here"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.first("rank").alias("rank"))
        before = F.coalesce(F.sum("here").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = bins.withColumn("before", before).where("rank >= before and rank < before + here")
        todo = durable(hit.select(*keys, "low", "high", F.col("here").alias("n"), (F.col("rank") - F.col("before")).alias("rank")))


def moments(value: Column, mean: Column) -> list[Column]:
    """Aggregates of one group: mean deviation, rms, skew and excess kurtosis; the last two are null for equal values."""
    d = value - mean
    m2, m3, m4 = (F.avg(F.pow(d, F.lit(p))) for p in (2, 3, 4))
    return [
        F.avg(F.abs(d)).alias("ra"),
        F.sqrt(m2).alias("rms"),
        F.try_divide(m3, F.pow(m2, F.lit(1.5))).alias("skew"),
        (F.try_divide(m4, m2 * m2) - 3).alias("kurtosis"),
    ]


def summary(field: DataFrame, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    """A row for each field: ``n, min, max, sum, mean, ra, rms, skew, kurtosis, median``; a field without chosen pixels has no row."""
    chosen = field.where(selected(region, masking)).select("field_id", "z")
    basic = (F.count("z").alias("n"), F.min("z").alias("min"), F.max("z").alias("max"), F.sum("z").alias("sum"), F.avg("z").alias("mean"))
    known = per_field(chosen, *basic, width=96)
    firsts = [F.first(c).alias(c) for c in ("n", "min", "max", "sum", "mean")]
    rows = known.groupBy("field_id").agg(*firsts, *moments(F.col("z"), F.col("mean")))
    return rows.join(upper_median(chosen, ["field_id"]), "field_id")


def line_statistics(field: DataFrame, by: str = "row", masking: Masking = Masking.IGNORE) -> DataFrame:
    """A row for each row or column: ``n, mean, min, max, range, ra, rms, skew, kurtosis, slope, median``."""
    along = "col" if by == "row" else "row"
    keys = ["field_id", by]
    chosen = field.where(selected(None, masking)).select(*keys, F.col(along).cast("double").alias("t"), "z")
    basic = chosen.groupBy(*keys).agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("min"), F.max("z").alias("max"), F.avg("t").alias("_t"))
    t = F.col("t") - F.col("_t")
    slope = F.try_divide(F.sum(t * (F.col("z") - F.col("mean"))), F.sum(t * t)).alias("slope")
    spread = [F.first(c).alias(c) for c in ("n", "mean", "min", "max")]
    rows = chosen.join(basic, keys).groupBy(*keys).agg(*spread, *moments(F.col("z"), F.col("mean")), slope)
    middle = chosen.groupBy(*keys).agg(F.get(F.sort_array(F.collect_list("z")), F.floor(F.count("z") / 2).cast("int")).alias("median"))
    return rows.withColumn("range", F.col("max") - F.col("min")).join(middle, keys)


def count_in_range(field: DataFrame, below: float, above: float) -> DataFrame:
    """``field_id, n_below, n_above``: pixels under one limit and over the other."""
    return field.groupBy("field_id").agg(F.count_if(F.col("z") < below).alias("n_below"), F.count_if(F.col("z") > above).alias("n_above"))


def volume_above(field: DataFrame, base: float = 0.0, pixel_area: float = 1.0) -> DataFrame:
    """Volume between the surface and a base level."""
    return field.groupBy("field_id").agg((F.sum(F.col("z") - base) * pixel_area).alias("volume"))


def with_neighbours(field: DataFrame) -> DataFrame:
    """``field`` with ``right``, ``below`` and ``diagonal`` values; null beyond the border."""
    across = Window.partitionBy("field_id", "row").orderBy("col")
    down = Window.partitionBy("field_id", "col").orderBy("row")
    one = field.withColumn("right", F.lead("z").over(across))
    return one.withColumns({"below": F.lead("z").over(down), "diagonal": F.lead("right").over(down)})


def surface(field: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``surface_area``, ``projected_area`` and ``variation`` over the squares between pixel centres.

    A square's surface is four triangles meeting at its mean height.
    """
    around = with_neighbours(field).where("diagonal is not null")
    a, b, c, d = (F.col(x) for x in ("z", "right", "diagonal", "below"))
    mid = (a + b + c + d) / 4

    def triangle(p: Column, q: Column, side: float, height: float) -> Column:
        # Half the parallelogram of the side and the way from its middle to the centre.
        rise, climb = q - p, mid - (p + q) / 2
        return F.sqrt((side * height / 2) ** 2 + (rise * height / 2) ** 2 + (side * climb) ** 2) / 2

    area = triangle(a, b, dx, dy) + triangle(d, c, dx, dy) + triangle(a, d, dy, dx) + triangle(b, c, dy, dx)
    gx, gy = ((b - a) + (c - d)) / (2 * dx), ((d - a) + (c - b)) / (2 * dy)
    return around.groupBy("field_id").agg(
        F.sum(area).alias("surface_area"),
        (F.count(F.lit(1)) * dx * dy).alias("projected_area"),
        (F.sum(F.hypot(gx, gy)) * dx * dy).alias("variation"),
    )


def inclination(field: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Mean slopes, and the tilt (from the vertical) and direction of the mean normal, in radians."""
    around = with_neighbours(field).where("diagonal is not null")
    gx = ((F.col("right") - F.col("z")) + (F.col("diagonal") - F.col("below"))) / (2 * dx)
    gy = ((F.col("below") - F.col("z")) + (F.col("diagonal") - F.col("right"))) / (2 * dy)
    mean = around.groupBy("field_id").agg(F.avg(gx).alias("slope_x"), F.avg(gy).alias("slope_y"))
    return mean.withColumns({"theta": F.atan(F.hypot("slope_x", "slope_y")), "phi": F.atan2("slope_y", "slope_x")})


def outliers(field: DataFrame, times: float = 3.0) -> DataFrame:
    """``field`` with mask ``m`` of the pixels further than ``times`` the rms from the mean."""
    known = per_field(field, F.avg("z").alias("_mean"), F.stddev_pop("z").alias("_rms"))
    return known.withColumn("m", (F.abs(F.col("z") - F.col("_mean")) > times * F.col("_rms")).cast("double")).drop("_mean", "_rms")


def outliers_between(field: DataFrame, below: float, above: float) -> DataFrame:
    """``field`` with mask ``m`` of the pixels more than ``below`` rms under or ``above`` rms over the mean."""
    known = per_field(field, F.avg("z").alias("_mean"), F.stddev_pop("z").alias("_rms"))
    d = F.col("z") - F.col("_mean")
    test = (d < -below * F.col("_rms")) | (d > above * F.col("_rms"))
    return known.withColumn("m", test.cast("double")).drop("_mean", "_rms")


def distances(field: DataFrame, segments: list[tuple[int, int, int, int]]) -> DataFrame:
    """``field_id, k, dx, dy, length, angle, dz`` of segments between pixels (column, row, column, row); the angle counts upwards."""
    ends = field.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(segments)], "k int, x1 int, y1 int, x2 int, y2 int")
    read = field.select("field_id", "row", "col", "z")
    pixel = lambda i: read.toDF("field_id" if i == 1 else "_f", f"y{i}", f"x{i}", f"z{i}")
    both = pixel(1).join(F.broadcast(ends), ["x1", "y1"]).join(pixel(2), ["x2", "y2"]).where("field_id = _f")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return both.select("field_id", "k", dx.alias("dx"), dy.alias("dy"), F.hypot(dx.cast("double"), dy.cast("double")).alias("length"), F.atan2(-dy, dx).alias("angle"), (F.col("z2") - F.col("z1")).alias("dz"))


def read_values(field: DataFrame, places: list[tuple[int, int]], radius: int = 1) -> DataFrame:
    """``field_id, k, n, z``: mean of the pixels within ``radius`` of each place (column, row)."""
    spots = field.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(places)], "k int, _x int, _y int")
    near = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius))
    wanted = spots.select("k", "_x", "_y", F.explode(near).alias("d")).select("k", (F.col("_x") + F.col("d.dx")).alias("col"), (F.col("_y") + F.col("d.dy")).alias("row"))
    return field.join(F.broadcast(wanted), ["row", "col"]).groupBy("field_id", "k").agg(F.count("z").alias("n"), F.avg("z").alias("z"))


def grainwise_rms(field: DataFrame, grains: DataFrame) -> DataFrame:
    """``field_id, rms``: rms of the grains' pixels, each grain less its own mean."""
    joined = grains.join(field.select("field_id", "row", "col", "z"), ["field_id", "row", "col"])
    sums = joined.groupBy("field_id", "grain").agg(F.count("z").alias("n"), F.var_pop("z").alias("v"))
    return sums.groupBy("field_id").agg(F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("rms"))
