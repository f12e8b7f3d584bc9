"""One-dimensional data: ``line_id, i, y`` lines and ``curve_id, i, x, y`` curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators import spatial
from terrace.operators.statistics import upper_median

def _order():
    return Window.partitionBy("line_id").orderBy("i")


def statistics(lines: DataFrame) -> DataFrame:
    """A row for each line: ``n, mean, min, max, ra, rq, rt, rp, rv, skew, kurtosis, length``.

    Skew and excess kurtosis count n + 1 values, and are 0 for a line of equal values.
    """
    mean, step = F.avg("y").over(Window.partitionBy("line_id")), F.col("y") - F.lag("y").over(_order())
    known = lines.select("line_id", "y", (F.col("y") - mean).alias("d"), F.sqrt(1 + step * step).alias("s"))
    d = F.col("d")
    s2, s3, s4 = (F.sum(F.pow(d, F.lit(p))) for p in (2, 3, 4))
    n = F.count("y")
    return known.groupBy("line_id").agg(
        n.alias("n"),
        F.avg("y").alias("mean"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        F.avg(F.abs(d)).alias("ra"),
        F.sqrt(F.avg(d * d)).alias("rq"),
        (F.max("y") - F.min("y")).alias("rt"),
        F.max(d).alias("rp"),
        F.max(-d).alias("rv"),
        F.coalesce(F.try_divide(s3 * F.sqrt(n + 1), F.pow(s2, F.lit(1.5))), F.lit(0.0)).alias("skew"),
        F.coalesce(F.try_divide(s4 * (n + 1), s2 * s2) - 3, F.lit(0.0)).alias("kurtosis"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("length"),
    )


def cumulate(lines: DataFrame) -> DataFrame:
    return lines.select("line_id", "i", F.sum("y").over(_order()).alias("y"))


def derivative(lines: DataFrame, step: float = 1.0) -> DataFrame:
    """Central differences, one-sided at the ends."""
    before, after = F.lag("y").over(_order()), F.lead("y").over(_order())
    span = (F.when(before.isNull(), 0).otherwise(1) + F.when(after.isNull(), 0).otherwise(1)) * step
    value = F.try_divide(F.coalesce(after, F.col("y")) - F.coalesce(before, F.col("y")), span)
    return lines.select("line_id", "i", F.coalesce(value, F.lit(0.0)).alias("y"))


def moving_average(lines: DataFrame, reach: int = 5) -> DataFrame:
    return lines.select("line_id", "i", F.avg("y").over(_order().rowsBetween(-reach, reach)).alias("y"))


def level(lines: DataFrame) -> DataFrame:
    """Each line less its fitted straight line."""
    whole = Window.partitionBy("line_id")
    t = F.col("i") - F.avg("i").over(whole)
    known = lines.select("line_id", "i", "y", t.alias("t"), F.avg("y").over(whole).alias("m"))
    slope = F.coalesce(F.try_divide(F.sum(F.col("t") * (F.col("y") - F.col("m"))).over(whole), F.sum(F.col("t") * F.col("t")).over(whole)), F.lit(0.0))
    return known.select("line_id", "i", (F.col("y") - F.col("m") - slope * F.col("t")).alias("y"))


def reverse(lines: DataFrame) -> DataFrame:
    return lines.select("line_id", (F.max("i").over(Window.partitionBy("line_id")) - F.col("i")).alias("i"), "y")


def resample(lines: DataFrame, res: int) -> DataFrame:
    """Lines of ``res`` samples over the same extent, linear between the old ones."""
    size = F.count(F.lit(1)).over(Window.partitionBy("line_id"))
    known = lines.select("line_id", "i", "y", F.lead("y").over(_order()).alias("next"), size.alias("n"))
    # A sample's place among the old ones is (t + 1/2) n / res - 1/2, held within the ends; each old one serves those up to the next.
    at = lambda t: F.least(F.greatest((t + 0.5) * F.col("n") / res - 0.5, F.lit(0.0)), (F.col("n") - 1).cast("double"))
    low = F.greatest(F.floor((F.col("i") - 1 + 0.5) * res / F.col("n") - 0.5), F.lit(0)).cast("int")
    high = F.least(F.ceil((F.col("i") + 1 + 0.5) * res / F.col("n") - 0.5), F.lit(res - 1)).cast("int")
    reach = F.when(F.col("i") == 0, F.sequence(F.lit(0), F.greatest(high, F.lit(0)))).when(F.col("next").isNull(), F.sequence(F.least(low, F.lit(res - 1)), F.lit(res - 1)))
    every = known.withColumn("t", F.explode(reach.otherwise(F.sequence(low, F.greatest(low, high)))))
    hit = every.where(F.floor(at(F.col("t"))) == F.col("i"))
    part = at(F.col("t")) - F.col("i")
    return hit.select("line_id", F.col("t").alias("i"), (F.col("y") + F.coalesce((F.col("next") - F.col("y")) * part, F.lit(0.0))).alias("y"))


def peaks(lines: DataFrame, most: int = 10) -> DataFrame:
    """``line_id, rank, i, y``: the ``most`` highest places above both neighbours, highest first."""
    before, after = F.lag("y").over(_order()), F.lead("y").over(_order())
    top = lines.withColumns({"_b": before, "_a": after}).where("y > _b and y > _a")
    rank = F.row_number().over(Window.partitionBy("line_id").orderBy(F.desc("y"), "i"))
    return top.select("line_id", rank.alias("rank"), "i", "y").where(F.col("rank") <= most)


def crossings(lines: DataFrame) -> DataFrame:
    """``line_id, crossings``: how often a line passes its mean."""
    high = (F.col("y") > F.avg("y").over(Window.partitionBy("line_id"))).cast("int")
    signs = lines.select("line_id", "i", high.alias("h"))
    change = signs.select("line_id", (F.col("h") != F.lag("h").over(_order())).alias("c"))
    return change.groupBy("line_id").agg(F.count_if("c").alias("crossings"))


def hurst_ranges(lines: DataFrame, sizes: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """``line_id, size, range``: mean range of the values in whole blocks of each size."""
    sized = lines.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("block", F.floor(F.col("i") / F.col("size")))
    blocks = sized.groupBy("line_id", "size", "block").agg((F.max("y") - F.min("y")).alias("r"), F.count("y").alias("n")).where("n = size")
    return blocks.groupBy("line_id", "size").agg(F.avg("r").alias("range"))


def power_spectrum(lines: DataFrame, window: str = "hann", step: float = 1.0) -> DataFrame:
    """``line_id, bin, k, psdf``: power spectral density of each line less its mean, up to half its number of values.

    The window keeps the line's mean square. Lines without ids or values have no rows.
    """
    rows = lines.where("line_id is not null and y is not null").select(F.col("line_id").alias("field_id"), F.lit(0).alias("row"), F.col("i").alias("col"), F.col("y").alias("z"))
    return spatial.power_spectrum(rows, window, step).select(F.col("field_id").alias("line_id"), "bin", "k", "psdf")


# Curves: points of any spacing.


def fit_straight(curves: DataFrame) -> DataFrame:
    """``curve_id, n, slope, intercept, r2`` of the least-squares line of each curve."""
    means = curves.groupBy("curve_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    both = curves.join(means, "curve_id").select("curve_id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "mx", "my")
    xx, xy, yy = (F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "xy", "yy"))
    s = both.groupBy("curve_id", "mx", "my").agg(F.count("x").alias("n"), xx.alias("xx"), xy.alias("xy"), yy.alias("yy"))
    slope = F.try_divide("xy", "xx")
    return s.select("curve_id", "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.try_divide(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy")).alias("r2"))


def cut(curves: DataFrame, low: float, high: float) -> DataFrame:
    """The points of a range of ``x``, counted anew."""
    place = F.row_number().over(Window.partitionBy("curve_id").orderBy("i")) - 1
    return curves.where(F.col("x").between(low, high)).withColumn("i", place)


def merge_equal(curves: DataFrame) -> DataFrame:
    """Points of one ``x`` joined to their mean."""
    return curves.groupBy("curve_id", "x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def smooth(curves: DataFrame, reach: int = 5) -> DataFrame:
    """Moving average over the points in order."""
    order = Window.partitionBy("curve_id").orderBy("i")
    return curves.select("curve_id", "i", "x", F.avg("y").over(order.rowsBetween(-reach, reach)).alias("y"))


def area_under(curves: DataFrame) -> DataFrame:
    """``curve_id, area``: trapezoids between neighbours in order of ``x``."""
    order = Window.partitionBy("curve_id").orderBy("x", "i")
    step = (F.col("x") - F.lag("x").over(order)) * (F.col("y") + F.lag("y").over(order)) / 2
    return curves.select("curve_id", step.alias("s")).groupBy("curve_id").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("area"))


def density_of_states(curves: DataFrame, least: float = 1e-15) -> DataFrame:
    """Normalised conductance ``|dy/dx * x/y|`` of current over voltage, from each point and the one before it, counted anew.

    Points without a step in ``x``, or with ``y`` of no size, give no row; ``least`` is the limit of both.
    """
    order = Window.partitionBy("curve_id").orderBy("i")
    known = curves.withColumns({"_dx": F.col("x") - F.lag("x").over(order), "_dy": F.col("y") - F.lag("y").over(order)})
    kept = known.where((F.abs("_dx") >= least) & (F.abs("y") >= least))
    value = F.abs(F.col("_dy") / F.col("_dx") * (F.col("x") / F.col("y")))
    return kept.select("curve_id", (F.row_number().over(order) - 1).alias("i"), "x", value.alias("y"))


# Parts of lines: samples from ``start`` up to, not including, ``stop``; the whole line without them.


def _in_part(start: int | None, stop: int | None):
    test = F.lit(True)
    if start is not None:
        test = test & (F.col("i") >= start)
    return test & (F.col("i") < stop) if stop is not None else test


def part(lines: DataFrame, start: int, stop: int) -> DataFrame:
    """The samples of a part, counted anew."""
    return lines.where(_in_part(start, stop)).select("line_id", (F.col("i") - start).alias("i"), "y")


def changed(lines: DataFrame, value, start: int | None = None, stop: int | None = None) -> DataFrame:
    """``value``, a column over ``y`` and ``i``, instead of the samples of a part."""
    return lines.select("line_id", "i", F.when(_in_part(start, stop), value).otherwise(F.col("y")).alias("y"))


def fill(lines: DataFrame, value: float = 0.0, start: int | None = None, stop: int | None = None) -> DataFrame:
    return changed(lines, F.lit(float(value)), start, stop)


def add(lines: DataFrame, value: float, start: int | None = None, stop: int | None = None) -> DataFrame:
    return changed(lines, F.col("y") + value, start, stop)


def multiply(lines: DataFrame, value: float, start: int | None = None, stop: int | None = None) -> DataFrame:
    return changed(lines, F.col("y") * value, start, stop)


def threshold(lines: DataFrame, at: float, bottom: float = 0.0, top: float = 1.0, start: int | None = None, stop: int | None = None) -> DataFrame:
    """``bottom`` below ``at``, ``top`` from it on."""
    return changed(lines, F.when(F.col("y") < at, bottom).otherwise(top), start, stop)


def square_root(lines: DataFrame) -> DataFrame:
    """Roots of the samples; negative ones become 0."""
    return changed(lines, F.sqrt(F.greatest("y", F.lit(0.0))))


def part_statistics(lines: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A row for each line that has samples in the part: ``n, min, max, sum, mean, ra, rms, skew, kurtosis, tan_beta0, variation, median``.

    Skew and excess kurtosis count n + 1 values; ``tan_beta0`` is the rms slope and
    ``variation`` the sum of steps, in samples; ``median`` is element floor(n/2).
    """
    chosen = lines.where(_in_part(start, stop))
    means = chosen.groupBy("line_id").agg(F.avg("y").alias("mean"))
    step = F.col("y") - F.lag("y").over(_order())
    known = chosen.withColumn("s", step).join(means, "line_id").withColumn("d", F.col("y") - F.col("mean"))
    s2, s3, s4 = (F.sum(F.pow("d", F.lit(p))) for p in (2, 3, 4))
    n = F.count("y")
    numbers = known.groupBy("line_id").agg(
        n.alias("n"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        F.sum("y").alias("sum"),
        F.first("mean").alias("mean"),
        F.avg(F.abs("d")).alias("ra"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"),
        F.coalesce(F.try_divide(s3 * F.sqrt(n + 1), F.pow(s2, F.lit(1.5))), F.lit(0.0)).alias("skew"),
        F.coalesce(F.try_divide(s4 * (n + 1), s2 * s2) - 3, F.lit(0.0)).alias("kurtosis"),
        F.coalesce(F.sqrt(F.avg(F.col("s") * F.col("s"))), F.lit(0.0)).alias("tan_beta0"),
        F.coalesce(F.sum(F.abs("s")), F.lit(0.0)).alias("variation"),
    )
    return numbers.join(upper_median(chosen, ["line_id"], "y"), "line_id", "left")


def _binned(lines: DataFrame, bins: int | None) -> DataFrame:
    extremes = lines.groupBy("line_id").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("y").alias("n"))
    default = F.greatest(F.floor(3.49 * F.cbrt(F.col("n").cast("double")) + 0.5), F.lit(2))
    known = lines.join(extremes.withColumn("bins", (F.lit(bins) if bins else default).cast("int")), "line_id")
    at = F.floor(F.try_divide(F.col("y") - F.col("low"), F.col("high") - F.col("low")) * F.col("bins"))
    return known.withColumn("bin", F.coalesce(F.least(at, F.col("bins") - 1), F.lit(0)).cast("int"))


def distribution(lines: DataFrame, bins: int | None = None) -> DataFrame:
    """``line_id, bin, x, n, share``: equal bins from minimum to maximum; ``share`` is that of values up to the bin's end."""
    width = (F.col("high") - F.col("low")) / F.col("bins")
    counted = _binned(lines, bins).groupBy("line_id", "bin", "low", "high", "bins", F.col("n").alias("total")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("line_id").orderBy("bin"))
    return counted.select("line_id", "bin", (F.col("low") + (F.col("bin") + 0.5) * width).alias("x"), "n", (upto / F.col("total")).alias("share"))


def steps(lines: DataFrame) -> DataFrame:
    """Differences of neighbouring samples as lines, for distributions of slopes."""
    known = lines.select("line_id", (F.col("i") - 1).alias("i"), (F.col("y") - F.lag("y").over(_order())).alias("y"))
    return known.where("y is not null")


def modus(lines: DataFrame, bins: int | None = None) -> DataFrame:
    """``line_id, modus``: mean of the samples in the fullest bin, the first of equals."""
    binned = _binned(lines, bins)
    sizes = binned.groupBy("line_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    return sizes.groupBy("line_id").agg(F.max_by("mean", F.struct("n", -F.col("bin"))).alias("modus"))


def _lagged(lines: DataFrame, lags: int) -> DataFrame:
    wide = lines.select("line_id", "y", F.array(F.col("y"), *(F.lead("y", k).over(_order()) for k in range(1, lags + 1))).alias("ahead"))
    return wide.select("line_id", "y", F.posexplode("ahead").alias("lag", "other")).where("other is not null")


def autocorrelation(lines: DataFrame, lags: int = 16) -> DataFrame:
    """``line_id, lag, acf``: mean product of samples ``lag`` apart, the line less its mean."""
    mean = lines.groupBy("line_id").agg(F.avg("y").alias("_m"))
    centred = lines.join(mean, "line_id").withColumn("y", F.col("y") - F.col("_m"))
    return _lagged(centred, lags).groupBy("line_id", "lag").agg(F.avg(F.col("y") * F.col("other")).alias("acf"))


def height_difference(lines: DataFrame, lags: int = 16) -> DataFrame:
    """``line_id, lag, hhcf``: mean squared difference of samples ``lag`` apart."""
    return _lagged(lines, lags).groupBy("line_id", "lag").agg(F.avg((F.col("y") - F.col("other")) ** 2).alias("hhcf"))


#: Weights of the samples at -1, 0, 1 and 2 by the place ``x`` between 0 and 1.
KERNELS = {
    "round": lambda x: (0 * x, (x < 0.5).cast("double"), (x >= 0.5).cast("double"), 0 * x),
    "linear": lambda x: (0 * x, 1 - x, x, 0 * x),
    "key": lambda x: ((-0.5 + (1 - x / 2) * x) * x, 1 + (-2.5 + 1.5 * x) * x * x, (0.5 + (2 - 1.5 * x) * x) * x, (-0.5 + x / 2) * x * x),
    "schaum": lambda x: (-x * (x - 1) * (x - 2) / 6, (x * x - 1) * (x - 2) / 2, -x * (x + 1) * (x - 2) / 2, x * (x * x - 1) / 6),
}


def sample(lines: DataFrame, places: list[float], kind: str = "linear") -> DataFrame:
    """``line_id, x, y``: values between samples by a kernel of four; lines are mirrored at their ends.

    Places outside a line's samples give no row.
    """
    before, after, second = (F.lead("y", k).over(_order()) for k in (-1, 1, 2))
    y = F.col("y")
    around = lines.select(
        "line_id",
        "i",
        F.coalesce(before, y).alias("a"),
        y.alias("b"),
        F.coalesce(after, y).alias("c"),
        F.coalesce(second, after, before, y).alias("d"),
        after.isNull().alias("last"),
    )
    wanted = F.array(*(F.struct(F.lit(float(p)).alias("x"), F.lit(int(p // 1)).alias("at")) for p in places))
    hit = around.select("*", F.explode(F.filter(wanted, lambda p: p["at"] == F.col("i"))).alias("p")).where("not last or p.x = i")
    weights = KERNELS[kind](F.col("p.x") - F.col("i"))
    return hit.select("line_id", "p.x", sum((w * F.col(c) for w, c in zip(weights, "abcd")), F.lit(0.0)).alias("y"))
