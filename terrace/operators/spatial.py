"""Spatial statistics along rows: correlation functions, spectra, and of two fields: correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators import geometry
from terrace.operators.arithmetic import per_field
from terrace.operators.filters import patches
from terrace.plans.lines import Line, map_lines


def _lagged(field: DataFrame, lags: int, centre: bool, by: str) -> DataFrame:
    """Per lag: sum of products, sum of squared differences and number of pairs, in one pass over sorted rows, or columns."""
    if by == "col":
        field = geometry.transpose(field)
    z = F.col("z") - F.avg("z").over(Window.partitionBy("field_id", "row")) if centre else F.col("z")
    order = Window.partitionBy("field_id", "row").orderBy("col")
    centred = field.select("field_id", "row", "col", z.alias("z"))
    wide = centred.select("field_id", "z", *(F.lead("z", k).over(order).alias(f"z{k}") for k in range(1, lags + 1)))
    other = lambda k: F.col(f"z{k}") if k else F.col("z")
    sums = [
        F.struct(
            F.lit(k).alias("lag"),
            F.sum(F.col("z") * other(k)).alias("products"),
            F.sum((F.col("z") - other(k)) ** 2).alias("squares"),
            F.count(other(k)).alias("n"),
        )
        for k in range(lags + 1)
    ]
    return wide.groupBy("field_id").agg(F.array(*sums).alias("_all")).select("field_id", F.explode("_all").alias("_e")).select("field_id", "_e.*").where("n > 0")


def autocorrelation(field: DataFrame, lags: int = 16, by: str = "row") -> DataFrame:
    """``field_id, lag, acf``: mean product of pixels ``lag`` columns apart, rows less their means; ``by="col"`` exchanges both."""
    return _lagged(field, lags, True, by).select("field_id", "lag", (F.col("products") / F.col("n")).alias("acf"))


def height_difference(field: DataFrame, lags: int = 16, by: str = "row") -> DataFrame:
    """``field_id, lag, hhcf``: mean squared difference of pixels ``lag`` columns apart; ``by="col"``: rows apart."""
    return _lagged(field, lags, False, by).select("field_id", "lag", (F.col("squares") / F.col("n")).alias("hhcf"))


WINDOWS = {
    "none": lambda n: np.ones(n),
    "hann": lambda n: 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n),
    "hamming": lambda n: 0.54 - 0.46 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n),
    "blackman": lambda n: 0.42 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n) + 0.08 * np.cos(4 * np.pi * (np.arange(n) + 0.5) / n),
}


def power_spectrum(field: DataFrame, window: str = "hann", step: float = 1.0) -> DataFrame:
    """``field_id, bin, k, psdf``: power spectral density along rows, averaged over them.

    Rows come back as spectra, which are averaged by partial aggregation; a row must fit
    in a task. The window keeps the row's mean square.
    """

    def spectrum(line: Line) -> Line:
        z = line["z"]
        w = WINDOWS[window](len(z))
        f = np.fft.rfft((z - z.mean()) * w / np.sqrt((w**2).mean()))
        bins = np.arange(len(f))
        return {"bin": bins, "k": 2 * np.pi * bins / (len(z) * step), "p": np.abs(f) ** 2 * step / (2 * np.pi * len(z))}

    of_rows = map_lines(field, ["field_id", "row"], ["col"], ["z"], spectrum, "bin int, k double, p double")
    return of_rows.groupBy("field_id", "bin").agg(F.first("k").alias("k"), F.avg("p").alias("psdf"))


def _transformed(field: DataFrame, real: bool, inverse: bool) -> DataFrame:
    """Unitary transform of each row, of ``z`` or of ``re`` and ``im``; a row must fit in a task."""

    def transform(line: Line) -> Line:
        values = line["z"] if real else line["re"] + 1j * line["im"]
        f = (np.fft.ifft if inverse else np.fft.fft)(values, norm="ortho")
        return {"col": np.arange(len(f)), "re": f.real, "im": f.imag}

    out = map_lines(field, ["field_id", "row"], ["col"], ["z"] if real else ["re", "im"], transform, "col int, re double, im double")
    return out.withColumn("z", F.col("re")) if inverse else out


def row_transform(field: DataFrame, inverse: bool = False) -> DataFrame:
    """Unitary Fourier transform of each row: ``field_id, row, col, re, im``; the inverse reads ``re`` and ``im`` and gives ``z`` too."""
    return _transformed(field, not inverse, inverse)


def haar_level(field: DataFrame) -> DataFrame:
    """One level of the Haar wavelet transform: ``field_id, row, col, ll, hl, lh, hh`` for each 2 by 2 square; odd edges are left out."""
    cell = {"row": F.floor(F.col("row") / 2).cast("int"), "col": F.floor(F.col("col") / 2).cast("int")}
    part = F.when((F.col("row") % 2 == 0) & (F.col("col") % 2 == 0), "a").when(F.col("row") % 2 == 0, "b").when(F.col("col") % 2 == 0, "c").otherwise("d")
    parts = field.select("field_id", cell["row"].alias("row"), cell["col"].alias("col"), part.alias("_part"), "z")
    pick = {p: F.max(F.when(F.col("_part") == p, F.col("z"))) for p in "abcd"}
    squares = parts.groupBy("field_id", "row", "col").agg(*(c.alias(p) for p, c in pick.items())).where("d is not null")
    a, b, c, d = (F.col(p) for p in "abcd")
    return squares.select("field_id", "row", "col", ((a + b + c + d) / 2).alias("ll"), ((a - b + c - d) / 2).alias("hl"), ((a + b - c - d) / 2).alias("lh"), ((a - b - c + d) / 2).alias("hh"))


def correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pearson correlation of two fields of one shape: ``field_id, score``."""
    pairs = left.join(right.select("field_id", "row", "col", F.col("z").alias("_o")), ["field_id", "row", "col"])
    return pairs.groupBy("field_id").agg(F.corr("z", "_o").alias("score"))


def box_counting(field: DataFrame) -> DataFrame:
    """``field_id, size, ranges``: for boxes of side 2, 4, 8 .. the sum of the value ranges in them, divided by the side.

    The slope of its logarithm over that of the size is the fractal dimension's complement.
    """
    sizes = field.agg(F.max(F.greatest("row", "col"))).first()[0] or 0
    sides = [1 << i for i in range(1, max(2, int(sizes + 1).bit_length() - 1))]
    low_high = field.select("field_id", (F.floor(F.col("row") / 2)).alias("r"), (F.floor(F.col("col") / 2)).alias("c"), F.col("z").alias("lo"), F.col("z").alias("hi"))
    out = None
    for side in sides:  # each size is made of the boxes of the one before
        boxes = low_high.groupBy("field_id", "r", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        part = boxes.groupBy("field_id").agg(F.lit(side).alias("size"), (F.sum(F.col("hi") - F.col("lo")) / side).alias("ranges"))
        out = part if out is None else out.union(part)
        low_high = boxes.select("field_id", F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c"), "lo", "hi")
    return out


def autocorrelation_2d(field: DataFrame, reach: int = 4) -> DataFrame:
    """``field_id, dx, dy, acf``: mean product of pixels (dx, dy) apart, less the field's mean, for shifts of up to ``reach``.

    Half of the plane is computed, the other half is its mirror image.
    """
    mean = per_field(field.select("field_id", "row", "col", "z"), F.avg("z").alias("_m"))
    centred = mean.select("field_id", "row", "col", (F.col("z") - F.col("_m")).alias("z"))
    down = Window.partitionBy("field_id", "col").orderBy("row")
    across = Window.partitionBy("field_id", "row").orderBy("col")
    rows = centred.select("*", *(F.lead("z", dy).over(down).alias(f"d{dy}") for dy in range(1, reach + 1))).withColumnRenamed("z", "d0")
    shifts = [(dx, dy) for dy in range(reach + 1) for dx in range(-reach, reach + 1) if dy or dx >= 0]
    wide = rows.select("field_id", F.col("d0").alias("z"), *(F.lead(f"d{dy}", dx).over(across).alias(f"s{k}") for k, (dx, dy) in enumerate(shifts)))
    sums = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.avg(F.col("z") * F.col(f"s{k}")).alias("acf")) for k, (dx, dy) in enumerate(shifts)))
    half = wide.groupBy("field_id").agg(sums.alias("_s")).select("field_id", F.explode("_s").alias("s")).select("field_id", "s.*").where("acf is not null")
    other = half.where("dx != 0 or dy != 0").select("field_id", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), "acf")
    return half.union(other)


def radial_autocorrelation(field: DataFrame, reach: int = 4) -> DataFrame:
    """``field_id, lag, n, acf``: the two-dimensional function averaged over shifts of rounded length ``lag`` up to ``reach``."""
    lag = F.floor(F.hypot("dx", "dy") + 0.5).cast("int")
    rows = autocorrelation_2d(field, reach).select("field_id", lag.alias("lag"), "acf").where(F.col("lag") <= reach)
    return rows.groupBy("field_id", "lag").agg(F.count("acf").alias("n"), F.avg("acf").alias("acf"))


def transform_2d(field: DataFrame, inverse: bool = False) -> DataFrame:
    """Unitary two-dimensional Fourier transform, rows and then columns: ``field_id, row, col, re, im``; the inverse reads these and gives ``z`` too."""
    turned = geometry.transpose(row_transform(field, inverse)).select("field_id", "row", "col", "re", "im")
    return geometry.transpose(_transformed(turned, False, inverse))


def radial_spectrum(field: DataFrame) -> DataFrame:
    """``field_id, bin, n, psdf``: mean power of the two-dimensional transform over frequencies of rounded length ``bin``, the mean left out."""
    known = per_field(transform_2d(centred(field)), (F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    signed = lambda c, n: F.when(F.col(c) * 2 > F.col(n), F.col(c) - F.col(n)).otherwise(F.col(c))
    at = F.floor(F.hypot(signed("col", "_w").cast("double"), signed("row", "_h").cast("double")) + 0.5).cast("int")
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return known.select("field_id", at.alias("bin"), power.alias("p")).where("bin > 0").groupBy("field_id", "bin").agg(F.count("p").alias("n"), F.avg("p").alias("psdf"))


def centred(field: DataFrame) -> DataFrame:
    """``field`` less its mean."""
    return per_field(field.select("field_id", "row", "col", "z"), F.avg("z").alias("_m")).withColumn("z", F.col("z") - F.col("_m")).drop("_m")


def haar_rows(field: DataFrame, direction: str = "x") -> DataFrame:
    """One Haar level along rows (``x``) or columns (``y``): ``field_id, row, col, low, high`` for each pair of pixels; an odd last pixel is left out."""
    along = "col" if direction == "x" else "row"
    other = "row" if direction == "x" else "col"
    pick = lambda k: F.max(F.when(F.col(along) % 2 == k, F.col("z")))
    pairs = field.groupBy("field_id", other, F.floor(F.col(along) / 2).cast("int").alias("pair")).agg(pick(0).alias("a"), pick(1).alias("b")).where("b is not null")
    half = lambda c: (c / float(np.sqrt(2.0)))
    return pairs.select("field_id", F.col(other), F.col("pair").alias(along), half(F.col("a") + F.col("b")).alias("low"), half(F.col("a") - F.col("b")).alias("high"))


def weighted_correlation(left: DataFrame, right: DataFrame, weight: str = "weight") -> DataFrame:
    """``field_id, score``: Pearson correlation of two fields of one shape under the weights in a column of ``left``."""
    w, a, b = F.col(weight), F.col("z"), F.col("_o")
    pairs = left.join(right.select("field_id", "row", "col", F.col("z").alias("_o")), ["field_id", "row", "col"])
    total = F.sum(w)
    means = pairs.groupBy("field_id").agg((F.sum(w * a) / total).alias("_ma"), (F.sum(w * b) / total).alias("_mb"))
    d = pairs.join(F.broadcast(means) if means.limit(1001).count() <= 1000 else means, "field_id")
    da, db = a - F.col("_ma"), b - F.col("_mb")
    return d.groupBy("field_id").agg(F.try_divide(F.sum(w * da * db), F.sqrt(F.sum(w * da * da) * F.sum(w * db * db))).alias("score"))


def wavelet_rows(field: DataFrame, order: int = 4, direction: str = "x") -> DataFrame:
    """One level of a Daubechies wavelet transform of 2 or 4 coefficients along rows (``x``) or columns (``y``).

    ``field_id, row, col, low, high`` for each pair of pixels; a line closes upon itself
    and its odd last pixel is left out.
    """
    root = np.sqrt(3.0)
    taps = {2: np.array([1.0, 1.0]) / np.sqrt(2.0), 4: np.array([1 + root, 3 + root, 3 - root, 1 - root]) / (4 * np.sqrt(2.0))}[order]
    along, other = ("col", "row") if direction == "x" else ("row", "col")
    n = F.col("_n") - F.col("_n") % 2
    line = Window.partitionBy("field_id", other)
    even = per_field(field.select("field_id", "row", "col", "z"), (F.max(along) + 1).alias("_n")).where(F.col(along) < n)
    # What follows the last pixel is the line's beginning.
    starts = [F.max(F.when(F.col(along) == j, F.col("z"))).over(line) for j in range(max(order - 2, 0))]
    start = F.array(*starts) if starts else F.array().cast("array<double>")
    after = [F.coalesce(F.lead("z", i).over(line.orderBy(along)), F.get(start, (F.col(along) + i - n).cast("int"))) if i else F.col("z") for i in range(order)]
    low = sum((a * float(t) for a, t in zip(after, taps)), F.lit(0.0))
    high = sum((a * float(t) * (-1.0) ** i for i, (a, t) in enumerate(zip(after, taps[::-1]))), F.lit(0.0))
    out = even.select("field_id", "row", "col", low.alias("low"), high.alias("high")).where(F.col(along) % 2 == 0)
    return out.withColumn(along, F.floor(F.col(along) / 2).cast("int"))


def correlation_map(field: DataFrame, kernel: list[float], width: int, height: int) -> DataFrame:
    """Pearson correlation, as ``z``, of the window around each pixel with a kernel of odd sides, given row by row.

    -1 where the window leaves the field, 0 where the window or the kernel is constant.
    """
    own = np.asarray(kernel, float)
    own = own - own.mean()
    rms = float(np.sqrt((own**2).mean()))
    if len(own) != width * height or width % 2 == 0 or height % 2 == 0:
        raise ValueError("the kernel must have width * height values and odd sides")
    patch, n = F.col("patch"), float(width * height)
    mean = F.aggregate(patch, F.lit(0.0), lambda s, v: s + v) / n
    known = patches(field, width, height).withColumn("_mean", mean)
    dev = F.transform(patch, lambda v: v - F.col("_mean"))
    squares = F.aggregate(dev, F.lit(0.0), lambda s, v: s + v * v) / n
    product = F.aggregate(F.zip_with(dev, F.array(*(F.lit(float(k)) for k in own)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / n
    score = F.coalesce(F.try_divide(product, F.sqrt(squares) * rms), F.lit(0.0))
    return known.select("field_id", "row", "col", F.when(F.size("patch") == int(n), score).otherwise(-1.0).alias("z"))


def hough_lines(mask: DataFrame, angles: int = 90) -> DataFrame:
    """``field_id, angle, distance, votes``: how many marked pixels lie on each straight line.

    A line's normal has the angle ``angle`` * pi / ``angles``; its distance from the
    first pixel is in whole pixels. Votes are summed before they are shuffled.
    """
    marks = mask.where("m > 0").select("field_id", "row", "col", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("angle"))
    theta = F.col("angle") * (np.pi / angles)
    at = F.floor(F.col("col") * F.cos(theta) + F.col("row") * F.sin(theta) + 0.500001)
    return marks.groupBy("field_id", "angle", at.alias("distance")).agg(F.count(F.lit(1)).alias("votes"))
