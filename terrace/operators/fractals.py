"""How roughness scales: block variances and triangulated areas of square fields by size, and the dimensions they give."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.arithmetic import per_field
from terrace.operators.geometry import resample
from terrace.operators.spatial import power_spectrum
from terrace.plans import tiles
from terrace.plans.durable import durable
from terrace.plans.lines import Line, map_lines


def square(field: DataFrame, levels: int | None = None, linear: bool = True) -> DataFrame:
    """The field on a square grid of 2^levels + 1 pixels; the nearest power of its width without ``levels``."""
    if levels is None:
        width = (field.agg(F.max("col")).first()[0] or 0) + 1
        levels = int(math.log2(width) + 0.5)
    side = (1 << levels) + 1
    return durable(resample(field, side, side, linear))


def partitioning(squared: DataFrame) -> DataFrame:
    """``field_id, level, log_size, log_variance``: logarithm of the mean variance in blocks of 2^level pixels a side.

    Takes fields of 2^k + 1 pixels a side. The last row and column of blocks do not take
    part, but all blocks divide the sum. The smallest blocks are made from pixels, the
    others from these.
    """
    d = F.col("z") - F.col("mean")
    known = per_field(squared, F.max("col").alias("side"), F.avg("z").alias("mean"))
    small = known.groupBy("field_id", "side", F.floor(F.col("row") / 2).alias("r"), F.floor(F.col("col") / 2).alias("c"))
    small = durable(small.agg(F.count("z").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q")))
    top = F.floor(F.log2(F.col("side").cast("double")) + 0.5).cast("int") - 1
    each = small.where(F.col("side") >= 4).withColumn("level", F.explode(F.sequence(F.lit(1), top)))
    blocks = F.floor(F.col("side") / F.pow(F.lit(2.0), F.col("level")))
    scale = F.pow(F.lit(2.0), F.col("level") - 1)
    placed = each.withColumns({"blocks": blocks, "r": F.floor(F.col("r") / scale), "c": F.floor(F.col("c") / scale)})
    taken = placed.where("r < blocks - 1 and c < blocks - 1").groupBy("field_id", "level", "blocks", "r", "c")
    sums = taken.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))
    mean_of = F.sum(variance) / (F.col("blocks") * F.col("blocks"))
    out = sums.groupBy("field_id", "level", "blocks").agg(mean_of.alias("v"))
    return out.select("field_id", "level", (F.col("level") * math.log(2)).alias("log_size"), F.ln("v").alias("log_variance"))


def _triangle(a, b, c):
    half = (a + b + c) / 2
    return np.sqrt(np.maximum(half * (half - a) * (half - b) * (half - c), 0.0))


def _areas(line: Line, side: int) -> Line:
    """Area over the squares of each level that lie in a tile of ``side`` squares; levels of larger squares stay out."""
    wide, top = side + 1, int(line["top"][0])
    h, known = tiles.frame(line, "h", wide, 0.0), tiles.frame({**line, "_k": np.ones(len(line["h"]), bool)}, "_k", wide, False)
    levels, sums = [], []
    for level in range(top + 1):
        step = 1 << (top - level)
        if step > side:
            continue
        g, k = h[::step, ::step], known[::step, ::step]
        whole = k[:-1, :-1] & k[:-1, 1:] & k[1:, :-1] & k[1:, 1:]
        if not whole.any():
            continue
        h1, h2, h3, h4 = (x[whole] for x in (g[:-1, :-1], g[:-1, 1:], g[1:, :-1], g[1:, 1:]))
        across = np.hypot(step * math.sqrt(2), h3 - h2)
        one = _triangle(np.hypot(step, h1 - h2), np.hypot(step, h1 - h3), across)
        levels.append(level)
        sums.append((one + _triangle(np.hypot(step, h3 - h4), np.hypot(step, h2 - h4), across)).sum())
    return {"level": np.array(levels, np.int32), "top": np.full(len(levels), top, np.int32), "a": np.array(sums, float)}


def triangulation(squared: DataFrame) -> DataFrame:
    """``field_id, level, log_scale, log_area``: area of the surface over 2^level squares a side, each cut in two triangles.

    Takes fields of 2^k + 1 pixels a side, heights stretched to a range of 2^k pixels. A
    task adds up the levels whose squares fit into a tile; pixels at the corners of tiles
    make a field of their own, from which come the larger squares.
    """
    top = F.floor(F.log2(F.col("side").cast("double")) + 0.5).cast("int")
    known = per_field(squared, F.max("col").alias("side"), F.min("z").alias("low"), F.max("z").alias("high")).where("high > low").withColumn("top", top)
    height = F.col("z") * F.col("side") / (F.col("high") - F.col("low"))
    pixels = known.select("field_id", "row", "col", height.alias("h"), "top").where("h is not null")
    side = tiles.TILE
    columns, schema = ["h", "top", *tiles.PLACES], "level int, top int, a double"
    dealt = tiles.with_tiles(pixels, before=0)
    small = map_lines(dealt, tiles.KEYS, ["row", "col"], columns, partial(_areas, side=side), schema).select("field_id", "level", "top", "a")
    step = F.pow(F.lit(2.0), F.col("top") - F.col("level"))
    corners = pixels.where((F.col("row") % side == 0) & (F.col("col") % side == 0) & (F.pow(F.lit(2.0), "top") > side))
    large = _large_faces(corners.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))).withColumn("s", step).where((F.col("s") > side) & (F.col("row") % F.col("s") == 0) & (F.col("col") % F.col("s") == 0)))
    out = small.union(large).groupBy("field_id", "level", "top").agg(F.sum("a").alias("a"))
    return out.select("field_id", "level", ((F.col("level") - F.col("top")) * math.log(2)).alias("log_scale"), F.ln("a").alias("log_area"))


def _large_faces(corners: DataFrame) -> DataFrame:
    """``field_id, level, top, a``: area over the squares of ``s`` pixels a side between neighbouring ``corners`` of a level."""
    right = F.lead("h").over(Window.partitionBy("field_id", "level", "row").orderBy("col"))
    down = Window.partitionBy("field_id", "level", "col").orderBy("row")
    faces = corners.withColumn("h2", right).withColumns({"h3": F.lead("h").over(down), "h4": F.lead("h2").over(down)}).where("h4 is not null")
    edge = lambda p, q: F.hypot(F.col("s"), F.col(p) - F.col(q))
    across = F.hypot(F.col("s") * math.sqrt(2), F.col("h3") - F.col("h2"))

    def triangle(a, b, c):
        half = (a + b + c) / 2
        return F.sqrt(F.greatest(half * (half - a) * (half - b) * (half - c), F.lit(0.0)))

    area = triangle(edge("h", "h2"), edge("h", "h3"), across) + triangle(edge("h3", "h4"), edge("h2", "h4"), across)
    return faces.groupBy("field_id", "level", "top").agg(F.sum(area).alias("a"))


def dimension(scaling: DataFrame, x: str, y: str, start: float, factor: float) -> DataFrame:
    """``field_id, dimension``: ``start`` plus ``factor`` times the slope of ``y`` over ``x``."""
    return scaling.groupBy("field_id").agg((start + factor * F.regr_slope(y, x)).alias("dimension"))


def partitioning_dimension(squared: DataFrame) -> DataFrame:
    return dimension(partitioning(squared), "log_size", "log_variance", 3.0, -0.5)


def triangulation_dimension(squared: DataFrame) -> DataFrame:
    return dimension(triangulation(squared), "log_scale", "log_area", 2.0, 1.0)


def spectral(field: DataFrame) -> DataFrame:
    """``field_id, bin, log_frequency, log_power``: logarithms of the power spectral density along rows, by the Hann window; frequency 0 is left out."""
    spectrum = power_spectrum(field, "hann").where("bin > 0 and psdf > 0")
    return spectrum.select("field_id", "bin", F.ln(F.col("bin").cast("double")).alias("log_frequency"), F.ln("psdf").alias("log_power"))


def spectral_dimension(field: DataFrame) -> DataFrame:
    """``field_id, dimension``: 3.5 and half the slope of the spectrum, frequencies alike in weight."""
    d = spectral(field)
    return d.groupBy("field_id").agg((3.5 + F.regr_slope("log_power", "log_frequency") / 2).alias("dimension"))
