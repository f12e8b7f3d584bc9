"""Grains: parts of a mask connected over pixel edges, their quantities and selections.

A mask is a field's column ``m``; pixels with ``m > 0`` are marked. Labelling is
distributed: marked pixels of a row form runs, runs of neighbouring rows that touch are
joined within strips of rows, one strip in a task, and components of the far smaller graph
of what touches across the strips' borders are the grains.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators import filters
from terrace.operators.arithmetic import PLACE, per_field
from terrace.operators.components import connected_components
from terrace.operators.statistics import upper_median
from terrace.plans.durable import durable, maybe_broadcast
from terrace.plans.indexing import row_index
from terrace.plans.lines import Line, map_lines

#: Rows of pixels whose runs one task joins.
STRIP = 64


def _runs(mask: DataFrame) -> DataFrame:
    """``field_id, row, start, stop, node``: marked pixels of a row that follow one another, each run with a number of its own."""
    order = Window.partitionBy("field_id", "row").orderBy("col")
    # Columns of a run differ from their rank by the same number.
    marked = mask.where("m > 0").select(*PLACE, (F.col("col") - F.row_number().over(order)).alias("_run"))
    return durable(marked.groupBy("field_id", "row", "_run").agg(F.min("col").alias("start"), F.max("col").alias("stop")).drop("_run").withColumn("node", F.monotonically_increasing_id()))


def _touching(runs: DataFrame, corners: bool) -> DataFrame:
    """``src, dst``: runs of neighbouring rows that share a column, or only touch at a corner.

    Of two such runs the later start lies in the other one, so each run need only look
    at the last run of the other row that starts no later than itself.
    """
    own = runs.select("field_id", "row", "start", "stop", "node", F.lit(0).alias("side"))
    both = own.union(runs.select("field_id", F.col("row") + 1, "start", "stop", "node", F.lit(1)))
    order = Window.partitionBy("field_id", "row").orderBy("start", "side")
    run = F.struct("stop", "node")
    seen = [F.last(F.when(F.col("side") == side, run), True).over(order) for side in (0, 1)]
    met = both.withColumns({"_0": seen[0], "_1": seen[1]}).withColumn("_o", F.when(F.col("side") == 0, F.col("_1")).otherwise(F.col("_0")))
    return met.where(F.col("_o.stop") >= F.col("start") - int(corners)).select(F.col("node").alias("src"), F.col("_o.node").alias("dst"))


def _in_strip(row: np.ndarray, start: np.ndarray, stop: np.ndarray, node: np.ndarray, corners: bool) -> np.ndarray:
    """The least ``node`` of what each run is joined to among these runs, which are sorted by row and start."""
    wide = int(stop.max()) + 2
    key = row.astype(np.int64) * wide + start
    ends = []
    for step in (-1, 1):
        at = np.searchsorted(key, key + step * wide, side="right") - 1
        hit = (at >= 0) & (row[at] == row + step) & (stop[at] >= start - int(corners))
        ends.append((np.flatnonzero(hit), at[hit]))
    one, two = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    order = np.argsort(node)
    root = np.empty(len(node), np.int64)
    root[order] = np.arange(len(node))
    one, two, root = root[one], root[two], np.arange(len(node))
    while len(one):
        a, b = root[one], root[two]
        apart = a != b
        one, two = one[apart], two[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    ranked = node[order]
    out = np.empty_like(node)
    out[order] = ranked[root]
    return out


def _by_strips(runs: DataFrame, corners: bool) -> DataFrame:
    """``runs`` with the number of one of those that each is joined to within its strip of ``STRIP`` rows."""

    def join(line: Line) -> Line:
        part = _in_strip(line["row"], line["start"], line["stop"], line["node"], corners)
        return {"row": line["row"], "start": line["start"], "stop": line["stop"], "node": part}

    dealt = runs.withColumn("_strip", F.floor(F.col("row") / STRIP))
    columns = ["row", "start", "stop", "node"]
    schema = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in columns)
    return durable(map_lines(dealt, ["field_id", "_strip"], ["row", "start"], columns, join, schema).drop("_strip"))


def number(mask: DataFrame, corners: bool = False) -> DataFrame:
    """``field_id, row, col, grain``: marked pixels with their grain's number, from 1 in the order of first pixels.

    Grains hold together over edges, with ``corners`` over corners too.
    """
    runs = _by_strips(_runs(mask), corners)
    # What is left to link are rows on both sides of a strip's border.
    border = runs.where(F.pmod("row", F.lit(STRIP)).isin(0, STRIP - 1))
    found = connected_components(_touching(border, corners))
    parts = durable(runs.join(found, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component", "node"))
    firsts = parts.groupBy("field_id", "part").agg(F.min(F.struct("row", "start")).alias("_first"))
    # One row a grain, numbered over all fields, less those of the fields before.
    ranked = row_index(firsts.select("field_id", "part", F.col("_first.row").alias("_row"), F.col("_first.start").alias("_col")), ["field_id", "_row", "_col"], "_k")
    before = ranked.groupBy("field_id").agg(F.min("_k").alias("_before"))
    names = ranked.join(maybe_broadcast(before, 32), "field_id").select("field_id", "part", (F.col("_k") - F.col("_before") + 1).alias("grain"))
    named = parts.join(maybe_broadcast(names, 40), ["field_id", "part"])
    return named.select("field_id", "row", F.explode(F.sequence("start", "stop")).alias("col"), "grain")


def quantities(field: DataFrame, grains: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """A row for each grain: size, box, centre, and the values' extremes, mean, rms, volume and slope-free spread."""
    joined = grains.join(field.select(*PLACE, "z"), PLACE)
    area = F.count(F.lit(1)) * (dx * dy)
    return joined.groupBy("field_id", "grain").agg(
        F.count(F.lit(1)).alias("pixels"),
        area.alias("area"),
        F.sqrt(area).alias("square_side"),
        F.sqrt(area / F.pi()).alias("disc_radius"),
        F.min("col").alias("left"),
        F.min("row").alias("top"),
        (F.max("col") - F.min("col") + 1).alias("width"),
        (F.max("row") - F.min("row") + 1).alias("height"),
        ((F.avg("col") + 0.5) * dx).alias("centre_x"),
        ((F.avg("row") + 0.5) * dy).alias("centre_y"),
        F.min("z").alias("min"),
        F.max("z").alias("max"),
        F.avg("z").alias("mean"),
        F.stddev_pop("z").alias("rms"),
        (F.sum("z") * dx * dy).alias("volume"),
    )


def boundary_lengths(grains: DataFrame) -> DataFrame:
    """``field_id, grain, boundary``: pixel edges between a grain and what is outside it."""
    steps = F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    sides = grains.withColumn("_s", F.explode(steps))
    looked = sides.select("field_id", (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"), "grain")
    # A neighbour of a grain's pixel that is marked is of the same grain.
    return looked.join(grains.select(*PLACE), PLACE, "left_anti").groupBy("field_id", "grain").agg(F.count(F.lit(1)).alias("boundary"))


def select(mask: DataFrame, grains: DataFrame, chosen: DataFrame) -> DataFrame:
    """``mask`` with only the grains named by ``chosen`` (``field_id, grain``) marked."""
    kept = grains.join(chosen.select("field_id", "grain"), ["field_id", "grain"], "left_semi").select(*PLACE, F.lit(1.0).alias("_m"))
    return mask.join(kept, PLACE, "left").withColumn("m", F.coalesce("_m", F.lit(0.0))).drop("_m")


def remove_small(mask: DataFrame, grains: DataFrame, pixels: int) -> DataFrame:
    """Grains of fewer than ``pixels`` pixels unmarked."""
    return select(mask, grains, grains.groupBy("field_id", "grain").count().where(F.col("count") >= pixels))


def remove_at_border(mask: DataFrame, grains: DataFrame) -> DataFrame:
    """Grains that touch the field's border unmarked."""
    size = mask.groupBy("field_id").agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    at = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("_h")) | (F.col("col") == F.col("_w"))
    inner = grains.join(size, "field_id").groupBy("field_id", "grain").agg(F.max(at).alias("at")).where("not at")
    return select(mask, grains, inner)


def fill_voids(mask: DataFrame) -> DataFrame:
    """Unmarked parts that do not reach the border marked."""
    outside = mask.withColumn("m", (F.col("m") <= 0).cast("double"))
    voids = remove_at_border(outside, number(outside)).select(*PLACE, F.col("m").alias("_void"))
    return mask.join(voids, PLACE).withColumn("m", F.greatest((F.col("m") > 0).cast("double"), "_void")).drop("_void")


def _moved(mask: DataFrame, of) -> Column:
    across = Window.partitionBy("field_id", "row").orderBy("col").rowsBetween(-1, 1)
    down = Window.partitionBy("field_id", "col").orderBy("row").rowsBetween(-1, 1)
    return mask.withColumns({"_a": of("m").over(across), "_d": of("m").over(down)})


def grow(mask: DataFrame, steps: int = 1) -> DataFrame:
    """Each step marks the pixels that share an edge with a marked one."""
    for _ in range(steps):
        mask = _moved(mask, F.max).withColumn("m", F.greatest("_a", "_d")).drop("_a", "_d")
    return mask


def shrink(mask: DataFrame, steps: int = 1) -> DataFrame:
    """Each step unmarks the pixels that share an edge with an unmarked one; the border counts as marked."""
    for _ in range(steps):
        mask = _moved(mask, F.min).withColumn("m", F.least("_a", "_d")).drop("_a", "_d")
    return mask


def merge(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Set operations on masks: ``union``, ``intersection`` or ``difference``."""
    a, b = F.col("m") > 0, F.col("_m") > 0
    m = {"union": a | b, "intersection": a & b, "difference": a & ~b}[how]
    return left.join(right.select(*PLACE, F.col("m").alias("_m")), PLACE).withColumn("m", m.cast("double")).drop("_m")


def complement(mask: DataFrame) -> DataFrame:
    return mask.withColumn("m", (F.col("m") <= 0).cast("double"))


def mark_by_threshold(field: DataFrame, share: float, below: bool = False) -> DataFrame:
    """Pixels above (or below) a share of the way from minimum to maximum marked."""
    known = per_field(field, F.min("z").alias("_low"), F.max("z").alias("_high"))
    limit = F.col("_low") + share * (F.col("_high") - F.col("_low"))
    test = F.col("z") < limit if below else F.col("z") > limit
    return known.withColumn("m", test.cast("double")).drop("_low", "_high")


def mark_slopes(field: DataFrame, share: float, below: bool = False) -> DataFrame:
    """``field_id, row, col, z, m``: the size of the gradient by Sobel's kernels, marked by ``mark_by_threshold``."""
    return mark_by_threshold(durable(filters.gradient(field)), share, below)


def mark_curvature(field: DataFrame, share: float, below: bool = False) -> DataFrame:
    """``field_id, row, col, z, m``: the Laplacian, marked by ``mark_by_threshold``."""
    return mark_by_threshold(durable(filters.kernel3(field, "laplace")), share, below)


def coverage(mask: DataFrame) -> DataFrame:
    """``field_id, marked, share``."""
    marked = F.count_if(F.col("m") > 0)
    return mask.groupBy("field_id").agg(marked.alias("marked"), (marked / F.count(F.lit(1))).alias("share"))


def extrema(field: DataFrame, maxima: bool = True) -> DataFrame:
    """``field_id, row, col, z`` of pixels above (or below) all eight neighbours."""
    across = Window.partitionBy("field_id", "row").orderBy("col")
    down = Window.partitionBy("field_id", "col").orderBy("row")
    sign = F.col("z") if maxima else -F.col("z")
    rows = field.select(*PLACE, "z", sign.alias("s")).withColumn("side", F.greatest(F.lag("s").over(across), F.lead("s").over(across)))
    rows = rows.withColumn("line", F.greatest("side", "s"))
    around = rows.select(*PLACE, "z", "s", F.greatest("side", F.lag("line").over(down), F.lead("line").over(down)).alias("around"))
    return around.where("around is null or s > around").select(*PLACE, "z")


def more_quantities(field: DataFrame, grains: DataFrame) -> DataFrame:
    """A row for each grain: ``median``, ``volume_min`` (over the minimum), ``half_area`` (pixels above half height),
    ``slope_x``, ``slope_y``, ``theta``, ``phi`` (of the fitted plane), and the axes and angle of the ellipse of equal second moments.

    The median is element floor(n/2). A pixel counts as a square, which adds 1/12 to
    each second moment. A grain without a plane of its own has slope 0.
    """
    joined = grains.join(field.select(*PLACE, "z"), PLACE)
    key = ["field_id", "grain"]
    means = joined.groupBy(*key).agg(F.avg("col").alias("_x"), F.avg("row").alias("_y"), F.avg("z").alias("_z"), F.min("z").alias("_low"), F.max("z").alias("_high"))
    d = joined.join(means, key).withColumns({"x": F.col("col") - F.col("_x"), "y": F.col("row") - F.col("_y"), "h": F.col("z") - F.col("_z")})
    xx, xy, yy, xz, yz = (F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "xy", "yy", "xh", "yh"))
    half = F.count_if(F.col("z") >= (F.col("_low") + F.col("_high")) / 2)
    sums = d.groupBy(*key).agg(F.count("z").alias("n"), xx.alias("xx"), xy.alias("xy"), yy.alias("yy"), xz.alias("xz"), yz.alias("yz"), F.sum(F.col("z") - F.col("_low")).alias("volume_min"), half.alias("half_area"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda p: F.when(det > 1e-9 * F.col("n"), p / F.nullif(det, F.lit(0.0))).otherwise(0.0)
    bx, by = solve(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")), solve(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"))
    flat = sums.withColumns({"slope_x": bx, "slope_y": by, "u": F.col("xx") / F.col("n") + 1 / 12, "v": F.col("yy") / F.col("n") + 1 / 12, "c": F.col("xy") / F.col("n")})
    root = F.sqrt(((F.col("u") - F.col("v")) / 2) ** 2 + F.col("c") * F.col("c"))
    mid = (F.col("u") + F.col("v")) / 2
    # Axes of an ellipse of these moments, scaled to the grain's area.
    big, small = F.sqrt(mid + root), F.sqrt(mid - root)
    scale = F.sqrt(F.col("n") / (F.pi() * big * small))
    angle = F.atan2(2 * F.col("c"), F.col("u") - F.col("v")) / 2
    named = flat.select(
        *key,
        "volume_min",
        "half_area",
        "slope_x",
        "slope_y",
        F.atan(F.hypot("slope_x", "slope_y")).alias("theta"),
        F.atan2("slope_y", "slope_x").alias("phi"),
        (big * scale).alias("ellipse_major"),
        (small * scale).alias("ellipse_minor"),
        angle.alias("ellipse_angle"),
    )
    return named.join(upper_median(joined, key), key)


def boundary_values(field: DataFrame, grains: DataFrame) -> DataFrame:
    """``field_id, grain, boundary_min, boundary_max``: extremes of the pixels that have a neighbour outside, or stand at the border."""
    mine = grains.join(field.select(*PLACE, "z"), PLACE)
    across = Window.partitionBy("field_id", "row", "grain").orderBy("col")
    down = Window.partitionBy("field_id", "col", "grain").orderBy("row")
    near = [(F.lag("col").over(across), F.col("col") - 1), (F.lead("col").over(across), F.col("col") + 1), (F.lag("row").over(down), F.col("row") - 1), (F.lead("row").over(down), F.col("row") + 1)]
    inner = [F.coalesce(found == wanted, F.lit(False)) for found, wanted in near]
    edge = mine.withColumn("_in", inner[0] & inner[1] & inner[2] & inner[3]).where("not _in")
    return edge.groupBy("field_id", "grain").agg(F.min("z").alias("boundary_min"), F.max("z").alias("boundary_max"))


def radii(grains: DataFrame) -> DataFrame:
    """``field_id, grain, mean_radius``: mean distance of the outer pixel edges' middles from the grain's centre."""
    centre = grains.groupBy("field_id", "grain").agg(F.avg("col").alias("_x"), F.avg("row").alias("_y"))
    steps = F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    sides = grains.withColumn("_s", F.explode(steps))
    looked = sides.select("field_id", "grain", (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"), "_s")
    outer = looked.join(grains.select(*PLACE), PLACE, "left_anti").join(centre, ["field_id", "grain"])
    x, y = F.col("col") - F.col("_s.dc") / 2 - F.col("_x"), F.col("row") - F.col("_s.dr") / 2 - F.col("_y")
    return outer.groupBy("field_id", "grain").agg(F.avg(F.hypot(x, y)).alias("mean_radius"))


def at(grains: DataFrame, row: int, col: int) -> DataFrame:
    """``field_id, grain`` of the grain that holds a pixel."""
    return grains.where((F.col("row") == row) & (F.col("col") == col)).select("field_id", "grain")


def remove_at(mask: DataFrame, grains: DataFrame, row: int, col: int) -> DataFrame:
    """The grain that holds a pixel unmarked."""
    return select(mask, grains, grains.select("field_id", "grain").distinct().join(at(grains, row, col), ["field_id", "grain"], "left_anti"))


def extract_at(mask: DataFrame, grains: DataFrame, row: int, col: int) -> DataFrame:
    """Only the grain that holds a pixel left marked."""
    return select(mask, grains, at(grains, row, col))


def remove_by_number(mask: DataFrame, grains: DataFrame, number: int) -> DataFrame:
    return select(mask, grains, grains.where(F.col("grain") != number).select("field_id", "grain").distinct())


def remove_by_height(field: DataFrame, grains: DataFrame, height: float, below: bool = False) -> DataFrame:
    """Grains unmarked of which some value lies above (or below) ``height``."""
    joined = grains.join(field.select(*PLACE, "z"), PLACE)
    test = F.min("z") >= height if below else F.max("z") <= height
    return select(field, grains, joined.groupBy("field_id", "grain").agg(test.alias("keep")).where("keep"))


def autocrop(mask: DataFrame, symmetric: bool = False) -> DataFrame:
    """``field_id, left, top, width, height``: the smallest box of all marked pixels; with ``symmetric`` the field's centre stays."""
    whole = mask.groupBy("field_id").agg((F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    box = mask.where("m > 0").groupBy("field_id").agg(F.min("col").alias("x0"), F.max("col").alias("x1"), F.min("row").alias("y0"), F.max("row").alias("y1"))
    both = box.join(whole, "field_id")
    if symmetric:
        x, y = F.least("x0", F.col("_w") - 1 - F.col("x1")), F.least("y0", F.col("_h") - 1 - F.col("y1"))
        both = both.withColumns({"x0": x, "x1": F.col("_w") - 1 - x, "y0": y, "y1": F.col("_h") - 1 - y})
    return both.select("field_id", F.col("x0").alias("left"), F.col("y0").alias("top"), (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"))


def mark_range(field: DataFrame, low: float, high: float) -> DataFrame:
    """Pixels of values from ``low`` to ``high`` marked."""
    return field.withColumn("m", F.col("z").between(low, high).cast("double"))


def distance(mask: DataFrame, steps: int) -> DataFrame:
    """``field_id, row, col, z``: steps over pixel edges from each marked pixel to the nearest unmarked one, up to ``steps``; 0 outside.

    The border counts as marked, as in ``shrink``.
    """
    now = mask.select(*PLACE, (F.col("m") > 0).cast("double").alias("m"), (F.col("m") > 0).cast("double").alias("z"))
    for _ in range(steps - 1):
        now = shrink(now).withColumn("z", F.col("z") + F.col("m"))
    return now.select(*PLACE, "z")
