"""Moving pixels: crops, flips, quarter turns, margins, resampling, profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.selection import Region
from terrace.operators.arithmetic import PLACE, per_field
from terrace.plans import tiles
from terrace.plans.lines import Line, map_lines


def _size() -> tuple[Column, Column]:
    return F.max("col") + 1, F.max("row") + 1


def _sized(field: DataFrame) -> DataFrame:
    width, height = _size()
    return per_field(field, width.alias("_xres"), height.alias("_yres"))


def crop(field: DataFrame, region: Region) -> DataFrame:
    """The rectangle as a field of its own."""
    return field.where(region.inside()).withColumns({"col": F.col("col") - region.col, "row": F.col("row") - region.row})


def paste(field: DataFrame, patch: DataFrame, col: int, row: int) -> DataFrame:
    """``field`` with the pixels of ``patch`` in place of its own; what would fall outside is left off."""
    moved = patch.select("field_id", (F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), F.col("z").alias("_new"))
    return field.join(moved, PLACE, "left").withColumn("z", F.coalesce("_new", "z")).drop("_new")


def flip(field: DataFrame, rows: bool = False, columns: bool = False) -> DataFrame:
    """Order of rows or columns reversed."""
    new = {}
    if rows:
        new["row"] = F.col("_yres") - 1 - F.col("row")
    if columns:
        new["col"] = F.col("_xres") - 1 - F.col("col")
    return _sized(field).withColumns(new).drop("_xres", "_yres") if new else field


def quarter_turn(field: DataFrame, clockwise: bool = True) -> DataFrame:
    row, col = (F.col("col"), F.col("_yres") - 1 - F.col("row")) if clockwise else (F.col("_xres") - 1 - F.col("col"), F.col("row"))
    return _sized(field).select("*", row.alias("_row"), col.alias("_col")).withColumns({"row": F.col("_row"), "col": F.col("_col")}).drop("_row", "_col", "_xres", "_yres")


def _images(at: Column, size: Column, before: int, after: int, exterior: str) -> Column:
    """Where a pixel stands in the field with margins: its own place and those of its images."""
    inside = F.array(at)
    if exterior == "edge":
        first = F.when(at == 0, F.sequence(F.lit(-before), F.lit(-1))) if before else None
        last = F.when(at == size - 1, F.sequence(size, size + (after - 1))) if after else None
        return F.concat(inside, *(F.coalesce(x, F.array().cast("array<int>")) for x in (first, last) if x is not None))
    period = 2 * size if exterior == "mirror" else size
    turns = F.sequence(F.lit(-(before + after + 1)), F.lit(before + after + 1))
    direct = F.transform(turns, lambda t: at + t * period)
    images = F.concat(direct, F.transform(turns, lambda t: t * period - 1 - at)) if exterior == "mirror" else direct
    return F.filter(images, lambda p: (p >= -before) & (p < size + after))


def extend(field: DataFrame, left: int = 0, right: int = 0, up: int = 0, down: int = 0, exterior: str = "mirror", value: float = 0.0) -> DataFrame:
    """The field with margins: ``edge`` repeats the border pixel, ``mirror`` reflects at half samples,
    ``periodic`` wraps around, ``fixed`` is ``value``. Places count from the new corner.

    Every pixel is sent to its images, so no pixel looks for another one. With
    ``fixed`` the margin's own pixels are made per field and added.
    """
    if exterior == "fixed":
        width, height = _size()
        size = field.groupBy("field_id").agg(width.alias("w"), height.alias("h"))
        rows = size.withColumn("row", F.explode(F.sequence(F.lit(-up), F.col("h") + (down - 1))))
        cells = rows.withColumn("col", F.explode(F.sequence(F.lit(-left), F.col("w") + (right - 1))))
        out = cells.where((F.col("row") < 0) | (F.col("col") < 0) | (F.col("row") >= F.col("h")) | (F.col("col") >= F.col("w")))
        whole = field.select(*PLACE, "z").union(out.select(*PLACE, F.lit(float(value))))
        return whole.withColumns({"row": F.col("row") + up, "col": F.col("col") + left})
    known = _sized(field)
    down_rows = known.withColumn("row", F.explode(_images(F.col("row"), F.col("_yres"), up, down, exterior)))
    both = down_rows.withColumn("col", F.explode(_images(F.col("col"), F.col("_xres"), left, right, exterior)))
    return both.select("field_id", (F.col("row") + up).alias("row"), (F.col("col") + left).alias("col"), "z")


def resample(field: DataFrame, xres: int, yres: int, linear: bool = True) -> DataFrame:
    """The field on a grid of ``xres`` by ``yres`` pixels of the same extent: bilinear, or the nearest pixel's value.

    Every source pixel is sent to the tiles of new pixels that it weighs in, one tile in a task.
    """
    known, side = _sized(field), tiles.TILE

    def dealt(at: Column, size: Column, new: int) -> Column:
        scale = F.lit(float(new)) / size
        reach = 1.0 if linear else 0.5
        low = F.greatest(F.floor((at + 0.5 - reach) * scale - 0.5), F.lit(0)).cast("int")
        high = F.least(F.ceil((at + 0.5 + reach) * scale - 0.5), F.lit(new - 1)).cast("int")
        weighs = F.filter(F.sequence(low, F.greatest(low, high)), lambda t: weight(at, size, (t + 0.5) / scale - 0.5) > 0)
        return F.array_distinct(F.transform(weighs, lambda t: F.floor(t / side).cast("int")))

    def weight(at: Column, size: Column, source: Column) -> Column:
        inside = F.least(F.greatest(source, F.lit(0.0)), (size - 1).cast("double"))
        if linear:
            return F.greatest(1.0 - F.abs(inside - at), F.lit(0.0))
        return F.when(F.floor(inside + 0.5) == at, 1.0).otherwise(0.0)

    rows = known.withColumn("_tr", F.explode(dealt(F.col("row"), F.col("_yres"), yres)))
    cells = rows.withColumn("_tc", F.explode(dealt(F.col("col"), F.col("_xres"), xres)))
    sent = cells.select("field_id", "_tr", "_tc", F.col("_tr").alias("_r"), F.col("_tc").alias("_c"), "row", "col", "_yres", "_xres", F.col("z").cast("double").alias("z"), F.col("z").isNotNull().alias("_known"))
    columns = ["_r", "_c", "row", "col", "_yres", "_xres", "z", "_known"]
    made = map_lines(sent, tiles.KEYS, ["row", "col"], columns, partial(_resampled, shape=(yres, xres), linear=linear, side=side), "row int, col int, z double, known boolean")
    return made.select(*PLACE, F.when(F.col("known"), F.col("z")).alias("z"))


def _axis(tile: int, side: int, size: int, new: int, linear: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Along one axis of a tile: its new places, the source places that weigh in, and for both of them around each new place the index and the weight."""
    t = np.arange(tile * side, min((tile + 1) * side, new))
    source = np.clip((t + 0.5) / (float(new) / size) - 0.5, 0.0, float(size - 1))
    if linear:
        low = np.floor(source).astype(np.int64)
        ends = [(at, np.maximum(1.0 - np.abs(source - at), 0.0)) for at in (low, low + 1)]
    else:
        ends = [(np.floor(source + 0.5).astype(np.int64), np.ones(len(t)))]
    used = np.unique(np.concatenate([at for at, _ in ends]))
    return t, used, [(np.searchsorted(used, at), w) for at, w in ends]


def _resampled(line: Line, shape: tuple[int, int], linear: bool, side: int) -> Line:
    """A tile of new pixels from the source pixels that weigh in it; a new pixel without any stays out, one of nulls alone is not known."""
    (r, rows, down), (c, cols, across) = (_axis(int(line[a][0]), side, int(line[b][0]), new, linear) for a, b, new in (("_r", "_yres", shape[0]), ("_c", "_xres", shape[1])))
    at = np.searchsorted(rows, line["row"]), np.searchsorted(cols, line["col"])
    here, known, z = (np.zeros((len(rows), len(cols)), kind) for kind in (bool, bool, float))
    has = line["_known"].astype(bool)
    here[at] = True
    known[at] = has
    z[at] = np.where(has, line["z"], 0.0)
    total = np.zeros((len(r), len(c)))
    any_here, any_known = total > 0, total > 0
    for i, u in down:
        for j, v in across:
            w = u[:, None] * v[None, :]
            cell = np.ix_(i, j)
            # A weight of zero times an infinite value is none, not NaN.
            total += np.where(w > 0, z[cell] * u[:, None] * v[None, :], 0.0)
            any_here |= here[cell] & (w > 0)
            any_known |= known[cell] & (w > 0)
    row, col = np.nonzero(any_here)
    return {"row": r[row], "col": c[col], "z": total[row, col], "known": any_known[row, col]}


def profile(field: DataFrame, start: Sequence[float], end: Sequence[float], res: int) -> DataFrame:
    """Bilinear samples along a segment between two (col, row) places: ``field_id, i, z``.

    The few sample places are made per field and meet only the four pixels around each.
    """
    t = F.lit(0.0) if res < 2 else F.col("i") / (res - 1)
    spark = field.sparkSession
    samples = spark.range(res).select(F.col("id").cast("int").alias("i")).withColumns({"x": start[0] + t * (end[0] - start[0]), "y": start[1] + t * (end[1] - start[1])})
    near = samples.withColumn("dc", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dr", F.explode(F.array(F.lit(0), F.lit(1))))
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    w = F.when(F.col("dc") == 1, fx).otherwise(1 - fx) * F.when(F.col("dr") == 1, fy).otherwise(1 - fy)
    placed = near.select("i", (F.floor("y") + F.col("dr")).cast("int").alias("row"), (F.floor("x") + F.col("dc")).cast("int").alias("col"), w.alias("w")).where("w > 0")
    # As many rows as samples, a parameter of the call.
    return field.join(F.broadcast(placed), ["row", "col"]).groupBy("field_id", "i").agg((F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("z"))


def column_of(field: DataFrame, col: int) -> DataFrame:
    return field.where(F.col("col") == col).select(F.col("field_id").alias("line_id"), F.col("row").alias("i"), F.col("z").alias("y"))


def row_of(field: DataFrame, row: int) -> DataFrame:
    return field.where(F.col("row") == row).select(F.col("field_id").alias("line_id"), F.col("col").alias("i"), F.col("z").alias("y"))


def line_of(field: DataFrame, at: int, by: str = "row", start: int = 0, stop: int | None = None) -> DataFrame:
    """A row or column, or a part of it, as a line."""
    along = "col" if by == "row" else "row"
    inside = (F.col(along) >= start) & (F.lit(True) if stop is None else F.col(along) < stop)
    return field.where((F.col(by) == at) & inside).select(F.col("field_id").alias("line_id"), (F.col(along) - start).alias("i"), F.col("z").alias("y"))


def put_line(field: DataFrame, lines: DataFrame, at: int, by: str = "row", start: int = 0) -> DataFrame:
    """``field`` with a line's samples in a row or column, from ``start`` on."""
    along = "col" if by == "row" else "row"
    new = lines.select(F.col("line_id").alias("field_id"), F.lit(at).alias(by), (F.col("i") + start).cast("int").alias(along), F.col("y").alias("_y"))
    return field.join(new, PLACE, "left").withColumn("z", F.coalesce("_y", "z")).drop("_y")


def in_circle(col: int, row: int, radius: float) -> Column:
    """Whether a pixel lies within ``radius`` of a pixel."""
    dx, dy = F.col("col") - col, F.col("row") - row
    return dx * dx + dy * dy <= radius * radius


def extract(field: DataFrame, inside: Column) -> DataFrame:
    """``field_id, row, col, z`` of the pixels of a shape."""
    return field.where(inside).select(*PLACE, "z")


def put_back(field: DataFrame, pixels: DataFrame) -> DataFrame:
    """``field`` with the values of ``pixels`` where there are some."""
    new = pixels.select(*PLACE, F.col("z").alias("_new"))
    return field.join(new, PLACE, "left").withColumn("z", F.coalesce("_new", "z")).drop("_new")


def size_of(field: DataFrame, inside: Column) -> DataFrame:
    """``field_id, n``: pixels of a shape."""
    return field.where(inside).groupBy("field_id").agg(F.count(F.lit(1)).alias("n"))


def fill_shape(field: DataFrame, inside: Column, value: float) -> DataFrame:
    return field.withColumn("z", F.when(inside, float(value)).otherwise(F.col("z")))


def on_area(field: DataFrame, region: Region, of) -> DataFrame:
    """``field`` with an area replaced by what ``of`` makes of it; ``of`` sees the area alone, as a field of its own."""
    done = of(crop(field, region)).select("field_id", (F.col("row") + region.row).alias("row"), (F.col("col") + region.col).alias("col"), "z")
    return put_back(field, done)


def transpose(field: DataFrame) -> DataFrame:
    """Rows and columns exchanged."""
    return field.withColumns({"row": F.col("col"), "col": F.col("row")})


def roll(field: DataFrame, back: bool = False) -> DataFrame:
    """Quadrants exchanged, so that what was at (0, 0) stands in the middle; ``back`` undoes it."""
    known = per_field(field, (F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    half = lambda n: F.floor((F.col(n) + (1 if back else 0)) / 2)
    return known.withColumns({"col": ((F.col("col") + half("_w")) % F.col("_w")).cast("int"), "row": ((F.col("row") + half("_h")) % F.col("_h")).cast("int")}).drop("_w", "_h")


def warp(field: DataFrame, x: Column, y: Column) -> DataFrame:
    """The field read, bilinearly, at place (``x``, ``y``) for each of its pixels.

    ``x`` and ``y`` are columns over ``row``, ``col`` and the field's size ``_xres``,
    ``_yres``. Places off the field get its minimum; the half pixel at its edge is
    mirrored; pixels without value have no weight. Every pixel asks the at most four
    around its place for their values, in one join on places and one aggregation.
    """
    size = F.col("_xres"), F.col("_yres")
    known = per_field(field.select(*PLACE, "z"), (F.max("col") + 1).alias("_xres"), (F.max("row") + 1).alias("_yres"), F.min("z").alias("_low"))
    at = known.select(*PLACE, "_xres", "_yres", "_low", x.alias("_x"), y.alias("_y"))
    inside = F.col("_x").between(0, size[0]) & F.col("_y").between(0, size[1])
    values = read_places(field, at.where(inside).select(*PLACE, F.col("_xres").alias("_w"), F.col("_yres").alias("_h"), "_x", "_y"))
    return at.join(values, PLACE, "left").select(*PLACE, F.coalesce("_v", "_low").alias("z"))


def read_places(field: DataFrame, places: DataFrame) -> DataFrame:
    """``field_id, row, col, _v``: the field's bilinear value at column ``_x`` and row ``_y`` of each of ``places``, which may be of any number and shape.

    ``places`` has its own ``field_id, row, col`` and the size ``_w, _h`` of the field, whose edge is
    mirrored. Pixels without value have no weight, and places that only such surround no row.
    """
    corners = F.array(*(F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b")) for a in (0, 1) for b in (0, 1)))
    near = places.select("*", F.inline(corners))

    def part(place: str, step: str) -> Column:
        over = F.col(place) - F.floor(place)
        return F.when(F.col(step) == 1, over).otherwise(1 - over)

    def mirrored(place: str, step: str, n: Column) -> Column:
        i = F.pmod(F.floor(place) + F.col(step), 2 * n)
        return F.when(i < n, i).otherwise(2 * n - 1 - i).cast("int")

    asked = near.select(
        "field_id", F.col("row").alias("_row"), F.col("col").alias("_col"), (part("_x", "_a") * part("_y", "_b")).alias("_part"),
        mirrored("_y", "_b", F.col("_h")).alias("row"), mirrored("_x", "_a", F.col("_w")).alias("col"),
    ).where("_part > 0")
    found = asked.join(field.select(*PLACE, "z").where("z is not null"), PLACE).groupBy("field_id", "_row", "_col")
    return found.agg((F.sum(F.col("z") * F.col("_part")) / F.sum("_part")).alias("_v")).toDF(*PLACE, "_v")


def rotate(field: DataFrame, angle: float) -> DataFrame:
    """The field turned about its middle by ``angle`` radians, in its own frame; see ``warp``."""
    sin, cos = math.sin(angle), math.cos(angle)
    mx, my = (F.col("_xres") - 1) / 2, (F.col("_yres") - 1) / 2
    dx, dy = F.col("col") - mx, F.col("row") - my
    return warp(field, dx * cos - dy * sin + mx, dx * sin + dy * cos + my)


def affine(field: DataFrame, matrix: Sequence[float], shift: Sequence[float] = (0.0, 0.0)) -> DataFrame:
    """The field read at x = a col + b row + shift, y = c col + d row + shift for the matrix (a, b, c, d); see ``warp``."""
    a, b, c, d = (float(v) for v in matrix)
    col, row = F.col("col"), F.col("row")
    return warp(field, a * col + b * row + float(shift[0]), c * col + d * row + float(shift[1]))


def undrift(field: DataFrame, per_row: float) -> DataFrame:
    """Rows moved back by a steady drift of ``per_row`` columns a row; see ``warp``."""
    return affine(field, (1, per_row, 0, 1))


def shift(field: DataFrame, columns: int, rows: int, value: float = 0.0, of: str = "z") -> DataFrame:
    """Column ``of`` moved by whole pixels within the field's frame; pixels that nothing moves to get ``value``."""
    moved = field.select("field_id", (F.col("row") + rows).alias("row"), (F.col("col") + columns).alias("col"), F.col(of).alias("_v"), F.lit(True).alias("_has"))
    return field.select(*PLACE).join(moved, PLACE, "left").select(*PLACE, F.when(F.col("_has"), F.col("_v")).otherwise(value).alias(of))
