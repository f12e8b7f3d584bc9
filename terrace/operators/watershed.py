"""Watershed: a field cut into basins, one around each minimum.

Pixels are ordered by value, then by row and column, so no two are equal. Each points to
the least of its eight neighbours that is less than itself, and a pixel without one is a
minimum; following the pointers gives the basin that flooding in this order gives.
Pointers are followed within tiles, one tile in a task, then by doubling over the pixels on
tiles' borders alone. Shallow basins, and the parts of a flat minimum, are joined over
their lowest saddles. A pixel's place is one number, in the order of rows and columns.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.arithmetic import PLACE
from terrace.operators.components import connected_components
from terrace.plans import tiles
from terrace.plans.durable import durable, maybe_broadcast, written
from terrace.plans.indexing import row_index
from terrace.plans.lines import Line, map_lines

_BOTTOM = ["bottom_row", "bottom_col"]
_WIDE = 1 << 32  # places of one row


def _place(row: str, col: str) -> Column:
    return F.col(row).cast("long") * _WIDE + F.col(col)


def _row_of(place: Column) -> Column:
    return F.shiftright(place + (_WIDE >> 1), 32)


def _bottoms(df: DataFrame, place: str, row: str, col: str) -> list[Column]:
    """``bottom_row, bottom_col`` from a place, of the types that the field has."""
    at, kinds = F.col(place), df.schema
    return [_row_of(at).cast(kinds[row].dataType).alias("bottom_row"), (at - _row_of(at) * _WIDE).cast(kinds[col].dataType).alias("bottom_col")]


def _descend(line: Line, side: int) -> Line:
    """For each pixel of a tile: where its way down ends, or leaves the tile; ``inside`` if it ends."""
    wide = side + 2
    z = tiles.frame(line, "z", wide, np.inf).ravel()
    order = np.argsort(z, kind="stable")
    rank = np.empty(wide * wide, np.int64)
    rank[order] = np.arange(wide * wide)
    rank[np.isinf(z)] = wide * wide
    rank = rank.reshape(wide, wide)
    least = rank.copy()
    for axis in (0, 1):
        near = least.copy()
        for to, of in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
            to, of = ((to, slice(None)), (of, slice(None))) if axis == 0 else ((slice(None), to), (slice(None), of))
            near[to] = np.minimum(near[to], least[of])
        least = near
    own = np.zeros((wide, wide), bool)
    own[1:-1, 1:-1] = rank[1:-1, 1:-1] < wide * wide
    to = np.arange(wide * wide)
    to[own.ravel()] = order[least[own]]
    while (to[to] != to).any():
        to = to[to]
    at = np.flatnonzero(own.ravel())
    end = to[at]
    top, left = int(line["_top"][0]), int(line["_left"][0])
    place = lambda k: (k // wide + top) * _WIDE + k % wide + left
    return {"row": at // wide + top, "col": at % wide + left, "z": z[at], "to": place(end), "inside": own.ravel()[end]}


def _typed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def basins(field: DataFrame) -> DataFrame:
    """``field_id, row, col, z, bottom_row, bottom_col``: each pixel with the minimum that its way down ends in.

    Pixels whose value is null, NaN or infinite stand outside, as walls. Only ways that
    leave their tile are followed further, over the pixels on tiles' borders, and their steps
    double in every round.
    """
    inside = field.where(F.abs("z") < float("inf")).select(*PLACE, F.col("z").cast("double").alias("z"))
    dealt = tiles.with_tiles(inside)
    schema = f"{_typed(inside, ['row', 'col'])}, z double, to bigint, inside boolean"
    now = durable(map_lines(dealt, tiles.KEYS, ["row", "col"], ["z", *tiles.PLACES], partial(_descend, side=tiles.TILE), schema).select(*PLACE, "z", "to", "inside"))
    on_border = [F.pmod(c, F.lit(tiles.TILE)).isin(0, tiles.TILE - 1) for c in ("row", "col")]
    # A step from any pixel on a border, doubled in every round.
    step = durable(now.where(on_border[0] | on_border[1]).select("field_id", _place("row", "col").alias("at"), "to", "inside"))
    ends, todo = step.where("inside"), step.where("not inside")
    while not todo.isEmpty():
        ahead = step.select("field_id", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("inside").alias("_in"))
        moved = written(todo.join(ahead, ["field_id", "to"]).select("field_id", "at", F.col("_to").alias("to"), F.col("_in").alias("inside")))
        ends = ends.unionByName(moved.where("inside"))
        todo = moved.where("not inside")
        step = ends.unionByName(todo)
    names = ends.select("field_id", F.col("at").alias("to"), F.col("to").alias("_end"))
    far = now.where("not inside").join(maybe_broadcast(names, 40), ["field_id", "to"]).select(*PLACE, "z", F.col("_end").alias("to"))
    found = now.where("inside").select(*PLACE, "z", "to").unionByName(far)
    return found.select(*PLACE, "z", *_bottoms(found, "to", "row", "col"))


def _meet(line: Line, side: int) -> Line:
    """Basins that touch in a tile, or a tile and the pixels around it, and their least height."""
    wide = side + 2
    z = tiles.frame(line, "z", wide, np.inf)
    part = tiles.frame(line, "_part", wide, 0)
    own = slice(1, -1)
    a, b, height = [], [], []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        there = slice(1 + dr, wide - 1 + dr), slice(1 + dc, wide - 1 + dc)
        high = np.maximum(z[own, own], z[there])
        met = (part[own, own] != part[there]) & np.isfinite(high)
        one, two = part[own, own][met], part[there][met]
        a.append(np.minimum(one, two))
        b.append(np.maximum(one, two))
        height.append(high[met])
    a, b, height = map(np.concatenate, (a, b, height))
    order = np.lexsort((height, b, a))
    a, b, height = a[order], b[order], height[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return {"a": a[first], "b": b[first], "height": height[first]}


def _saddles(parts: DataFrame) -> DataFrame:
    """``saddles`` with basins by the places of their minima."""
    here = parts.select(*PLACE, "z", _place(*_BOTTOM).alias("_part"))
    met = map_lines(tiles.with_tiles(here), tiles.KEYS, ["row", "col"], ["z", "_part", *tiles.PLACES], partial(_meet, side=tiles.TILE), "a bigint, b bigint, height double")
    return met.groupBy("field_id", "a", "b").agg(F.min("height").alias("height"))


def saddles(parts: DataFrame) -> DataFrame:
    """``field_id, a, b, height``: for basins that touch, the least height at which water passes; ``a < b`` are structs of row and column.

    Water passes between two neighbouring pixels at the greater of their values.
    """
    return _saddles(parts).select("field_id", *(F.struct(*_bottoms(parts, c, *_BOTTOM)).alias(c) for c in "ab"), "height")


def merge_shallow(parts: DataFrame, depth: float = 0.0) -> DataFrame:
    """Basins (of ``basins``) no deeper than ``depth`` joined to the one over their lowest saddle.

    In each round every basin whose lowest saddle lies no more than ``depth`` over its
    minimum is joined to the neighbour there (of equal saddles, the neighbour of least
    minimum, then place); what is joined is one basin with the least of the minima, and
    rounds go on until no basin is shallow. With 0 the parts of a flat minimum become one.
    """
    lows = durable(parts.where("row = bottom_row and col = bottom_col").select("field_id", _place(*_BOTTOM).alias("part"), F.col("z").alias("low")))
    edges = durable(_saddles(parts))
    # The basin that each first basin has become.
    became = lows.select("field_id", F.col("part").alias("first"), "part")
    while True:
        ways = edges.select("field_id", "a", "b", "height").union(edges.select("field_id", "b", "a", "height"))
        far = lows.select("field_id", F.col("part").alias("b"), F.col("low").alias("far"))
        best = ways.join(far, ["field_id", "b"]).groupBy("field_id", F.col("a").alias("part")).agg(F.min(F.struct("height", "far", "b")).alias("way"))
        shallow = best.join(lows, ["field_id", "part"]).where(F.col("way.height") - F.col("low") <= depth)
        node = lambda c: F.struct("field_id", F.col(c).alias("part"))
        joins = durable(shallow.withColumn("to", F.col("way.b")).select(node("part").alias("src"), node("to").alias("dst")))
        if joins.isEmpty():
            break
        groups = durable(connected_components(joins).select(F.col("node.field_id").alias("field_id"), F.col("node.part").alias("part"), F.col("component.part").alias("group")))
        grouped = lows.join(maybe_broadcast(groups, 60), ["field_id", "part"], "left").withColumn("group", F.coalesce("group", "part"))
        leads = grouped.groupBy("field_id", "group").agg(F.min(F.struct("low", "part")).alias("lead")).select("field_id", "group", F.col("lead.part").alias("new"))
        renamed = durable(grouped.join(leads, ["field_id", "group"]).select("field_id", "part", "low", "new"))
        names = maybe_broadcast(renamed.select("field_id", "part", "new"), 60)
        became = durable(became.join(names, ["field_id", "part"]).select("field_id", "first", F.col("new").alias("part")))
        for side in "ab":
            edges = edges.join(names.select("field_id", F.col("part").alias(side), F.col("new").alias(f"new_{side}")), ["field_id", side])
        kept = edges.where("new_a != new_b").groupBy("field_id", F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        edges = written(kept.agg(F.min("height").alias("height")))
        lows = written(renamed.where("part = new").select("field_id", "part", "low"))
    table = maybe_broadcast(became.select("field_id", F.col("first").alias("_first"), F.col("part").alias("_part")), 60)
    joined = parts.withColumn("_first", _place(*_BOTTOM)).join(table, ["field_id", "_first"])
    return joined.select(*PLACE, "z", *_bottoms(parts, "_part", *_BOTTOM))


def watershed(field: DataFrame, depth: float = 0.0) -> DataFrame:
    """``field_id, row, col, grain``: basins deeper than ``depth``, numbered from 1 in the order of their minima's places."""
    parts = durable(merge_shallow(durable(basins(field)), depth))
    bottoms = durable(parts.select("field_id", *_BOTTOM).distinct())
    ranked = row_index(bottoms, ["field_id", *_BOTTOM], "_k")
    before = ranked.groupBy("field_id").agg(F.min("_k").alias("_before"))
    names = ranked.join(maybe_broadcast(before, 32), "field_id").select("field_id", *_BOTTOM, (F.col("_k") - F.col("_before") + 1).alias("grain"))
    return parts.join(maybe_broadcast(durable(names), 60), ["field_id", *_BOTTOM]).select(*PLACE, "grain")


def _lines(line: Line, side: int) -> Line:
    """Whether each pixel of a tile has the least number of those around it."""
    wide = side + 2
    none = np.iinfo(np.int64).max
    grain = tiles.frame({**line, "grain": line["grain"].astype(np.int64)}, "grain", wide, none)
    own = grain[1:-1, 1:-1]
    least = np.minimum.reduce([grain[1 + dr : wide - 1 + dr, 1 + dc : wide - 1 + dc] for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    row, col = np.nonzero(own != none)
    return {"row": row + 1 + int(line["_top"][0]), "col": col + 1 + int(line["_left"][0]), "m": (least == own)[row, col].astype(float)}


def segments(grains: DataFrame) -> DataFrame:
    """``field_id, row, col, m``: pixels of basins marked, but for lines of one pixel between them.

    A pixel is on a line if one of its eight neighbours is of a basin of smaller number.
    """
    dealt = tiles.with_tiles(grains.select(*PLACE, "grain"))
    made = map_lines(dealt, tiles.KEYS, ["row", "col"], ["grain", *tiles.PLACES], partial(_lines, side=tiles.TILE), f"{_typed(grains, ['row', 'col'])}, m double")
    return made.select(*PLACE, "m")
