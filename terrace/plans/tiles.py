"""Fields cut into tiles: a task works on one tile of pixels and the pixels around it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.plans.lines import Line

#: Rows and columns of a tile.
TILE = 256


def _tiles(c: str, side: int, before: int, after: int) -> Column:
    """The tiles along one axis that a pixel belongs to, its own and those that it stands around."""
    own, place = F.floor(F.col(c) / side).cast("int"), F.pmod(c, F.lit(side))
    more = []
    if before:
        more.append(F.when(place >= side - before, own + 1))
    if after:
        more.append(F.when(place < after, own - 1))
    return F.explode(F.array_compact(F.array(own, *more)))


def with_tiles(field: DataFrame, before: int = 1, after: int = 1, side: int | None = None) -> DataFrame:
    """``field`` with the place of a tile, ``_tr, _tc``: each pixel stands in its own tile and in those it is next to.

    A tile has ``side`` rows and columns of its own, ``before`` more above and on the left and
    ``after`` more below and on the right.
    """
    side = side or TILE
    return field.withColumn("_tr", _tiles("row", side, before, after)).withColumn("_tc", _tiles("col", side, before, after)).withColumns({"_top": F.col("_tr") * side - before, "_left": F.col("_tc") * side - before})


#: Keys of a tile, for ``map_lines``.
KEYS = ["field_id", "_tr", "_tc"]
#: What a function of a tile needs to know of each pixel's place.
PLACES = ["row", "col", "_top", "_left"]


def frame(line: Line, name: str, width: int, empty: float) -> np.ndarray:
    """The column ``name`` of a tile's pixels as a square array of ``width``; ``empty`` where there is no pixel."""
    out = np.full((width, width), empty, line[name].dtype)
    out[line["row"] - line["_top"], line["col"] - line["_left"]] = line[name]
    return out
