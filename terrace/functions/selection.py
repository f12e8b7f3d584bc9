"""Which pixels take part: rectangles, ellipses and masks."""

from __future__ import annotations

from enum import Enum
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Masking(Enum):
    """How a mask column selects; of a fractional mask both kinds keep values between 0 and 1."""

    IGNORE = "ignore"
    INCLUDE = "include"
    EXCLUDE = "exclude"


class Region(NamedTuple):
    """A rectangle of pixels."""

    col: int
    row: int
    width: int
    height: int

    def inside(self) -> Column:
        return F.col("col").between(self.col, self.col + self.width - 1) & F.col("row").between(self.row, self.row + self.height - 1)

    def ellipse(self) -> Column:
        """Pixels whose centres lie in the ellipse inscribed in the rectangle."""
        x = (F.col("col") - self.col + 0.5) * (2.0 / self.width) - 1
        y = (F.col("row") - self.row + 0.5) * (2.0 / self.height) - 1
        return self.inside() & (x * x + y * y <= 1)


def selected(region: Region | None = None, masking: Masking = Masking.IGNORE, mask: str = "m") -> Column:
    """Column: the pixel is in the region and the mask lets it through."""
    chosen = region.inside() if region else F.lit(True)
    if masking is Masking.INCLUDE:
        return chosen & (F.col(mask) > 0)
    if masking is Masking.EXCLUDE:
        return chosen & (F.col(mask) < 1)
    return chosen


def chosen(field: DataFrame, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    """The pixels of a region, in or out of the mask: what a statistic of a part is taken over."""
    return field.where(selected(region, masking))
