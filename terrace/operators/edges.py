"""Edges and corners found by gradients."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators import filters, grains
from terrace.operators.arithmetic import PLACE, per_field
from terrace.plans.durable import durable


def _gradients(field: DataFrame) -> DataFrame:
    return filters.convolved(field, {"gx": filters.KERNELS["sobel_x"], "gy": filters.KERNELS["sobel_y"]}, 3, 3)


def _not_less(size: Column, before: Column, after: Column) -> Column:
    """Larger than the neighbour after, no less than the one before; outside the field is nothing."""
    nothing = F.lit(0.0)
    return (size >= F.coalesce(before, nothing)) & (size > F.coalesce(after, nothing))


def ridges(field: DataFrame) -> DataFrame:
    """``field_id, row, col, size, top``: length of Sobel's gradient, and whether it is greatest along the gradient's direction.

    The direction is one of four: along rows or columns if the angle to them is under
    22.5 degrees, else along a diagonal.
    """
    across = Window.partitionBy("field_id", "row").orderBy("col")
    down = Window.partitionBy("field_id", "col").orderBy("row")
    sized = durable(_gradients(field).withColumn("size", F.hypot("gx", "gy")))
    rows = sized.withColumns({"_l": F.lag("size").over(across), "_r": F.lead("size").over(across)})
    near = {f"_{a}{b}": of(c).over(down) for a, of in (("u", F.lag), ("d", F.lead)) for b, c in (("l", "_l"), ("c", "size"), ("r", "_r"))}
    around = rows.withColumns(near)
    x, y, flat = F.abs("gx"), F.abs("gy"), math.tan(math.pi / 8)
    pairs = (("_l", "_r"), ("_uc", "_dc"), ("_ul", "_dr"), ("_ur", "_dl"))
    along, up, falling, rising = (_not_less(F.col("size"), F.col(a), F.col(b)) for a, b in pairs)
    top = F.when(y <= flat * x, along).when(x <= flat * y, up).when(F.col("gx") * F.col("gy") > 0, falling).otherwise(rising)
    return around.select(*PLACE, "size", (top & (F.col("size") > 0)).alias("top"))


def canny(field: DataFrame, low: float = 0.1, high: float = 0.3) -> DataFrame:
    """``field_id, row, col, m``: ridges of the gradient of at least ``high`` times its maximum, and what hangs on them of at least ``low``.

    Weak ridges hold together over edges and corners; of each such part all is kept if
    one of its pixels is strong, else nothing.
    """
    known = per_field(durable(ridges(field)), F.max("size").alias("_most"))
    weak = F.col("top") & (F.col("size") >= low * F.col("_most"))
    marked = durable(known.select(*PLACE, weak.cast("double").alias("m"), (F.col("top") & (F.col("size") >= high * F.col("_most"))).alias("strong")))
    parts = durable(grains.number(marked, corners=True))
    strong = parts.join(marked.where("strong").select(*PLACE), PLACE).select("field_id", "grain").distinct()
    return grains.select(marked.drop("strong"), parts, strong)


def harris(field: DataFrame, neighbourhood: int = 3, alpha: float = 0.07) -> DataFrame:
    """``field_id, row, col, z``: Harris's corner response, determinant less ``alpha`` times the squared trace.

    Products of the gradients, over the squared sum of their ranges, are weighed by a
    Gaussian of sigma ``neighbourhood / 5`` cut at ``neighbourhood`` pixels. Pixels
    nearer than that to the border count as 0 and are 0.
    """
    if neighbourhood < 1:
        raise ValueError("the neighbourhood must be at least one pixel")
    spread = (F.max("gx") - F.min("gx") + F.max("gy") - F.min("gy")).alias("_s")
    known = per_field(durable(_gradients(field)), spread, (F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    inner = (F.col("col") >= neighbourhood) & (F.col("row") >= neighbourhood) & (F.col("col") < F.col("_w") - neighbourhood) & (F.col("row") < F.col("_h") - neighbourhood)
    products = {"xx": F.col("gx") * F.col("gx"), "xy": F.col("gx") * F.col("gy"), "yy": F.col("gy") * F.col("gy")}
    weighed = {k: F.when(inner & (F.col("_s") > 0), p / (F.col("_s") * F.col("_s"))).otherwise(0.0) for k, p in products.items()}
    now = known.select(*PLACE, inner.alias("inner"), *(c.alias(k) for k, c in weighed.items()))
    sigma = neighbourhood / 5
    weights = [math.exp(-((k / sigma) ** 2) / 2) / (2 * math.pi * sigma * sigma) for k in range(-neighbourhood, neighbourhood + 1)]
    for by, order in (("row", "col"), ("col", "row")):
        w = Window.partitionBy("field_id", by).orderBy(order)
        shifted = lambda c, k: F.coalesce(F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else F.col(c), F.lit(0.0))
        now = now.withColumns({c: sum((weights[k + neighbourhood] * shifted(c, k) for k in range(-neighbourhood, neighbourhood + 1)), F.lit(0.0)) for c in products})
    trace = F.col("xx") + F.col("yy")
    response = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - alpha * trace * trace
    return now.select(*PLACE, F.when(F.col("inner"), response).otherwise(0.0).alias("z"))
