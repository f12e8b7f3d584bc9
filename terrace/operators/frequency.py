"""Fields filtered between two Fourier transforms.

Both transforms go over rows and then over columns, a row or column at a time in its task;
between them every frequency is a row with its own weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators import geometry
from terrace.operators.arithmetic import PLACE, per_field
from terrace.operators.spatial import row_transform, transform_2d
from terrace.plans.durable import durable, maybe_broadcast


def _plane(field: DataFrame) -> DataFrame:
    """The transform with ``_w, _h`` and signed frequencies ``_i`` by columns and ``_j`` by rows, from -n/2 up."""
    sized = per_field(durable(transform_2d(field)), (F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    signed = lambda c, n: F.when(F.col(c) * 2 > F.col(n), F.col(c) - F.col(n)).otherwise(F.col(c))
    return sized.withColumns({"_i": signed("col", "_w"), "_j": signed("row", "_h")})


def _weighed(plane: DataFrame, weight: Column) -> DataFrame:
    """Back from the plane after every frequency is multiplied by its weight."""
    kept = plane.select(*PLACE, (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))
    return transform_2d(kept, inverse=True).select(*PLACE, "z")


def keep_band(field: DataFrame, low: float = 0.0, high: float = math.inf, edge: float = 0.0) -> DataFrame:
    """Frequencies from ``low`` to ``high``, in cycles for each pixel, kept and the others cut.

    With ``edge`` the weight rises over so wide a band around both limits, as half a
    cosine. ``low`` 0 keeps the mean; so a low pass has only ``high`` and a high pass only ``low``.
    """
    f = F.hypot(F.col("_i") / F.col("_w"), F.col("_j") / F.col("_h"))

    def above(limit: float) -> Column:
        if edge <= 0:
            return (f >= limit).cast("double")
        part = F.least(F.greatest((f - (limit - edge / 2)) / edge, F.lit(0.0)), F.lit(1.0))
        return (1 - F.cos(part * math.pi)) / 2

    weight = F.lit(1.0)
    if low > 0:
        weight = weight * above(low)
    if high < math.inf:
        weight = weight * (1 - above(high) if edge > 0 else (f <= high).cast("double"))
    return _weighed(_plane(field), weight)


def filter_by_mask(field: DataFrame, mask: DataFrame, keep: bool = True) -> DataFrame:
    """Frequencies marked in ``mask`` kept, or with ``keep=False`` removed.

    The mask is drawn on the plane with frequency 0 in its middle, at row h // 2 and
    column w // 2. A frequency counts as marked if it or its mirror image is, so that the result is real.
    """
    plane = _plane(field)
    marked = mask.where("m > 0").select("field_id", F.col("row").alias("_r"), F.col("col").alias("_c"))
    at = lambda sign: [F.pmod(sign * F.col("_j") + F.floor(F.col("_h") / 2), "_h").alias("_r"), F.pmod(sign * F.col("_i") + F.floor(F.col("_w") / 2), "_w").alias("_c")]
    hits = [plane.select(*PLACE, *at(sign)).join(marked, ["field_id", "_r", "_c"], "left_semi").select(*PLACE) for sign in (1, -1)]
    hit = hits[0].union(hits[1]).distinct().withColumn("_m", F.lit(1.0))
    weight = F.coalesce("_m", F.lit(0.0)) if keep else 1 - F.coalesce("_m", F.lit(0.0))
    return _weighed(plane.join(hit, PLACE, "left"), weight)


def wavelet(field: DataFrame, scale: float, kind: str = "gauss") -> DataFrame:
    """Continuous wavelet transform at one scale: every frequency times the wavelet's own transform, ``gauss`` or ``hat``.

    The frequency's length counts in steps of the plane, over a quarter of the field's width.
    """
    x = F.hypot(F.col("_i").cast("double"), F.col("_j").cast("double")) * 4 / F.col("_w")
    bell = F.exp(-(scale * scale) * x * x / 2)
    weight = {"gauss": bell, "hat": scale * scale * x * x * bell * (2 * math.pi * scale * scale)}[kind]
    return _weighed(_plane(field), weight)


def filter_rows(field: DataFrame, weights: DataFrame, direction: str = "x") -> DataFrame:
    """Each row (``y``: column) with its frequencies multiplied by ``weights`` (``i, y``), a line over the lower half of the spectrum.

    The line is read between its points as far as the frequency lies along the half
    spectrum; the upper half mirrors the lower one.
    """
    turned = field if direction == "x" else geometry.transpose(field)
    plane = per_field(durable(row_transform(turned)), (F.max("col") + 1).alias("_w"))
    last = weights.agg(F.max("i")).first()[0]
    k = F.least("col", F.col("_w") - F.col("col"))
    at = F.try_divide(k * float(last), F.floor(F.col("_w") / 2))
    near = plane.withColumn("_at", F.coalesce(at, F.lit(0.0))).withColumn("_k", F.floor("_at"))
    own = maybe_broadcast(weights.select(F.col("i").alias("_k"), F.col("y").alias("_y")), 24)
    after = maybe_broadcast(weights.select((F.col("i") - 1).alias("_k"), F.col("y").alias("_n")), 24)
    read = near.join(own, "_k").join(after, "_k", "left")
    weight = F.col("_y") + (F.coalesce("_n", "_y") - F.col("_y")) * (F.col("_at") - F.col("_k"))
    kept = read.select(*PLACE, (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))
    back = row_transform(kept, inverse=True).select(*PLACE, "z")
    return back if direction == "x" else geometry.transpose(back)
