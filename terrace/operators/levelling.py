"""Backgrounds: planes, polynomials, rows put in line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.selection import Masking, Region, selected
from terrace.operators.arithmetic import PLACE, per_field
from terrace.operators.filters import median
from terrace.operators.geometry import transpose
from terrace.plans.durable import durable, maybe_broadcast
from terrace.plans.lines import Line, map_lines


def _unit(at: str, size: Column) -> Column:
    """Place scaled to -1 .. 1, which keeps the normal equations well conditioned."""
    return F.coalesce(F.try_divide(2.0 * F.col(at), size - 1) - 1, F.lit(0.0))


def _terms(degree: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def polynomial_coefficients(field: DataFrame, degree: int, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    """``field_id, xres, yres, coefficients`` of the least-squares polynomial of total degree ``degree``.

    All sums of the normal equations are one partial aggregation; what is solved in
    Python is a matrix for each field. The terms are x^i y^j with i, then j, counting
    up, in coordinates scaled to -1 .. 1.
    """
    terms = _terms(degree)
    sized = per_field(field, (F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    x, y = _unit("col", F.col("_w")), _unit("row", F.col("_h"))
    chosen = sized.where(selected(region, masking)).select("field_id", "_w", "_h", x.alias("x"), y.alias("y"), "z")
    power = lambda i, j: F.pow("x", F.lit(i)) * F.pow("y", F.lit(j))
    sums = {f"a{i}_{j}": F.sum(power(i, j)) for i in range(2 * degree + 1) for j in range(2 * degree + 1 - i)}
    sums |= {f"b{i}_{j}": F.sum(power(i, j) * F.col("z")) for i, j in terms}
    small = chosen.groupBy("field_id", "_w", "_h").agg(*(c.alias(k) for k, c in sums.items()))

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                a = np.array([[r[f"a{i + k}_{j + m}"] for k, m in terms] for i, j in terms])
                out.append(np.linalg.lstsq(a, np.array([r[f"b{i}_{j}"] for i, j in terms]), rcond=None)[0])
            yield pd.DataFrame({"field_id": rows["field_id"], "xres": rows["_w"], "yres": rows["_h"], "coefficients": out})

    kind = field.schema["field_id"].dataType.simpleString()
    return small.mapInPandas(solve, f"field_id {kind}, xres int, yres int, coefficients array<double>")


def level_polynomial(field: DataFrame, degree: int, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    """The field less its fitted polynomial; region and mask choose what is fitted, not what is levelled."""
    fit = polynomial_coefficients(field, degree, region, masking)
    joined = field.join(maybe_broadcast(fit, 512), "field_id")
    x, y = _unit("col", F.col("xres")), _unit("row", F.col("yres"))
    value = sum((F.get("coefficients", F.lit(n)) * F.pow(x, F.lit(i)) * F.pow(y, F.lit(j)) for n, (i, j) in enumerate(_terms(degree))), F.lit(0.0))
    return joined.select(*PLACE, (F.col("z") - value).alias("z"))


def _legendre(at: Column, degree: int) -> Column:
    """Legendre polynomials of degrees 0 to ``degree`` at a place from -1 to 1, as an array that each joins after the two before it."""
    term = lambda p, k: ((2 * k + 1) * at * F.get(p, k) - k * F.get(p, k - 1)) / (k + 1)
    first = F.array(F.lit(1.0), at) if degree else F.array(F.lit(1.0))
    if degree < 2:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(degree - 1)), first, lambda p, k: F.concat(p, F.array(term(p, k))))


def _products(degree: int) -> np.ndarray:
    """``[i, j, k]``: how much of the k-th Legendre polynomial is in the product of the i-th and the j-th."""
    one = np.eye(degree + 1)
    out = np.zeros((degree + 1, degree + 1, 2 * degree + 1))
    for i in range(degree + 1):
        for j in range(degree + 1):
            of = np.polynomial.legendre.legmul(one[i], one[j])
            out[i, j, : len(of)] = of
    return out


def legendre_coefficients(field: DataFrame, col_degree: int, row_degree: int, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    """``field_id, xres, yres, coefficients`` of the least-squares sum of P_i(x) P_j(y), i up to ``col_degree`` and j up to ``row_degree``; coefficients with i, then j, counting up.

    x and y run from -1 to 1 over the field, so that the normal equations stay well
    conditioned at high degrees. Products of Legendre polynomials are sums of such of up to twice
    their degree; so the sums of those, first over the pixels of a row, then over rows, are all the
    equations need. What is solved in Python is a matrix for each field.
    """
    sized = per_field(field, (F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    keys = ["field_id", "_w", "_h"]
    chosen = sized.where(selected(region, masking)).where("z is not null").select(*keys, "row", "z", _legendre(_unit("col", F.col("_w")), 2 * col_degree).alias("_p"))
    along = [F.sum(F.get("_p", F.lit(i))).alias(f"g{i}") for i in range(2 * col_degree + 1)] + [F.sum(F.get("_p", F.lit(i)) * F.col("z")).alias(f"b{i}") for i in range(col_degree + 1)]
    rows = chosen.groupBy(*keys, "row").agg(*along).withColumn("_p", _legendre(_unit("row", F.col("_h")), 2 * row_degree))
    kinds = [("g", i) for i in range(2 * col_degree + 1)] + [("b", i) for i in range(col_degree + 1)]
    long = rows.select(*keys, "_p", F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), F.col(f"{kind}{i}").alias("v")) for kind, i in kinds))))
    sums = long.groupBy(*keys, "kind", "i").agg(F.array(*(F.sum(F.get("_p", F.lit(j)) * F.col("v")) for j in range(2 * row_degree + 1))).alias("v"))
    small = sums.groupBy(*keys).agg(F.collect_list(F.struct("kind", "i", "v")).alias("all"))
    px, py = _products(col_degree), _products(row_degree)
    m = (col_degree + 1) * (row_degree + 1)

    def solve(batches):
        for part in batches:
            out = []
            for parts in part["all"]:
                g = np.zeros((2 * col_degree + 1, 2 * row_degree + 1))
                b = np.zeros((col_degree + 1, row_degree + 1))
                for e in parts:
                    if e["kind"] == "g":
                        g[e["i"]] = e["v"]
                    else:
                        b[e["i"]] = e["v"][: row_degree + 1]
                a = np.einsum("ika,jlb,ab->ijkl", px, py, g, optimize=True).reshape(m, m)
                out.append(np.linalg.lstsq(a, b.reshape(m), rcond=None)[0])
            yield pd.DataFrame({"field_id": part["field_id"], "xres": part["_w"], "yres": part["_h"], "coefficients": out})

    kind = field.schema["field_id"].dataType.simpleString()
    return small.mapInPandas(solve, f"field_id {kind}, xres int, yres int, coefficients array<double>")


def level_legendre(field: DataFrame, col_degree: int, row_degree: int, region: Region | None = None, masking: Masking = Masking.IGNORE) -> DataFrame:
    """The field less its fitted Legendre polynomials; region and mask choose what is fitted, not what is levelled."""
    fit = legendre_coefficients(field, col_degree, row_degree, region, masking)
    joined = field.join(maybe_broadcast(durable(fit), 512), "field_id")
    places = joined.select(*PLACE, "z", "coefficients", _legendre(_unit("col", F.col("xres")), col_degree).alias("_x"), _legendre(_unit("row", F.col("yres")), row_degree).alias("_y"))
    products = F.flatten(F.transform("_x", lambda p: F.transform("_y", lambda q: p * q)))
    value = F.aggregate(F.zip_with("coefficients", products, lambda c, p: c * p), F.lit(0.0), lambda s, v: s + v)
    return places.select(*PLACE, (F.col("z") - value).alias("z"))


def plane_coefficients(field: DataFrame, masking: Masking = Masking.IGNORE) -> DataFrame:
    """``field_id, a, bx, by``: the least-squares plane a + bx col + by row, solved from centred sums."""
    chosen = field.where(selected(None, masking)).select("field_id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "z")
    means = chosen.groupBy("field_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    joined = chosen.join(maybe_broadcast(means, 64), "field_id")
    x, y, z = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("z") - F.col("mz")
    sums = {"xx": x * x, "xy": x * y, "yy": y * y, "xz": x * z, "yz": y * z}
    s = joined.groupBy("field_id").agg(*(F.sum(c).alias(k) for k, c in sums.items()), *(F.first(c).alias(c) for c in ("mx", "my", "mz")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    bx = F.coalesce(F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det), F.lit(0.0))
    by = F.coalesce(F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det), F.lit(0.0))
    both = s.withColumns({"bx": bx, "by": by})
    return both.select("field_id", (F.col("mz") - F.col("bx") * F.col("mx") - F.col("by") * F.col("my")).alias("a"), "bx", "by")


def level_plane(field: DataFrame, masking: Masking = Masking.IGNORE, keep_mean: bool = False) -> DataFrame:
    """The field less its plane; with ``keep_mean`` only the tilt about the field's mean place goes."""
    joined = field.join(maybe_broadcast(plane_coefficients(field, masking), 48), "field_id")
    tilt = F.col("bx") * F.col("col") + F.col("by") * F.col("row")
    if keep_mean:
        middle = per_field(joined, F.avg("col").alias("_mc"), F.avg("row").alias("_mr"))
        return middle.select(*PLACE, (F.col("z") - tilt + F.col("bx") * F.col("_mc") + F.col("by") * F.col("_mr")).alias("z"))
    return joined.select(*PLACE, (F.col("z") - F.col("a") - tilt).alias("z"))


def zero_mean(field: DataFrame) -> DataFrame:
    return per_field(field, F.avg("z").alias("_v")).withColumn("z", F.col("z") - F.col("_v")).drop("_v")


def fix_zero(field: DataFrame) -> DataFrame:
    """The minimum moved to zero."""
    return per_field(field, F.min("z").alias("_v")).withColumn("z", F.col("z") - F.col("_v")).drop("_v")


def _rows_median(values: Column) -> Column:
    return F.get(F.sort_array(F.collect_list(values)), F.floor(F.count(values) / 2).cast("int"))


def _trimmed(rows: DataFrame, value: Column, share: float) -> DataFrame:
    """``field_id, row, _mean``: the mean of each row's values less ``share`` of them at either end; one or two in the middle always stay."""
    keys = ["field_id", "row"]
    ranked = rows.select(*keys, value.alias("_v")).where("_v is not null")
    ranked = ranked.withColumns({"_p": F.row_number().over(Window.partitionBy(*keys).orderBy("_v")), "_n": F.count("_v").over(Window.partitionBy(*keys))})
    cut = F.least(F.floor(F.col("_n") * share + 0.5), F.floor((F.col("_n") - 1) / 2))
    return ranked.where((F.col("_p") > cut) & (F.col("_p") <= F.col("_n") - cut)).groupBy(*keys).agg(F.avg("_v").alias("_mean"))


def align_rows(field: DataFrame, method: str = "median", masking: Masking = Masking.IGNORE, trim: float = 0.05) -> DataFrame:
    """Rows put in line by their ``mean``, ``median``, ``midrange`` or ``trimmed_mean``, or by the median or trimmed mean of differences of neighbour rows (``differences``, ``trimmed_differences``).

    Trimmed means leave out the part ``trim`` of a row's values at either end.

    Shifts are centred, so that the field's mean shift is zero; rows without chosen
    pixels stay. A row's pixels are gathered in one task, never the field's.
    """
    keys = ["field_id", "row"]
    if method in ("differences", "trimmed_differences"):
        below = field.select("field_id", (F.col("row") + 1).alias("row"), "col", F.col("z").alias("_above"), *(["m"] if masking is not Masking.IGNORE else []))
        if masking is not Masking.IGNORE:
            below = below.where(selected(None, masking)).drop("m")
        pairs = field.where(selected(None, masking)).join(below, PLACE)
        rise = F.col("z") - F.col("_above")
        if method == "differences":
            steps = pairs.groupBy(*keys).agg(_rows_median(rise).alias("_step"))
        else:
            steps = _trimmed(pairs, rise, trim).withColumnRenamed("_mean", "_step")
        rows = field.select(*keys).distinct().join(steps, keys, "left")
        # One number a row of the field.
        upto = Window.partitionBy("field_id").orderBy("row")
        shifts = rows.select(*keys, F.coalesce(F.sum("_step").over(upto), F.lit(0.0)).alias("_shift"))
    elif method == "trimmed_mean":
        shifts = _trimmed(field.where(selected(None, masking)), F.col("z"), trim).withColumnRenamed("_mean", "_shift")
    else:
        z = F.col("z")
        of = {"mean": F.avg(z), "median": _rows_median(z), "midrange": (F.min(z) + F.max(z)) / 2}[method]
        shifts = field.where(selected(None, masking)).groupBy(*keys).agg(of.alias("_shift"))
    centred = per_field(shifts, F.avg("_shift").alias("_all")).select(*keys, (F.col("_shift") - F.col("_all")).alias("_shift"))
    moved = field.join(maybe_broadcast(centred, 32), keys, "left")
    return moved.select(*PLACE, (F.col("z") - F.coalesce("_shift", F.lit(0.0))).alias("z"))


def level_rows(field: DataFrame, degree: int = 1) -> DataFrame:
    """Each row less its mean (degree 0) or its line (degree 1)."""
    keys = ["field_id", "row"]
    x, z = F.col("col").cast("double"), F.col("z")
    means = field.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(z).alias("_mz"))
    both = field.join(means, keys)
    if degree == 0:
        return both.select(*PLACE, (z - F.col("_mz")).alias("z"))
    dx = x - F.col("_mx")
    slopes = both.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(dx * (z - F.col("_mz"))), F.sum(dx * dx)), F.lit(0.0)).alias("_b"))
    return both.join(slopes, keys).select(*PLACE, (z - F.col("_mz") - F.col("_b") * dx).alias("z"))


def scars(field: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``field`` with mask ``m`` of pixels that stand out from both rows beside them by more than ``threshold`` times the rms of row differences."""
    down = Window.partitionBy("field_id", "col").orderBy("row")
    above, below = F.lag("z").over(down), F.lead("z").over(down)
    near = field.drop("m").withColumns({"_a": above, "_b": below})
    known = per_field(near, F.sqrt(F.avg((F.col("z") - F.col("_a")) ** 2)).alias("_rms"))
    high = (F.col("z") - F.greatest("_a", "_b")) > threshold * F.col("_rms")
    low = (F.least("_a", "_b") - F.col("z")) > threshold * F.col("_rms")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return known.withColumn("m", F.coalesce(whole & (high | low), F.lit(False)).cast("double")).drop("_a", "_b", "_rms")


def interpolate_masked(field: DataFrame) -> DataFrame:
    """Masked pixels filled along their row between the nearest free ones; at a row's end the nearest one's value; a wholly masked row stays."""
    # Both looks are running ones: a frame that ends with the row is read again for each of its pixels.
    past, ahead = (Window.partitionBy("field_id", "row").orderBy(o) for o in (F.asc("col"), F.desc("col")))
    free = F.when(F.col("m") <= 0, F.struct(F.col("col").alias("c"), F.col("z").alias("z")))
    near = field.withColumns({"_l": F.last(free, True).over(past), "_r": F.last(free, True).over(ahead)})
    part = F.try_divide(F.col("col") - F.col("_l.c"), F.col("_r.c") - F.col("_l.c"))
    between = F.col("_l.z") + (F.col("_r.z") - F.col("_l.z")) * part
    filled = F.when(F.col("m") <= 0, F.col("z")).otherwise(F.coalesce(between, "_l.z", "_r.z", "z"))
    return near.select(*PLACE, filled.alias("z"))


def correct_average(field: DataFrame, unmasked: bool = True) -> DataFrame:
    """Marked pixels replaced by the mean of the unmarked ones, or of all."""
    source = F.when(F.col("m") <= 0, F.col("z")) if unmasked else F.col("z")
    known = per_field(field, F.avg(source).alias("_mean"))
    return known.withColumn("z", F.when(F.col("m") > 0, F.coalesce("_mean", "z")).otherwise(F.col("z"))).drop("_mean")


def tilt(field: DataFrame, bx: float, by: float) -> DataFrame:
    """A plane of these slopes subtracted."""
    return field.withColumn("z", F.col("z") - bx * F.col("col") - by * F.col("row"))


def level_three(field: DataFrame, places: list[tuple[int, int]]) -> DataFrame:
    """The plane through the values at three pixels (column, row) subtracted."""
    (x1, y1), (x2, y2), (x3, y3) = places
    at = lambda x, y: F.max(F.when((F.col("col") == x) & (F.col("row") == y), F.col("z")))
    known = per_field(field, at(x1, y1).alias("_1"), at(x2, y2).alias("_2"), at(x3, y3).alias("_3"))
    det = (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)
    if not det:
        raise ValueError("three pixels in one line define no plane")
    p, q = F.col("_2") - F.col("_1"), F.col("_3") - F.col("_1")
    bx, by = (p * (y3 - y1) - q * (y2 - y1)) / det, (q * (x2 - x1) - p * (x3 - x1)) / det
    plane = F.col("_1") + bx * (F.col("col") - x1) + by * (F.col("row") - y1)
    return known.withColumn("z", F.col("z") - plane).drop("_1", "_2", "_3")


def facet_slopes(field: DataFrame) -> DataFrame:
    """``field_id, bx, by``: the slope that most facets share, by weights that fall with the square of a facet's steepness.

    A facet is a square of four pixels. Fields of fewer than four facets have slope zero.
    """
    across = Window.partitionBy("field_id", "row").orderBy("col")
    down = Window.partitionBy("field_id", "col").orderBy("row")
    left = F.lag("z").over(across)
    pairs = field.select(*PLACE, (F.col("z") - left).alias("_d"), (F.col("z") + left).alias("_s"))
    vx, vy = (F.col("_d") + F.lag("_d").over(down)) / 2, (F.col("_s") - F.lag("_s").over(down)) / 2
    facets = pairs.select("field_id", vx.alias("vx"), vy.alias("vy")).where("vx is not null and vy is not null")
    steep = F.col("vx") ** 2 + F.col("vy") ** 2
    weighed = per_field(facets, F.avg(steep).alias("_mean"), F.count(F.lit(1)).alias("_n")).where("_n >= 4")
    weight = F.exp(-F.coalesce(F.try_divide(steep, F.col("_mean") / 20), F.lit(0.0)))
    sums = weighed.groupBy("field_id").agg(*(F.try_divide(F.sum(F.col(v) * weight), F.sum(weight)).alias(b) for v, b in (("vx", "bx"), ("vy", "by"))))
    known = field.select("field_id").distinct().join(sums, "field_id", "left")
    return known.select("field_id", *(F.coalesce(b, F.lit(0.0)).alias(b) for b in ("bx", "by")))


def level_facet(field: DataFrame, rounds: int = 1) -> DataFrame:
    """The field tilted so that its commonest facets lie flat; each round starts from the last one's result."""
    out = field.select(*PLACE, "z")
    for _ in range(rounds):
        sized = per_field(out, (F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
        both = sized.join(maybe_broadcast(facet_slopes(out), 32), "field_id")
        plane = F.col("bx") * (F.col("col") - F.col("_w") / 2) + F.col("by") * (F.col("row") - F.col("_h") / 2)
        out = both.select(*PLACE, (F.col("z") - plane).alias("z"))
    return out


def level_local_median(field: DataFrame, size: int) -> DataFrame:
    """Each pixel less the upper median of the window around it."""
    local = median(field, size).withColumnRenamed("z", "_local")
    return field.join(local, PLACE).select(*PLACE, (F.col("z") - F.col("_local")).alias("z"))


def _windowed(z: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rms of the window around each value, as the ends cut it, by running sums of values less their mean."""
    at = np.arange(len(z))
    low, high = np.maximum(at - before, 0), np.minimum(at + after, len(z) - 1) + 1
    n, middle = high - low, z.mean()
    sums = [np.concatenate([[0.0], np.cumsum((z - middle) ** p)]) for p in (1, 2)]
    mean, square = ((s[high] - s[low]) / n for s in sums)
    return mean + middle, np.sqrt(np.maximum(square - mean**2, 0))


def revolved_arc(field: DataFrame, radius: float, direction: str = "x") -> DataFrame:
    """The background under an arc of ``radius`` pixels rolled along rows (``x``), columns (``y``) or both, one after the other (``xy``).

    Heights count in units that give the field the rms of such arcs side by side. Values further than 2.5 times the
    rms below the mean of their surroundings of a radius do not hold the arc up. A row streams
    through a task. Pixels without value take no part and have no row; subtract the result to level.
    """
    if direction not in ("x", "y", "xy"):
        raise ValueError("direction is x, y or xy")
    if direction == "xy":
        return revolved_arc(revolved_arc(field, radius, "x"), radius, "y")
    turned = (field if direction == "x" else transpose(field)).select(*PLACE, "z").where("z is not null")
    known = per_field(turned, F.stddev_pop("z").alias("_rms"), (F.max("col") + 1).alias("_w"))

    def roll(line: Line) -> Line:
        z, at = line["z"].astype(float), line["col"].astype(np.int64)
        size = int(min(radius, line["_w"][0]) + 0.5)
        u = np.minimum(np.arange(size + 1) / radius, 1.0)
        arc = line["_rms"][0] / np.sqrt(2 / 3 - np.pi / 16) * (u * u / (1 + np.sqrt(1 - u * u)))
        mean, rms = _windowed(z, size // 2, (size - 1) // 2)
        held = np.full(at[-1] + 1, np.inf)
        held[at] = np.maximum(z, mean - 2.5 * rms)
        low = held.copy()
        for d in range(1, min(size, len(held) - 1) + 1):
            np.minimum(low[:-d], held[d:] + arc[d], out=low[:-d])
            np.minimum(low[d:], held[:-d] + arc[d], out=low[d:])
        return {"col": at.astype(np.int32), "z": low[at]}

    out = map_lines(known, ["field_id", "row"], ["col"], ["col", "z", "_rms", "_w"], roll, "col int, z double")
    return out if direction == "x" else transpose(out)
