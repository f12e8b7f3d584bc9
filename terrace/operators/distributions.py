"""Histograms of heights and slopes, what follows from them, and distributions over thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.arithmetic import per_field
from terrace.operators.statistics import with_neighbours
from terrace.plans.durable import durable, maybe_broadcast


def bin_count(n: int | Column, factor: float = 3.49) -> Column:
    """Default number of bins of ``n`` values."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.floor(factor * F.cbrt(n.cast("double")) + 0.5), F.lit(2)).cast("int")


def _binned(values: DataFrame, bins: int | None, factor: float = 3.49) -> DataFrame:
    known = per_field(values, F.min("z").alias("low"), F.max("z").alias("high"), F.count("z").alias("n"))
    known = known.withColumn("bins", F.lit(bins) if bins else bin_count(F.col("n"), factor))
    at = F.floor((F.col("z") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins"))
    # All values equal: everything is in the first bin.
    bin = F.when(F.col("high") > F.col("low"), F.least(at, F.col("bins") - 1)).otherwise(0)
    return known.withColumn("bin", bin.cast("int"))


def histogram(values: DataFrame, bins: int | None = None, factor: float = 3.49) -> DataFrame:
    """``field_id, bin, x, n, density``: equal bins from minimum to maximum, the last closed; empty bins have no row."""
    width = (F.col("high") - F.col("low")) / F.col("bins")
    counted = _binned(values, bins, factor).groupBy("field_id", "bin", "low", "high", "bins", F.col("n").alias("total")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("field_id", "bin", (F.col("low") + (F.col("bin") + 0.5) * width).alias("x"), "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def cumulative(values: DataFrame, bins: int | None = None) -> DataFrame:
    """``field_id, bin, x, share``: part of the values up to the end of each bin that has any."""
    counted = histogram(values, bins)
    # The window runs over bins, a few thousand at most.
    order = Window.partitionBy("field_id").orderBy("bin")
    whole = Window.partitionBy("field_id")
    return counted.select("field_id", "bin", "x", (F.sum("n").over(order) / F.sum("n").over(whole)).alias("share"))


def slopes(field: DataFrame, direction: str = "x", dx: float = 1.0) -> DataFrame:
    """Differences of neighbours along ``x`` or ``y`` as values to be binned."""
    around = with_neighbours(field)
    ahead = F.col("right") if direction == "x" else F.col("below")
    return around.select("field_id", ((ahead - F.col("z")) / dx).alias("z")).where("z is not null")


def slope_directions(field: DataFrame, bins: int = 36) -> DataFrame:
    """``field_id, bin, n, weight``: the directions of the local slopes, and their sums of slope."""
    around = with_neighbours(field).where("diagonal is not null")
    gx = ((F.col("right") - F.col("z")) + (F.col("diagonal") - F.col("below"))) / 2
    gy = ((F.col("below") - F.col("z")) + (F.col("diagonal") - F.col("right"))) / 2
    angle = F.atan2(gy, gx)
    bin = F.pmod(F.floor((angle / (2 * F.pi())) * bins).cast("int"), F.lit(bins))
    return around.groupBy("field_id", bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.hypot(gx, gy)).alias("weight"))


def entropy(values: DataFrame, bins: int | None = None) -> DataFrame:
    """Shannon entropy of the binned values, in nats."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("field_id"))
    return histogram(values, bins).select("field_id", (-p * F.log(p)).alias("_term")).groupBy("field_id").agg(F.sum("_term").alias("entropy"))


def otsu(values: DataFrame, bins: int | None = None) -> DataFrame:
    """``field_id, threshold``: the end of the bin that best parts the values in two classes; the first of equals."""
    known = _binned(values, bins, factor=7.49)
    counted = known.groupBy("field_id", "bin", "low", "high", "bins").agg(F.count(F.lit(1)).alias("n"))
    middle = F.col("bin") + 0.5
    upto, whole = Window.partitionBy("field_id").orderBy("bin"), Window.partitionBy("field_id")
    sums = counted.withColumns(
        {"w": F.sum("n").over(upto), "s": F.sum(F.col("n") * middle).over(upto), "all_w": F.sum("n").over(whole), "all_s": F.sum(F.col("n") * middle).over(whole)}
    )
    rest = F.col("all_w") - F.col("w")
    apart = F.col("s") / F.col("w") - F.try_divide(F.col("all_s") - F.col("s"), rest)
    between = F.round(F.coalesce(F.col("w") * rest * apart * apart / (F.col("all_w") * F.col("all_w")), F.lit(0.0)), 9)
    edge = F.col("low") + (F.col("bin") + 1) * (F.col("high") - F.col("low")) / F.col("bins")
    best = F.max_by(edge, F.struct(between, -F.col("bin")))
    return sums.groupBy("field_id").agg(best.alias("threshold"))


def minkowski(field: DataFrame, levels: int = 16) -> DataFrame:
    """Minkowski functionals over ``levels`` equally spaced thresholds: ``field_id, level, volume, boundary, euler``.

    ``volume`` is the part of pixels at or above the threshold, ``boundary`` the part of
    neighbour pairs that it parts, ``euler`` pixels minus neighbour pairs plus squares
    above it, a pixel. A value enters the counts of a level range, not of each level:
    it is counted where it enters and the counts are summed over levels.
    """
    around = per_field(with_neighbours(field), F.min("z").alias("_low"), F.max("z").alias("_high"), F.count("z").alias("_n"))

    def level(v: Column) -> Column:  # the last level that v reaches
        return F.coalesce(F.floor(F.try_divide(v - F.col("_low"), F.col("_high") - F.col("_low")) * (levels - 1)), F.lit(0)).cast("int")

    z, right, below, diagonal = (level(F.col(c)) for c in ("z", "right", "below", "diagonal"))

    def event(at: Column, kind: str, present: Column) -> Column:
        return F.when(present, F.struct(at.alias("at"), F.lit(kind).alias("kind")))

    has_r, has_b, has_d = (F.col(c).isNotNull() for c in ("right", "below", "diagonal"))
    low_r, low_b = F.least(z, right), F.least(z, below)
    square = F.least(z, right, below, diagonal)
    events = [
        event(z, "pixel", F.lit(True)),
        event(low_r, "pair", has_r), event(low_b, "pair", has_b),
        event(F.greatest(z, right), "touched", has_r), event(F.greatest(z, below), "touched", has_b),
        event(square, "square", has_d),
    ]
    rows = around.select("field_id", "_n", F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e"))
    counted = rows.groupBy("field_id", "_n", "e.at", "e.kind").agg(F.count(F.lit(1)).alias("n"))
    every = counted.groupBy("field_id", "_n", "at").pivot("kind", ["pixel", "pair", "touched", "square"]).agg(F.sum("n")).na.fill(0)
    grid = every.select("field_id", "_n").distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    full = grid.join(every, ["field_id", "_n", "at"], "left").na.fill(0)
    down = Window.partitionBy("field_id").orderBy(F.desc("at"))
    s = {k: F.sum(k).over(down) for k in ("pixel", "pair", "touched", "square")}
    pairs = F.sum("pair").over(Window.partitionBy("field_id"))
    return full.select(
        "field_id",
        F.col("at").alias("level"),
        (s["pixel"] / F.col("_n")).alias("volume"),
        F.try_divide(s["touched"] - s["pair"], pairs).alias("boundary"),
        ((s["pixel"] - s["pair"] + s["square"]) / F.col("_n")).alias("euler"),
    )


def angular_average(field: DataFrame, col: float, row: float, step: float = 1.0) -> DataFrame:
    """``field_id, bin, n, z``: mean value of the pixels whose distance from a place is in ``[bin, bin + 1)`` steps."""
    at = F.floor(F.hypot(F.col("col") - col, F.col("row") - row) / step).cast("int")
    return field.groupBy("field_id", at.alias("bin")).agg(F.count("z").alias("n"), F.avg("z").alias("z"))


def of_quantity(grains: DataFrame, quantity: str, bins: int | None = None) -> DataFrame:
    """Histogram of a quantity of the grains (``grains.quantities``)."""
    return histogram(grains.select("field_id", F.col(quantity).cast("double").alias("z")), bins)


def _levels(n: int, factor: float) -> int:
    """Halvings of the range that a number of values can tell apart, 50 at most."""
    return min(50, math.floor(factor * math.log2(n) + 1e-12)) if n >= 2 else 0


#: Bits of a bin's number that go into each half of its place.
_HALF = 25


def _spread(bits: Column, between: int) -> Column:
    """The bits of a number of up to 25, with ``between`` (0 or 1) zeros after each."""
    for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)) if between else ():
        bits = bits.bitwiseOR(F.shiftleft(bits, step)).bitwiseAND(F.lit(mask))
    return bits


def _nested_sums(finest: DataFrame, names: list[str], deepest: int) -> DataFrame:
    """``field_id, level, _s``: the sum of k ln k over the bins of every level, from the counts ``_k`` of the finest ones.

    In the order of their interleaved bits all bins of a coarser one stand together, so rows are
    sorted once for all levels. A batch of rows sums up the bins that begin and end in it;
    of its first and its last bin of each level the counts go on to meet those of other batches.
    """
    wide = len(names)
    # The topmost bits of all columns first; the bits above ``deepest`` are 0.
    halves = [(F.shiftright(n, _HALF), F.col(n).bitwiseAND(F.lit((1 << _HALF) - 1))) for n in names]
    merged = [sum((F.shiftleft(_spread(h[part], wide - 1), wide - 1 - i) for i, h in enumerate(halves)), F.lit(0).cast("long")) for part in (0, 1)]
    keys = ["field_id", "_high", "_low"]
    placed = finest.select("field_id", merged[0].alias("_high"), merged[1].alias("_low"), "_k")
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low, count = (batch.column(c).to_numpy() for c in ("_high", "_low", "_k"))
            fields = batch.column("field_id")
            whole = np.ones(len(high), bool)
            whole[1:] = np.array([a != b for a, b in zip(fields[1:], fields[:-1])], bool) if fields[0] != fields[-1] else False
            ends: list[list] = [[] for _ in range(6)]
            for level in range(deepest + 1):
                cut = wide * (deepest - level)
                h, v = (high, low >> cut) if cut < wide * _HALF else (high >> (cut - wide * _HALF), np.zeros_like(low))
                new = whole.copy()
                new[1:] |= (h[1:] != h[:-1]) | (v[1:] != v[:-1])
                first = np.flatnonzero(new)
                k = np.add.reduceat(count, first)
                owner = np.flatnonzero(whole)
                inner = np.where((np.arange(len(k)) > 0) & (np.arange(len(k)) < len(k) - 1), k * np.log(k), 0.0)
                totals = np.add.reduceat(inner, np.searchsorted(first, owner))
                rows = [(int(o), None, None, None, float(t)) for o, t in zip(owner, totals)]
                rows += [(int(first[i]), int(h[first[i]]), int(v[first[i]]), int(k[i]), 0.0) for i in sorted({0, len(k) - 1})]
                for column, values in zip(ends, zip(*((o, level, *rest) for o, *rest in rows))):
                    column.extend(values)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([fields.take(pa.array(ends[0])), *(pa.array(v, t) for v, t in zip(ends[1:], kinds))], ["field_id", "level", "_high", "_low", "_k", "_s"])

    schema = T.StructType([finest.schema["field_id"], *T._parse_datatype_string("level int, _high long, _low long, _k long, _s double").fields])
    parts = dealt.mapInArrow(run, schema)
    met = parts.groupBy("field_id", "level", "_high", "_low").agg(F.sum("_k").alias("_k"), F.sum("_s").alias("_s"))
    own = F.coalesce(F.col("_k") * F.log(F.col("_k").cast("double")), F.lit(0.0))
    return met.groupBy("field_id", "level").agg(F.sum(own + F.col("_s")).alias("_s"))


def entropy_at_scales(field: DataFrame, columns: tuple[str, ...] = ("z",), halvings: int | None = None) -> DataFrame:
    """``field_id, level, width, entropy``: entropy of the values with their range cut into 2^level bins, for every level.

    With two columns the cloud of both is cut along each of them: 4^level boxes of area
    ``width``. The entropy is of the density: a level more takes ln 2 off for each column once all
    values stand apart. Values are counted once in the finest bins, whose numbers less
    their last bits are the bins of every coarser level; the top bins hold the maximum.
    Fields of one value, or with a column of equal values, have no rows; nulls and NaN do not count.
    """
    known = field
    for c in columns:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c))
    ends = [e for c in columns for e in (F.min(c).alias(f"_low_{c}"), F.max(c).alias(f"_high_{c}"))]
    sizes = durable(known.groupBy("field_id").agg(F.count(F.lit(1)).alias("_n"), *ends))
    spans = [F.col(f"_high_{c}") - F.col(f"_low_{c}") for c in columns]
    for span in spans:
        sizes = sizes.where(span > 0)
    most = sizes.agg(F.max("_n")).first()[0] or 0
    deepest = halvings if halvings is not None else _levels(most, 3.0 / len(columns))
    own = F.least(F.floor(F.lit(3.0 / len(columns)) * F.log2("_n") + 1e-12), F.lit(50)) if halvings is None else F.lit(halvings)
    joined = known.join(maybe_broadcast(sizes, 64), "field_id")
    parts = float(1 << deepest)
    places = [F.least(F.floor((F.col(c) - F.col(f"_low_{c}")) / span * parts).cast("long"), F.lit((1 << deepest) - 1)) for c, span in zip(columns, spans)]
    names = [f"_p{i}" for i in range(len(columns))]
    finest = durable(joined.select("field_id", *(p.alias(n) for p, n in zip(places, names))).groupBy("field_id", *names).agg(F.count(F.lit(1)).alias("_k")))
    sums = _nested_sums(finest, names, deepest)
    area = spans[0] if len(spans) == 1 else spans[0] * spans[1]
    width = area / F.pow(F.lit(2.0), F.col("level") * len(columns))
    value = F.log("_n") + F.log(width) - F.col("_s") / F.col("_n")
    named = sums.join(maybe_broadcast(sizes.withColumn("_own", own), 72), "field_id").where(F.col("level") <= F.col("_own"))
    return named.select("field_id", F.col("level").cast("int").alias("level"), width.alias("width"), value.alias("entropy"))


def entropy_2d(field: DataFrame, columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``field_id, entropy``: that of the level from which on the entropy at scales changes least, over three levels.

    Levels from the first on count whose changes to both sides differ; of equal ones the coarsest.
    """
    scales = entropy_at_scales(field, columns)
    order = Window.partitionBy("field_id").orderBy("level")
    before, after = F.lag("entropy").over(order), F.lead("entropy").over(order)
    change = F.abs(F.col("entropy") - before) + F.abs(after - F.col("entropy"))
    mean = (before + F.col("entropy") + after) / 3
    rated = scales.select("field_id", "level", change.alias("_c"), mean.alias("_m")).where("_c is not null")
    best = rated.groupBy("field_id").agg(F.min(F.struct("_c", "level", "_m")).alias("_b"))
    return best.select("field_id", F.col("_b._m").alias("entropy"))
