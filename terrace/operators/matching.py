"""Where the surroundings of each pixel of one field lie in another one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.arithmetic import PLACE

#: The score of no displacement counts this much more, so that flat parts stay where they are.
AT_REST = 1.0001


def cross_correlate(left: DataFrame, right: DataFrame, reach: int = 2, size: int = 5) -> DataFrame:
    """``field_id, row, col, dx, dy, score, x, y``: for each pixel the shift of up to ``reach`` under which windows correlate best.

    The window of ``size`` by ``size`` pixels (odd) around the pixel of ``left`` is
    compared, by Pearson's correlation, with those of ``right``. ``dx`` and ``dy`` are
    whole pixels; ``x`` and ``y`` are refined by a parabola through the scores to both
    sides, where the shift is not the furthest. Of equal scores that of least shift
    counts, then least ``dy`` and ``dx``. A window without spread scores 0. Pixels whose shifted windows leave
    the field have no row.

    All shifts are columns of one row: three sorts by rows or columns in all, and no join but
    the one of the two fields.
    """
    if size % 2 == 0 or size < 1 or reach < 0:
        raise ValueError("the window's size must be odd and the reach not negative")
    half, n = size // 2, size * size
    across = Window.partitionBy("field_id", "row").orderBy("col")
    down = Window.partitionBy("field_id", "col").orderBy("row")
    shifts = range(-reach, reach + 1)
    moved = lambda c, k, w: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else F.col(c)
    both = left.select(*PLACE, F.col("z").alias("a")).join(right.select(*PLACE, F.col("z").alias("b")), PLACE)
    both = both.select(*PLACE, "a", "b", *(moved("b", dy, down).alias(f"b_{dy + reach}") for dy in shifts))
    places = {(dx, dy): f"{dx + reach}_{dy + reach}" for dy in shifts for dx in shifts}
    wide = both.select(*PLACE, "a", *(moved(f"b_{dy + reach}", dx, across).alias(f"s{p}") for (dx, dy), p in places.items()))
    along, tall = across.rowsBetween(-half, half), down.rowsBetween(-half, half)
    values: dict[str, Column] = {"a": F.col("a"), "aa": F.col("a") * F.col("a")}
    for p in places.values():
        values |= {f"b{p}": F.col(f"s{p}"), f"bb{p}": F.col(f"s{p}") * F.col(f"s{p}"), f"ab{p}": F.col("a") * F.col(f"s{p}")}
    # A sum counts only where all its pixels exist.
    rows = wide.select(*PLACE, *(F.when(F.count(v).over(along) == size, F.sum(v).over(along)).alias(k) for k, v in values.items()))
    sums = rows.select(*PLACE, *(F.when(F.count(k).over(tall) == size, F.sum(k).over(tall)).alias(k) for k in values))

    def score(p: str) -> Column:
        var_a, var_b = F.col("aa") - F.col("a") * F.col("a") / n, F.col(f"bb{p}") - F.col(f"b{p}") * F.col(f"b{p}") / n
        cov = F.col(f"ab{p}") - F.col("a") * F.col(f"b{p}") / n
        # What rounding leaves of no spread is no spread.
        flat = (var_a <= 1e-12 * F.col("aa")) | (var_b <= 1e-12 * F.col(f"bb{p}"))
        return F.when(flat, 0.0).otherwise(cov / F.sqrt(var_a * var_b))

    whole = sums.where(" and ".join(f"ab{p} is not null" for p in places.values()))
    scored = whole.select(*PLACE, *(score(p).alias(f"c{p}") for p in places.values()))
    options = [
        F.struct((F.col(f"c{p}") * (AT_REST if dx == dy == 0 else 1.0)).alias("score"), F.lit(-(dx * dx + dy * dy)).alias("near"), F.lit(-dy).alias("ny"), F.lit(-dx).alias("nx"))
        for (dx, dy), p in places.items()
    ]
    best = scored.withColumn("_b", F.greatest(*options) if len(options) > 1 else options[0])
    table = F.create_map(*(item for (dx, dy), p in places.items() for item in (F.lit(f"{dx},{dy}"), F.col(f"c{p}"))))
    dx, dy = -F.col("_b.nx"), -F.col("_b.ny")
    found = best.select(*PLACE, dx.alias("dx"), dy.alias("dy"), F.col("_b.score").alias("score"), table.alias("_t"))
    at = lambda x, y: F.try_element_at("_t", F.concat_ws(",", x.cast("string"), y.cast("string")))

    def refined(shift: Column, before: Column, after: Column) -> Column:
        bend = before + after - 2 * F.col("score")
        return F.coalesce(shift + F.try_divide(before - after, bend) / 2, shift.cast("double"))

    x, y = F.col("dx"), F.col("dy")
    return found.select(*PLACE, "dx", "dy", "score", refined(x, at(x - 1, y), at(x + 1, y)).alias("x"), refined(y, at(x, y - 1), at(x, y + 1)).alias("y"))


def shift_found(left: DataFrame, right: DataFrame, reach: int = 2, size: int = 5) -> DataFrame:
    """``field_id, dx, dy, n``: the shift of most pixels (of equal numbers the least ``dy``, ``dx``): drift between two scans of one place."""
    votes = cross_correlate(left, right, reach, size).groupBy("field_id", "dx", "dy").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("field_id").agg(F.max(F.struct("n", (-F.col("dy")).alias("ny"), (-F.col("dx")).alias("nx"))).alias("b"))
    return best.select("field_id", (-F.col("b.nx")).alias("dx"), (-F.col("b.ny")).alias("dy"), F.col("b.n").alias("n"))
