"""Non-linear least squares for many groups at once.

Gauss-Newton steps with Levenberg's damping. Each round is one aggregation over the rows:
every group's normal equations and sum of squares at its trial parameters. What is solved
in Python is a matrix for each group, of as many rows as there are parameters. Groups that have settled are not read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrace.plans.durable import durable, maybe_broadcast, written

Model = Callable[[dict[str, Column], list[Column]], Column]


@dataclass(frozen=True)
class Preset:
    """A function with its parameters' names, and aggregates from which their first values are taken."""

    names: tuple[str, ...]
    value: Model
    start: Callable[[], list[Column]]


def _bell(c: dict[str, Column], p: list[Column]) -> Column:
    return p[0] + p[1] * F.exp(-((c["x"] - p[2]) * (c["x"] - p[2])) / (2 * p[3] * p[3]))


def _lorentz(c: dict[str, Column], p: list[Column]) -> Column:
    return p[0] + p[1] / (1 + ((c["x"] - p[2]) / p[3]) ** 2)


def _peak_start() -> list[Column]:
    top = F.max_by("x", "y")
    return [F.min("y"), F.max("y") - F.min("y"), top, F.greatest((F.max("x") - F.min("x")) / 8, F.lit(1e-9))]


def _dish(c: dict[str, Column], p: list[Column]) -> Column:
    return p[0] + p[1] * ((c["x"] - p[2]) ** 2 + (c["y"] - p[3]) ** 2)


def _ball(c: dict[str, Column], p: list[Column]) -> Column:
    """A sphere of curvature ``p[1]`` that touches ``z = p[0]`` at (p[2], p[3]); beyond its equator it goes on level."""
    r = (c["x"] - p[2]) ** 2 + (c["y"] - p[3]) ** 2
    return p[0] + p[1] * r / (1 + F.sqrt(F.greatest(1 - p[1] * p[1] * r, F.lit(0.0))))


CURVES = {
    "line": Preset(("a", "b"), lambda c, p: p[0] + p[1] * c["x"], lambda: [F.avg("y"), F.lit(0.0)]),
    "gaussian": Preset(("y0", "a", "x0", "s"), _bell, _peak_start),
    "lorentzian": Preset(("y0", "a", "x0", "s"), _lorentz, _peak_start),
    "exponential": Preset(("y0", "a", "b"), lambda c, p: p[0] + p[1] * F.exp(c["x"] / p[2]), lambda: [F.min("y"), F.max("y") - F.min("y"), -F.greatest((F.max("x") - F.min("x")) / 2, F.lit(1e-9))]),
}
SHAPES = {
    "plane": Preset(("z0", "bx", "by"), lambda c, p: p[0] + p[1] * c["x"] + p[2] * c["y"], lambda: [F.avg("z"), F.lit(0.0), F.lit(0.0)]),
    "bowl": Preset(("z0", "bx", "by", "a"), lambda c, p: p[0] + p[1] * c["x"] + p[2] * c["y"] + p[3] * (c["x"] ** 2 + c["y"] ** 2), lambda: [F.avg("z"), F.lit(0.0), F.lit(0.0), F.lit(0.0)]),
    "paraboloid": Preset(("z0", "a", "x0", "y0"), _dish, list),
    "sphere": Preset(("z0", "c", "x0", "y0"), _ball, list),
}


def _step(batches: Iterator[pa.RecordBatch], k: int, tolerance: float, most: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Trial parameters judged by the sums at them, and the next trial."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            turn, lam = r["turn"] + 1, r["lam"]
            better = r["new_sse"] is not None and np.isfinite(r["new_sse"]) and (r["sse"] is None or r["new_sse"] <= r["sse"])
            gain = None
            if better:
                gain = np.inf if r["sse"] is None else r["sse"] - r["new_sse"]
                r |= {"p": r["trial"], "sse": r["new_sse"], "normal": r["new_normal"], "slope": r["new_slope"]}
                lam = max(lam / 10, 1e-12)
            else:
                lam = lam * 10
            if r["normal"] is None:  # not even the first parameters have a value
                r |= {"done": True, "turn": turn}
                continue
            a, g = np.array(r["normal"]).reshape(k, k), np.array(r["slope"])
            damped = a + lam * np.diag(np.where(np.diag(a) > 0, np.diag(a), 1.0))
            move = np.linalg.lstsq(damped, g, rcond=None)[0]
            small = np.all(np.abs(move) <= 1e-10 * (np.abs(r["p"]) + 1e-10))
            settled = (gain is not None and gain <= tolerance * r["sse"]) or small or r["sse"] == 0
            r |= {"trial": (np.array(r["p"]) + move).tolist(), "lam": lam, "turn": turn, "settled": bool(settled), "done": bool(settled or lam > 1e12 or turn >= most)}
        yield pa.RecordBatch.from_pylist([{n: r[n] for n in arrow.names} for r in rows], arrow)


def fit(rows: DataFrame, keys: list[str], value: str, preset: Preset, start: DataFrame | None = None, rounds: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """``keys``, the preset's parameters, their errors ``<name>_err``, ``n``, ``rms`` and ``settled``, for each group of ``rows``.

    ``start`` gives first parameters by key where those of the preset will not do. Rows with a
    null or NaN among the coordinates and the value do not count. A group with fewer rows than parameters
    is fitted, without errors. ``settled`` is false where the rounds ended before the sum of squares
    stopped falling by more than ``tolerance`` of itself.
    """
    k = len(preset.names)
    columns = [c for c in ("x", "y") if c in rows.columns and c != value]
    usable = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in [*columns, value]))
    for c in [*columns, value]:
        usable = usable.where(F.col(c).isNotNull() & ~F.isnan(c))
    usable = durable(usable)
    begun = start.select(*keys, F.array(*(F.col(n).cast("double") for n in preset.names)).alias("trial")) if start is not None else usable.groupBy(*keys).agg(F.array(*(c.cast("double") for c in preset.start())).alias("trial"))
    doubles = T.ArrayType(T.DoubleType())
    fields = [("p", doubles), ("trial", doubles), ("sse", T.DoubleType()), ("normal", doubles), ("slope", doubles), ("lam", T.DoubleType()), ("turn", T.IntegerType()), ("settled", T.BooleanType()), ("done", T.BooleanType())]
    first = {"p": F.col("trial"), "sse": F.lit(None).cast("double"), "normal": F.lit(None).cast("array<double>"), "slope": F.lit(None).cast("array<double>"), "lam": F.lit(1e-3), "turn": F.lit(0), "settled": F.lit(False), "done": F.lit(False)}
    state = durable(begun.withColumns(first).select(*keys, *(n for n, _ in fields)))
    schema = T.StructType([*(state.schema[key] for key in keys), *(T.StructField(n, t) for n, t in fields)])
    arrow = to_arrow_schema(schema)
    done, turn = None, 0
    while True:
        known = usable.join(maybe_broadcast(state.select(*keys, "trial"), 16 * (k + len(keys))), keys)
        place = {c: F.col(c) for c in columns}
        p = [F.get("trial", F.lit(i)) for i in range(k)]
        # Central differences; a parameter's step goes with its size.
        h = [1e-6 * F.greatest(F.abs(v), F.lit(1e-4)) for v in p]
        moved = lambda i, sign: [v + sign * h[i] if j == i else v for j, v in enumerate(p)]
        slopes = [((preset.value(place, moved(i, 1)) - preset.value(place, moved(i, -1))) / (2 * h[i])).alias(f"_j{i}") for i in range(k)]
        lined = known.select(*keys, (F.col(value) - preset.value(place, p)).alias("_r"), *slopes)
        normal = F.array(*(F.sum(F.col(f"_j{min(i, j)}") * F.col(f"_j{max(i, j)}")) for i in range(k) for j in range(k)))
        sums = lined.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_r")).alias("new_sse"), normal.alias("new_normal"), F.array(*(F.sum(F.col("_r") * F.col(f"_j{i}")) for i in range(k))).alias("new_slope"))
        both = state.join(sums, keys, "left")
        turn += 1
        state = (written if turn % 4 == 0 else durable)(both.mapInArrow(lambda b: _step(b, k, tolerance, rounds, arrow), schema))
        ended = state.where("done")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("not done")
        if state.isEmpty():
            break
    counts = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = done.join(counts, keys)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                free = r["n"] - k
                if free > 0 and r["normal"] is not None:
                    inverse = np.linalg.pinv(np.array(r["normal"]).reshape(k, k))
                    r["err"] = np.sqrt(np.maximum(np.diag(inverse), 0) * r["sse"] / free).tolist()
                else:
                    r["err"] = [None] * k
                out.append({name: r[name] for name in final.names})
            yield pa.RecordBatch.from_pylist(out, final)

    shown = T.StructType([*(state.schema[key] for key in keys), T.StructField("p", doubles), T.StructField("err", doubles), T.StructField("n", T.LongType()), T.StructField("sse", T.DoubleType()), T.StructField("settled", T.BooleanType())])
    final = to_arrow_schema(shown)
    made = joined.select(*keys, "p", "normal", "sse", "n", "settled").mapInArrow(errors, shown)
    named = [F.get("p", F.lit(i)).alias(n) for i, n in enumerate(preset.names)] + [F.get("err", F.lit(i)).alias(f"{n}_err") for i, n in enumerate(preset.names)]
    return made.select(*keys, *named, "n", F.sqrt(F.col("sse") / F.col("n")).alias("rms"), "settled")


def fit_curves(curves: DataFrame, kind: str, start: DataFrame | None = None) -> DataFrame:
    """One of ``CURVES`` fitted to every curve (``curve_id, x, y``)."""
    return fit(curves, ["curve_id"], "y", CURVES[kind], start)


def fit_shape(field: DataFrame, kind: str, start: DataFrame | None = None) -> DataFrame:
    """One of ``SHAPES`` fitted to every field, by pixel columns as x and rows as y, over unmasked pixels where there is a mask.

    ``sphere`` has the curvature ``c``, one over the radius, negative for a ball seen from above.
    It and ``paraboloid`` start from the ``bowl``, which is linear; a field without any curvature has no such shape and gives null or far parameters.
    """
    chosen = field.where("m <= 0 or m is null") if "m" in field.columns else field
    pixels = durable(chosen.select("field_id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "z"))
    if start is None and kind in ("paraboloid", "sphere"):
        bowl = fit(pixels, ["field_id"], "z", SHAPES["bowl"]).withColumns({"x0": F.try_divide(-F.col("bx"), 2 * F.col("a")), "y0": F.try_divide(-F.col("by"), 2 * F.col("a"))})
        start = bowl.select("field_id", (F.col("z0") - F.col("a") * (F.col("x0") ** 2 + F.col("y0") ** 2)).alias("z0"), "a", (2 * F.col("a")).alias("c"), "x0", "y0")
    return fit(pixels, ["field_id"], "z", SHAPES[kind], start)


def without_shape(field: DataFrame, kind: str, start: DataFrame | None = None) -> DataFrame:
    """``field`` less the shape fitted to it."""
    preset = SHAPES[kind]
    fitted = fit_shape(field, kind, start).select("field_id", *(F.col(n).alias(f"_{n}") for n in preset.names))
    known = field.join(maybe_broadcast(durable(fitted), 16 * (1 + len(preset.names))), "field_id")
    shape = preset.value({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")}, [F.col(f"_{n}") for n in preset.names])
    return known.withColumn("z", F.col("z") - shape).drop(*(f"_{n}" for n in preset.names))
