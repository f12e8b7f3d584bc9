"""Volumes ``brick_id, lev, row, col, w``: reductions to planes, slices, profiles, clusters."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrace.operators import levelling
from terrace.operators import profiles as kernels
from terrace.plans.durable import BROADCAST_BYTES, durable, written

_AXES = ("lev", "row", "col")


def _kept(along: str) -> list[str]:
    return ["brick_id", *(a for a in _AXES if a != along)]


def reduce_along(brick: DataFrame, along: str, how: str) -> DataFrame:
    """A plane of a statistic along an axis; the first place of equal extremes.

    Statistics: ``min, max, sum, mean, rms, range, minpos, maxpos``, ``median`` (the upper
    one), ``variation`` (the sum of absolute steps), and about the profile's own mean
    ``ra``, ``skew`` and excess ``kurtosis``, null where all values are equal.
    """
    w, at = F.col("w"), F.col(along)
    if how == "variation":
        step = F.abs(w - F.lag(w).over(Window.partitionBy(*_kept(along)).orderBy(at)))
        return brick.select(*_kept(along), step.alias("_step")).groupBy(*_kept(along)).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("z"))
    if how in ("ra", "skew", "kurtosis"):
        d = F.col("_d")
        moved = brick.select(*_kept(along), (w - F.avg(w).over(Window.partitionBy(*_kept(along)))).alias("_d"))
        square = F.avg(d * d)
        of = {"ra": F.avg(F.abs(d)), "skew": F.try_divide(F.avg(d * d * d), F.pow(square, F.lit(1.5))), "kurtosis": F.try_divide(F.avg(d * d * d * d), square * square) - 3}[how]
        return moved.groupBy(*_kept(along)).agg(of.alias("z"))
    of = {
        "min": F.min(w),
        "max": F.max(w),
        "sum": F.sum(w),
        "mean": F.avg(w),
        "rms": F.stddev_pop(w),
        "range": F.max(w) - F.min(w),
        "median": F.get(F.sort_array(F.collect_list(w)), F.floor(F.count(w) / 2).cast("int")),
        "minpos": F.min_by(at, F.struct(w, at)).cast("double"),
        "maxpos": F.max_by(at, F.struct(w, -at)).cast("double"),
    }[how]
    return brick.groupBy(*_kept(along)).agg(of.alias("z"))


def slice_at(brick: DataFrame, along: str, at: int) -> DataFrame:
    """The plane at a place of an axis."""
    return brick.where(F.col(along) == at).select(*_kept(along), F.col("w").alias("z"))


def profile_at(brick: DataFrame, row: int, col: int) -> DataFrame:
    return brick.where((F.col("row") == row) & (F.col("col") == col)).select(F.col("brick_id").alias("line_id"), F.col("lev").alias("i"), F.col("w").alias("y"))


def level_summary(brick: DataFrame) -> DataFrame:
    """``brick_id, lev, mean, rms, min, max`` of each level."""
    w = F.col("w")
    return brick.groupBy("brick_id", "lev").agg(F.avg(w).alias("mean"), F.stddev_pop(w).alias("rms"), F.min(w).alias("min"), F.max(w).alias("max"))


def flip(brick: DataFrame, along: str) -> DataFrame:
    size = brick.groupBy("brick_id").agg(F.max(along).alias("_last"))
    return brick.join(size, "brick_id").withColumn(along, F.col("_last") - F.col(along)).drop("_last")


def transpose(brick: DataFrame, order: tuple[str, str, str]) -> DataFrame:
    """Axes renamed: ``order`` tells which old axes become level, row and column."""
    return brick.select("brick_id", *(F.col(old).alias(new) for old, new in zip(order, _AXES)), "w")


def level_profiles(brick: DataFrame) -> DataFrame:
    """Each profile less its mean."""
    mean = brick.groupBy("brick_id", "row", "col").agg(F.avg("w").alias("_mean"))
    return brick.join(mean, ["brick_id", "row", "col"]).withColumn("w", F.col("w") - F.col("_mean")).drop("_mean")


def normalise_profiles(brick: DataFrame) -> DataFrame:
    """Each profile divided by its length; a zero profile stays."""
    norm = brick.groupBy("brick_id", "row", "col").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return brick.join(norm, ["brick_id", "row", "col"]).withColumn("w", F.coalesce(F.try_divide("w", "_norm"), F.col("w"))).drop("_norm")


def arithmetic(left: DataFrame, right: DataFrame, value: Column) -> DataFrame:
    """``value`` over columns ``a`` and ``b``, cell by cell."""
    keys = ["brick_id", *_AXES]
    both = left.withColumnRenamed("w", "a").join(right.withColumnRenamed("w", "b"), keys)
    return both.select(*keys, value.alias("w"))


def profiles(brick: DataFrame) -> DataFrame:
    """``brick_id, row, col, p``: each pixel's values in the order of levels."""
    profile = F.transform(F.array_sort(F.collect_list(F.struct("lev", "w"))), lambda e: e["w"].cast("double"))
    return brick.groupBy("brick_id", "row", "col").agg(profile.alias("p"))


def _packed(of: DataFrame, kind: type, seed: int) -> DataFrame:
    """``brick_id, row, col, h, p, holes``: profiles as bytes, which tasks read without a step for each value; ``h`` is a hash of the place."""
    marked = of.where("brick_id is not null").select("brick_id", "row", "col", F.xxhash64("row", "col", F.lit(seed)).alias("h"), "p")

    def run(batches):
        for batch in batches:
            p, holes = kernels.packed(batch.column("p"), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], p, holes], [*batch.schema.names[:4], "p", "holes"])

    fields = [T.StructField(name, T.BinaryType()) for name in ("p", "holes")]
    return marked.mapInArrow(run, T.StructType([*marked.schema.fields[:4], *fields]))


def _with_states(rows: DataFrame, states: DataFrame, few: bool, all_of: bool = False):
    """``rows`` of the volumes of ``states``, all or those not done, and a function of a volume and its rows that gives the volume's state inside a task; None if no volume is left."""
    if few:
        held = {r.brick_id: bytes(r.sent) for r in states.select("brick_id", "sent", "done").collect() if all_of or not r.done}
        return (rows, lambda brick, part: pickle.loads(held[brick]) if brick in held else None) if held else None
    left = states if all_of else states.where("not done")
    return None if left.isEmpty() else (rows.join(left.select("brick_id", "sent"), "brick_id"), lambda brick, part: pickle.loads(part.column("sent")[0].as_py()))


def clusters(brick: DataFrame, k: int, seed: int = 1, rounds: int = 100, centre: str = "mean") -> DataFrame:
    """``clusters_of`` the profiles of ``brick``."""
    return clusters_of(profiles(brick), k, seed, rounds, centre)


def clusters_of(of: DataFrame, k: int, seed: int = 1, rounds: int = 100, centre: str = "mean") -> DataFrame:
    """``brick_id, row, col, cluster``: profiles of every volume in ``k`` groups, by k-means, or with ``centre="median"`` by k-medians.

    All volumes go at once: in a round each profile is given its nearest centre
    (by squared differences; medians: by absolute ones; of equal ones the first) and
    the groups' profiles make the new centres. It ends for a volume when no profile moves, or after
    ``rounds``. The first centres are the profiles of ``k`` pixels drawn by a hash
    of their place; a group that no profile is nearest to keeps its centre.

    Profiles are written once. A pass over them shuffles a row for each task and volume, sums or
    counts by group and level, and keeps a state for each volume. A round of means is one pass; one of medians
    mostly one or two, as medians are looked for around the last ones.
    """
    medians, kind = centre == "median", np.float32 if isinstance(of.schema["p"].dataType.elementType, T.FloatType) else np.float64
    rows = written(_packed(of, kind, seed))
    brick_id, tasks = rows.schema["brick_id"], 4 * rows.sparkSession.sparkContext.defaultParallelism
    rows, fine = rows.coalesce(tasks), float(np.finfo(kind).eps)
    telling = T.StructType([brick_id, T.StructField("part", T.LongType()), T.StructField("told", T.BinaryType())])
    keeping = T.StructType([brick_id, T.StructField("state", T.BinaryType()), T.StructField("sent", T.BinaryType()), T.StructField("done", T.BooleanType())])

    def pass_over(known, made_of, join):
        """``brick_id, part, told``: what each task's rows of each volume tell."""

        def run(batches):
            task = TaskContext.get().partitionId()
            for brick, part, made in kernels.gathered(batches, made_of, join, task):
                yield pa.RecordBatch.from_pylist([{"brick_id": brick, "part": part, "told": made}], to_arrow_schema(telling))

        def meet(table):
            parts = table.sort_by("part")
            joined = join([pickle.loads(p.as_py()) for p in parts.column("told")])
            return parts.slice(0, 1).set_column(2, "told", pa.array([pickle.dumps(joined)], pa.binary()))

        sent, n = known.mapInArrow(run, telling), tasks
        while n > 32:  # not all in one task
            sent, n = sent.groupBy("brick_id", F.floor(F.col("part") / (32 << 24) * tasks / n)).applyInArrow(meet, telling), n / 32
        return sent

    def states(sent, of_parts):
        """``brick_id, state, sent, done`` of each volume's rows."""

        def run(table):
            parts = table.sort_by("part")
            state = of_parts([pickle.loads(p.as_py()) for p in parts.column("told")])
            slim = {name: state[name] for name in kernels.SENT if name in state}
            made = {"brick_id": parts.column("brick_id")[0].as_py(), "state": pickle.dumps(state), "sent": pickle.dumps(slim), "done": state["done"]}
            return pa.Table.from_pylist([made], to_arrow_schema(keeping))

        return sent.groupBy("brick_id").applyInArrow(run, keeping)

    def first(brick, part):
        return kernels.first_of(part, kind, k)

    def firsts(parts):
        return kernels.drawn(parts, k)

    def begin(parts):
        return kernels.started(firsts(parts), rounds, medians)

    def step(parts):
        return kernels.stepped(parts[0], kernels.merged(parts[1:]), rounds, medians, fine) if len(parts) > 1 else parts[0]

    def seen(part, state):
        return kernels.matrix(part.column("p"), part.column("holes"), kind, state["c"].shape[1])

    state = durable(states(durable(pass_over(rows, first, firsts)), begin))
    few = (state.agg(F.sum(F.octet_length("sent"))).first()[0] or 0) <= BROADCAST_BYTES
    turn = 0
    while todo := _with_states(rows.drop("row", "col"), state, few):
        known, state_of = todo

        def tell(brick, part, state_of=state_of):
            state = state_of(brick, part)
            return state and kernels.told(*seen(part, state), part.column("h").to_numpy().view(np.uint64), state, medians)

        before = state.select("brick_id", F.lit(-1).cast("long").alias("part"), F.col("state").alias("told"))
        turn += 1
        state = (written if turn % 4 == 0 else durable)(states(before.union(pass_over(known, tell, kernels.merged)), step))
    known, state_of = _with_states(rows, state, few, True) or (rows.limit(0), None)

    def assign(batches):
        for batch in batches:
            for brick, part in kernels.by_volume(batch):
                state = state_of(brick, part)
                group = kernels.nearest(*seen(part, state), state, medians)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("brick_id", "row", "col")), pa.array(group.astype(np.int32))], ["brick_id", "row", "col", "cluster"])

    return known.mapInArrow(assign, T.StructType([*(rows.schema[c] for c in ("brick_id", "row", "col")), T.StructField("cluster", T.IntegerType())]))


def part(brick: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """A box of the volume, its axes counted anew; corner and size are by level, row and column."""
    inside = [F.col(a).between(at, at + n - 1) for a, at, n in zip(_AXES, low, size)]
    return brick.where(inside[0] & inside[1] & inside[2]).select("brick_id", *((F.col(a) - at).alias(a) for a, at in zip(_AXES, low)), "w")


def resample(brick: DataFrame, levels: int) -> DataFrame:
    """The volume with another number of levels over the same extent, each from the old level that holds its middle."""
    size = brick.groupBy("brick_id").agg((F.max("lev") + 1).alias("_n"))
    wanted = size.select("brick_id", "_n", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_new"))
    sources = wanted.select("brick_id", F.col("_new"), F.floor((F.col("_new") + 0.5) * F.col("_n") / levels).cast("int").alias("lev"))
    return brick.join(F.broadcast(sources) if sources.limit(100_001).count() <= 100_000 else sources, ["brick_id", "lev"]).select("brick_id", F.col("_new").alias("lev"), "row", "col", "w")


def value_at(brick: DataFrame, lev: int, row: int, col: int) -> DataFrame:
    return brick.where((F.col("lev") == lev) & (F.col("row") == row) & (F.col("col") == col)).select("brick_id", "w")


def extremes(brick: DataFrame) -> DataFrame:
    """``brick_id, n, min, max``."""
    return brick.groupBy("brick_id").agg(F.count("w").alias("n"), F.min("w").alias("min"), F.max("w").alias("max"))


def changed(brick: DataFrame, value: Column) -> DataFrame:
    """``value``, over ``w`` and the places, in every cell; a constant fills, 0 clears."""
    return brick.withColumn("w", value.cast("double"))


def calibrated(brick: DataFrame, axis: DataFrame) -> DataFrame:
    """``brick`` with ``value``, the calibrated place of each level; ``axis`` is a line ``line_id, i, y`` for each brick."""
    at = axis.select(F.col("line_id").alias("brick_id"), F.col("i").alias("lev"), F.col("y").alias("value"))
    return brick.join(at, ["brick_id", "lev"], "left")


def _as_fields(brick: DataFrame) -> DataFrame:
    """Each level of each volume as a field of its own."""
    return brick.select(F.struct("brick_id", "lev").alias("field_id"), "row", "col", F.col("w").alias("z"))


def _as_volume(fields: DataFrame) -> DataFrame:
    return fields.select("field_id.brick_id", "field_id.lev", "row", "col", F.col("z").alias("w"))


def level_planes(brick: DataFrame) -> DataFrame:
    """Each level less its own least-squares plane."""
    return _as_volume(levelling.level_plane(_as_fields(brick)))


def each_level(brick: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any operator on fields applied to every level at once; ``field_id`` is a struct of volume and level there."""
    return _as_volume(of(_as_fields(brick)))


def zero_at(brick: DataFrame, lev: int) -> DataFrame:
    """Each profile less its value at a level; null where it has none there."""
    base = F.max(F.when(F.col("lev") == lev, F.col("w"))).over(Window.partitionBy("brick_id", "row", "col"))
    return brick.withColumn("w", F.col("w") - base)


def difference_along(brick: DataFrame, along: str = "lev") -> DataFrame:
    """Each voxel's step to the next one along an axis; the last ones have no row."""
    ahead = F.lead("w").over(Window.partitionBy(*_kept(along)).orderBy(along))
    return brick.withColumn("w", ahead - F.col("w")).where("w is not null")


def running_sum(brick: DataFrame, along: str = "lev") -> DataFrame:
    """Sums from an axis' beginning up to each voxel."""
    return brick.withColumn("w", F.sum("w").over(Window.partitionBy(*_kept(along)).orderBy(along)))


def centre_along(brick: DataFrame, along: str = "lev") -> DataFrame:
    """A plane of the mean place along an axis, weighted by values over the profile's least one; null for constant profiles."""
    over = F.col("w") - F.min("w").over(Window.partitionBy(*_kept(along)))
    weighed = brick.select(*_kept(along), along, over.alias("_k"))
    return weighed.groupBy(*_kept(along)).agg(F.try_divide(F.sum(F.col(along) * F.col("_k")), F.sum("_k")).alias("z"))
