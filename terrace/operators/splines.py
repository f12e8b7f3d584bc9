"""Smooth open and closed paths through given points, measured and sampled by arc length.

A path is ``path_id, i, x, y``: its points in the order of ``i``, ties by x and y.
Points with a null, NaN or infinite coordinate are left out. Points, segments and pieces
of segments are rows, handled in blocks of a bounded number of points, so that one long path
spreads over tasks; only one sum for each block meets the others of its path.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators import geometry
from terrace.operators.arithmetic import per_field
from terrace.plans.durable import durable, maybe_broadcast
from terrace.plans.indexing import row_index

#: Points of a path in one block.
BLOCK = 4096
#: Pieces of a segment, and points of the quadrature in each.
PIECES = 16
NODES, WEIGHTS = np.polynomial.legendre.leggauss(8)


def _points(paths: DataFrame) -> DataFrame:
    """``path_id, j, n, x, y`` of the usable points: their place from 0 and their number."""
    usable = (F.abs("x") < math.inf) & (F.abs("y") < math.inf)
    rows = row_index(paths.select("path_id", "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(usable), ["path_id", "i", "x", "y"])
    sizes = rows.groupBy("path_id").agg(F.min("k").alias("_lo"), F.count(F.lit(1)).alias("n"))
    return rows.join(maybe_broadcast(sizes, 32), "path_id").select("path_id", (F.col("k") - F.col("_lo")).alias("j"), "n", "x", "y")


def segments(paths: DataFrame, slackness: float = 1 / math.sqrt(2), closed: bool = False) -> DataFrame:
    """``path_id, j, n, x0..x3, y0..y3``: a cubic for each two points that follow each other, its coefficients by powers of a time from 0 to 1.

    The tangent at a point is that of the line between its neighbours; each side's reach
    is as long as its segment's share of both. ``slackness`` scales the reaches, from 0
    (straight segments) to the root of 2. A closed path returns to its first point. A path
    of one point has no segment.
    """
    return _cubics(_points(paths), slackness, closed)


def _cubics(points: DataFrame, slackness: float, closed: bool) -> DataFrame:
    if not 0 <= slackness <= math.sqrt(2):
        raise ValueError("slackness lies between 0 and the root of 2")
    points = points.where("n > 1")
    if closed:  # the last point stands before the first one too, and the first two after the last one
        copies = F.filter(F.array("j", F.when(F.col("j") == F.col("n") - 1, F.lit(-1)), F.when(F.col("j") < 2, F.col("j") + F.col("n"))), lambda v: v.isNotNull())
        points = points.withColumn("j", F.explode(copies))
    # A block sees one point before its own and two after them.
    block = lambda c: F.floor(c / BLOCK)
    blocks = F.array_distinct(F.array(block(F.col("j") - 2), block(F.col("j") - 1), block(F.col("j")), block(F.col("j") + 1)))
    dealt = points.withColumn("_block", F.explode(blocks))
    along = Window.partitionBy("path_id", "_block").orderBy("j")
    own = F.struct("x", "y")
    near = dealt.withColumns({"_p": F.lag(own).over(along), "_q": F.lead(own).over(along), "_r": F.lead(own, 2).over(along)})
    last = F.col("n") - (0 if closed else 1)
    whole = near.where((block(F.col("j")) == F.col("_block")) & (F.col("j") >= 0) & (F.col("j") < last))
    length = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    p, q, r = F.col("_p"), F.col("_q"), F.col("_r")
    lengths = whole.withColumns({"_lp": length(p, own), "_l": length(own, q), "_ln": length(q, r)})
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.5))
    parts = []
    for c in "xy":
        a, b = F.col(c), q[c]
        u = a + slackness * share("_l", "_lp") * (b - p[c]) / 2
        v = b - slackness * share("_l", "_ln") * (r[c] - a) / 2
        # An end without neighbour leans towards the other reach; two points alone are joined by a line.
        no_p, no_r = p.isNull(), r.isNull()
        open_u = ((2 - slackness) * a + slackness * v) / 2
        open_v = ((2 - slackness) * b + slackness * u) / 2
        line_u, line_v = (2 * a + b) / 3, (a + 2 * b) / 3
        straight = (no_p & no_r) if slackness else F.lit(True)
        parts += [F.when(straight, line_u).when(no_p, open_u).otherwise(u).alias(f"_u{c}"), F.when(straight, line_v).when(no_r, open_v).otherwise(v).alias(f"_v{c}"), b.alias(f"_b{c}")]
    bent = lengths.select("path_id", "j", "n", "x", "y", *parts)
    powers = []
    for c in "xy":
        a, u, v, b = (F.col(k) for k in (c, f"_u{c}", f"_v{c}", f"_b{c}"))
        powers += [a.alias(f"{c}0"), (3 * (u - a)).alias(f"{c}1"), (3 * (a - 2 * u + v)).alias(f"{c}2"), (b - a + 3 * (u - v)).alias(f"{c}3")]
    return bent.select("path_id", "j", "n", *powers)


def _at(c: str, t: Column) -> Column:
    return F.col(f"{c}0") + t * (F.col(f"{c}1") + t * (F.col(f"{c}2") + t * F.col(f"{c}3")))


def _velocity(c: str, t: Column) -> Column:
    return F.col(f"{c}1") + t * (2 * F.col(f"{c}2") + t * 3 * F.col(f"{c}3"))


def _speed(t: Column) -> Column:
    return F.hypot(_velocity("x", t), _velocity("y", t))


def _arc(start: Column, stop: Column) -> Column:
    """Length between two times of a segment, by quadrature."""
    half = (stop - start) / 2
    return half * sum((float(w) * _speed(start + half * (1 + float(x))) for x, w in zip(NODES, WEIGHTS)), F.lit(0.0))


def _measured(cubics: DataFrame) -> DataFrame:
    """The segments with the lengths of their pieces, ``_ls``, and their own, ``_l``; the quadrature runs over Arrow batches."""

    def run(batches):
        for batch in batches:
            of = {c: batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("x1", "x2", "x3", "y1", "y2", "y3")}
            sums = np.zeros((batch.num_rows, PIECES))
            starts, half = np.arange(PIECES) / PIECES, 0.5 / PIECES
            for node, weight in zip(NODES, WEIGHTS):
                t = starts + half * (1 + node)
                sums += weight * np.hypot(*(of[f"{c}1"] + t * (2 * of[f"{c}2"] + t * 3 * of[f"{c}3"]) for c in "xy"))
            sums *= half
            whole = np.zeros(batch.num_rows)
            for k in range(PIECES):  # in the pieces' order, as they are summed up later
                whole += sums[:, k]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * PIECES), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(whole)], [*batch.schema.names, "_ls", "_l"])

    extra = [T.StructField("_ls", T.ArrayType(T.DoubleType())), T.StructField("_l", T.DoubleType())]
    return cubics.mapInArrow(run, T.StructType([*cubics.schema.fields, *extra]))


def _placed(cubics: DataFrame) -> DataFrame:
    """The segments with the arc length at which each begins and ends, ``_start`` and ``_stop``, and the path's, ``length``.

    Only coefficients and lengths are kept; the pieces of the segments that are wanted are measured again.
    """
    known = durable(_measured(cubics).drop("_ls").withColumn("_block", F.floor(F.col("j") / BLOCK)))
    along = Window.partitionBy("path_id", "_block").orderBy("j")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    run = known.withColumns({"_s": F.coalesce(F.sum("_l").over(before), none), "_e": F.sum("_l").over(along.rowsBetween(Window.unboundedPreceding, 0))})
    # The blocks' last values, summed up in order, so that a segment ends exactly where the next begins.
    totals = run.groupBy("path_id", "_block").agg(F.max("_e").alias("_e"))
    by_path = Window.partitionBy("path_id").orderBy("_block")
    all_of = Window.partitionBy("path_id")
    starts = totals.withColumns({"_base": F.coalesce(F.sum("_e").over(by_path.rowsBetween(Window.unboundedPreceding, -1)), none), "_sum": F.sum("_e").over(by_path)})
    starts = durable(starts.select("path_id", "_block", "_base", F.max("_sum").over(all_of).alias("length")))
    placed = run.join(maybe_broadcast(starts, 48), ["path_id", "_block"])
    return placed.withColumns({"_start": F.col("_base") + F.col("_s"), "_stop": F.col("_base") + F.col("_e")}).drop("_s", "_e", "_base", "_block", "_l")


def _pieces(placed: DataFrame) -> DataFrame:
    """Pieces of segments (of ``_placed``) from time ``a`` to ``b``, with the arc length ``s`` and ``e`` at which each begins and ends."""
    sums = F.aggregate("_ls", F.array(F.lit(0.0)), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))
    cut = _measured(placed).withColumn("_cs", sums).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    inner = lambda k: F.col("_start") + F.get("_cs", k)
    own = cut.withColumns({
        "a": F.col("_k") / PIECES, "b": (F.col("_k") + 1) / PIECES, "_l": F.get("_ls", "_k"),
        "s": inner(F.col("_k")), "e": F.when(F.col("_k") == PIECES - 1, F.col("_stop")).otherwise(inner(F.col("_k") + 1)),
    })
    return own.drop("_cs", "_ls", "_start", "_stop")


def lengths(paths: DataFrame, slackness: float = 1 / math.sqrt(2), closed: bool = False) -> DataFrame:
    """``path_id, n, length``; 0 for a path of one point, no row for one of none."""
    points = _points(paths)
    sums = _measured(_cubics(points, slackness, closed)).groupBy("path_id").agg(F.sum("_l").alias("length"))
    sizes = points.where("j = 0").select("path_id", "n")
    return sizes.join(sums, "path_id", "left").select("path_id", "n", F.coalesce("length", F.lit(0.0)).alias("length"))


def sample_uniformly(paths: DataFrame, samples: int | None, slackness: float = 1 / math.sqrt(2), closed: bool = False) -> DataFrame:
    """``path_id, k, x, y, tx, ty``: ``samples`` points at equal arc lengths, and the unit tangents there.

    Samples of an open path stand at both ends (a single one in the middle), those of a
    closed one begin at its first point. With ``samples`` None a path has one for each unit of its
    length, rounded, and one more. A path of no length gives its first point with tangents of 0,
    as does a place at which the path stands still. Segments into which samples fall are cut into
    pieces, and every piece emits the samples that fall into it.
    """
    points = _points(paths)
    count = F.lit(samples).cast("long") if samples is not None else F.floor(F.col("length") + 1.5)
    whole = _placed(_cubics(points, slackness, closed)).where("length > 0").withColumn("_n", count)
    step = F.col("length") / (F.col("_n") if closed else F.greatest(F.col("_n") - 1, F.lit(1)))
    last = F.col("j") == F.col("n") - (1 if closed else 2)
    # A segment's pieces emit no others than these; a single sample of an open path stands anywhere.
    held = last | (F.ceil(F.col("_start") / step) < F.ceil(F.col("_stop") / step)) | (F.col("_n") == 1)
    cut = _pieces(whole.where(held))
    first = F.ceil(F.col("s") / step)
    is_last = (F.col("_k") == PIECES - 1) & last
    until = F.when(is_last, F.col("_n") - 1).otherwise(F.least(F.ceil(F.col("e") / step), F.col("_n")) - 1)
    hits = cut.withColumns({"_step": step, "_first": first, "_until": until}).where("_first <= _until").withColumn("k", F.explode(F.sequence("_first", "_until")))
    middle = None
    if not closed:  # a single sample of an open path stands in its middle
        half = F.col("length") / 2
        middle = cut.where("_n = 1").where((F.col("s") <= half) & (half < F.col("e"))).withColumns({"k": F.lit(0).cast("long"), "_r": half - F.col("s")})
        hits = hits.where("_n > 1")
    hits = hits.withColumn("_r", F.least(F.greatest(F.col("k") * F.col("_step") - F.col("s"), F.lit(0.0)), F.col("_l")))
    if middle is not None:
        hits = hits.drop("_step", "_first", "_until").unionByName(middle)
    at = hits.withColumn("t", F.col("a") + (F.col("b") - F.col("a")) * F.coalesce(F.try_divide(F.col("_r"), F.col("_l")), F.lit(0.0)))
    # Newton's steps on the arc length, which grows steadily within a piece.
    closer = lambda t, _: F.least(F.greatest(t - F.coalesce(F.try_divide(_arc(F.col("a"), t) - F.col("_r"), _speed(t)), F.lit(0.0)), F.col("a")), F.col("b"))
    at = at.withColumn("t", F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.col("t"), closer))
    t = F.col("t")
    moving = at.select("path_id", "k", _at("x", t).alias("x"), _at("y", t).alias("y"), _velocity("x", t).alias("_vx"), _velocity("y", t).alias("_vy"))
    unit = lambda c: F.coalesce(F.try_divide(F.col(c), F.hypot("_vx", "_vy")), F.lit(0.0))
    moving = moving.select("path_id", "k", "x", "y", unit("_vx").alias("tx"), unit("_vy").alias("ty"))
    firsts = points.where("j = 0").join(whole.select("path_id").distinct(), "path_id", "left_anti")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples or 1).cast("long") - 1))
    return moving.union(firsts.select("path_id", k.alias("k"), "x", "y", F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty")))


def straighten(field: DataFrame, paths: DataFrame, thickness: int, slackness: float = 1 / math.sqrt(2), closed: bool = False) -> DataFrame:
    """A band of ``thickness`` pixels along a path made straight: ``field_id, row, col, z, m``.

    ``path_id`` is the field's id and x and y are columns and rows, pixel centres at halves. A row
    of the result is a place along the path, one for each pixel of its length; columns run across it, to the left
    of a path that goes up the rows last. Places off the field are marked in ``m`` and get
    the mean of the others.
    """
    across = F.explode(F.sequence(F.lit(0), F.lit(thickness - 1)))
    band = sample_uniformly(paths, None, slackness, closed).select("*", across.alias("col"))
    off = F.col("col") + 0.5 - thickness / 2
    places = band.select(F.col("path_id").alias("field_id"), F.col("k").cast("int").alias("row"), "col", (F.col("x") + off * F.col("ty")).alias("_x"), (F.col("y") - off * F.col("tx")).alias("_y"))
    sizes = field.groupBy("field_id").agg((F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    known = durable(places.join(maybe_broadcast(durable(sizes), 24), "field_id"))
    outside = (F.col("_x") < 0) | (F.col("_x") > F.col("_w")) | (F.col("_y") < 0) | (F.col("_y") > F.col("_h"))
    read = geometry.read_places(field, known.where(~outside).select("field_id", "row", "col", "_w", "_h", (F.col("_x") - 0.5).alias("_x"), (F.col("_y") - 0.5).alias("_y")))
    marked = known.select("field_id", "row", "col", outside.cast("double").alias("m")).join(read, ["field_id", "row", "col"], "left")
    filled = per_field(marked.withColumnRenamed("_v", "z"), F.avg("z").alias("_mean"))
    return filled.select("field_id", "row", "col", F.coalesce("z", "_mean").alias("z"), "m")
