"""Delaunay triangulation of scattered points, and values read between them.

The plane is cut into square cells, each as small as it takes that neither it nor the
eight around it hold too many points. A task triangulates a cell's points together with
those around and the corners of the convex hull. Triangles whose circle stays within these
cells are right; the circles of the others are searched for points that the task did not
have, and cells that missed some are done again with them. So every triangle kept has an
empty circle among all points, and the star of every point is whole. Points on one circle
are told apart by one rule everywhere (``functions.mesh``), so the cells agree.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import mesh
from terrace.plans.durable import durable, maybe_broadcast, written

#: Points of one cell, at most; a task sees nine cells, and what their circles still need.
CELL_POINTS = 2000
#: Corners of the hull that every task may be given.
HULL_POINTS = 1_000_000
#: Points that one circle may bring into its cell in one round; the next round brings more.
BROUGHT = 8
_DEPTH = 30
_LEAF = ["surface_id", "level", "cx", "cy"]


def places(points: DataFrame) -> DataFrame:
    """``surface_id, pt_id, x, y, z``: points of one place as one, of the smallest ``pt_id`` and the mean ``z``; unusable coordinates left out."""
    usable = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    # Adding 0 makes one of the two zeros.
    x, y = (F.col(c).cast("double") + 0.0 for c in "xy")
    return points.where(usable).groupBy("surface_id", x.alias("x"), y.alias("y")).agg(F.min("pt_id").alias("pt_id"), F.avg("z").alias("z")).select("surface_id", "pt_id", "x", "y", "z")


def _located(known: DataFrame) -> DataFrame:
    """Places with their surface's box and their cell ``ux, uy`` at the finest level."""
    box = known.groupBy("surface_id").agg(*(of(c).alias(f"{name}_{c}") for c in "xy" for name, of in (("low", F.min), ("high", F.max))))
    box = box.withColumn("side", F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y"))).where("side > 0")
    joined = known.join(maybe_broadcast(durable(box), 64), "surface_id")
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / F.col("side") * float(1 << _DEPTH)).cast("long"), F.lit((1 << _DEPTH) - 1))
    return durable(joined.withColumns({"ux": cell("x"), "uy": cell("y")}))


def _at(level: int | Column, c: str) -> Column:
    return F.shiftright(F.col(c), _DEPTH - level) if isinstance(level, int) else F.expr(f"shiftright({c}, {_DEPTH} - level)")


def _nine(df: DataFrame) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return df.withColumn("_s", F.explode(steps)).withColumns({"nx": F.col("cx") + F.col("_s.a"), "ny": F.col("cy") + F.col("_s.b")}).drop("_s")


def _leaves(located: DataFrame, most: int) -> DataFrame:
    """Places with the ``level, cx, cy`` of the cell that owns them: the coarsest whose nine cells hold no more than ``most`` each."""
    n = located.count()
    level = min(_DEPTH, max(0, math.ceil(math.log(max(n, 1) / most, 4)))) if n > most else 0
    todo, done = located, None
    while True:
        cell = {"cx": _at(level, "ux"), "cy": _at(level, "uy")}
        named = todo.withColumns({"level": F.lit(level), **cell})
        crowded = located.select("surface_id", *(c.alias(k) for k, c in cell.items())).groupBy("surface_id", "cx", "cy").count().where(F.col("count") > most)
        crowded = durable(_nine(crowded).select("surface_id", F.col("nx").alias("cx"), F.col("ny").alias("cy")).distinct())
        if level == _DEPTH or crowded.isEmpty():
            return named if done is None else done.unionByName(named)
        crowded = maybe_broadcast(crowded, 32)
        fine = named.join(crowded, ["surface_id", "cx", "cy"], "left_anti")
        done = fine if done is None else done.unionByName(fine)
        todo = named.join(crowded, ["surface_id", "cx", "cy"], "left_semi").drop("level", "cx", "cy")
        level += 1


def _hull_of(table: pa.Table) -> pa.Table:
    at = {(x, y): i for i, (x, y) in enumerate(zip(table.column("x").to_pylist(), table.column("y").to_pylist()))}
    return table.take(pa.array([at[p] for p in mesh.hull(list(at))], pa.int64()))


def hull_corners(leaves: DataFrame) -> DataFrame:
    """``surface_id, pt_id, x, y, z`` of the corners of each cloud's convex hull: hulls of cells, of coarser cells, and at last of all."""
    names = ["surface_id", "pt_id", "x", "y", "z", "ux", "uy"]
    schema = leaves.select(*names).schema
    now = durable(leaves.select(*names, "level", "cx", "cy").groupBy(*_LEAF).applyInArrow(lambda t: _hull_of(t.select(names)), schema))
    for level in range(_DEPTH - 4, 0, -4):
        if now.groupBy("surface_id").count().where(F.col("count") > 20_000).isEmpty():
            break
        dealt = now.withColumns({"cx": _at(level, "ux"), "cy": _at(level, "uy")})
        now = durable(dealt.groupBy("surface_id", "cx", "cy").applyInArrow(lambda t: _hull_of(t.select(names)), schema))
    if not now.groupBy("surface_id").count().where(F.col("count") > HULL_POINTS).isEmpty():
        raise ValueError(f"a convex hull of more than {HULL_POINTS} corners")
    return now.groupBy("surface_id").applyInArrow(_hull_of, schema).drop("ux", "uy")


# The third corner's coordinates are named by v, as cx and cy name the cell.
_TRIANGLE = ", ".join(["a long, b long, c long", *(f"{p}{v} double" for p in "abv" for v in "xyz"), "x double, y double, r double, sure boolean, own boolean"])


def _local(table: pa.Table) -> pa.Table:
    """The triangles at a cell's own points, with their circles, and whether these stay within the points known."""
    rows = {r["pt_id"]: r for r in sorted(table.to_pylist(), key=lambda r: r["own"])}  # an own point last, so that it counts as own
    first = next(iter(rows.values()))
    # Strips of the cell, so that each point is inserted near the one before.
    wide = max(first["side"] / (1 << first["level"]) * 3 / max(len(rows), 1) ** 0.5, 1e-300)
    near = sorted(rows.values(), key=lambda r: (r["x"] // wide, r["y"]))
    points = [(r["x"], r["y"]) for r in near]
    step = first["side"] / (1 << first["level"])
    x0, y0 = first["low_x"] + (first["cx"] - 1) * step, first["low_y"] + (first["cy"] - 1) * step
    # Beyond the surface's own box there are no points.
    open_x0, open_x1 = x0 <= first["low_x"], x0 + 3 * step >= first["high_x"]
    open_y0, open_y1 = y0 <= first["low_y"], y0 + 3 * step >= first["high_y"]
    slack = 1e-9 * step
    out = []
    for t in mesh.Mesh(points).triangles() if len(points) > 2 else []:
        corners = [near[k] for k in t]
        if not any(c["own"] for c in corners):
            continue
        least = min(range(3), key=lambda k: corners[k]["pt_id"])
        a, b, c = corners[least:] + corners[:least]
        x, y, r = mesh.circle(*((p["x"], p["y"]) for p in (a, b, c)))
        wide, high = max(abs(b["x"] - a["x"]), abs(c["x"] - a["x"])), max(abs(b["y"] - a["y"]), abs(c["y"] - a["y"]))
        if r > 1e6 * (wide + high):  # so flat that its centre is not known
            r = math.inf
        sure = (open_x0 or x - r > x0 + slack) and (open_x1 or x + r < x0 + 3 * step - slack) and (open_y0 or y - r > y0 + slack) and (open_y1 or y + r < y0 + 3 * step - slack)
        out.append([a["pt_id"], b["pt_id"], c["pt_id"], *(p[v] for p in (a, b, c) for v in "xyz"), x, y, r, sure, a["own"]])
    keys = [pa.array([first[k]] * len(out), table.schema.field(k).type) for k in _LEAF]
    types = [pa.int64()] * 3 + [pa.float64()] * 12 + [pa.bool_()] * 2
    names = [part.split()[0] for part in _TRIANGLE.split(", ")]
    return pa.Table.from_arrays([*keys, *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], [*_LEAF, *names])


def _inside(batches):
    """Rows whose point ``px, py`` lies in the triangle's circle, decided exactly."""
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("ax", "ay", "bx", "by", "vx", "vy", "px", "py")]
        keep = [mesh.in_circle((ax, ay), (bx, by), (cx, cy), (px, py)) for ax, ay, bx, by, cx, cy, px, py in zip(*columns)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _missed(triangles: DataFrame, members: DataFrame, located: DataFrame, level: int) -> DataFrame:
    """Points inside the circles of triangles that are not sure and that the cell did not have, a few of the innermost for each circle."""
    cells = 1 << level
    box = located.select("surface_id", "low_x", "low_y", "side").distinct()
    spots = located.select("surface_id", _at(level, "ux").alias("i"), _at(level, "uy").alias("j"), "pt_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    unsure = triangles.where("not sure").select(*_LEAF, "a", "b", "c", "ax", "ay", "bx", "by", "vx", "vy", "x", "y", "r")
    step = F.col("side") / cells
    known = unsure.join(maybe_broadcast(durable(box), 40), "surface_id")
    clip = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(float(cells - 1)))).cast("int")
    reach = F.col("r") * (1 + 1e-9)
    rows = known.withColumn("j", F.explode(F.sequence(clip((F.col("y") - reach - F.col("low_y")) / step), clip((F.col("y") + reach - F.col("low_y")) / step))))
    low = F.col("low_y") + F.col("j") * step
    off = F.greatest(low - F.col("y"), F.col("y") - low - step, F.lit(0.0))
    half = F.when(F.col("r") == float("inf"), F.col("r")).otherwise(F.sqrt(F.greatest(reach * reach - off * off, F.lit(0.0))))
    cover = rows.withColumn("_h", half)
    cover = cover.withColumn("i", F.explode(F.sequence(clip((F.col("x") - F.col("_h") - F.col("low_x")) / step), clip((F.col("x") + F.col("_h") - F.col("low_x")) / step))))
    apart = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    found = cover.drop("_h", "low_x", "low_y", "side").join(spots, ["surface_id", "i", "j"]).withColumn("_d", apart).where((F.col("_d") <= reach) | (F.col("r") == float("inf")))
    new = found.join(members.select(*_LEAF, "pt_id"), [*_LEAF, "pt_id"], "left_anti")
    names = [*_LEAF, "a", "b", "c", "ax", "ay", "bx", "by", "vx", "vy", "pt_id", "px", "py", "pz", "_d"]
    sure = new.select(*names).mapInArrow(_inside, new.select(*names).schema)
    rank = F.row_number().over(Window.partitionBy(*_LEAF, "a", "b", "c").orderBy("_d", "pt_id"))
    few = sure.withColumn("_k", rank).where(F.col("_k") <= BROUGHT)
    return few.select(*_LEAF, "pt_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")).dropDuplicates([*_LEAF, "pt_id"])


def delaunay(points: DataFrame, most: int = CELL_POINTS) -> DataFrame:
    """``surface_id, a, b, c`` and the corners' ``ax, ay, az`` .. ``cz``: the Delaunay triangles, turning left, the smallest ``pt_id`` first.

    Points of one place are one point (``places``); null, NaN and infinite coordinates
    are left out. A cloud of fewer than three places, or all in one line, has no
    triangles. ``pt_id`` is a whole number.
    """
    located = _located(places(points))
    leaves = durable(_leaves(located, most))
    if leaves.isEmpty():
        return _named(leaves.groupBy(*_LEAF).applyInArrow(_local, _schema(leaves)))
    box = ["low_x", "low_y", "high_x", "high_y", "side"]
    levels = [r[0] for r in leaves.select("level").distinct().collect()]
    cells = leaves.select(*_LEAF).distinct()
    by_level = located.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"nx": _at(F.col("level"), "ux"), "ny": _at(F.col("level"), "uy")})
    around = _nine(cells).where("nx != cx or ny != cy").join(by_level.drop("cx", "cy"), ["surface_id", "level", "nx", "ny"])
    columns = [*_LEAF, "pt_id", "x", "y", "z", "own"]
    own = leaves.withColumn("own", F.lit(True)).select(*columns)
    corners = hull_corners(leaves)
    everywhere = cells.join(maybe_broadcast(durable(corners), 48), "surface_id").withColumn("own", F.lit(False)).select(*columns)
    members = durable(own.union(around.withColumn("own", F.lit(False)).select(*columns)).union(everywhere))
    boxes = maybe_broadcast(durable(located.select("surface_id", *box).distinct()), 64)
    level = min(_DEPTH, max(0, math.ceil(math.log(max(located.count(), 1) / 16, 4)))) if located.count() > 16 else 0
    done, active = None, members
    turn = 0
    while True:
        ready = active.join(boxes, "surface_id")
        made = durable(ready.groupBy(*_LEAF).applyInArrow(_local, _schema(ready)))
        missed = durable(_missed(made, members, located, level).withColumn("own", F.lit(False)).select(*columns))
        again = durable(missed.select(*_LEAF).distinct())
        right = made.join(maybe_broadcast(again, 40), _LEAF, "left_anti").where("own")
        done = right if done is None else done.unionByName(right)
        if again.isEmpty():
            return _named(done)
        turn += 1
        members = (written if turn % 3 == 0 else durable)(members.union(missed))
        active = members.join(maybe_broadcast(again, 40), _LEAF, "left_semi")


def _schema(ready: DataFrame) -> str:
    of = ready.schema["surface_id"].dataType.simpleString()
    return f"surface_id {of}, level int, cx long, cy long, {_TRIANGLE}"


def _named(triangles: DataFrame) -> DataFrame:
    return triangles.select("surface_id", "a", "b", "c", *(f"{p}{v}" for p in "ab" for v in "xyz"), *(F.col(f"v{v}").alias(f"c{v}") for v in "xyz"))


def interpolate(points: DataFrame, xres: int, yres: int, most: int = CELL_POINTS) -> DataFrame:
    """``field_id, row, col, z``: a grid over the points' extent, each pixel's middle read from the plane of its triangle.

    Pixels outside the convex hull have no row.
    """
    triangles = durable(delaunay(points, most))
    box = places(points).groupBy("surface_id").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    known = triangles.join(maybe_broadcast(durable(box), 48), "surface_id")
    dx, dy = (F.col("_x1") - F.col("_x0")) / xres, (F.col("_y1") - F.col("_y0")) / yres
    place = lambda v, low, d, size: F.greatest(F.least(F.floor((v - F.col(low)) / d).cast("int"), F.lit(size - 1)), F.lit(0))
    span = lambda v, low, d, size: F.sequence(place(F.least(*(f"{p}{v}" for p in "abc")), low, d, size), place(F.greatest(*(f"{p}{v}" for p in "abc")), low, d, size))
    spread = known.withColumn("row", F.explode(span("y", "_y0", dy, yres))).withColumn("col", F.explode(span("x", "_x0", dx, xres)))
    at = spread.withColumns({"_x": F.col("_x0") + (F.col("col") + 0.5) * dx, "_y": F.col("_y0") + (F.col("row") + 0.5) * dy})

    def twice(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column]) -> Column:
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    a, b, c = ((F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc")
    here = F.col("_x"), F.col("_y")
    whole = twice(a, b, c)
    parts = at.withColumns({"_a": twice(here, b, c) / whole, "_b": twice(a, here, c) / whole, "_c": twice(a, b, here) / whole})
    inside = parts.where((F.col("_a") >= -1e-9) & (F.col("_b") >= -1e-9) & (F.col("_c") >= -1e-9))
    z = F.col("_a") * F.col("az") + F.col("_b") * F.col("bz") + F.col("_c") * F.col("cz")
    # A pixel on an edge takes the first of its triangles.
    best = inside.groupBy(F.col("surface_id").alias("field_id"), "row", "col").agg(F.min(F.struct("a", "b", "c", z.alias("z"))).alias("_t"))
    return best.select("field_id", "row", "col", F.col("_t.z").alias("z"))
