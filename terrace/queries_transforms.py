"""Registered queries of warps, row alignment by trimmed means, facets, wavelets and line votes, in the manner of ``terrace.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.operators import filters, geometry, levelling, spatial, volume
from terrace.queries import _VOXEL, CELL, PLANE_CELL, PX, brick_query, cells, on_grid, register, rounded, whole

# --- warps: the place (x, y) read for pixel (c, r)

_WARPED = """, p as (select r, c, w, h, cast({x} as double) x, cast({y} as double) y from px),
  s as (select *, cast(floor(x) as bigint) fx, cast(floor(y) as bigint) fy, unnest([0, 0, 1, 1]) dy, unnest([0, 1, 0, 1]) dx from p where x between 0 and w and y between 0 and h),
  n as (select r, c, case dx when 1 then x - fx else 1 - x + fx end * case dy when 1 then y - fy else 1 - y + fy end k,
    case when (fy + dy) % (2 * h) < h then (fy + dy) % (2 * h) else 2 * h - 1 - (fy + dy) % (2 * h) end i, case when (fx + dx) % (2 * w) < w then (fx + dx) % (2 * w) else 2 * w - 1 - (fx + dx) % (2 * w) end j from s),
  v as (select n.r, n.c, sum(k * z) v from n join px b on b.r = i and b.c = j group by all)"""
for _name, _of, _x, _y in (
    ("rotate", lambda f: geometry.rotate(f, 0.3), "c * cos(0.3) - r * sin(0.3) + ((w - 1) * (1 - cos(0.3)) + (h - 1) * sin(0.3)) / 2", "r * cos(0.3) + c * sin(0.3) + ((h - 1) * (1 - cos(0.3)) - (w - 1) * sin(0.3)) / 2"),
    ("affine", lambda f: geometry.affine(f, (0.8, 0.15, -0.1, 0.9), (1.37, 4.73)), "0.8 * c + 0.15 * r + 1.37", "-0.1 * c + 0.9 * r + 4.73"),
    ("undrift", lambda f: geometry.undrift(f, 0.037), "c + 0.037 * r", "r"),
):
    register(
        f"field_{_name}", cells(_of),
        f"with {PX}{_WARPED.format(x=_x, y=_y)} select cast(0 as bigint) as field_id, px.r as \"row\", px.c as col, {rounded('coalesce(v, (select min(z) from px))', 'z', 3)} from px left join v on v.r = px.r and v.c = px.c", digits=3,
    )
register("field_shift", cells(lambda f: geometry.shift(f, 3, -2, 1.5)), f"with {PX} select cast(0 as bigint) as field_id, a.r as \"row\", a.c as col, {rounded('coalesce(b.z, 1.5)', 'z')} from px a left join px b on b.r = a.r + 2 and b.c = a.c - 3")
register("mask_shift", cells(lambda f: geometry.shift(f, -1, 4, of="m").withColumn("z", F.col("m"))), f"with {PX} select cast(0 as bigint) as field_id, a.r as \"row\", a.c as col, {rounded('coalesce(b.m, 0)', 'z')} from px a left join px b on b.r = a.r - 4 and b.c = a.c + 1")

# --- rows by trimmed means, facets, local medians

_CUT = "least(floor(n * 0.05 + 0.5), (n - 1) // 2)"
_RANKED = "select r, v, row_number() over (partition by r order by v) p, count(*) over (partition by r) n from"
_KEPT = f"select r, avg(v) v from t where p > {_CUT} and p <= n - {_CUT} group by r"
register(
    "align_rows_trimmed_mean", cells(lambda f: levelling.align_rows(f, "trimmed_mean")),
    f"with {PX}, t as ({_RANKED} (select r, z v from px)), s as ({_KEPT}) select cast(0 as bigint) as field_id, px.r as \"row\", c as col, {rounded('z - v + (select avg(v) from s)', 'z')} from px join s on s.r = px.r",
)
register(
    "align_rows_trimmed_differences", cells(lambda f: levelling.align_rows(f, "trimmed_differences")),
    f"""with {PX}, t as ({_RANKED} (select a.r, a.z - b.z v from px a join px b on b.r = a.r - 1 and b.c = a.c)), k as ({_KEPT}), s as (select u.r, sum(coalesce(k.v, 0)) over (order by u.r) v from (select distinct r from px) u left join k on k.r = u.r)
    select cast(0 as bigint) as field_id, px.r as "row", c as col, {rounded('z - v + (select avg(v) from s)', 'z')} from px join s on s.r = px.r""",
)
_FACETS = f"""with {PX}, f as (select a.r, a.c, (a.z + b.z - l.z - m.z) / 2 vx, (l.z + a.z - m.z - b.z) / 2 vy from px a join px b on b.r = a.r - 1 and b.c = a.c join px l on l.r = a.r and l.c = a.c - 1 join px m on m.r = a.r - 1 and m.c = a.c - 1),
  q as (select vx, vy, exp(-20 * (vx * vx + vy * vy) / (select avg(vx * vx + vy * vy) from f)) q from f), b as (select sum(vx * q) / sum(q) bx, sum(vy * q) / sum(q) ky from q)"""
register("facet_slopes", on_grid(levelling.facet_slopes), f"{_FACETS} select cast(0 as bigint) as field_id, {rounded('bx', 'bx')}, {rounded('ky', 'by')} from b")
register("level_facet", cells(levelling.level_facet), f"{_FACETS} select {CELL}, {rounded('z - bx * (c - w / 2) - ky * (r - h / 2)', 'z')} from px, b")
register(
    "level_local_median", cells(lambda f: levelling.level_local_median(f, 3)),
    f"""with {PX}, o as (select a.r, a.c, a.z, list_sort(list(b.z)) v from (select r, c, z, unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) dr, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) dc from px) a join px b on b.r = a.r + dr and b.c = a.c + dc group by all)
    select {CELL}, {rounded('z - v[len(v) // 2 + 1]', 'z')} from o""",
)

# --- wavelets, kernel search, lines

_TAPS = {2: ["1 / sqrt(2)"] * 2, 4: [f"({t}) / (4 * sqrt(2))" for t in ("1 + sqrt(3)", "3 + sqrt(3)", "3 - sqrt(3)", "1 - sqrt(3)")]}
for _order, _taps in _TAPS.items():
    for _axis, _along, _n in (("x", "c", "w"), ("y", "r", "h")):
        _other = "r" if _axis == "x" else "c"
        _high = [f"({t}) * {(-1) ** i}" for i, t in enumerate(reversed(_taps))]
        _row, _col = ("r", "c // 2") if _axis == "x" else ("r // 2", "c")
        register(
            f"wavelet_{_order}_{_axis}", on_grid(lambda f, o=_order, a=_axis: spatial.wavelet_rows(f, o, a)),
            f"""with {PX}, e as (select r, c, {_n} - {_n} % 2 n, unnest(range({_order})) i, unnest([{', '.join(_taps)}]) g, unnest([{', '.join(_high)}]) k from px where {_along} % 2 = 0 and {_along} < {_n} - {_n} % 2),
            o as (select e.r, e.c, sum(g * z) low, sum(k * z) high from e join px b on b.{_other} = e.{_other} and b.{_along} = (e.{_along} + i) % n group by all)
            select cast(0 as bigint) as field_id, {whole(_row, 'row')}, {whole(_col, 'col')}, {rounded('low', 'low')}, {rounded('high', 'high')} from o""",
        )
_K3 = [1.0, 2.0, 1.0, 0.0, 4.0, 2.0, -1.0, 0.0, 3.0]
register(
    "correlation_map", cells(lambda f: spatial.correlation_map(f, _K3, 3, 3)),
    f"""with {PX}, o as (select a.r, a.c, b.z, k from (select r, c, unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) dr, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) dc, unnest({_K3}::double[]) k from px) a join px b on b.r = a.r + dr and b.c = a.c + dc)
    select {CELL}, {rounded('case when count(*) < 9 then -1 else coalesce(covar_pop(z, k) / nullif(stddev_pop(z) * stddev_pop(k), 0), 0) end', 'z')} from o group by r, c""",
)
register(
    "hough_lines", on_grid(lambda f: spatial.hough_lines(f, 36)),
    f"""with {PX}, o as (select r, c, unnest(range(36)) a from px where m > 0)
    select cast(0 as bigint) as field_id, {whole('a', 'angle')}, {whole('floor(c * cos(a * pi() / 36) + r * sin(a * pi() / 36) + 0.500001)', 'distance')}, count(*) as votes from o group by all""",
)

# --- volumes

_D = ", d as (select *, w - avg(w) over (partition by r, c) d, abs(w - lag(w) over (partition by r, c order by l)) s, w - min(w) over (partition by r, c) k from vx)"
for _how, _sql in {
    "ra": "avg(abs(d))", "skew": "avg(d * d * d) / nullif(avg(d * d), 0) ** 1.5", "kurtosis": "avg(d * d * d * d) / nullif(avg(d * d), 0) ** 2 - 3",
    "median": "list_sort(list(w))[count(*) // 2 + 1]", "variation": "coalesce(sum(s), 0)",
}.items():
    brick_query(f"reduce_{_how}", lambda b, how=_how: volume.reduce_along(b, "lev", how), f"{_D} {PLANE_CELL}, {rounded(_sql, 'z')} from d group by r, c")
brick_query("centre", volume.centre_along, f"{_D} {PLANE_CELL}, {rounded('sum(l * k) / nullif(sum(k), 0)', 'z')} from d group by r, c")
_VOXELS = ("brick_id", "lev", "row", "col", "w")
brick_query(
    "level_planes", lambda b: volume.level_planes(b).select(*_VOXELS),
    f", f as (select l, avg(w) mw, avg(r) mr, avg(c) mc, covar_pop(w, c) / var_pop(c) bx, covar_pop(w, r) / var_pop(r) ky from vx group by l) {_VOXEL.replace('l as bigint', 'vx.l as bigint')}, {rounded('w - mw - bx * (c - mc) - ky * (r - mr)', 'w')} from vx join f on f.l = vx.l",
)
brick_query("zero_at", lambda b: volume.zero_at(b, 5).select(*_VOXELS), f"{_VOXEL}, {rounded('w - max(w) filter (l = 5) over (partition by r, c)', 'w')} from vx")
for _axis, _place, _others in (("lev", "l", "r, c"), ("row", "r", "l, c"), ("col", "c", "l, r")):
    _next = f"lead(w) over (partition by {_others} order by {_place}) - w"
    brick_query(f"difference_{_axis}", lambda b, a=_axis: volume.difference_along(b, a).select(*_VOXELS), f", d as (select l, r, c, {_next} d from vx) {_VOXEL}, {rounded('d', 'w')} from d where d is not null")
    brick_query(f"running_sum_{_axis}", lambda b, a=_axis: volume.running_sum(b, a).select(*_VOXELS), f"{_VOXEL}, {rounded(f'sum(w) over (partition by {_others} order by {_place})', 'w')} from vx")
brick_query(
    "each_level_maximum", lambda b: volume.each_level(b, lambda f: filters.maximum(f, 3)).select(*_VOXELS),
    f", s as (select l, r, c, max(w) over (partition by l, r order by c rows between 1 preceding and 1 following) w from vx) {_VOXEL}, {rounded('max(w) over (partition by l, c order by r rows between 1 preceding and 1 following)', 'w')} from s",
)
