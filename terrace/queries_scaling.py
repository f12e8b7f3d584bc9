"""Registered queries of scaling, 5 by 5 kernels, marks by slope and curvature and convex outlines, in the manner of ``terrace.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.operators import filters, fractals, grains, hulls, lines
from terrace.queries import _MIRROR3, CELL, PX, cells, curve_query, grain_sql, numbered, on_grid, register, rounded, weighted, whole

# --- scaling, on the square grid of 2^k + 1 pixels

_SQUARE = f"""with {PX}, sz as (select any_value(w) w, any_value(h) h, cast(floor(log2(any_value(w)) + 0.5) as bigint) k from px),
  ax as (select unnest(range(cast(1 << k as bigint) + 1)) t, (1 << k) + 1 n from sz),
  ry as (select t, y, unnest([floor(y), floor(y) + 1]) i from (select t, least(greatest((t + 0.5) * h / n - 0.5, 0), h - 1) y from ax, sz)),
  rx as (select t, x, unnest([floor(x), floor(x) + 1]) j from (select t, least(greatest((t + 0.5) * w / n - 0.5, 0), w - 1) x from ax, sz)),
  sq as materialized (select ry.t r, rx.t c, sum((1 - abs(y - i)) * (1 - abs(x - j)) * z) z from px join ry on px.r = i join rx on px.c = j group by all)"""
_BLOCKS = f"""{_SQUARE}, v as (select l, r // (1 << l) a, c // (1 << l) b, var_pop(z) v from sq, (select unnest(range(1, k)) l from sz) group by all),
  s as (select l, l * ln(2) x, ln(sum(v) / (1 << (2 * (k - l)))) y from v, sz where greatest(a, b) < (1 << (k - l)) - 1 group by l, k)"""
_HERON = "sqrt(greatest(({a} + {b} + {c}) * ({b} + {c} - {a}) * ({a} + {c} - {b}) * ({a} + {b} - {c}), 0)) / 4"
_FACES = f"""{_SQUARE}, st as (select (1 << k) / (max(z) - min(z)) f from sq, sz group by k), g as materialized (select l, r, c, z * f h, 1 << (k - l) s from sq, st, (select k, unnest(range(k + 1)) l from sz) where r % (1 << (k - l)) = 0 and c % (1 << (k - l)) = 0),
  n as (select *, lead(h) over (partition by l, r order by c) u, lead(h) over (partition by l, c order by r) v from g), p as (select *, lead(u) over (partition by l, c order by r) w from n),
  q as (select l, sqrt(s * s + (h - u) ** 2) a, sqrt(s * s + (h - v) ** 2) b, sqrt(s * s + (v - w) ** 2) c, sqrt(s * s + (u - w) ** 2) d, sqrt(2 * s * s + (v - u) ** 2) e from p where w is not null),
  s as (select l, (l - k) * ln(2) x, ln(sum({_HERON.format(a='a', b='b', c='e')} + {_HERON.format(a='c', b='d', c='e')})) y from q, sz group by l, k)"""
for _name, _of, _x, _y, _sql in (
    ("partitioning", fractals.partitioning, "log_size", "log_variance", _BLOCKS),
    ("triangulation", fractals.triangulation, "log_scale", "log_area", _FACES),
):
    register(f"fractal_{_name}", on_grid(lambda f, of=_of: of(fractals.square(f))), f"{_sql} select cast(0 as bigint) as field_id, {whole('l', 'level')}, {rounded('x', _x)}, {rounded('y', _y)} from s")
for _name, _of, _sql, _dimension in (
    ("partitioning", fractals.partitioning_dimension, _BLOCKS, "3 - regr_slope(y, x) / 2"),
    ("triangulation", fractals.triangulation_dimension, _FACES, "2 + regr_slope(y, x)"),
):
    register(f"fractal_{_name}_dimension", on_grid(lambda f, of=_of: of(fractals.square(f))), f"{_sql} select cast(0 as bigint) as field_id, {rounded(_dimension, 'dimension')} from s")

# --- 5 by 5 kernels, marks

_MIRROR5 = """, s1 as (select r, c, w, h, unnest([-2, -1, 0, 1, 2]) dr from px), s2 as (select *, unnest([-2, -1, 0, 1, 2]) dc from s1),
  s3 as (select r, c, dr, dc, case when r + dr < 0 then -1 - r - dr when r + dr >= h then 2 * h - 1 - r - dr else r + dr end i, case when c + dc < 0 then -1 - c - dc when c + dc >= w then 2 * w - 1 - c - dc else c + dc end j from s2),
  o as (select s3.r, s3.c, dr, dc, z from s3 join px b on b.r = i and b.c = j)"""
for _name, (_kernel, _divisor) in filters.KERNELS_5.items():
    _sum = f"sum(z * ({list(_kernel)})[dr * 5 + dc + 13]) / {_divisor}"
    register(f"filter_{_name}", cells(lambda f, name=_name: filters.kernel5(f, name)), f"with {PX}{_MIRROR5} select {CELL}, {rounded(_sum, 'z')} from o group by r, c")
_SIZE = f"sqrt({weighted(filters.KERNELS['sobel_x'])}**2 + {weighted(filters.KERNELS['sobel_y'])}**2)"
for _name, _of, _value in (("slopes", grains.mark_slopes, _SIZE), ("curvature", grains.mark_curvature, weighted(filters.KERNELS["laplace"]))):
    for _below in (False, True):
        register(
            f"mark_{_name}{'_below' if _below else ''}", cells(lambda f, of=_of, b=_below: of(f, 0.35, b).withColumn("z", F.col("m"))),
            f"with {PX}{_MIRROR3}, g as materialized (select r, c, {_value} v from o group by r, c), e as (select min(v) + 0.35 * (max(v) - min(v)) t from g) select {CELL}, {rounded('case when v ' + '><'[_below] + ' t then 1 else 0 end', 'z')} from g, e",
        )

# --- outlines of grains, curves

_CORNERS = "(select distinct g, c + unnest([0, 0, 1, 1]) x, r + unnest([0, 1, 0, 1]) y from gr)"
register("grain_outlines", on_grid(lambda f: hulls.outlines(numbered(f))))
register(
    "grain_widest", on_grid(lambda f: hulls.outlines(numbered(f)).select("field_id", "grain", "max_bound")),
    grain_sql(f"select cast(0 as bigint) as field_id, a.g as grain, {rounded('sqrt(max((a.x - b.x)**2 + (a.y - b.y)**2))', 'max_bound')} from {_CORNERS} a join {_CORNERS} b on b.g = a.g group by a.g"),
)
curve_query(
    "density_of_states", lines.density_of_states,
    f""", d as (select *, x - lag(x) over (partition by curve_id order by i) dx, y - lag(y) over (partition by curve_id order by i) dy from cv)
    select curve_id, row_number() over (partition by curve_id order by i) - 1 as i, {rounded('x', 'x')}, {rounded('abs(dy / dx * (x / y))', 'y')} from d where abs(dx) >= 1e-15 and abs(y) >= 1e-15""",
)
