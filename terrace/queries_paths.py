"""Registered queries of splines by arc length and of bands along them, in the manner of ``terrace.queries``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import splines
from terrace.queries import PX, register, rounded
from terrace.sources import tables


def orders_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path through the orders of each priority: days and thousands of the price."""
    return tables.curves(spark, sf_dir).select(F.col("curve_id").alias("path_id"), "i", "x", (F.col("y") / 1000).alias("y"))


def ring(spark: SparkSession, sf_dir: str, field: DataFrame) -> DataFrame:
    """A closed path around the field's middle with a point for each nation."""
    size = field.agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    angle = F.col("n_nationkey") * (2 * math.pi / 25)
    radius = F.least("w", "h") * (0.4 + 0.15 * F.sin(3 * angle))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").join(F.broadcast(size))  # one row
    return nations.select(F.lit(0).alias("path_id"), F.col("n_nationkey").alias("i"), (F.col("w") / 2 + radius * F.cos(angle)).alias("x"), (F.col("h") / 2 + radius * F.sin(angle)).alias("y"))


_ORDERS = """pt as (select o_orderpriority p, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) - 1 j, count(*) over (partition by o_orderpriority) n,
  datediff('day', date '1992-01-01', o_orderdate::date)::double x, o_totalprice / 1000 y from orders)"""
_RING = f"""{PX}, rg as (select n_nationkey j, w, h, n_nationkey * 2 * pi() / 25 g, least(w, h) * (0.4 + 0.15 * sin(3 * n_nationkey * 2 * pi() / 25)) d from nation, (select any_value(w) w, any_value(h) h from px)),
  pt as (select 0 p, j, count(*) over () n, w / 2 + d * cos(g) x, h / 2 + d * sin(g) y from rg)"""


def _velocity(c: str, t: str) -> str:
    return f"({c}1 + ({t}) * (2 * {c}2 + ({t}) * 3 * {c}3))"


def _speed(t: str) -> str:
    return f"sqrt({_velocity('x', t)} ** 2 + {_velocity('y', t)} ** 2)"


def _arc(stop: str) -> str:
    return "(" + " + ".join(f"{w!r} * {_speed(f'a + ({stop} - a) / 2 * {1 + x!r}')}" for x, w in zip(splines.NODES.tolist(), splines.WEIGHTS.tolist())) + f") * ({stop} - a) / 2"


def _pieces(slack: float, closed: bool) -> str:
    """``pc``: the cubics' pieces with their arc lengths, from the points ``pt``."""
    joins = " ".join(f"left join pt {k} on {k}.p = a.p and {k}.j = {f'(a.j + {d} + a.n) % a.n' if closed else f'a.j + {d}'}" for k, d in (("o", -1), ("q", 1), ("r", 2)))
    far = lambda a, b: f"sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2)"
    reach = lambda a, b: f"coalesce({a} / nullif({a} + {b}, 0), 0.5)"
    bend = ", ".join(f"{c} + {slack!r} * {reach('l', 'lp')} * (q{c} - o{c}) / 2 u{c}, q{c} - {slack!r} * {reach('l', 'ln')} * (r{c} - {c}) / 2 v{c}" for c in "xy")
    ends = ", ".join(
        f"coalesce(u{c}, ({2 - slack!r} * {c} + {slack!r} * v{c}) / 2, (2 * {c} + q{c}) / 3) u{c}, coalesce(v{c}, ({2 - slack!r} * q{c} + {slack!r} * u{c}) / 2, ({c} + 2 * q{c}) / 3) v{c}" for c in "xy"
    )
    powers = ", ".join(f"{c} {c}0, 3 * (u{c} - {c}) {c}1, 3 * ({c} - 2 * u{c} + v{c}) {c}2, q{c} - {c} + 3 * (u{c} - v{c}) {c}3" for c in "xy")
    return f""", nb as (select a.*, o.x ox, o.y oy, q.x qx, q.y qy, r.x rx, r.y ry, {far('a', 'o')} lp, {far('a', 'q')} l, {far('q', 'r')} ln from pt a {joins} where a.j < a.n - {0 if closed else 1}),
  bn as (select p, j, n, x, y, qx, qy, {bend} from nb), en as (select p, j, n, x, y, qx, qy, {ends} from bn), cu as (select p, j, n, {powers} from en),
  cp as (select *, k / 16 a, (k + 1) / 16 b from (select *, unnest(range(16)) k from cu)), pc as materialized (select *, {_arc('b')} l from cp)"""


def _samples(count: str, closed: bool) -> str:
    """``sm``: the samples ``i, x, y, tx, ty`` of each path."""
    steps = "".join(f", t{i + 1} as (select * exclude (t), least(greatest(t - coalesce(({_arc('t')} - g) / nullif({_speed('t')}, 0), 0), a), b) t from t{i})" for i in range(5))
    at = lambda c: f"{c}0 + t * ({c}1 + t * ({c}2 + t * {c}3)) {c}, {_velocity(c, 't')} v{c}"
    return f""", ru as (select *, coalesce(sum(l) over (partition by p order by j, k rows between unbounded preceding and 1 preceding), 0) s, sum(l) over (partition by p order by j, k rows unbounded preceding) e, row_number() over (partition by p order by j desc, k desc) = 1 z from pc),
  le as (select *, max(e) over (partition by p) t from ru), st as (select *, {count} m from le), sz as (select *, t / (m - {0 if closed else 1}) d from st),
  hi as (select *, unnest(range(cast(ceil(s / d) as bigint), cast(case when z then m else least(ceil(e / d), m) end as bigint))) i from sz),
  t0 as (select * exclude (t), least(greatest(i * d - s, 0), l) g, a + (b - a) * coalesce(least(greatest(i * d - s, 0), l) / nullif(l, 0), 0) t from hi){steps},
  sm as (select p, i, x, y, coalesce(vx / nullif(sqrt(vx * vx + vy * vy), 0), 0) tx, coalesce(vy / nullif(sqrt(vx * vx + vy * vy), 0), 0) ty from (select p, i, {at('x')}, {at('y')} from t5))"""


_SLACK = 1 / math.sqrt(2)
for _closed in (False, True):
    register(
        "spline_lengths_closed" if _closed else "spline_lengths", lambda spark, sf_dir, c=_closed: splines.lengths(orders_paths(spark, sf_dir), closed=c),
        f"with {_ORDERS}{_pieces(_SLACK, _closed)} select p as path_id, any_value(n) as n, {rounded('sum(l)', 'length')} from pc group by p",
    )
    register(
        "spline_samples_closed" if _closed else "spline_samples", lambda spark, sf_dir, c=_closed: splines.sample_uniformly(orders_paths(spark, sf_dir), 500, closed=c),
        f"with {_ORDERS}{_pieces(_SLACK, _closed)}{_samples('500', _closed)} select p as path_id, i as k, {', '.join(rounded(c, c) for c in ('x', 'y', 'tx', 'ty'))} from sm",
    )


def _straightened(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = tables.grid(spark, sf_dir)
    return splines.straighten(field, ring(spark, sf_dir, field), 7, closed=True)


_MIRRORED = "case when ({at}) % (2 * {n}) between 0 and {n} - 1 then ({at}) % (2 * {n}) else 2 * {n} - 1 - (({at}) + 2 * {n}) % (2 * {n}) end"
register(
    "field_straightened", _straightened,
    f"""with {_RING}{_pieces(_SLACK, True)}{_samples('floor(t + 1.5)', True)}, pl as (select i r, c, x + (c - 3) * ty x, y - (c - 3) * tx y from (select *, unnest(range(7)) c from sm)),
    ou as (select *, case when x < 0 or y < 0 or x > w or y > h then 1 else 0 end m, floor(x - 0.5) fx, floor(y - 0.5) fy from pl, (select any_value(w) w, any_value(h) h from px)),
    co as (select *, unnest([0, 0, 1, 1]) dx, unnest([0, 1, 0, 1]) dy from ou where m = 0),
    rd as (select *, case dx when 1 then x - 0.5 - fx else 1 - x + 0.5 + fx end * case dy when 1 then y - 0.5 - fy else 1 - y + 0.5 + fy end k, {_MIRRORED.format(at='fx + dx', n='w')} ix, {_MIRRORED.format(at='fy + dy', n='h')} iy from co),
    vl as (select a.r, a.c, sum(k * z) / sum(k) v from rd a join px b on b.r = iy and b.c = ix where k > 0 group by all)
    select cast(0 as bigint) as field_id, cast(ou.r as bigint) as "row", cast(ou.c as bigint) as col, {rounded('coalesce(v, (select avg(v) from vl))', 'z')}, {rounded('m', 'm')} from ou left join vl on vl.r = ou.r and vl.c = ou.c""",
)
