"""Registered queries of the array operators, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace import streaming
from terrace.functions.selection import Masking, Region
from terrace.operators import arithmetic, distributions, filters, geometry, grains, levelling, lines, points, spatial, statistics, tips, volume
from terrace.plans.durable import durable
from terrace.sources import synthetic, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DIGITS = 4


def near(value, digits: int):
    """``value`` to so many digits by plain double arithmetic, as ``rounded`` does in SQL; halves, which sums in another order may miss, go up."""
    return F.floor(value * float(10**digits) + 0.501) / float(10**digits)


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Whole numbers as longs and doubles rounded, so that results of different engines compare."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            out.append(near(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def register(name: str, query: Query, sql: str | None = None, digits: int = DIGITS) -> None:
    QUERIES[name] = lambda spark, sf_dir: tidy(query(spark, sf_dir), digits)
    if sql:
        ORACLE_SQL[name] = sql


def rounded(expression: str, name: str, digits: int = DIGITS) -> str:
    return f'floor(cast({expression} as double) * 1e{digits} + 0.501) / 1e{digits} as "{name}"'


def whole(expression: str, name: str) -> str:
    return f'cast({expression} as bigint) as "{name}"'


# The field of the tables as a SQL relation px(r, c, z, q, m, w, h).
PX = """px as materialized (
  select cast(k // w as bigint) r, cast(k % w as bigint) c, z, q, m, w, n // w as h from (
    select l_extendedprice z, l_quantity q, case when l_discount > 0.05 then 1.0 else 0.0 end::double m,
      row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 k, n, w
    from lineitem, (select n, case when 8 * d >= floor(sqrt(n)) then d else cast(round(sqrt(n)) as bigint) end w from
      (select n, (select max(d) from range(1, 100000) u(d) where d * d <= n and n % d = 0) d from (select count(*) n from lineitem))))
  where k < (n // w) * w)"""
CELL = 'cast(0 as bigint) as field_id, r as "row", c as col'


def pixels(expression: str, source: str = "px", where: str = "", extra: str = "", digits: int = DIGITS) -> str:
    return f"with {PX}{extra} select {CELL}, {rounded(expression, 'z', digits)} from {source} {where}"


def on_grid(of: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: of(tables.grid(spark, sf_dir))


def cells(of: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: of(tables.grid(spark, sf_dir)).select("field_id", "row", "col", "z")


def second(field: DataFrame) -> DataFrame:
    return field.select("field_id", "row", "col", F.col("q").alias("z"))


AREA = Region(5, 3, 20, 15)
INSIDE = "c between 5 and 24 and r between 3 and 17"

# --- summaries


def _summary_sql(where: str) -> str:
    parts = [
        "cast(0 as bigint) as field_id", "count(*) as n", rounded("min(z)", "min"), rounded("max(z)", "max"), rounded("sum(z)", "sum", 2),
        rounded("avg(z)", "mean"), rounded("avg(abs(z - mu))", "ra"), rounded("sqrt(avg((z - mu)**2))", "rms"),
        rounded("avg((z - mu)**3) / avg((z - mu)**2)**1.5", "skew"), rounded("avg((z - mu)**4) / avg((z - mu)**2)**2 - 3", "kurtosis"),
        rounded("list_sort(list(z))[count(*) // 2 + 1]", "median"),
    ]
    return f"with {PX}, s as (select * from px {where}), t as (select s.z, mu from s, (select avg(z) mu from s)) select {', '.join(parts)} from t"


def _summary(field: DataFrame, **how) -> DataFrame:
    return statistics.summary(field, **how).withColumn("sum", near(F.col("sum"), 2))


register("field_summary", on_grid(_summary), _summary_sql(""))
register("field_summary_masked", on_grid(lambda f: _summary(f, masking=Masking.INCLUDE)), _summary_sql("where m > 0"))
register("field_summary_unmasked", on_grid(lambda f: _summary(f, masking=Masking.EXCLUDE)), _summary_sql("where m < 1"))
register("field_summary_region", on_grid(lambda f: _summary(f, region=AREA)), _summary_sql(f"where {INSIDE}"))

for by, key, along in (("row", "r", "c"), ("col", "c", "r")):
    register(
        f"{by}_statistics",
        on_grid(lambda f, by=by: statistics.line_statistics(f, by)),
        f"""with {PX}, t as (select *, avg(z) over (partition by {key}) mu, avg({along}) over (partition by {key}) mt from px)
        select cast(0 as bigint) as field_id, {whole(key, by)}, count(*) as n, {rounded('avg(z)', 'mean')}, {rounded('min(z)', 'min')}, {rounded('max(z)', 'max')},
          {rounded('max(z) - min(z)', 'range')}, {rounded('avg(abs(z - mu))', 'ra')}, {rounded('sqrt(avg((z - mu)**2))', 'rms')},
          {rounded('avg((z - mu)**3) / avg((z - mu)**2)**1.5', 'skew')}, {rounded('avg((z - mu)**4) / avg((z - mu)**2)**2 - 3', 'kurtosis')},
          {rounded(f'sum(({along} - mt) * (z - mu)) / sum(({along} - mt)**2)', 'slope')}, {rounded('list_sort(list(z))[count(*) // 2 + 1]', 'median')}
        from t group by {key}""",
    )
register(
    "count_in_range", on_grid(lambda f: statistics.count_in_range(f, 20000.0, 80000.0)),
    f"with {PX} select cast(0 as bigint) as field_id, count(*) filter (z < 20000) as n_below, count(*) filter (z > 80000) as n_above from px",
)
register(
    "volume_above", on_grid(lambda f: statistics.volume_above(f, 1000.0)),
    f"with {PX} select cast(0 as bigint) as field_id, {rounded('sum(z - 1000)', 'volume', 2)} from px", digits=2,
)
register(
    "outliers", cells(lambda f: statistics.outliers(f, 1.5).withColumn("z", F.col("m"))),
    pixels("case when abs(z - mu) > 1.5 * sd then 1 else 0 end", "px, (select avg(z) mu, stddev_pop(z) sd from px)"),
)

AROUND = """, nb as (select a.r, a.c, a.z, b.z as rt, d.z as bl, e.z as dg from px a
  left join px b on b.r = a.r and b.c = a.c + 1 left join px d on d.r = a.r + 1 and d.c = a.c left join px e on e.r = a.r + 1 and e.c = a.c + 1)"""


_GX, _GY = "(((rt - z) + (dg - bl)) / 2)", "(((bl - z) + (dg - rt)) / 2)"
register(
    "surface_area",
    on_grid(statistics.surface),
    f"""with {PX}{AROUND} select cast(0 as bigint) as field_id,
      {rounded('sum(sqrt(0.25 + ((rt - z) / 2)**2 + ((z + rt + bl + dg) / 4 - (z + rt) / 2)**2) / 2 + sqrt(0.25 + ((dg - bl) / 2)**2 + ((z + rt + bl + dg) / 4 - (bl + dg) / 2)**2) / 2 + sqrt(0.25 + ((bl - z) / 2)**2 + ((z + rt + bl + dg) / 4 - (z + bl) / 2)**2) / 2 + sqrt(0.25 + ((dg - rt) / 2)**2 + ((z + rt + bl + dg) / 4 - (rt + dg) / 2)**2) / 2)', 'surface_area', 2)},
      {rounded('count(*)', 'projected_area', 2)}, {rounded(f'sum(sqrt({_GX}**2 + {_GY}**2))', 'variation', 2)} from nb where dg is not null""",
    digits=2,
)
register(
    "inclination",
    on_grid(statistics.inclination),
    f"""with {PX}{AROUND}, s as (select avg({_GX}) gx, avg({_GY}) gy from nb where dg is not null)
    select cast(0 as bigint) as field_id, {rounded('gx', 'slope_x')}, {rounded('gy', 'slope_y')}, {rounded('atan(sqrt(gx*gx + gy*gy))', 'theta')}, {rounded('atan2(gy, gx)', 'phi')} from s""",
)

# --- arithmetic

_ARITHMETIC = {"sum": "z + q", "subtract": "z - q", "multiply": "z * q", "divide": "z / q", "min": "least(z, q)", "max": "greatest(z, q)", "hypot": "sqrt(z*z + q*q)"}
for how, sql in _ARITHMETIC.items():
    register(f"fields_{how}", cells(lambda f, how=how: arithmetic.combine(f, second(f), how)), pixels(sql))
register(
    "field_expression", cells(lambda f: arithmetic.evaluate({"d1": f, "d2": second(f)}, "sqrt(abs(d1 - 100 * d2)) + x - 2 * y + if(d1 > d2, ln(d1), 0)")),
    pixels("sqrt(abs(z - 100 * q)) + c - 2 * r + case when z > q then ln(z) else 0 end"),
)
register("add_constant", cells(lambda f: arithmetic.add(f, 10.5)), pixels("z + 10.5"))
register("multiply_region", cells(lambda f: arithmetic.multiply(f, 2.0, AREA)), pixels(f"case when {INSIDE} then z * 2 else z end"))
register("fill_masked", cells(lambda f: arithmetic.fill(f, 7.0, masking=Masking.INCLUDE)), pixels("case when m > 0 then 7 else z end"))
register("clear_region", cells(lambda f: arithmetic.fill(f, region=AREA)), pixels(f"case when {INSIDE} then 0 else z end"))
register(
    "fill_ellipse", cells(lambda f: arithmetic.fill_ellipse(f, AREA, -1.0)),
    pixels(f"case when {INSIDE} and ((c - 5 + 0.5) * 0.1::double - 1)**2 + ((r - 3 + 0.5) * (2.0::double / 15) - 1)**2 <= 1 then -1 else z end"),
)
register("clamp", cells(lambda f: arithmetic.clamp(f, 5000.0, 60000.0)), pixels("least(greatest(z, 5000), 60000)"))
register("threshold", cells(lambda f: arithmetic.threshold(f, 30000.0)), pixels("case when z < 30000 then 0 else 1 end"))
register("renormalize", cells(lambda f: arithmetic.renormalize(f, 100.0, -50.0)), pixels("(z - lo) / (hi - lo) * 100 - 50", "px, (select min(z) lo, max(z) hi from px)"))
register("invert_values", cells(arithmetic.invert_values), pixels("2 * mu - z", "px, (select avg(z) mu from px)"))

# --- geometry


def moved(row: str, col: str, where: str = "", z: str = "z") -> str:
    return f"with {PX} select cast(0 as bigint) as field_id, {whole(row, 'row')}, {whole(col, 'col')}, {rounded(z, 'z')} from px {where}"


register("crop", cells(lambda f: geometry.crop(f, AREA)), moved("r - 3", "c - 5", f"where {INSIDE}"))
register("flip_rows", cells(lambda f: geometry.flip(f, rows=True)), moved("h - 1 - r", "c"))
register("flip_columns", cells(lambda f: geometry.flip(f, columns=True)), moved("r", "w - 1 - c"))
register("quarter_turn", cells(geometry.quarter_turn), moved("c", "h - 1 - r"))
register("quarter_turn_back", cells(lambda f: geometry.quarter_turn(f, False)), moved("w - 1 - c", "r"))
register(
    "paste", cells(lambda f: geometry.paste(f, geometry.crop(f, AREA), 30, 2)),
    f"with {PX} select cast(0 as bigint) as field_id, a.r as \"row\", a.c as col, {rounded('coalesce(b.z, a.z)', 'z')} from px a left join (select r - 3 + 2 as r, c - 5 + 30 as c, z from px where {INSIDE}) b on a.r = b.r and a.c = b.c",
)
_SOURCE = {
    "edge": "least(greatest({i}, 0), {n} - 1)",
    "mirror": "case when {i} < 0 then -{i} - 1 when {i} >= {n} then 2 * {n} - 1 - {i} else {i} end",
    "periodic": "({i} + {n}) % {n}",
    "fixed": "{i}",
}
for exterior, index in _SOURCE.items():
    register(
        f"extend_{exterior}",
        cells(lambda f, e=exterior: geometry.extend(f, 3, 2, 1, 4, e, 5.0)),
        f"""with {PX}, size as (select max(w) w, max(h) h from px), spots as (select i.i, j.j, w, h from size, unnest(range(-1, h + 4)) i(i), unnest(range(-3, w + 2)) j(j))
        select cast(0 as bigint) as field_id, {whole('i + 1', 'row')}, {whole('j + 3', 'col')}, {rounded('coalesce(z, 5)', 'z')}
        from spots left join px on px.r = {index.format(i='i', n='spots.h')} and px.c = {index.format(i='j', n='spots.w')}""",
    )
register(
    "resample_linear",
    cells(lambda f: geometry.resample(f, 40, 30)),
    f"""with {PX}, size as (select max(w) w, max(h) h from px),
    spots as (select i.i, j.j, least(greatest((i + 0.5) * h / 30 - 0.5, 0), h - 1)::double y, least(greatest((j + 0.5) * w / 40 - 0.5, 0), w - 1)::double x from size, unnest(range(30)) i(i), unnest(range(40)) j(j))
    select cast(0 as bigint) as field_id, {whole('i', 'row')}, {whole('j', 'col')}, {rounded('sum(z * (1 - abs(r - y)) * (1 - abs(c - x)))', 'z')}
    from spots join px on r in (floor(y), floor(y) + 1) and c in (floor(x), floor(x) + 1) group by i, j""",
)
register(
    "profile",
    on_grid(lambda f: geometry.profile(f, (2.5, 1.25), (40.0, 30.5), 25)),
    f"""with {PX}, spots as (select i, 2.5 + i / 24.0::double * 37.5 x, 1.25 + i / 24.0::double * 29.25 y from unnest(range(25)) t(i))
    select cast(0 as bigint) as field_id, {whole('i', 'i')}, {rounded('sum(z * (1 - abs(r - y)) * (1 - abs(c - x)))', 'z')}
    from spots join px on r in (floor(y), floor(y) + 1) and c in (floor(x), floor(x) + 1) group by i""",
)

# --- distributions

BINNED = """, e as (select min(z) lo, max(z) hi, count(*) n, greatest(cast(floor({f} * cbrt(count(*)) + 0.5) as bigint), 2) b from px),
  hb as (select least(cast(floor((z - lo) / (hi - lo) * b) as bigint), b - 1) bin, lo, hi, b, n as total, count(*) k from px, e group by all)"""
HIST = BINNED.format(f=3.49)
register(
    "height_histogram", on_grid(distributions.histogram),
    f"""with {PX}{HIST} select cast(0 as bigint) as field_id, {whole('bin', 'bin')}, {rounded('lo + (bin + 0.5) * (hi - lo) / b', 'x', 7)}, k as n, {rounded('k / (total * (hi - lo) / b)', 'density', 7)} from hb""", digits=7,
)
register(
    "height_cumulative", on_grid(distributions.cumulative),
    f"with {PX}{HIST} select cast(0 as bigint) as field_id, {whole('bin', 'bin')}, {rounded('lo + (bin + 0.5) * (hi - lo) / b', 'x')}, {rounded('sum(k) over (order by bin) / total', 'share')} from hb",
)
register(
    "slope_histogram", on_grid(lambda f: distributions.histogram(distributions.slopes(f), 50)),
    f"""with {PX}{AROUND}, d as (select rt - z as g from nb where rt is not null), e as (select min(g) lo, max(g) hi, count(*) total from d)
    select cast(0 as bigint) as field_id, {whole('least(floor((g - lo) / (hi - lo) * 50), 49)', 'bin')}, {rounded('lo + (least(floor((g - lo) / (hi - lo) * 50), 49) + 0.5) * (hi - lo) / 50', 'x')}, count(*) as n,
      {rounded('count(*) / (total * (hi - lo) / 50)', 'density')} from d, e group by least(floor((g - lo) / (hi - lo) * 50), 49), lo, hi, total""",
)
register(
    "slope_directions", on_grid(distributions.slope_directions),
    f"""with {PX}{AROUND}, g as (select {_GX} gx, {_GY} gy from nb where dg is not null), b as (select cast(floor(atan2(gy, gx) / (2 * pi()) * 36) as bigint) b, sqrt(gx*gx + gy*gy) s from g)
    select cast(0 as bigint) as field_id, {whole('((b % 36) + 36) % 36', 'bin')}, count(*) as n, {rounded('sum(s)', 'weight', 2)} from b group by ((b % 36) + 36) % 36""", digits=2,
)
register("entropy", on_grid(distributions.entropy), f"with {PX}{HIST} select cast(0 as bigint) as field_id, {rounded('sum(-(k / total) * ln(k / total))', 'entropy')} from hb")
register(
    "otsu", on_grid(distributions.otsu),
    f"""with {PX}{BINNED.format(f=7.49)}, s as (select *, sum(k) over (order by bin) w1, sum(k * (bin + 0.5)) over (order by bin) s1, sum(k) over () wa, sum(k * (bin + 0.5)) over () sa from hb),
    v as (select bin, lo, hi, b, round(coalesce(w1 * (wa - w1) * (s1 / w1 - (sa - s1) / nullif(wa - w1, 0))**2 / (wa * wa), 0)::double, 9) v from s)
    select cast(0 as bigint) as field_id, {rounded('lo + (bin + 1) * (hi - lo) / b', 'threshold')} from v order by v desc, bin limit 1""",
)
register(
    "minkowski", on_grid(lambda f: distributions.minkowski(f, 12)),
    f"""with {PX}, e as (select min(z) lo, max(z) hi, count(*) n from px), lv as (select r, c, cast(floor((z - lo) / (hi - lo) * 11) as bigint) v, n from px, e),
    nb as (select a.v, b.v as vr, d.v as vb, f.v as vd, a.n from lv a left join lv b on b.r = a.r and b.c = a.c + 1 left join lv d on d.r = a.r + 1 and d.c = a.c left join lv f on f.r = a.r + 1 and f.c = a.c + 1),
    t as (select unnest(range(12)) t), per as (select t, n, count(*) filter (v >= t) px1, count(*) filter (vr is not null and least(v, vr) >= t) + count(*) filter (vb is not null and least(v, vb) >= t) pairs,
      count(*) filter (vr is not null and greatest(v, vr) >= t) + count(*) filter (vb is not null and greatest(v, vb) >= t) touched, count(vr) + count(vb) as every, count(*) filter (vd is not null and least(v, vr, vb, vd) >= t) sq from nb, t group by t, n)
    select cast(0 as bigint) as field_id, {whole('t', 'level')}, {rounded('px1 / n', 'volume', 9)}, {rounded('(touched - pairs) / every', 'boundary', 9)}, {rounded('(px1 - pairs + sq) / n', 'euler', 9)} from per""", digits=9,
)

# --- filters


def window(expression: str, size: int, digits: int = DIGITS) -> str:
    low, high = -((size - 1) // 2), size // 2
    return f"""with {PX} select cast(0 as bigint) as field_id, a.r as "row", a.c as col, {rounded(expression, 'z', digits)}
    from px a join px b on b.r between a.r + {low} and a.r + {high} and b.c between a.c + {low} and a.c + {high} group by a.r, a.c, a.z"""


def fast_window(steps: list[str], size: int) -> str:
    """Separable windows, ``min`` or ``max`` in turn."""
    frame = f"rows between {(size - 1) // 2} preceding and {size // 2} following"
    ctes, last = "", "px"
    for i, f in enumerate(steps):
        ctes += f", h{i} as (select r, c, {f}(z) over (partition by r order by c {frame}) z from {last}), v{i} as (select r, c, {f}(z) over (partition by c order by r {frame}) z from h{i})"
        last = f"v{i}"
    return pixels("z", last, extra=ctes)


_IN3 = """, s1 as (select r, c, z, unnest([-1, 0, 1]) dr from px), s2 as (select r, c, z, dr, unnest([-1, 0, 1]) dc from s1), o as (select s2.r, s2.c, s2.z, b.z as bz from s2 join px b on b.r = s2.r + dr and b.c = s2.c + dc)"""
_MIRROR3 = """, s1 as (select r, c, z, w, h, unnest([-1, 0, 1]) dr from px), s2 as (select *, unnest([-1, 0, 1]) dc from s1),
  o as (select s2.r, s2.c, s2.z, dr, dc, b.z as bz from s2 join px b on b.r = least(greatest(s2.r + dr, 0), s2.h - 1) and b.c = least(greatest(s2.c + dc, 0), s2.w - 1))"""


def in3(expression: str, digits: int = DIGITS) -> str:
    return f'with {PX}{_IN3} select cast(0 as bigint) as field_id, r as "row", c as col, {rounded(expression, "z", digits)} from o group by r, c, z'


def weighted(kernel: tuple) -> str:
    return "sum(bz * case " + " ".join(f"when dr = {i // 3 - 1} and dc = {i % 3 - 1} then {k}" for i, k in enumerate(kernel)) + " end)"


def convolved(expression: str) -> str:
    return f'with {PX}{_MIRROR3} select cast(0 as bigint) as field_id, r as "row", c as col, {rounded(expression, "z")} from o group by r, c'


register("filter_mean", cells(lambda f: filters.mean(f, 3)), in3("avg(bz)"))
register("filter_rms", cells(lambda f: filters.local_rms(f, 3)), in3("stddev_pop(bz)", 3), digits=3)
register("filter_minimum", cells(lambda f: filters.minimum(f, 4)), fast_window(["min"], 4))
register("filter_maximum", cells(lambda f: filters.maximum(f, 5)), fast_window(["max"], 5))
register("filter_opening", cells(lambda f: filters.opening(f, 3)), fast_window(["min", "max"], 3))
register("filter_closing", cells(lambda f: filters.closing(f, 3)), fast_window(["max", "min"], 3))
register("filter_range", cells(lambda f: filters.local_range(f, 3)), in3("max(bz) - min(bz)"))
register("filter_median", cells(lambda f: filters.median(f, 3)), in3("list_sort(list(bz))[count(*) // 2 + 1]"))
register("filter_rank", cells(lambda f: filters.rank(f, 3)), in3("(count(*) filter (bz < z) + count(*) filter (bz <= z)) / (2 * count(*))"))
register(
    "filter_trimmed_mean", cells(lambda f: filters.trimmed_mean(f, 3, 2)),
    in3("case when count(*) > 4 then list_avg(list_sort(list(bz))[3:count(*) - 2]) else avg(bz) end"),
)
register("filter_conservative", cells(filters.conservative), in3(
    "least(greatest(z, case when z = min(bz) then list_sort(list(bz))[2] else min(bz) end), case when z = max(bz) then list_sort(list(bz))[count(*) - 1] else max(bz) end)"
))
for kernel, values in filters.KERNELS.items():
    register(f"filter_{kernel}", cells(lambda f, k=kernel: filters.kernel3(f, k)), convolved(weighted(values)))
register("filter_gradient", cells(filters.gradient), convolved(f"sqrt({weighted(filters.KERNELS['sobel_x'])}**2 + {weighted(filters.KERNELS['sobel_y'])}**2)"))
_BELL9 = "gw as (select k, exp(-k * k / 2.0) / sum(exp(-k * k / 2.0)) over () g from range(-4, 5) t(k))"
_MIRRORED = "case when {0} < 0 then -1 - ({0}) when {0} >= {1} then 2 * {1} - 1 - ({0}) else {0} end"
register(
    "filter_gaussian", cells(lambda f: filters.gaussian(f, 1.0)),
    f"""with {PX}, {_BELL9}, s1 as (select r, c, w, h, g, {_MIRRORED.format('c + k', 'w')} o from px, gw), a1 as materialized (select s1.r, s1.c, any_value(s1.w) w, any_value(s1.h) h, sum(g * px.z) z from s1 join px on px.r = s1.r and px.c = o group by 1, 2),
    s2 as (select r, c, g, {_MIRRORED.format('r + k', 'h')} o from a1, gw) select {CELL.replace('r as', 's2.r as').replace('c as', 's2.c as')}, {rounded('sum(g * a1.z)', 'z', 3)} from s2 join a1 on a1.r = o and a1.c = s2.c group by s2.r, s2.c""", digits=3,
)
for direction, part, order in (("x", "r", "c"), ("y", "c", "r")):
    over = f"over (partition by {part} order by {order})"
    register(
        f"derivative_{direction}", cells(lambda f, d=direction: filters.derivative(f, d)),
        f'with {PX} select {CELL}, {rounded(f"(coalesce(lead(z) {over}, z) - coalesce(lag(z) {over}, z)) / (case when lag(z) {over} is null then 0 else 1 end + case when lead(z) {over} is null then 0 else 1 end)", "z")} from px',
    )
register(
    "tip_dilation", cells(lambda f: tips.dilate(f, tips.paraboloid(3, 5000.0))),
    convolved("max(bz - 5000.0::double * (dr * dr + dc * dc) / 2)"),
)
register("tip_erosion", cells(lambda f: tips.erode(f, tips.cone(3, 5000.0))), convolved("min(bz + 5000.0::double * sqrt(dr * dr + dc * dc))"))

# --- levelling

PLANE = """, mu as (select avg(c) mx, avg(r) my, avg(z) mz from px {where}),
  s as (select sum((c - mx)**2) xx, sum((c - mx) * (r - my)) xy, sum((r - my)**2) yy, sum((c - mx) * (z - mz)) xz, sum((r - my) * (z - mz)) yz, any_value(mx) mx, any_value(my) my, any_value(mz) mz from px, mu {where}),
  f as (select (xz * yy - yz * xy) / (xx * yy - xy * xy) bx, (yz * xx - xz * xy) / (xx * yy - xy * xy) as "by", mx, my, mz from s)"""
ALL = PLANE.format(where="")
register(
    "plane_coefficients", on_grid(levelling.plane_coefficients),
    f'with {PX}{ALL} select cast(0 as bigint) as field_id, {rounded("mz - bx * mx - " + chr(34) + "by" + chr(34) + " * my", "a")}, {rounded("bx", "bx")}, {rounded(chr(34) + "by" + chr(34), "by")} from f',
)
register("level_plane", cells(levelling.level_plane), pixels('z - mz - bx * (c - mx) - "by" * (r - my)', "px, f", extra=ALL))
register(
    "level_plane_masked", cells(lambda f: levelling.level_plane(f, Masking.EXCLUDE)),
    pixels('z - mz - bx * (c - mx) - "by" * (r - my)', "px, f", extra=PLANE.format(where="where m < 1")),
)
register("level_polynomial_1", cells(lambda f: levelling.level_polynomial(f, 1)), pixels('z - mz - bx * (c - mx) - "by" * (r - my)', "px, f", extra=ALL))
register("level_polynomial_3", cells(lambda f: levelling.level_polynomial(f, 3)))
register("zero_mean", cells(levelling.zero_mean), pixels("z - mu", "px, (select avg(z) mu from px)"))
register("fix_zero", cells(levelling.fix_zero), pixels("z - lo", "px, (select min(z) lo from px)"))
for method, sql in {"mean": "avg(z)", "median": "list_sort(list(z))[count(*) // 2 + 1]", "midrange": "(min(z) + max(z)) / 2"}.items():
    register(
        f"align_rows_{method}", cells(lambda f, m=method: levelling.align_rows(f, m)),
        f'with {PX}, s as (select r, {sql} v from px group by r) select cast(0 as bigint) as field_id, px.r as "row", c as col, {rounded("z - v + (select avg(v) from s)", "z")} from px join s on s.r = px.r',
    )
register(
    "align_rows_differences", cells(lambda f: levelling.align_rows(f, "differences")),
    f"""with {PX}, d as (select a.r, list_sort(list(a.z - b.z))[count(*) // 2 + 1] v from px a join px b on b.r = a.r - 1 and b.c = a.c group by a.r),
    s as (select t.r, coalesce(sum(v) over (order by t.r), 0) v from (select distinct r from px) t left join d on d.r = t.r)
    select cast(0 as bigint) as field_id, px.r as "row", c as col, {rounded('z - v + (select avg(v) from s)', 'z')} from px join s on s.r = px.r""",
)
register(
    "level_rows", cells(levelling.level_rows),
    f"""with {PX}, t as (select *, avg(z) over (partition by r) mz, avg(c) over (partition by r) mc from px), b as (select r, sum((c - mc) * (z - mz)) / sum((c - mc)**2) b from t group by r)
    select cast(0 as bigint) as field_id, t.r as "row", c as col, {rounded('z - mz - b * (c - mc)', 'z')} from t join b on b.r = t.r""",
)
register(
    "scars", cells(lambda f: levelling.scars(f, 0.5).withColumn("z", F.col("m"))),
    f"""with {PX}, t as materialized (select *, lag(z) over w1 a, lead(z) over w1 b from px window w1 as (partition by c order by r)), g as materialized (select sqrt(avg((z - a)**2)) s from t)
    select {CELL}, {rounded('case when a is null or b is null then 0 when z - greatest(a, b) > 0.5 * s or least(a, b) - z > 0.5 * s then 1 else 0 end', 'z')} from t, g""",
)
register(
    "interpolate_masked", cells(levelling.interpolate_masked),
    f"""with {PX}, t as (select *, last_value(case when m <= 0 then c end ignore nulls) over w1 lc, last_value(case when m <= 0 then z end ignore nulls) over w1 lz,
      first_value(case when m <= 0 then c end ignore nulls) over w2 rc, first_value(case when m <= 0 then z end ignore nulls) over w2 rz from px
      window w1 as (partition by r order by c rows between unbounded preceding and current row), w2 as (partition by r order by c rows between current row and unbounded following))
    select {CELL}, {rounded('case when m <= 0 then z else coalesce(lz + (rz - lz) * (c - lc) / (rc - lc), lz, rz, z) end', 'z')} from t""",
)

# --- spatial statistics

_LAGS = ", lg as (select unnest(range(13)) k)"
register(
    "autocorrelation", on_grid(lambda f: spatial.autocorrelation(f, 12)),
    f"""with {PX}{_LAGS}, t as (select r, c, z - avg(z) over (partition by r) d from px) select cast(0 as bigint) as field_id, {whole('k', 'lag')}, {rounded('avg(a.d * b.d)', 'acf', 1)}
    from lg join t a on true join t b on b.r = a.r and b.c = a.c + k group by k""", digits=1,
)
register(
    "height_difference", on_grid(lambda f: spatial.height_difference(f, 12)),
    f"""with {PX}{_LAGS} select cast(0 as bigint) as field_id, {whole('k', 'lag')}, {rounded('avg((a.z - b.z)**2)', 'hhcf', 1)} from lg join px a on true join px b on b.r = a.r and b.c = a.c + k group by k""", digits=1,
)
register(
    "haar_level", on_grid(spatial.haar_level),
    f"""with {PX}, s as (select r // 2 r2, c // 2 c2, max(z) filter (r % 2 = 0 and c % 2 = 0) a, max(z) filter (r % 2 = 0 and c % 2 = 1) b, max(z) filter (r % 2 = 1 and c % 2 = 0) g, max(z) filter (r % 2 = 1 and c % 2 = 1) d from px group by all)
    select cast(0 as bigint) as field_id, {whole('r2', 'row')}, {whole('c2', 'col')}, {rounded('(a + b + g + d) / 2', 'll')}, {rounded('(a - b + g - d) / 2', 'hl')}, {rounded('(a + b - g - d) / 2', 'lh')}, {rounded('(a - b - g + d) / 2', 'hh')} from s where d is not null""",
)
register("field_correlation", on_grid(lambda f: spatial.correlation(f, second(f))), f"with {PX} select cast(0 as bigint) as field_id, {rounded('corr(z, q)', 'score')} from px")
register(
    "box_counting", on_grid(spatial.box_counting),
    f"""with {PX}, sz as (select s from (select 2**unnest(range(1, 20)) s), (select max(greatest(r, c)) big from px) where s <= greatest(2, 2**(length(bin(big + 1)) - 2)))
    select cast(0 as bigint) as field_id, {whole('s', 'size')}, {rounded('sum(x) / s', 'ranges', 2)} from (select s, max(z) - min(z) x from px, sz group by s, floor(r / s), floor(c / s)) group by s""", digits=2,
)
register("row_transform_round_trip", cells(lambda f: spatial.row_transform(spatial.row_transform(f), inverse=True)), pixels("z"))

# --- lines

LN = "ln as materialized (select user_id as line_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as y from events)"
_O = "over (partition by line_id order by i)"


def line_query(name: str, of: Callable[[DataFrame], DataFrame], sql: str | None, digits: int = DIGITS) -> None:
    register(f"line_{name}", lambda spark, sf_dir: of(tables.lines(spark, sf_dir)), sql and f"with {LN} {sql}", digits)


line_query(
    "statistics", lines.statistics,
    f""", t as (select *, y - avg(y) over (partition by line_id) d, sqrt(1 + (y - lag(y) {_O})**2) s from ln)
    select line_id, count(*) as n, {rounded('avg(y)', 'mean')}, {rounded('min(y)', 'min')}, {rounded('max(y)', 'max')}, {rounded('avg(abs(d))', 'ra')}, {rounded('sqrt(avg(d*d))', 'rq')}, {rounded('max(y) - min(y)', 'rt')},
      {rounded('max(d)', 'rp')}, {rounded('max(-d)', 'rv')}, {rounded('coalesce(sum(d**3) * sqrt(count(*) + 1) / nullif(sum(d*d), 0)**1.5, 0)', 'skew')}, {rounded('coalesce(sum(d**4) * (count(*) + 1) / nullif(sum(d*d), 0)**2 - 3, 0)', 'kurtosis')},
      {rounded('coalesce(sum(s), 0)', 'length')} from t group by line_id""",
)
line_query("cumulate", lines.cumulate, f"select line_id, {whole('i', 'i')}, {rounded(f'sum(y) {_O}', 'y')} from ln")
line_query(
    "derivative", lines.derivative,
    f"select line_id, {whole('i', 'i')}, {rounded(f'coalesce((coalesce(lead(y) {_O}, y) - coalesce(lag(y) {_O}, y)) / nullif(case when lag(y) {_O} is null then 0 else 1 end + case when lead(y) {_O} is null then 0 else 1 end, 0), 0)', 'y')} from ln",
)
line_query("moving_average", lines.moving_average, f"select line_id, {whole('i', 'i')}, {rounded('avg(y) over (partition by line_id order by i rows between 5 preceding and 5 following)', 'y')} from ln")
line_query(
    "level", lines.level,
    f", t as (select *, i - avg(i) over (partition by line_id) t, avg(y) over (partition by line_id) m from ln) select line_id, {whole('i', 'i')}, {rounded('y - m - coalesce(sum(t * (y - m)) over (partition by line_id) / nullif(sum(t * t) over (partition by line_id), 0), 0) * t', 'y')} from t",
)
line_query("reverse", lines.reverse, f"select line_id, {whole('max(i) over (partition by line_id) - i', 'i')}, {rounded('y', 'y')} from ln")
line_query(
    "resample", lambda d: lines.resample(d, 32),
    f""", sz as (select line_id, count(*) n from ln group by 1), spots as (select line_id, t, least(greatest((t + 0.5) * n / 32 - 0.5, 0), n - 1)::double x from sz, unnest(range(32)) u(t))
    select spots.line_id, {whole('t', 'i')}, {rounded('sum(y * (1 - abs(i - x)))', 'y')} from spots join ln on ln.line_id = spots.line_id and i in (floor(x), floor(x) + 1) group by spots.line_id, t""",
)
line_query(
    "peaks", lambda d: lines.peaks(d, 5),
    f", t as (select *, lag(y) {_O} b, lead(y) {_O} a from ln), p as (select line_id, row_number() over (partition by line_id order by y desc, i) k, i, y from t where y > b and y > a) select line_id, {whole('k', 'rank')}, {whole('i', 'i')}, {rounded('y', 'y')} from p where k <= 5",
)
line_query(
    "crossings", lines.crossings,
    f", t as (select line_id, i, y > avg(y) over (partition by line_id) h from ln), c as (select line_id, h <> lag(h) {_O} c from t) select line_id, count(*) filter (c) as crossings from c group by line_id",
)
line_query(
    "block_ranges", lines.hurst_ranges,
    f", b as (select line_id, s, i // s, max(y) - min(y) x from ln, (values (4), (8), (16)) t(s) group by line_id, s, i // s having count(*) = s) select line_id, {whole('s', 'size')}, {rounded('avg(x)', 'range')} from b group by line_id, s",
)

CV = "cv as materialized (select o_orderpriority as curve_id, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) - 1 as i, date_diff('day', date '1992-01-01', cast(o_orderdate as date))::double as x, o_totalprice as y from orders)"


def curve_query(name: str, of: Callable[[DataFrame], DataFrame], sql: str, digits: int = DIGITS) -> None:
    register(f"curve_{name}", lambda spark, sf_dir: of(tables.curves(spark, sf_dir)), f"with {CV} {sql}", digits)


curve_query(
    "fit", lines.fit_straight,
    f"select curve_id, count(*) as n, {rounded('regr_slope(y, x)', 'slope')}, {rounded('regr_intercept(y, x)', 'intercept')}, {rounded('regr_r2(y, x)', 'r2')} from cv group by curve_id",
)
curve_query("cut", lambda d: lines.cut(d, 1500.0, 2300.0), f"select curve_id, row_number() over (partition by curve_id order by i) - 1 as i, {rounded('x', 'x')}, {rounded('y', 'y')} from cv where x between 1500 and 2300")
curve_query("merge", lines.merge_equal, f"select curve_id, {rounded('x', 'x')}, {rounded('avg(y)', 'y')}, count(*) as n from cv group by curve_id, x")
curve_query("smooth", lines.smooth, f"select curve_id, i, {rounded('x', 'x')}, {rounded('avg(y) over (partition by curve_id order by i rows between 5 preceding and 5 following)', 'y')} from cv")
curve_query(
    "area", lines.area_under,
    f", t as (select curve_id, (x - lag(x) over w) * (y + lag(y) over w) / 2 s from cv window w as (partition by curve_id order by x, i)) select curve_id, {rounded('coalesce(sum(s), 0)', 'area', 2)} from t group by curve_id",
    digits=2,
)

# --- volumes

VX = "vx as materialized (select cast(vec_id // 25 as bigint) r, cast(vec_id % 25 as bigint) c, unnest(range(len(embedding))) l, cast(unnest(embedding) as double) w from embeddings)"


def brick_query(name: str, of: Callable[[DataFrame], DataFrame], sql: str | None, digits: int = DIGITS) -> None:
    register(f"brick_{name}", lambda spark, sf_dir: of(tables.brick(spark, sf_dir)), sql and f"with {VX} {sql}", digits)


PLANE_CELL = 'select cast(0 as bigint) as brick_id, r as "row", c as col'
_REDUCE = {
    "min": "min(w)", "max": "max(w)", "sum": "sum(w)", "mean": "avg(w)", "rms": "stddev_pop(w)", "range": "max(w) - min(w)",
    "minpos": "arg_min(l, (w, l))", "maxpos": "arg_max(l, (w, -l))",
}
for how, sql in _REDUCE.items():
    brick_query(f"plane_{how}", lambda b, how=how: volume.reduce_along(b, "lev", how), f"{PLANE_CELL}, {rounded(sql, 'z')} from vx group by r, c")
brick_query("slice", lambda b: volume.slice_at(b, "lev", 7), f"{PLANE_CELL}, {rounded('w', 'z')} from vx where l = 7")
brick_query("profile", lambda b: volume.profile_at(b, 3, 4), f"select cast(0 as bigint) as line_id, {whole('l', 'i')}, {rounded('w', 'y')} from vx where r = 3 and c = 4")
brick_query("levels", volume.level_summary, f"select cast(0 as bigint) as brick_id, {whole('l', 'lev')}, {rounded('avg(w)', 'mean')}, {rounded('stddev_pop(w)', 'rms')}, {rounded('min(w)', 'min')}, {rounded('max(w)', 'max')} from vx group by l")
_VOXEL = f"select cast(0 as bigint) as brick_id, {whole('l', 'lev')}, r as \"row\", c as col"
brick_query("flip", lambda b: volume.flip(b, "lev").select("brick_id", "lev", "row", "col", "w"), f"select cast(0 as bigint) as brick_id, {whole('max(l) over () - l', 'lev')}, r as \"row\", c as col, {rounded('w', 'w')} from vx")
brick_query("transpose", lambda b: volume.transpose(b, ("row", "col", "lev")), f"select cast(0 as bigint) as brick_id, r as lev, c as \"row\", {whole('l', 'col')}, {rounded('w', 'w')} from vx")
brick_query("level_profiles", lambda b: volume.level_profiles(b).select("brick_id", "lev", "row", "col", "w"), f"{_VOXEL}, {rounded('w - avg(w) over (partition by r, c)', 'w')} from vx")
brick_query("normalise", lambda b: volume.normalise_profiles(b).select("brick_id", "lev", "row", "col", "w"), f"{_VOXEL}, {rounded('w / sqrt(sum(w * w) over (partition by r, c))', 'w')} from vx")
brick_query("arithmetic", lambda b: volume.arithmetic(b, volume.flip(b, "lev"), F.col("a") - F.col("b")), f", f as (select max(l) over () - l as l, r, c, w from vx) {_VOXEL.replace('l as bigint', 'vx.l as bigint').replace('r as', 'vx.r as').replace('c as', 'vx.c as')}, {rounded('vx.w - f.w', 'w')} from vx join f on f.l = vx.l and f.r = vx.r and f.c = vx.c")
register("brick_clusters", lambda spark, sf_dir: volume.clusters_of(tables.profiles(spark, sf_dir), 5))
register("brick_clusters_by_medians", lambda spark, sf_dir: volume.clusters_of(tables.profiles(spark, sf_dir), 5, centre="median"))

# --- point clouds

PT = "pt as materialized (select l_quantity x, l_discount y, l_extendedprice z from lineitem)"


def point_query(name: str, of: Callable[[DataFrame], DataFrame], sql: str, digits: int = DIGITS) -> None:
    register(f"points_{name}", lambda spark, sf_dir: of(tables.points(spark, sf_dir)), f"with {PT} {sql}", digits)


point_query("extent", points.extent, "select cast(0 as bigint) as surface_id, " + ", ".join(rounded(f"{f}({c})", f"{f}_{c}") for c in "xyz" for f in ("min", "max")) + ", count(*) as n from pt")
point_query("merge", points.merge_places, f"select cast(0 as bigint) as surface_id, {rounded('x', 'x')}, {rounded('y', 'y')}, {rounded('avg(z)', 'z')}, count(*) as n from pt group by x, y")
_PLANE_PT = """, mu as (select avg(x) mx, avg(y) my, avg(z) mz from pt), s as (select sum((x - mx)**2) xx, sum((x - mx) * (y - my)) xy, sum((y - my)**2) yy, sum((x - mx) * (z - mz)) xz, sum((y - my) * (z - mz)) yz, any_value(mx) mx, any_value(my) my, any_value(mz) mz from pt, mu),
  f as (select (xz * yy - yz * xy) / (xx * yy - xy * xy) bx, (yz * xx - xz * xy) / (xx * yy - xy * xy) ky, mx, my, mz from s)"""
point_query("plane", points.plane, f"{_PLANE_PT} select cast(0 as bigint) as surface_id, {rounded('mz - bx * mx - ky * my', 'a', 3)}, {rounded('bx', 'bx', 3)}, {rounded('ky', 'by', 3)} from f", digits=3)
point_query("level", lambda p: points.level(p).select("surface_id", "x", "y", "z"), f"{_PLANE_PT} select cast(0 as bigint) as surface_id, {rounded('x', 'x', 3)}, {rounded('y', 'y', 3)}, {rounded('z - mz - bx * (x - mx) - ky * (y - my)', 'z', 3)} from pt, f", digits=3)
point_query(
    "raster", lambda p: points.raster(p, 12, 7),
    f", e as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from pt), g as (select least(cast(floor((y - y0) / (y1 - y0) * 7) as bigint), 6) r, least(cast(floor((x - x0) / (x1 - x0) * 12) as bigint), 11) c, z from pt, e) select {CELL.replace('r as', 'r as').replace('c as', 'c as')}, {rounded('avg(z)', 'z')}, count(*) as n from g group by r, c",
)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.lit(0).alias("surface_id"), F.col("p_partkey").alias("pt_id"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


register(
    "points_within", lambda spark, sf_dir: points.within(_parts(spark, sf_dir), _parts(spark, sf_dir), 5.0),
    f"with p as (select p_partkey k, p_retailprice x, p_size::double y from part) select cast(0 as bigint) as surface_id, a.k as left_id, b.k as right_id, {rounded('sqrt((a.x - b.x)**2 + (a.y - b.y)**2)', 'distance')} from p a, p b where sqrt((a.x - b.x)**2 + (a.y - b.y)**2) <= 5",
)

# --- grains

# The closure of the neighbour relation of marked pixels; a grain is known by its smallest place.
GRAINS = """, mk as materialized (select r * w + c as p, r, c, w, h, z from px where m > 0),
  eg as materialized (select a.p as p, b.p as o from mk a join mk b on b.r = a.r and b.c = a.c + 1 union all select b.p, a.p from mk a join mk b on b.r = a.r and b.c = a.c + 1
    union all select a.p, b.p from mk a join mk b on b.r = a.r + 1 and b.c = a.c union all select b.p, a.p from mk a join mk b on b.r = a.r + 1 and b.c = a.c),
  reach(p, o) as (select p, p from mk union select reach.p, eg.o from reach join eg on eg.p = reach.o where eg.o > reach.p or true),
  gr as materialized (select mk.*, dense_rank() over (order by f) g from mk join (select p, min(o) f from reach group by p) t on t.p = mk.p)"""


def grain_sql(select: str) -> str:
    return f"with recursive {PX}{GRAINS} {select}"


def numbered(f: DataFrame) -> DataFrame:
    return durable(grains.number(f))


register("grain_numbers", on_grid(numbered), grain_sql('select cast(0 as bigint) as field_id, r as "row", c as col, g as grain from gr'))
register(
    "grain_quantities", on_grid(lambda f: grains.quantities(f, numbered(f))),
    grain_sql(
        f"""select cast(0 as bigint) as field_id, g as grain, count(*) as pixels, {rounded('count(*)', 'area')}, {rounded('sqrt(count(*))', 'square_side')}, {rounded('sqrt(count(*) / pi())', 'disc_radius')},
        {whole('min(c)', 'left')}, {whole('min(r)', 'top')}, {whole('max(c) - min(c) + 1', 'width')}, {whole('max(r) - min(r) + 1', 'height')}, {rounded('avg(c) + 0.5', 'centre_x')}, {rounded('avg(r) + 0.5', 'centre_y')},
        {rounded('min(z)', 'min')}, {rounded('max(z)', 'max')}, {rounded('avg(z)', 'mean')}, {rounded('stddev_pop(z)', 'rms')}, {rounded('sum(z)', 'volume')} from gr group by g"""
    ),
)
register(
    "grain_boundaries", on_grid(lambda f: grains.boundary_lengths(numbered(f))),
    grain_sql("select cast(0 as bigint) as field_id, g as grain, sum(4 - coalesce(k, 0))::bigint as boundary from gr left join (select p, count(*) k from eg group by p) t on t.p = gr.p group by g having sum(4 - coalesce(k, 0)) > 0"),
)
MASK = 'select cast(0 as bigint) as field_id, px.r as "row", px.c as col'
register(
    "grain_remove_small", cells(lambda f: grains.remove_small(f, numbered(f), 5).withColumn("z", F.col("m"))),
    grain_sql(f"{MASK}, case when s.g is null then 0.0 else 1.0 end::double as z from px left join gr on gr.r = px.r and gr.c = px.c left join (select g from gr group by g having count(*) >= 5) s on s.g = gr.g"),
)
register(
    "grain_remove_at_border", cells(lambda f: grains.remove_at_border(f, numbered(f)).withColumn("z", F.col("m"))),
    grain_sql(f"{MASK}, case when s.g is null then 0.0 else 1.0 end::double as z from px left join gr on gr.r = px.r and gr.c = px.c left join (select g from gr group by g having min(r) > 0 and min(c) > 0 and max(r) < max(h) - 1 and max(c) < max(w) - 1) s on s.g = gr.g"),
)
register(
    "mask_fill_voids", cells(lambda f: grains.fill_voids(f).withColumn("z", F.col("m"))),
    f"""with recursive {PX}, em as materialized (select r, c from px where m <= 0), ot(r, c) as (select r, c from px where m <= 0 and (r = 0 or c = 0 or r = h - 1 or c = w - 1) union
      select em.r, em.c from (select r + d[1] r, c + d[2] c from ot, (select unnest([[0, 1], [0, -1], [1, 0], [-1, 0]]) d)) n join em on em.r = n.r and em.c = n.c)
    select cast(0 as bigint) as field_id, px.r as "row", px.c as col, {rounded('case when ot.r is null then 1 else 0 end', 'z')} from px left join ot on ot.r = px.r and ot.c = px.c""",
)
_FRAME = "rows between 1 preceding and 1 following"
for name, of, both in (("grow", grains.grow, "greatest"), ("shrink", grains.shrink, "least")):
    f = "max" if both == "greatest" else "min"
    register(
        f"mask_{name}", cells(lambda d, of=of: of(d).withColumn("z", F.col("m"))),
        pixels(f"{both}({f}(m) over (partition by r order by c {_FRAME}), {f}(m) over (partition by c order by r {_FRAME}))"),
    )
HIGH = "z > lo + 0.6 * (hi - lo)"
for how, test in {"union": f"m > 0 or {HIGH}", "intersection": f"m > 0 and {HIGH}", "difference": f"m > 0 and not {HIGH}"}.items():
    register(
        f"mask_{how}", cells(lambda f, how=how: grains.merge(f, grains.mark_by_threshold(f, 0.6), how).withColumn("z", F.col("m"))),
        pixels(f"case when {test} then 1 else 0 end", "px, (select min(z) lo, max(z) hi from px)"),
    )
register("mask_complement", cells(lambda f: grains.complement(f).withColumn("z", F.col("m"))), pixels("case when m <= 0 then 1 else 0 end"))
register("mask_coverage", on_grid(grains.coverage), f"with {PX} select cast(0 as bigint) as field_id, count(*) filter (m > 0) as marked, {rounded('count(*) filter (m > 0) / count(*)', 'share')} from px")
register(
    "local_maxima", cells(grains.extrema),
    f'with {PX}{_IN3} select cast(0 as bigint) as field_id, r as "row", c as col, {rounded("any_value(z)", "z")} from o group by r, c having count(*) filter (bz >= z) = 1',
)

# --- generators and streams

def shaped(of: Callable[[SparkSession, int, int], DataFrame]) -> Query:
    """A generator over as many columns and rows of pixels as ``lineitem`` fills."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        width = tables.grid_width(n)
        return of(spark, width, n // width)

    return query


register("synthetic_waves", shaped(lambda spark, w, h: synthetic.waves(spark, w, h, 12.0, 9.0, 2.0)), pixels("2 * sin(2 * pi() * c / 12) * sin(2 * pi() * r / 9)"))
register("synthetic_chessboard", shaped(lambda spark, w, h: synthetic.chessboard(spark, w, h, 4, 3.0)), pixels("case when (c // 4 + r // 4) % 2 = 0 then 3 else 0 end"))
register("synthetic_noise", shaped(lambda spark, w, h: synthetic.white_noise(spark, w, h, 2.0, 7)))
register(
    "stream_windows", lambda spark, sf_dir: streaming.run_available(spark, sf_dir, "events.parquet", "1 day").withColumn("start", F.unix_timestamp("start")),
    f"select cast(epoch(date_trunc('day', ts)) as bigint) as start, event_type, count(value) as n, {rounded('sum(value)', 'total')}, {rounded('min(value)', 'low')}, {rounded('max(value)', 'high')} from events group by all",
)

from terrace import queries_fields as _fields, queries_local as _local, queries_more as _more, queries_paths as _paths, queries_regions as _regions, queries_scaling as _scaling, queries_transforms as _transforms  # noqa: E402, F401  they register their queries here too
