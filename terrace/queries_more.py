"""More registered queries, in the manner of ``terrace.queries``: formulas, uncertainties, lines, volumes, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.selection import Masking
from terrace.operators import arithmetic, lines, points, uncertainty, volume
from terrace.queries import (
    _O, _VOXEL, AREA, CELL, CV, INSIDE, LN, PT, PX, brick_query, cells, line_query, on_grid, pixels, point_query, register, rounded, second, whole,
)
from terrace.sources import tables

# --- formulas: name, formula, the same in SQL

FORMULAS = {
    "negate": ("~d1 - -d2", "-z + q"),
    "plus": ("d1 + d2", "z + q"),
    "minus": ("d1 - d2", "z - q"),
    "times": ("d1 * d2", "z * q"),
    "over": ("d1 / d2", "z / q"),
    "percent": ("~d1 % d2", "-z % q"),
    "power": ("d2^2^0.5 - 2^-d2", "q ** (2 ** 0.5) - 2 ** (-q)"),
    "pow": ("pow(d2, 1.5)", "q ** 1.5"),
    "min": ("min(d1, 900*d2)", "least(z, 900 * q)"),
    "max": ("max(d1, 900*d2)", "greatest(z, 900 * q)"),
    "mod": ("mod(d1, d2)", "z % q"),
    "hypot": ("hypot(d1, 1000*d2)", "sqrt(z * z + 1000000 * q * q)"),
    "atan2": ("atan2(d1 - 20000, d2)", "atan2(z - 20000, q)"),
    "abs": ("abs(d1 - 20000)", "abs(z - 20000)"),
    "floor": ("floor(d1/100)", "floor(z / 100)"),
    "ceil": ("ceil(d1/100)", "ceil(z / 100)"),
    "sqrt": ("sqrt(d1)", "sqrt(z)"),
    "cbrt": ("cbrt(d1)", "cbrt(z)"),
    "sin": ("sin(d2)", "sin(q)"),
    "cos": ("cos(pi*d2/3)", "cos(pi() * q / 3)"),
    "tan": ("tan(d2/40)", "tan(q / 40)"),
    "asin": ("asin(d2/50)", "asin(q / 50)"),
    "acos": ("acos(d2/50)", "acos(q / 50)"),
    "atan": ("atan(d2)", "atan(q)"),
    "exp": ("exp(d2/10)", "exp(q / 10)"),
    "ln": ("ln(d1)", "ln(z)"),
    "log": ("log(d1) + e", "ln(z) + exp(1)"),
    "pow10": ("pow10(d2/20)", "10 ** (q / 20)"),
    "log10": ("log10(d1)", "log10(z)"),
    "cosh": ("cosh(d2/10)", "cosh(q / 10)"),
    "sinh": ("sinh(d2/10)", "sinh(q / 10)"),
    "tanh": ("tanh(d2/10)", "tanh(q / 10)"),
    "acosh": ("acosh(d2)", "acosh(q)"),
    "asinh": ("asinh(d2)", "asinh(q)"),
    "atanh": ("atanh(d2/51)", "atanh(q / 51)"),
    "places": ("(x + 2*y)^2 / (1 + d2)", "(c + 2 * r) ** 2 / (1 + q)"),
}
for _name, (_formula, _sql) in FORMULAS.items():
    register(f"formula_{_name}", cells(lambda f, text=_formula: arithmetic.calculate({"d1": f, "d2": second(f)}, text)), pixels(_sql))

# --- uncertainties


def _with_u(field: DataFrame) -> DataFrame:
    return field.withColumn("u", F.col("q"))


def _u_sql(where: str = "") -> str:
    return f"""with {PX}, s as (select *, r * w + c p from px {where}), t as (select s.*, mu, sd, n, md from s, (select avg(z) mu, stddev_pop(z) sd, count(*) n, list_sort(list(z))[count(*) // 2 + 1] md from s))
    select cast(0 as bigint) as field_id, {rounded('arg_min(q, (z, p))', 'u_min')}, {rounded('arg_max(q, (z, -p))', 'u_max')}, {rounded('sqrt(sum(q * q)) / count(*)', 'u_mean', 7)},
      {rounded('sqrt(sum(((z - mu) * q)**2)) / count(*) / any_value(sd)', 'u_rms', 7)}, {rounded('min(q) filter (z = md)', 'u_median')} from t"""


register("uncertainty_summary", on_grid(lambda f: uncertainty.summary(_with_u(f))), _u_sql(), digits=7)
register("uncertainty_summary_region", on_grid(lambda f: uncertainty.summary(_with_u(f), AREA)), _u_sql(f"where {INSIDE}"), digits=7)
register("uncertainty_summary_masked", on_grid(lambda f: uncertainty.summary(_with_u(f), masking=Masking.INCLUDE)), _u_sql("where m > 0"), digits=7)
for _direction, _part, _order in (("x", "r", "c"), ("y", "c", "r")):
    _w = f"over (partition by {_part} order by {_order})"
    register(
        f"uncertainty_derivative_{_direction}", cells(lambda f, d=_direction: uncertainty.derivative(_with_u(f), d)),
        pixels(f"sqrt(coalesce(lead(q) {_w}, q)**2 + coalesce(lag(q) {_w}, q)**2) / (case when lag(q) {_w} is null then 0 else 1 end + case when lead(q) {_w} is null then 0 else 1 end)"),
    )
line_query("uncertainty_cumulate", lambda d: uncertainty.cumulate(d.withColumn("u", F.col("y") / 10)), f"select line_id, {whole('i', 'i')}, {rounded(f'sqrt(sum((y / 10)**2) {_O})', 'u')} from ln")

# --- parts of lines

_LINE = f"select line_id, {whole('i', 'i')}"


def _part_sql(value: str, inside: str = "i >= 3 and i < 9") -> str:
    return f"{_LINE}, {rounded(f'case when {inside} then {value} else y end', 'y')} from ln"


line_query("part", lambda d: lines.part(d, 3, 9), f"select line_id, {whole('i - 3', 'i')}, {rounded('y', 'y')} from ln where i >= 3 and i < 9")
line_query("fill", lambda d: lines.fill(d, 2.5), _part_sql("2.5", "true"))
line_query("part_fill", lambda d: lines.fill(d, 2.5, 3, 9), _part_sql("2.5"))
line_query("clear", lines.fill, _part_sql("0", "true"))
line_query("part_clear", lambda d: lines.fill(d, start=3, stop=9), _part_sql("0"))
line_query("add", lambda d: lines.add(d, 1.25), _part_sql("y + 1.25", "true"))
line_query("part_add", lambda d: lines.add(d, 1.25, 3, 9), _part_sql("y + 1.25"))
line_query("multiply", lambda d: lines.multiply(d, -3.0), _part_sql("y * -3", "true"))
line_query("part_multiply", lambda d: lines.multiply(d, -3.0, 3, 9), _part_sql("y * -3"))
line_query("threshold", lambda d: lines.threshold(d, 50.0, -1.0, 2.0), _part_sql("case when y < 50 then -1 else 2 end", "true"))
line_query("part_threshold", lambda d: lines.threshold(d, 50.0, -1.0, 2.0, 3, 9), _part_sql("case when y < 50 then -1 else 2 end"))
line_query("square_root", lines.square_root, _part_sql("sqrt(greatest(y, 0))", "true"))
for _name, _how, _inside in (("whole_statistics", (None, None), "true"), ("part_statistics", (2, 12), "i >= 2 and i < 12")):
    line_query(
        _name, lambda d, how=_how: lines.part_statistics(d, *how),
        f""", p as (select * from ln where {_inside}), t as (select *, y - avg(y) over (partition by line_id) d, y - lag(y) {_O} s from p)
        select line_id, count(*) as n, {rounded('min(y)', 'min')}, {rounded('max(y)', 'max')}, {rounded('sum(y)', 'sum')}, {rounded('avg(y)', 'mean')}, {rounded('avg(abs(d))', 'ra')}, {rounded('sqrt(avg(d*d))', 'rms')},
          {rounded('coalesce(sum(d**3) * sqrt(count(*) + 1) / nullif(sum(d*d), 0)**1.5, 0)', 'skew')}, {rounded('coalesce(sum(d**4) * (count(*) + 1) / nullif(sum(d*d), 0)**2 - 3, 0)', 'kurtosis')},
          {rounded('coalesce(sqrt(avg(s*s)), 0)', 'tan_beta0')}, {rounded('coalesce(sum(abs(s)), 0)', 'variation')}, {rounded('list_sort(list(y))[count(*) // 2 + 1]', 'median')} from t group by line_id""",
    )
_LINE_BINS = """{of}, e as (select line_id, min(y) lo, max(y) hi, count(*) n, {bins} b from d group by 1),
  hb as (select d.line_id, coalesce(least(cast(floor((y - lo) / nullif(hi - lo, 0) * b) as bigint), b - 1), 0) bin, y, lo, hi, b, n from d join e on e.line_id = d.line_id)"""
_DEFAULT_BINS = "greatest(cast(floor(3.49 * cbrt(count(*)) + 0.5) as bigint), 2)"
_LINE_DH = f""", k as (select line_id, bin, lo, hi, b, n, count(*) k from hb group by all) select line_id, {whole('bin', 'bin')}, {rounded('lo + (bin + 0.5) * (hi - lo) / b', 'x')}, k as n, {rounded('sum(k) over (partition by line_id order by bin) / n', 'share')} from k"""
line_query("distribution", lines.distribution, _LINE_BINS.format(of=", d as (select * from ln)", bins=_DEFAULT_BINS) + _LINE_DH)
line_query(
    "slope_distribution", lambda d: lines.distribution(lines.steps(d), 12),
    _LINE_BINS.format(of=f", g as (select line_id, y - lag(y) {_O} y from ln), d as (select * from g where y is not null)", bins=12) + _LINE_DH,
)
line_query(
    "modus", lines.modus,
    _LINE_BINS.format(of=", d as (select * from ln)", bins=_DEFAULT_BINS) + f", k as (select line_id, bin, count(*) k, avg(y) a from hb group by all) select line_id, {rounded('arg_max(a, (k, -bin))', 'modus')} from k group by line_id",
)
_LINE_PAIRS = "from ln2 a join ln2 b on b.line_id = a.line_id and b.i - a.i between 0 and 10 group by a.line_id, b.i - a.i"
line_query(
    "autocorrelation", lambda d: lines.autocorrelation(d, 10),
    f", ln2 as (select line_id, i, y - avg(y) over (partition by line_id) y from ln) select a.line_id, {whole('b.i - a.i', 'lag')}, {rounded('avg(a.y * b.y)', 'acf')} {_LINE_PAIRS}",
)
line_query("height_difference", lambda d: lines.height_difference(d, 10), f", ln2 as (select * from ln) select a.line_id, {whole('b.i - a.i', 'lag')}, {rounded('avg((a.y - b.y)**2)', 'hhcf')} {_LINE_PAIRS}")
PLACES = [0.0, 0.25, 1.5, 2.75, 4.0]
_KERNEL_SQL = {
    "round": ("0", "case when t < 0.5 then 1 else 0 end", "case when t >= 0.5 then 1 else 0 end", "0"),
    "linear": ("0", "1 - t", "t", "0"),
    "key": ("(-t**3 + 2 * t**2 - t) / 2", "(3 * t**3 - 5 * t**2 + 2) / 2", "(-3 * t**3 + 4 * t**2 + t) / 2", "(t**3 - t**2) / 2"),
    "schaum": ("-(t**3 - 3 * t**2 + 2 * t) / 6", "(t**3 - 2 * t**2 - t + 2) / 2", "-(t**3 - t**2 - 2 * t) / 2", "(t**3 - t) / 6"),
}
for _kind, _weights in _KERNEL_SQL.items():
    _sum = " + ".join(f"({w}) * {c}.y" for w, c in zip(_weights, "abcd"))
    line_query(
        f"sample_{_kind}", lambda d, kind=_kind: lines.sample(d, PLACES, kind),
        f""", n as (select line_id, count(*) n from ln group by 1), x as (select line_id, n, x, cast(floor(x) as bigint) i, x - floor(x) t from n, unnest({PLACES}) u(x) where x <= n - 1)
        select x.line_id, {rounded('x', 'x')}, {rounded(_sum, 'y')} from x join ln a on a.line_id = x.line_id and a.i = greatest(x.i - 1, 0) join ln b on b.line_id = x.line_id and b.i = x.i
          join ln c on c.line_id = x.line_id and c.i = case when x.i + 1 < n then x.i + 1 else x.i end
          join ln d on d.line_id = x.line_id and d.i = case when x.i + 2 < n then x.i + 2 when x.i + 1 < n then x.i + 1 else greatest(x.i - 1, 0) end""",
    )

# --- volumes

brick_query("part", lambda b: volume.part(b, (3, 1, 2), (10, 2, 8)).select("brick_id", "lev", "row", "col", "w"), f"select cast(0 as bigint) as brick_id, {whole('l - 3', 'lev')}, {whole('r - 1', 'row')}, {whole('c - 2', 'col')}, {rounded('w', 'w')} from vx where l between 3 and 12 and r between 1 and 2 and c between 2 and 9")
brick_query("resample", lambda b: volume.resample(b, 24), f", s as (select t, cast(floor((t + 0.5) * (select max(l) + 1 from vx) / 24) as bigint) l from unnest(range(24)) u(t)) select cast(0 as bigint) as brick_id, {whole('t', 'lev')}, r as \"row\", c as col, {rounded('w', 'w')} from s join vx on vx.l = s.l")
brick_query("value", lambda b: volume.value_at(b, 5, 2, 3), f"select cast(0 as bigint) as brick_id, {rounded('w', 'w')} from vx where l = 5 and r = 2 and c = 3")
brick_query("extremes", volume.extremes, f"select cast(0 as bigint) as brick_id, count(*) as n, {rounded('min(w)', 'min')}, {rounded('max(w)', 'max')} from vx")
brick_query("fill", lambda b: volume.changed(b, F.lit(1.5)).select("brick_id", "lev", "row", "col", "w"), f"{_VOXEL}, {rounded('1.5', 'w')} from vx")
brick_query("clear", lambda b: volume.changed(b, F.lit(0)).select("brick_id", "lev", "row", "col", "w"), f"{_VOXEL}, {rounded('0', 'w')} from vx")
brick_query("invert", lambda b: volume.changed(b, -F.col("w")).select("brick_id", "lev", "row", "col", "w"), f"{_VOXEL}, {rounded('-w', 'w')} from vx")
brick_query(
    "calibrated", lambda b: volume.calibrated(b, b.sparkSession.range(40).select(F.lit(0).alias("line_id"), F.col("id").cast("int").alias("i"), (F.col("id") * 0.5 + 3).alias("y"))).select("brick_id", "lev", "row", "col", "value"),
    f"{_VOXEL}, {rounded('case when l < 40 then l * 0.5 + 3 end', 'value')} from vx",
)

# --- point clouds and curves

point_query("zero_mean", lambda p: points.zero_mean(p).select("surface_id", "x", "y", "z"), f"select cast(0 as bigint) as surface_id, {rounded('x', 'x', 3)}, {rounded('y', 'y', 3)}, {rounded('z - (select avg(z) from pt)', 'z', 3)} from pt", digits=3)
point_query("fix_zero", lambda p: points.fix_zero(p).select("surface_id", "x", "y", "z"), f"select cast(0 as bigint) as surface_id, {rounded('x', 'x')}, {rounded('y', 'y')}, {rounded('z - (select min(z) from pt)', 'z')} from pt")
register("points_from_field", on_grid(points.from_field), f"with {PX} select cast(0 as bigint) as surface_id, {rounded('c + 0.5', 'x')}, {rounded('r + 0.5', 'y')}, {rounded('z', 'z')} from px")
register("points_from_mask", on_grid(lambda f: points.from_field(f, True)), f"with {PX} select cast(0 as bigint) as surface_id, {rounded('c + 0.5', 'x')}, {rounded('r + 0.5', 'y')}, {rounded('z', 'z')} from px where m > 0")
