"""Registered queries of distances, the Laplace equation, watershed, edges, matching, frequency filters and entropy at scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.operators import distances, distributions, edges, fitting, frequency, laplace, matching, peaks, points, spatial, tips, triangulation, watershed
from terrace.plans.durable import durable
from terrace.queries import _MIRROR3, CELL, PX, _parts, cells, on_grid, register, rounded, second, weighted, whole
from terrace.sources import tables

# --- distances

_AWAY = """, fr as (select r, c, w, h, case when m <= 0 then r end f from px),
  g as materialized (select r, c, w, least(r - coalesce(max(f) over (partition by c order by r), -1), coalesce(min(f) over (partition by c order by r rows between current row and unbounded following), h) - r) g from fr),
  sd as (select r, c, g from g union all select distinct r, -1, 0 from g union all select distinct r, w, 0 from g)"""
# The metric of a pixel dx columns and g rows away.
_METRIC = {
    "euclidean": "sqrt(min((a.c - b.c)**2 + b.g**2))",
    "cityblock": "min(abs(a.c - b.c) + b.g)",
    "chessboard": "min(greatest(abs(a.c - b.c), b.g))",
    "octagonal48": "min(greatest(abs(a.c - b.c), b.g, ceil(2 * (abs(a.c - b.c) + b.g) / 3.0)))",
    "octagonal84": "min(greatest(abs(a.c - b.c), b.g, ceil((2 * (abs(a.c - b.c) + b.g) - 1) / 3.0)))",
}
for _metric in distances.METRICS:
    register(
        f"mask_distance_{_metric}", cells(lambda f, metric=_metric: distances.distance_transform(f, metric)),
        f'with {PX}{_AWAY} select cast(0 as bigint) as field_id, a.r as "row", a.c as col, {rounded(_METRIC[_metric], "z")} from g a join sd b on b.r = a.r group by a.r, a.c',
    )
_EUCLID = f"{_AWAY}, ed as materialized (select a.r, a.c, min((a.c - b.c)**2 + b.g**2) d from g a join sd b on b.r = a.r group by a.r, a.c)"
register(
    "mask_shrink_by_distance", cells(lambda f: distances.shrink_by_distance(f, 1.4).withColumn("z", F.col("m"))),
    f"with {PX}{_EUCLID} select {CELL}, {rounded('case when d > 1.96 then 1 else 0 end', 'z')} from ed",
)

# --- the Laplace equation: DuckDB repeats means of neighbours until they settle

_RELAXED = """, nb as (select r, c, m, lag(z) over a l, lead(z) over a rt, lag(z) over d u, lead(z) over d dn, lag(m) over a ml, lead(m) over a mr, lag(m) over d mu, lead(m) over d md
    from px window a as (partition by r order by c), d as (partition by c order by r)),
  eq as materialized (select r * 100000 + c p, (l is not null)::int + (rt is not null)::int + (u is not null)::int + (dn is not null)::int k,
    (case when ml <= 0 then l else 0 end) + (case when mr <= 0 then rt else 0 end) + (case when mu <= 0 then u else 0 end) + (case when md <= 0 then dn else 0 end) b from nb where m > 0),
  ln as (select a.p, b.p o from eq a join eq b on b.p = a.p + 1 union all select a.p, b.p from eq a join eq b on b.p = a.p + 100000),
  lk as materialized (select p, o, 1 v from ln union all select o, p, 1 from ln union all select p, p, 0 from eq),
  it(i, p, x) as (select 0, p, b / k from eq union all
    select s.i + 1, lk.o, any_value(eq.b) / any_value(eq.k) + sum(s.x * v) / any_value(eq.k) from it s join lk on lk.p = s.p join eq on eq.p = lk.o where s.i < 400 group by s.i, lk.o)"""


def _residual(field):
    """How far each marked pixel of the solution is from the mean of its neighbours, as a share of the field's largest value."""
    solved = laplace.fill(field)
    around = durable(field.select("field_id", "row", "col", "m").join(solved, ["field_id", "row", "col"]))
    four = laplace._beside(F.col("z"), [])
    n = sum((c.isNotNull().cast("int") for c in four), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in four), F.lit(0.0))
    most = around.agg(F.max(F.abs("z"))).first()[0] or 1.0
    rest = around.select("field_id", "row", "col", "m", ((F.col("z") - total / n) / most).alias("z")).where("m > 0")
    return rest.select("field_id", "row", "col", F.when(F.abs("z") < 1e-8, 0.0).otherwise(F.col("z")).alias("z"))


register(
    "laplace_fill", cells(laplace.fill),
    f"""with recursive {PX}{_RELAXED}, en as (select p, x from it where i = 400) select {CELL}, {rounded('coalesce(x, z)', 'z', 3)} from px left join en on p = r * 100000 + c""", digits=3,
)
register("laplace_residual", on_grid(_residual), f"with {PX} select {CELL}, 0.0::double as z from px where m > 0", digits=9)
register(
    "laplace_unmasked", on_grid(lambda f: laplace.fill(f).join(f.where("m <= 0").select("field_id", "row", "col"), ["field_id", "row", "col"])),
    f"with {PX} select {CELL}, {rounded('z', 'z')} from px where m <= 0",
)

# --- watershed: pixels in the order of value and place

_BASINS = """, s1 as (select r, c, unnest([-1, 0, 1]) dr from px), s2 as (select *, unnest([-1, 0, 1]) dc from s1),
  nx as materialized (select s2.r * 100000 + s2.c p, min((b.z, b.r, b.c)) b from s2 join px b on b.r = s2.r + dr and b.c = s2.c + dc group by 1),
  n2 as materialized (select p, b[2] * 100000 + b[3] o from nx),
  up(p, o) as (select p, o from n2 union select up.p, n2.o from up join n2 on n2.p = up.o),
  ba as materialized (select up.p, up.o from up join n2 on n2.p = up.o where n2.o = n2.p)"""
register(
    "watershed_basins", on_grid(lambda f: watershed.basins(f).drop("z")),
    f'with recursive {PX}{_BASINS} select cast(0 as bigint) as field_id, p // 100000 as "row", p % 100000 as col, o // 100000 as bottom_row, o % 100000 as bottom_col from ba',
)
register(
    "watershed_saddles",
    on_grid(lambda f: watershed.saddles(durable(watershed.basins(f))).select("field_id", *(F.col(f"{s}.bottom_{p}").alias(f"{s}_{p}") for s in "ab" for p in ("row", "col")), "height")),
    f"""with recursive {PX}{_BASINS}, bp as materialized (select p, o, z from ba join px on r = p // 100000 and c = p % 100000),
    st as (select p, o, z, unnest([1, 99999, 100000, 100001]) d from bp),
    pr as (select least(a.o, b.o) x, greatest(a.o, b.o) y, greatest(a.z, b.z) hh from st a join bp b on b.p = a.p + a.d where a.o <> b.o)
    select cast(0 as bigint) as field_id, x // 100000 as a_row, x % 100000 as a_col, y // 100000 as b_row, y % 100000 as b_col, {rounded('min(hh)', 'height')} from pr group by x, y""",
)
register("watershed_grains", on_grid(lambda f: watershed.watershed(f, 20000.0)))
register("watershed_segments", cells(lambda f: watershed.segments(watershed.watershed(f, 20000.0)).withColumn("z", F.col("m"))))

# --- edges

_GRADIENT = ", gx as materialized (select r, c, " + weighted((1, 0, -1, 2, 0, -2, 1, 0, -1)) + " x, " + weighted((1, 2, 1, 0, 0, 0, -1, -2, -1)) + " y from o group by r, c)"
_TOP = f"""{_MIRROR3}{_GRADIENT}, sz as materialized (select r, c, x, y, sqrt(x * x + y * y) s, max(sqrt(x * x + y * y)) over () top from gx),
  pt as (select *, case when abs(y) <= tan(pi() / 8) * abs(x) then [0, 1] when abs(x) <= tan(pi() / 8) * abs(y) then [1, 0] when x * y > 0 then [1, 1] else [1, -1] end d from sz),
  rd as materialized (select a.r, a.c, a.s, a.top from pt a left join sz b on b.r = a.r - d[1] and b.c = a.c - d[2] left join sz e on e.r = a.r + d[1] and e.c = a.c + d[2]
    where a.s > 0 and a.s >= coalesce(b.s, 0) and a.s > coalesce(e.s, 0)),
  wk as materialized (select r, c, s >= 0.5 * top strong from rd where s >= 0.25 * top)"""
register(
    "filter_canny", cells(lambda f: edges.canny(f, 0.25, 0.5).withColumn("z", F.col("m"))),
    f"""with recursive {PX}{_TOP}, kept(r, c) as (select r, c from wk where strong union
      select b.r, b.c from (select k.r, k.c, unnest([-1, 0, 1]) dr from kept k) u join wk b on b.r = u.r + u.dr and b.c between u.c - 1 and u.c + 1)
    select cast(0 as bigint) as field_id, px.r as "row", px.c as col, {rounded('case when k.r is null then 0 else 1 end', 'z')} from px left join kept k on k.r = px.r and k.c = px.c""",
)
_BELL = "exp(-((d / 0.4)**2) / 2) / (2 * pi() * 0.16)"
register(
    "filter_harris", cells(lambda f: edges.harris(f, 2).withColumn("z", F.col("z") * 1e6)),
    f"""with {PX}{_MIRROR3}{_GRADIENT}, sp as (select (max(x) - min(x) + max(y) - min(y)) s from gx),
    pr as (select gx.r, gx.c, case when gx.r >= 2 and gx.c >= 2 and gx.r < h - 2 and gx.c < w - 2 then 1 else 0 end i, x * x / (s * s) xx, x * y / (s * s) xy, y * y / (s * s) yy from gx, sp, (select any_value(w) w, any_value(h) h from px)),
    a1 as (select r, c + d c, sum(xx * {_BELL}) xx, sum(xy * {_BELL}) xy, sum(yy * {_BELL}) yy from (select *, unnest([-2, -1, 0, 1, 2]) d from pr where i = 1) group by 1, 2),
    a2 as (select r + d r, c, sum(xx * {_BELL}) xx, sum(xy * {_BELL}) xy, sum(yy * {_BELL}) yy from (select *, unnest([-2, -1, 0, 1, 2]) d from a1) group by 1, 2)
    select cast(0 as bigint) as field_id, pr.r as "row", pr.c as col, {rounded('case when i = 1 then 1e6 * (a2.xx * a2.yy - a2.xy**2 - 0.07 * (a2.xx + a2.yy)**2) else 0 end', 'z')} from pr left join a2 on a2.r = pr.r and a2.c = pr.c""",
)

# --- matching

register(
    "cross_correlation", on_grid(lambda f: matching.cross_correlate(f, second(f), 1, 3)),
    f"""with {PX}, wd as (select r, c, unnest([-1, 0, 1]) i from px where r between 2 and h - 3 and c between 2 and w - 3), w2 as (select *, unnest([-1, 0, 1]) j from wd),
    ws as (select w2.*, z a from w2 join px on px.r = w2.r + i and px.c = w2.c + j), sh as (select *, unnest([-1, 0, 1]) dy from ws), s2 as (select *, unnest([-1, 0, 1]) dx from sh),
    cr as materialized (select s2.r, s2.c, dx, dy, coalesce(corr(a, px.q), 0) k from s2 join px on px.r = s2.r + i + dy and px.c = s2.c + j + dx group by s2.r, s2.c, dx, dy),
    bs as (select r, c, max((case when dx = 0 and dy = 0 then k * 1.0001 else k end, -(dx * dx + dy * dy), -dy, -dx)) b from cr group by r, c),
    b2 as (select r, c, b[1] s, -b[4] dx, -b[3] dy from bs),
    f as (select b2.*, l.k lk, g.k gk, u.k uk, o.k ok from b2 left join cr l on l.r = b2.r and l.c = b2.c and l.dx = b2.dx - 1 and l.dy = b2.dy left join cr g on g.r = b2.r and g.c = b2.c and g.dx = b2.dx + 1 and g.dy = b2.dy
      left join cr u on u.r = b2.r and u.c = b2.c and u.dx = b2.dx and u.dy = b2.dy - 1 left join cr o on o.r = b2.r and o.c = b2.c and o.dx = b2.dx and o.dy = b2.dy + 1)
    select {CELL}, {whole('dx', 'dx')}, {whole('dy', 'dy')}, {rounded('s', 'score')}, {rounded('coalesce(dx + (lk - gk) / nullif(lk + gk - 2 * s, 0) / 2, dx)', 'x')}, {rounded('coalesce(dy + (uk - ok) / nullif(uk + ok - 2 * s, 0) / 2, dy)', 'y')} from f""",
)

# --- the plane of frequencies: DuckDB adds up the transform's terms one by one

_TURN = "2 * pi() * (({}) % {}) / {}"


def _ft(source: str, re: str, im: str, along: str, size: str, sign: int, name: str) -> str:
    """Unitary transform of (r, c, re, im) along one axis."""
    other = "c" if along == "r" else "r"
    turn = _TURN.format(f"k * {along}", size, size)
    real, imag = f"{re} * cos({turn}) - ({sign}) * {im} * sin({turn})", f"{im} * cos({turn}) + ({sign}) * {re} * sin({turn})"
    return f"{name} as materialized (select {other}, k as {along}, any_value(w) w, any_value(h) h, sum({real}) / sqrt(any_value({size})) re, sum({imag}) / sqrt(any_value({size})) im from (select *, unnest(range({size})) k from {source}) group by {other}, k)"


_PLANE = f", {_ft('px', 'z', '0', 'c', 'w', -1, 'fc')}, {_ft('fc', 're', 'im', 'r', 'h', -1, 'ff')}, fq as (select *, case when 2 * c > w then c - w else c end i, case when 2 * r > h then r - h else r end j from ff)"
_BACK = f"{_ft('wt', 're', 'im', 'c', 'w', 1, 'bc')}, {_ft('bc', 're', 'im', 'r', 'h', 1, 'bb')}"


def _filtered(weight: str) -> str:
    return f"with {PX}{_PLANE}, wt as (select r, c, w, h, re * ({weight}) re, im * ({weight}) im from fq), {_BACK} select {CELL}, {rounded('re', 'z', 2)} from bb"


register("frequency_band", cells(lambda f: frequency.keep_band(f, 0.05, 0.2)), _filtered("case when sqrt((i / w)**2 + (j / h)**2) between 0.05 and 0.2 then 1 else 0 end"), digits=2)
register("frequency_low", cells(lambda f: frequency.keep_band(f, high=0.1, edge=0.04)), _filtered("1 - (1 - cos(least(greatest((sqrt((i / w)**2 + (j / h)**2) - 0.08) / 0.04, 0), 1) * pi())) / 2"), digits=2)
_MARKED = "select distinct fq.r, fq.c from fq join px on m > 0 and px.r = ({} + fq.h) % fq.h and px.c = ({} + fq.w) % fq.w"
register(
    "frequency_mask", cells(lambda f: frequency.filter_by_mask(f, f)),
    f"""with {PX}{_PLANE}, hit as ({_MARKED.format('fq.h // 2 + j', 'fq.w // 2 + i')} union {_MARKED.format('fq.h // 2 - j', 'fq.w // 2 - i')}),
    wt as (select fq.r, fq.c, w, h, case when hit.r is null then 0 else re end re, case when hit.r is null then 0 else im end im from fq left join hit on hit.r = fq.r and hit.c = fq.c), {_BACK} select {CELL}, {rounded('re', 'z', 2)} from bb""",
    digits=2,
)
_STEPS = "sqrt((i * 4 / w)**2 + (j * 4 / w)**2)"
register("wavelet_gauss", cells(lambda f: frequency.wavelet(f, 0.5)), _filtered(f"exp(-0.25 * {_STEPS}**2 / 2)"), digits=2)
register("wavelet_hat", cells(lambda f: frequency.wavelet(f, 0.5, "hat")), _filtered(f"0.25 * {_STEPS}**2 * exp(-0.25 * {_STEPS}**2 / 2) * 2 * pi() * 0.25"), digits=2)
register(
    "transform_2d", on_grid(spatial.transform_2d),
    f"with {PX}{_PLANE} select {CELL}, {rounded('re', 're', 1)}, {rounded('im', 'im', 1)} from ff", digits=1,
)
register("row_transform", on_grid(spatial.row_transform), f"with {PX}, {_ft('px', 'z', '0', 'c', 'w', -1, 'fc')} select {CELL}, {rounded('re', 're', 1)}, {rounded('im', 'im', 1)} from fc", digits=1)
_BIN = "floor(sqrt(i * i + j * j) + 0.5)"
register(
    "radial_spectrum", on_grid(spatial.radial_spectrum),
    f"with {PX}{_PLANE} select cast(0 as bigint) as field_id, {whole(_BIN, 'bin')}, count(*) as n, {rounded('avg(re * re + im * im)', 'psdf', 0)} from fq where {_BIN} > 0 group by {_BIN}", digits=0,
)
register(
    "power_spectrum", on_grid(spatial.power_spectrum),
    f"""with {PX}, ww as (select c, avg(1.0) over () one, 0.5 - 0.5 * cos(2 * pi() * (c + 0.5) / w) v from (select distinct c, w from px)), wm as (select c, v / sqrt(avg(v * v) over ()) v from ww),
    ct as (select px.r, px.c, px.w, px.h, (z - avg(z) over (partition by r)) * v as z from px join wm on wm.c = px.c), {_ft('ct', 'z', '0', 'c', 'w', -1, 'fc')}
    select cast(0 as bigint) as field_id, {whole('c', 'bin')}, {rounded('any_value(2 * pi() * c / w)', 'k', 1)}, {rounded('avg(re * re + im * im) / (2 * pi())', 'psdf', 1)} from fc where c <= w // 2 group by c""", digits=1,
)

# --- entropy at scales

register(
    "entropy_at_scales", on_grid(distributions.entropy_at_scales),
    f"""with {PX}, e as (select min(z) lo, max(z) hi, count(*)::double n, least(50, cast(floor(3 * log2(count(*)) + 1e-12) as bigint)) d from px),
    b as (select least(cast(floor((z - lo) / (hi - lo) * pow(2.0, d)) as bigint), (1::bigint << d::int) - 1) k, d, n, hi - lo s from px, e),
    l as (select *, unnest(range(d + 1)) lv from b), t as (select lv, k >> (d - lv)::int g, count(*)::double q, any_value(n) n, any_value(s) s from l group by 1, 2)
    select cast(0 as bigint) as field_id, {whole('lv', 'level')}, {rounded('any_value(s) / pow(2.0, lv)', 'width')}, {rounded('ln(any_value(n)) + ln(any_value(s) / pow(2.0, lv)) - sum(q * ln(q)) / any_value(n)', 'entropy')} from t group by lv""",
)
_CLOUD = f"""{PX}, e as (select min(z) a, max(z) b, min(q) u, max(q) v, count(*)::double n, least(50, cast(floor(1.5 * log2(count(*)) + 1e-12) as bigint)) d from px),
    bi as (select least(cast(floor((z - a) / (b - a) * pow(2.0, d)) as bigint), (1::bigint << d::int) - 1) k1, least(cast(floor((q - u) / (v - u) * pow(2.0, d)) as bigint), (1::bigint << d::int) - 1) k2, d, n, (b - a) * (v - u) s from px, e),
    l as (select *, unnest(range(d + 1)) lv from bi), t as (select lv, k1 >> (d - lv)::int g1, k2 >> (d - lv)::int g2, count(*)::double k, any_value(n) n, any_value(s) s from l group by 1, 2, 3),
    en as (select lv, any_value(s) / pow(2.0, 2 * lv) width, ln(any_value(n)) + ln(any_value(s) / pow(2.0, 2 * lv)) - sum(k * ln(k)) / any_value(n) h from t group by lv)"""
register(
    "entropy_2d_at_scales", on_grid(lambda f: distributions.entropy_at_scales(f, ("z", "q"))),
    f"with {_CLOUD} select cast(0 as bigint) as field_id, {whole('lv', 'level')}, {rounded('width', 'width')}, {rounded('h', 'entropy')} from en",
)
register(
    "entropy_2d", on_grid(lambda f: distributions.entropy_2d(f, ("z", "q"))),
    f"with {_CLOUD}, ch as (select lv, abs(h - lag(h) over o) + abs(lead(h) over o - h) d, (lag(h) over o + h + lead(h) over o) / 3 m from en window o as (order by lv)) select cast(0 as bigint) as field_id, {rounded('m', 'entropy')} from ch where d is not null order by d, lv limit 1",
)

# --- triangles of scattered points: parts by price and size

_PT = "pt as materialized (select p_partkey k, p_retailprice x, p_size::double y from part), pl as materialized (select x, y, min(k) k, avg(x + 2 * y) z from pt group by x, y)"
# Corners of the hull stand at an end of their row of sizes; a side is a pair of them with all others to its left and none on the line beyond.
_SIDES = f"""{_PT}, ed as materialized (select min(x) x, y from pl group by y union select max(x), y from pl group by y),
  sd as materialized (select a.x ax, a.y ay, b.x tx, b.y ty from ed a, ed b, ed p where (a.x, a.y) <> (b.x, b.y) group by all
    having min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) >= 0
      and count(*) filter ((b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) and ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y) < 0 or (p.x - b.x) * (a.x - b.x) + (p.y - b.y) * (a.y - b.y) < 0)) = 0),
  ou as (select count(*) n from (select distinct pl.x, pl.y from pl join sd on (tx - ax) * (pl.y - ay) = (ty - ay) * (pl.x - ax)))"""


def _cloud(spark, sf_dir):
    return _parts(spark, sf_dir).withColumn("z", F.col("x") + 2 * F.col("y"))


def _triangle_sums(spark, sf_dir):
    """Number and area of the triangles: all points but those of the border make two, and together they are the convex hull."""
    made = triangulation.delaunay(_cloud(spark, sf_dir))
    twice = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    return made.groupBy("surface_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(twice) / 2).alias("area"))


register(
    "delaunay_sums", _triangle_sums,
    f"with {_SIDES} select cast(0 as bigint) as surface_id, {whole('2 * (select count(*) from pl) - 2 - any_value(ou.n)', 'n')}, {rounded('sum(ax * ty - tx * ay) / 2', 'area', 2)} from sd, ou", digits=2,
)
register("delaunay_triangles", lambda spark, sf_dir: triangulation.delaunay(_cloud(spark, sf_dir)).select("surface_id", "a", "b", "c"))
register(
    "raster_triangulated", lambda spark, sf_dir: triangulation.interpolate(_cloud(spark, sf_dir), 40, 30),
    f"""with {_SIDES}, bx as (select min(x) x0, (max(x) - min(x)) / 40 dx, min(y) y0, (max(y) - min(y)) / 30 dy from pl),
    gr as (select i, j, x0 + (j + 0.5) * dx x, y0 + (i + 0.5) * dy y from bx, unnest(range(30)) a(i), unnest(range(40)) b(j))
    select cast(0 as bigint) as field_id, i as "row", j as col, {rounded('any_value(x + 2 * y)', 'z')} from gr, sd group by i, j having min((tx - ax) * (y - ay) - (ty - ay) * (x - ax)) >= 0""",
)
register(
    "points_nearest", lambda spark, sf_dir: points.nearest(_parts(spark, sf_dir).where("pt_id % 100 = 0"), _parts(spark, sf_dir), 2.0, 3),
    f"""with {_PT}, d as (select a.k left_id, b.k right_id, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) d from pt a, pt b where a.k % 100 = 0), r as (select *, row_number() over (partition by left_id order by d, right_id) n from d)
    select cast(0 as bigint) as surface_id, left_id, right_id, {rounded('d', 'distance')}, n as rank from r where n <= 3""",
)

# --- fits

register(
    "fit_line", lambda spark, sf_dir: fitting.fit_curves(tables.curves(spark, sf_dir), "line").select("curve_id", "a", "b", "n", "rms"),
    f"""with cv as (select o_orderpriority curve_id, datediff('day', date '1992-01-01', o_orderdate::date)::double x, o_totalprice y from orders), f as (select curve_id, regr_intercept(y, x) a, regr_slope(y, x) b from cv group by curve_id)
    select curve_id, {rounded('any_value(a)', 'a', 2)}, {rounded('any_value(b)', 'b', 2)}, count(*) as n, {rounded('sqrt(avg((y - a - b * x)**2))', 'rms', 2)} from cv join f using (curve_id) group by curve_id""", digits=2,
)
register(
    "fit_plane", on_grid(lambda f: fitting.fit_shape(f.drop("m"), "plane").select("field_id", "z0", "bx", "by")),
    f"""with {PX}, mm as (select avg(c) mc, avg(r) mr, avg(z) mz from px), t as (select sum((c - mc) * (z - mz)) / sum((c - mc)**2) u, sum((r - mr) * (z - mz)) / sum((r - mr)**2) v from px, mm)
    select cast(0 as bigint) as field_id, {rounded('mz - u * mc - v * mr', 'z0', 2)}, {rounded('u', 'bx', 2)}, {rounded('v', 'by', 2)} from mm, t""", digits=2,
)

# --- peaks, circles, tips

register("field_peaks", on_grid(lambda f: peaks.maxima(f, 50, 4.0, 90000.0)))
_RING = ", ".join(f"({r}, {c})" for r, c in peaks.ring(5))
register(
    "hough_circles", cells(lambda f: peaks.hough_circles(f, 5)),
    f"""with {PX}, rg(dr, dc) as (values {_RING}), vt as (select r + dr r, c + dc c, count(*) n from px, rg where m > 0 group by 1, 2)
    select cast(0 as bigint) as field_id, px.r as "row", px.c as col, {rounded('coalesce(n, 0)', 'z')} from px left join vt on vt.r = px.r and vt.c = px.c""",
)


def _blind(field):
    tip = tips.blind_estimate(field, 3)
    return field.sparkSession.createDataFrame([(i // 3, i % 3, h) for i, h in enumerate(tip)], "row int, col int, z double")


register("tip_blind", on_grid(_blind))
