"""More registered queries of fields, in the manner of ``terrace.queries``: parts of fields, shapes, transforms, grains."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.functions.selection import Masking, chosen
from terrace.operators import arithmetic, distributions, filters, geometry, grains, levelling, spatial, statistics
from terrace.queries import (
    _GX, _GY, _IN3, _LAGS, _MIRROR3, AREA, AROUND, CELL, HIST, INSIDE, MASK, PX, _summary_sql, cells, convolved, grain_sql, numbered, on_grid, pixels, register, rounded, second, weighted, whole,
)

FIELD = "cast(0 as bigint) as field_id"
#: The pixels of the area alone, instead of all.
IN_AREA = PX.replace("px as materialized (", "pw as materialized (") + f", px as materialized (select * from pw where {INSIDE})"
IN_MASK = PX.replace("px as materialized (", "pw as materialized (") + ", px as materialized (select * from pw where m > 0)"


def area(f):
    return chosen(f, AREA)


# --- statistics of a part

_HB = f"{whole('bin', 'bin')}, {rounded('lo + (bin + 0.5) * (hi - lo) / b', 'x')}"
for _name, _source, _of in (("area", IN_AREA, area), ("masked", IN_MASK, lambda f: chosen(f, masking=Masking.INCLUDE))):
    register(f"height_histogram_{_name}", on_grid(lambda f, of=_of: distributions.histogram(of(f))), f"with {_source}{HIST} select {FIELD}, {_HB}, k as n, {rounded('k / (total * (hi - lo) / b)', 'density', 7)} from hb".replace("1e4 + 0.501) / 1e4 as \"x\"", "1e7 + 0.501) / 1e7 as \"x\""), digits=7)
    register(f"height_cumulative_{_name}", on_grid(lambda f, of=_of: distributions.cumulative(of(f))), f"with {_source}{HIST} select {FIELD}, {_HB}, {rounded('sum(k) over (order by bin) / total', 'share')} from hb")
    register(f"entropy_{_name}", on_grid(lambda f, of=_of: distributions.entropy(of(f))), f"with {_source}{HIST} select {FIELD}, {rounded('sum(-(k / total) * ln(k / total))', 'entropy')} from hb")
for _axis, _ahead in (("x", "rt"), ("y", "bl")):
    for _name, _source, _of in (("", PX, lambda f: f), ("_area", IN_AREA, area)):
        _binned = f"""with {_source}{AROUND}, d as (select {_ahead} - z as g from nb where {_ahead} is not null), e as (select min(g) lo, max(g) hi, count(*) n from d),
          k as (select least(cast(floor((g - lo) / (hi - lo) * 50) as bigint), 49) bin, lo, hi, n, count(*) k from d, e group by all)"""
        _x = f"{whole('bin', 'bin')}, {rounded('lo + (bin + 0.5) * (hi - lo) / 50', 'x')}"
        register(f"slope_cumulative_{_axis}{_name}", on_grid(lambda f, a=_axis, of=_of: distributions.cumulative(distributions.slopes(of(f), a), 50)), f"{_binned} select {FIELD}, {_x}, {rounded('sum(k) over (order by bin) / n', 'share')} from k")
        if (_axis, _name) != ("x", ""):
            register(f"slope_histogram_{_axis}{_name}", on_grid(lambda f, a=_axis, of=_of: distributions.histogram(distributions.slopes(of(f), a), 50)), f"{_binned} select {FIELD}, {_x}, k as n, {rounded('k / (n * (hi - lo) / 50)', 'density')} from k")
for _name, _source, _of in (("", PX, lambda f: f), ("_area", IN_AREA, area)):
    for _by, _line, _other in (("row", "r", "c"), ("col", "c", "r")):
        if (_name, _by) == ("", "row"):
            continue
        register(
            f"autocorrelation_by_{_by}{_name}", on_grid(lambda f, of=_of, by=_by: spatial.autocorrelation(of(f), 12, by)),
            f"""with {_source}{_LAGS}, t as (select r, c, z - avg(z) over (partition by {_line}) d from px) select {FIELD}, {whole('k', 'lag')}, {rounded('avg(a.d * b.d)', 'acf', 1)}
            from lg join t a on true join t b on b.{_line} = a.{_line} and b.{_other} = a.{_other} + k group by k""", digits=1,
        )
        register(
            f"height_difference_by_{_by}{_name}", on_grid(lambda f, of=_of, by=_by: spatial.height_difference(of(f), 12, by)),
            f"with {_source}{_LAGS} select {FIELD}, {whole('k', 'lag')}, {rounded('avg((a.z - b.z)**2)', 'hhcf', 1)} from lg join px a on true join px b on b.{_line} = a.{_line} and b.{_other} = a.{_other} + k group by k", digits=1,
        )
_TRIANGLES = " + ".join(
    f"sqrt(0.25 + ((({q}) - ({p})) / 2)**2 + ((z + rt + bl + dg) / 4 - (({p}) + ({q})) / 2)**2) / 2" for p, q in (("z", "rt"), ("bl", "dg"), ("z", "bl"), ("rt", "dg"))
)
register(
    "surface_area_part", on_grid(lambda f: statistics.surface(area(f))),
    f"with {IN_AREA}{AROUND} select {FIELD}, {rounded(f'sum({_TRIANGLES})', 'surface_area', 2)}, {rounded('count(*)', 'projected_area', 2)}, {rounded(f'sum(sqrt({_GX}**2 + {_GY}**2))', 'variation', 2)} from nb where dg is not null", digits=2,
)
register(
    "inclination_part", on_grid(lambda f: statistics.inclination(area(f))),
    f"with {IN_AREA}{AROUND}, s as (select avg({_GX}) gx, avg({_GY}) gy from nb where dg is not null) select {FIELD}, {rounded('gx', 'slope_x')}, {rounded('gy', 'slope_y')}, {rounded('atan(sqrt(gx*gx + gy*gy))', 'theta')}, {rounded('atan2(gy, gx)', 'phi')} from s",
)
register(
    "slope_directions_part", on_grid(lambda f: distributions.slope_directions(area(f))),
    f"""with {IN_AREA}{AROUND}, g as (select {_GX} gx, {_GY} gy from nb where dg is not null), b as (select cast(floor(atan2(gy, gx) / (2 * pi()) * 36) as bigint) b, sqrt(gx*gx + gy*gy) s from g)
    select {FIELD}, {whole('((b % 36) + 36) % 36', 'bin')}, count(*) as n, {rounded('sum(s)', 'weight', 2)} from b group by ((b % 36) + 36) % 36""", digits=2,
)
register("count_in_range_part", on_grid(lambda f: statistics.count_in_range(area(f), 20000.0, 80000.0)), f"with {IN_AREA} select {FIELD}, count(*) filter (z < 20000) as n_below, count(*) filter (z > 80000) as n_above from px")
register("volume_above_part", on_grid(lambda f: statistics.volume_above(area(f), 1000.0)), f"with {IN_AREA} select {FIELD}, {rounded('sum(z - 1000)', 'volume', 2)} from px", digits=2)
register(
    "row_statistics_masked", on_grid(lambda f: statistics.line_statistics(f, "row", Masking.INCLUDE).select("field_id", "row", "n", "mean", "min", "max", "median")),
    f"with {IN_MASK} select {FIELD}, {whole('r', 'row')}, count(*) as n, {rounded('avg(z)', 'mean')}, {rounded('min(z)', 'min')}, {rounded('max(z)', 'max')}, {rounded('list_sort(list(z))[count(*) // 2 + 1]', 'median')} from px group by r",
)
register(
    "row_statistics_part", on_grid(lambda f: statistics.line_statistics(area(f)).select("field_id", "row", "n", "mean", "rms", "median")),
    f"with {IN_AREA} select {FIELD}, {whole('r', 'row')}, count(*) as n, {rounded('avg(z)', 'mean')}, {rounded('stddev_pop(z)', 'rms')}, {rounded('list_sort(list(z))[count(*) // 2 + 1]', 'median')} from px group by r",
)
_SHIFTS = "from t a join t b on b.r - a.r between -3 and 3 and b.c - a.c between -3 and 3"
_CENTRED = f"with {PX}, t as (select r, c, z - (select avg(z) from px) d from px)"
register("autocorrelation_2d", on_grid(lambda f: spatial.autocorrelation_2d(f, 3)), f"{_CENTRED} select {FIELD}, {whole('b.c - a.c', 'dx')}, {whole('b.r - a.r', 'dy')}, {rounded('avg(a.d * b.d)', 'acf', 1)} {_SHIFTS} group by b.c - a.c, b.r - a.r", digits=1)
register(
    "radial_autocorrelation", on_grid(lambda f: spatial.radial_autocorrelation(f, 3)),
    f"{_CENTRED}, s as (select b.c - a.c dx, b.r - a.r dy, avg(a.d * b.d) f {_SHIFTS} group by all) select {FIELD}, {whole('floor(sqrt(dx*dx + dy*dy) + 0.5)', 'lag')}, count(*) as n, {rounded('avg(f)', 'acf', 1)} from s where floor(sqrt(dx*dx + dy*dy) + 0.5) <= 3 group by floor(sqrt(dx*dx + dy*dy) + 0.5)", digits=1,
)
register("angular_average", on_grid(lambda f: distributions.angular_average(f, 20.0, 15.0)), f"with {PX} select {FIELD}, {whole('floor(sqrt((c - 20)**2 + (r - 15)**2))', 'bin')}, count(*) as n, {rounded('avg(z)', 'z')} from px group by floor(sqrt((c - 20)**2 + (r - 15)**2))")
register("local_minima", cells(lambda f: grains.extrema(f, False)), f'with {PX}{_IN3} select {FIELD}, r as "row", c as col, {rounded("any_value(z)", "z")} from o group by r, c having count(*) filter (bz <= z) = 1')
register("outliers_between", cells(lambda f: statistics.outliers_between(f, 1.2, 1.8).withColumn("z", F.col("m"))), pixels("case when z - mu < -1.2 * sd or z - mu > 1.8 * sd then 1 else 0 end", "px, (select avg(z) mu, stddev_pop(z) sd from px)"))
register(
    "weighted_correlation", on_grid(lambda f: spatial.weighted_correlation(f.withColumn("weight", F.col("m") + 1), second(f))),
    f"with {PX}, w as (select z, q, m + 1 v from px), u as (select w.*, mz, mq from w, (select sum(v * z) / sum(v) mz, sum(v * q) / sum(v) mq from w)) select {FIELD}, {rounded('sum(v * (z - mz) * (q - mq)) / sqrt(sum(v * (z - mz)**2) * sum(v * (q - mq)**2))', 'score')} from u",
)

# --- rows, columns, shapes

_LINE = 'select cast(0 as bigint) as line_id'
register("field_row", on_grid(lambda f: geometry.line_of(f, 4)), f"with {PX} {_LINE}, {whole('c', 'i')}, {rounded('z', 'y')} from px where r = 4")
register("field_column", on_grid(lambda f: geometry.line_of(f, 4, "col")), f"with {PX} {_LINE}, {whole('r', 'i')}, {rounded('z', 'y')} from px where c = 4")
register("field_row_part", on_grid(lambda f: geometry.line_of(f, 4, "row", 3, 11)), f"with {PX} {_LINE}, {whole('c - 3', 'i')}, {rounded('z', 'y')} from px where r = 4 and c between 3 and 10")
register("field_column_part", on_grid(lambda f: geometry.line_of(f, 4, "col", 3, 11)), f"with {PX} {_LINE}, {whole('r - 3', 'i')}, {rounded('z', 'y')} from px where c = 4 and r between 3 and 10")
_PUT = "px left join (select r, c, z y from px) o on "
_PUT_SQL = f"with {PX} select {FIELD}, px.r as \"row\", px.c as col, {rounded('coalesce(o.y, px.z)', 'z')} from {_PUT}"
register("put_row", cells(lambda f: geometry.put_line(f, geometry.line_of(f, 4), 9)), f"{_PUT_SQL} px.r = 9 and o.r = 4 and o.c = px.c")
register("put_column", cells(lambda f: geometry.put_line(f, geometry.line_of(f, 4, "col"), 9, "col")), f"{_PUT_SQL} px.c = 9 and o.c = 4 and o.r = px.r")
register("put_row_part", cells(lambda f: geometry.put_line(f, geometry.line_of(f, 4, "row", 3, 11), 9, "row", 6)), f"{_PUT_SQL} px.r = 9 and px.c between 6 and 13 and o.r = 4 and o.c = px.c - 3")
register("put_column_part", cells(lambda f: geometry.put_line(f, geometry.line_of(f, 4, "col", 3, 11), 9, "col", 6)), f"{_PUT_SQL} px.c = 9 and px.r between 6 and 13 and o.c = 4 and o.r = px.r - 3")
_ELLIPSE = f"{INSIDE} and ((c - 5 + 0.5) * 0.1::double - 1)**2 + ((r - 3 + 0.5) * (2.0::double / 15) - 1)**2 <= 1"
_CIRCLE = "(c - 20)**2 + (r - 15)**2 <= 6.5::double**2"
for _name, _shape, _test in (("ellipse", AREA.ellipse, _ELLIPSE), ("circle", lambda: geometry.in_circle(20, 15, 6.5), _CIRCLE)):
    register(f"{_name}_extract", cells(lambda f, s=_shape: geometry.extract(f, s())), pixels("z", where=f"where {_test}"))
    register(f"{_name}_size", on_grid(lambda f, s=_shape: geometry.size_of(f, s())), f"with {PX} select {FIELD}, count(*) as n from px where {_test}")
    register(f"{_name}_put_back", cells(lambda f, s=_shape: geometry.put_back(f, geometry.extract(second(f), s()))), pixels(f"case when {_test} then q else z end"))
register("fill_circle", cells(lambda f: geometry.fill_shape(f, geometry.in_circle(20, 15, 6.5), -1.0)), pixels(f"case when {_CIRCLE} then -1 else z end"))
register("transpose", cells(geometry.transpose), f"with {PX} select {FIELD}, c as \"row\", r as col, {rounded('z', 'z')} from px")
register("roll", cells(geometry.roll), f"with {PX} select {FIELD}, (r + h // 2) % h as \"row\", (c + w // 2) % w as col, {rounded('z', 'z')} from px")
register("roll_and_back", cells(lambda f: geometry.roll(geometry.roll(f), True)), pixels("z"))

# --- filters on an area alone, and further ones

_REST = f"select {FIELD}, r as \"row\", c as col, {rounded('z', 'z')} from pw where not ({INSIDE})"


def on_area(of):
    return cells(lambda f: geometry.on_area(f, AREA, of))


def area_sql(ctes: str, expression: str, group: str) -> str:
    return f'with {IN_AREA}{ctes}, done as (select {FIELD}, r as "row", c as col, {rounded(expression, "z")} from o group by {group}) select * from done union all {_REST}'


_AREA_MIRROR3 = f""", s1 as (select r, c, z, unnest([-1, 0, 1]) dr from px), s2 as (select *, unnest([-1, 0, 1]) dc from s1),
  o as (select s2.r, s2.c, s2.z, dr, dc, b.z as bz from s2 join px b on b.r = least(greatest(s2.r + dr, {AREA.row}), {AREA.row + AREA.height - 1}) and b.c = least(greatest(s2.c + dc, {AREA.col}), {AREA.col + AREA.width - 1}))"""
for _name, _of, _sql in (
    ("mean", lambda f: filters.mean(f, 3), "avg(bz)"),
    ("rms", lambda f: filters.local_rms(f, 3), "stddev_pop(bz)"),
    ("median", lambda f: filters.median(f, 3), "list_sort(list(bz))[count(*) // 2 + 1]"),
    ("minimum", lambda f: filters.minimum(f, 3), "min(bz)"),
    ("maximum", lambda f: filters.maximum(f, 3), "max(bz)"),
    ("range", lambda f: filters.local_range(f, 3), "max(bz) - min(bz)"),
):
    register(f"filter_{_name}_area", on_area(_of), area_sql(_IN3, _sql, "r, c, z"))
register("filter_conservative_area", on_area(filters.conservative), area_sql(_IN3, "least(greatest(z, case when z = min(bz) then list_sort(list(bz))[2] else min(bz) end), case when z = max(bz) then list_sort(list(bz))[count(*) - 1] else max(bz) end)", "r, c, z"))
for _kernel in ("laplace", "sobel_x", "prewitt_x"):
    register(f"filter_{_kernel}_area", on_area(lambda f, k=_kernel: filters.kernel3(f, k)), area_sql(_AREA_MIRROR3, weighted(filters.KERNELS[_kernel]), "r, c"))
register("renormalize_area", on_area(lambda f: arithmetic.renormalize(f, 10.0, 2.0)), f"with {IN_AREA}, done as (select {FIELD}, r as \"row\", c as col, {rounded('(z - lo) / (hi - lo) * 10 + 2', 'z')} from px, (select min(z) lo, max(z) hi from px)) select * from done union all {_REST}")
register("filter_prewitt_total", cells(lambda f: filters.total(f, "prewitt_x", "prewitt_y")), convolved(f"sqrt({weighted(filters.KERNELS['prewitt_x'])}**2 + {weighted(filters.KERNELS['prewitt_y'])}**2)"))


def _central(part: str, order: str) -> str:
    over = f"over (partition by {part} order by {order})"
    return f"(coalesce(lead(z) {over}, z) - coalesce(lag(z) {over}, z)) / (case when lag(z) {over} is null then 0 else 1 end + case when lead(z) {over} is null then 0 else 1 end)"


register("slope_map", on_grid(filters.slope), f"with {PX}, g as (select r, c, {_central('r', 'c')} gx, {_central('c', 'r')} gy from px) select {FIELD}, r as \"row\", c as col, {rounded('sqrt(gx*gx + gy*gy)', 'slope')}, {rounded('atan2(-gy, -gx)', 'direction')} from g")
register(
    "filter_kuwahara", cells(filters.kuwahara),
    f"""with {PX}{_IN3}, sq as (select r, c, avg(bz) m, var_pop(bz) v from o group by r, c having count(*) = 9),
    f4 as (select px.r, px.c, px.z, s.m, s.v, row_number() over (partition by px.r, px.c order by round(s.v, 3), s.r, s.c) k, count(*) over (partition by px.r, px.c) n from px left join sq s on abs(s.r - px.r) = 1 and abs(s.c - px.c) = 1)
    select {FIELD}, r as "row", c as col, {rounded('case when n = 4 then m else z end', 'z', 2)} from f4 where k = 1""", digits=2,
)

# --- levelling, presentations, tools

_MU = "px, (select avg(z) mu, avg(z) filter (m <= 0) mn from px)"
register("correct_average", cells(lambda f: levelling.correct_average(f, False)), pixels("case when m > 0 then mu else z end", _MU))
register("correct_average_unmasked", cells(levelling.correct_average), pixels("case when m > 0 then mn else z end", _MU))
register("tilt", cells(lambda f: levelling.tilt(f, 2.5, -1.5)), pixels("z - 2.5 * c + 1.5 * r"))
_P = "(select max(z) filter (c = 2 and r = 3) z1, max(z) filter (c = 30 and r = 5) z2, max(z) filter (c = 10 and r = 28) z3 from px)"
register("level_three", cells(lambda f: levelling.level_three(f, [(2, 3), (30, 5), (10, 28)])), pixels("z - z1 - ((z2 - z1) * 25 - (z3 - z1) * 2) / 684.0::double * (c - 2) - ((z3 - z1) * 28 - (z2 - z1) * 8) / 684.0::double * (r - 3)", f"px, {_P}"))
register("log_scale", cells(arithmetic.log_scale), pixels("ln(1 + 1000 * (z - lo) / (hi - lo))", "px, (select min(z) lo, max(z) hi from px)"))
register(
    "to_volume", on_grid(lambda f: arithmetic.to_volume(geometry.crop(f, AREA), 6)),
    f"with {IN_AREA} select cast(0 as bigint) as brick_id, {whole('l', 'lev')}, r - 3 as \"row\", c - 5 as col, {rounded('case when l <= floor((z - lo) / (hi - lo) * 5) then 1 else 0 end', 'w')} from px, (select min(z) lo, max(z) hi from px), unnest(range(6)) u(l)",
)
register(
    "layers_to_volume", on_grid(lambda f: arithmetic.layers_to_volume(geometry.crop(f, AREA).select("field_id", "row", "col", "z").union(second(geometry.crop(f, AREA)).withColumn("field_id", F.lit(1)).select("field_id", "row", "col", "z")), [1, 0])),
    f"with {IN_AREA} select cast(0 as bigint) as brick_id, {whole('l', 'lev')}, r - 3 as \"row\", c - 5 as col, {rounded('case when l = 0 then q else z end', 'w')} from px, unnest(range(2)) u(l)",
)
register(
    "distances", on_grid(lambda f: statistics.distances(f, [(1, 2, 10, 5), (4, 4, 4, 20), (30, 9, 3, 2)])),
    f"""with {PX}, s(k, x1, y1, x2, y2) as (values (0, 1, 2, 10, 5), (1, 4, 4, 4, 20), (2, 30, 9, 3, 2)) select {FIELD}, {whole('k', 'k')}, {whole('x2 - x1', 'dx')}, {whole('y2 - y1', 'dy')},
    {rounded('sqrt((x2 - x1)**2 + (y2 - y1)**2)', 'length')}, {rounded('atan2(y1 - y2, x2 - x1)', 'angle')}, {rounded('b.z - a.z', 'dz')} from s join px a on a.c = x1 and a.r = y1 join px b on b.c = x2 and b.r = y2""",
)
register("read_values", on_grid(lambda f: statistics.read_values(f, [(5, 6), (0, 0), (12, 20)], 2)), f"with {PX}, s(k, x, y) as (values (0, 5, 6), (1, 0, 0), (2, 12, 20)) select {FIELD}, {whole('k', 'k')}, count(*) as n, {rounded('avg(z)', 'z')} from s join px on (c - x)**2 + (r - y)**2 <= 4 group by k")

# --- transforms

register("transform_2d_round_trip", cells(lambda f: spatial.transform_2d(spatial.transform_2d(f), True)), pixels("z"))
for _axis, _along, _other in (("x", "c", "r"), ("y", "r", "c")):
    register(
        f"haar_{_axis}", on_grid(lambda f, a=_axis: spatial.haar_rows(f, a)),
        f"""with {PX} select {FIELD}, {whole('a.' + ('r' if _axis == 'x' else 'r // 2'), 'row')}, {whole('a.' + ('c // 2' if _axis == 'x' else 'c'), 'col')}, {rounded('(a.z + b.z) / sqrt(2)', 'low')}, {rounded('(a.z - b.z) / sqrt(2)', 'high')}
        from px a join px b on b.{_other} = a.{_other} and b.{_along} = a.{_along} + 1 where a.{_along} % 2 = 0""",
    )

# --- grains

register("grainwise_rms", on_grid(lambda f: statistics.grainwise_rms(f, numbered(f))), grain_sql(f"select {FIELD}, {rounded('sqrt(sum((z - mu)**2) / count(*))', 'rms')} from (select z, avg(z) over (partition by g) mu from gr)"))
register(
    "grain_more_quantities", on_grid(lambda f: grains.more_quantities(f, numbered(f)).select("field_id", "grain", "volume_min", "half_area", "median", "ellipse_major", "ellipse_minor")),
    grain_sql(
        f"""select {FIELD}, g as grain, {rounded('sum(z - lo)', 'volume_min')}, count(*) filter (z >= (lo + hi) / 2) as half_area, {rounded('list_sort(list(z))[count(*) // 2 + 1]', 'median')},
        {rounded('sqrt(count(*) / pi() * sqrt((any_value(u + v) / 2 + sqrt((any_value(u - v) / 2)**2 + any_value(k)**2)) / (any_value(u + v) / 2 - sqrt((any_value(u - v) / 2)**2 + any_value(k)**2))))', 'ellipse_major')},
        {rounded('sqrt(count(*) / pi() / sqrt((any_value(u + v) / 2 + sqrt((any_value(u - v) / 2)**2 + any_value(k)**2)) / (any_value(u + v) / 2 - sqrt((any_value(u - v) / 2)**2 + any_value(k)**2))))', 'ellipse_minor')}
        from (select *, min(z) over (partition by g) lo, max(z) over (partition by g) hi, var_pop(c) over (partition by g) + 1 / 12 u, var_pop(r) over (partition by g) + 1 / 12 v, covar_pop(c, r) over (partition by g) k from gr) group by g"""
    ),
)
register("grain_boundary_values", on_grid(lambda f: grains.boundary_values(f, numbered(f))), grain_sql(f"select {FIELD}, g as grain, {rounded('min(z)', 'boundary_min')}, {rounded('max(z)', 'boundary_max')} from gr left join (select p, count(*) k from eg group by p) t on t.p = gr.p where coalesce(k, 0) < 4 group by g"))
register(
    "grain_radii", on_grid(lambda f: grains.radii(numbered(f))),
    grain_sql(
        f""", ce as (select g, avg(c) x, avg(r) y from gr group by g), sd as (select gr.g, gr.c, gr.r, d.dx, d.dy from gr, (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)),
        ou as (select sd.* from sd left join gr n on n.r = sd.r + dy and n.c = sd.c + dx where n.p is null) select {FIELD}, ou.g as grain, {rounded('avg(sqrt((c + dx / 2 - x)**2 + (r + dy / 2 - y)**2))', 'mean_radius')} from ou join ce on ce.g = ou.g group by ou.g"""
    ),
)
_KEPT = f"{MASK}, case when s.g is null then 0.0 else 1.0 end::double as z from px left join gr on gr.r = px.r and gr.c = px.c left join (select g from gr group by g having "
_END = ") s on s.g = gr.g"
register("grain_remove_by_number", cells(lambda f: grains.remove_by_number(f, numbered(f), 3).withColumn("z", F.col("m"))), grain_sql(f"{_KEPT} g <> 3{_END}"))
register("grain_remove_by_height", cells(lambda f: grains.remove_by_height(f, numbered(f), 60000.0).withColumn("z", F.col("m"))), grain_sql(f"{_KEPT} max(z) <= 60000{_END}"))
register("grain_remove_at", cells(lambda f: grains.remove_at(f, numbered(f), 10, 12).withColumn("z", F.col("m"))), grain_sql(f"{_KEPT} count(*) filter (r = 10 and c = 12) = 0{_END}"))
register("grain_extract_at", cells(lambda f: grains.extract_at(f, numbered(f), 10, 12).withColumn("z", F.col("m"))), grain_sql(f"{_KEPT} count(*) filter (r = 10 and c = 12) > 0{_END}"))
register(
    "grain_size_histogram", on_grid(lambda f: distributions.of_quantity(grains.quantities(f, numbered(f)), "pixels", 10)),
    grain_sql(
        f""", k as (select g, count(*)::double z from gr group by g), e as (select min(z) lo, max(z) hi, count(*) n from k), b as (select least(cast(floor((z - lo) / (hi - lo) * 10) as bigint), 9) bin, lo, hi, n, count(*) k from k, e group by all)
        select {FIELD}, {whole('bin', 'bin')}, {rounded('lo + (bin + 0.5) * (hi - lo) / 10', 'x')}, k as n, {rounded('k / (n * (hi - lo) / 10)', 'density')} from b"""
    ),
)
_BOX = f"from (select min(c) x0, max(c) x1, min(r) y0, max(r) y1, max(w) w, max(h) h from px where z > 60000)"
register("mask_autocrop", on_grid(lambda f: grains.autocrop(grains.mark_range(f, 60000.0, 1e9))), f"with {PX} select {FIELD}, {whole('x0', 'left')}, {whole('y0', 'top')}, {whole('x1 - x0 + 1', 'width')}, {whole('y1 - y0 + 1', 'height')} {_BOX}")
register(
    "mask_autocrop_symmetric", on_grid(lambda f: grains.autocrop(grains.mark_range(f, 60000.0, 1e9), True)),
    f"with {PX} select {FIELD}, {whole('least(x0, w - 1 - x1)', 'left')}, {whole('least(y0, h - 1 - y1)', 'top')}, {whole('w - 2 * least(x0, w - 1 - x1)', 'width')}, {whole('h - 2 * least(y0, h - 1 - y1)', 'height')} {_BOX}",
)
register("mask_range", cells(lambda f: grains.mark_range(f, 20000.0, 30000.0).withColumn("z", F.col("m"))), pixels("case when z between 20000 and 30000 then 1 else 0 end"))
register("mark_height", cells(lambda f: grains.mark_by_threshold(f, 0.3, True).withColumn("z", F.col("m"))), pixels("case when z < lo + 0.3 * (hi - lo) then 1 else 0 end", "px, (select min(z) lo, max(z) hi from px)"))
_G = f"with {PX}, g as (select r, c, sqrt(({_central('r', 'c')})**2 + ({_central('c', 'r')})**2) s from px)"
register(
    "mark_slope", cells(lambda f: grains.mark_by_threshold(filters.slope(f).withColumn("z", F.col("slope")), 0.4).withColumn("z", F.col("m"))),
    f'{_G} select {FIELD}, r as "row", c as col, {rounded("case when s > lo + 0.4 * (hi - lo) then 1 else 0 end", "z")} from g, (select min(s) lo, max(s) hi from g)',
)
register(
    "mark_curvature", cells(lambda f: grains.mark_by_threshold(filters.kernel3(f, "laplace"), 0.55).withColumn("z", F.col("m"))),
    f'with {PX}{_MIRROR3}, l as (select r, c, {weighted(filters.KERNELS["laplace"])} s from o group by r, c) select {FIELD}, r as "row", c as col, {rounded("case when s > lo + 0.55 * (hi - lo) then 1 else 0 end", "z")} from l, (select min(s) lo, max(s) hi from l)',
)
register(
    "grain_distance", cells(lambda f: grains.distance(f, 3)),
    f"""with {PX}, n2 as (select a.r, a.c, min(abs(a.r - b.r) + abs(a.c - b.c)) d from px a join px b on b.m <= 0 and abs(a.r - b.r) + abs(a.c - b.c) <= 2 where a.m > 0 group by a.r, a.c)
    select {FIELD}, px.r as "row", px.c as col, {rounded('case when m <= 0 then 0 else coalesce(d, 3) end', 'z')} from px left join n2 on n2.r = px.r and n2.c = px.c""",
)
