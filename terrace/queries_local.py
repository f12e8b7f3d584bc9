"""Registered queries of local planes, Legendre bases and spectra of lines, in the manner of ``terrace.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.functions.selection import Masking
from terrace.operators import fractals, levelling, lines, local
from terrace.queries import CELL, PX, cells, line_query, on_grid, register, rounded, whole

# --- planes of the squares around pixels; s0 as its root, 0 where it is no more than rounding

_QUANTITIES = ("mean", "bx", "by", "slope", "rms")
for _size in (2, 5):
    _before, _after = (_size - 1) // 2, _size // 2
    register(
        f"local_planes_{_size}",
        on_grid(lambda f, s=_size: local.planes(f, s).withColumn("rms", F.when(F.col("s0") < 4e-4, 0.0).otherwise(F.sqrt("s0"))).select("field_id", "row", "col", *_QUANTITIES)),
        f"""with {PX}, nb as (select a.r, a.c, b.z, b.c - a.c x, b.r - a.r y from (select r, c, dr, unnest(range(-{_before}, {_after} + 1)) dc from (select r, c, unnest(range(-{_before}, {_after} + 1)) dr from px)) a join px b on b.r = a.r + dr and b.c = a.c + dc),
        f as (select r, c, avg(z) m, coalesce(covar_pop(x, z) / nullif(var_pop(x), 0), 0) bx, coalesce(covar_pop(y, z) / nullif(var_pop(y), 0), 0) ky, avg(x) mx, avg(y) my from nb group by r, c),
        e as (select r, c, m, bx, ky, sqrt(sum((z - m - bx * (x - mx) - ky * (y - my)) ** 2)) rms from nb join f using (r, c) group by all)
        select {CELL}, {rounded('m', 'mean')}, {rounded('bx', 'bx')}, {rounded('ky', 'by')}, {rounded('sqrt(bx * bx + ky * ky)', 'slope')}, {rounded('case when rms < 0.02 then 0 else rms end', 'rms')} from e""",
    )

# --- Legendre bases: on a whole grid 1, x and x^2 less its mean are orthogonal, as are their products with those of y

_BASE = """fx as (select c, unnest([0, 1, 2]) i, unnest([1, x, x * x - avg(x * x) over ()]) f from (select c, 2.0 * c / nullif(w - 1, 0) - 1 x from px where r = 0)),
  fy as (select r, unnest([0, 1, 2]) j, unnest([1, y, y * y - avg(y * y) over ()]) g from (select r, 2.0 * r / nullif(h - 1, 0) - 1 y from px where c = 0))"""
for _of, _m in (("z", "z"), ("mask", "m")):
    register(
        f"level_legendre_{_of}",
        cells(lambda f, v=_m: levelling.level_legendre(f.withColumn("z", F.col(v)), 2, 2)),
        f"""with {PX}, {_BASE}, co as materialized (select i, j, sum({_m} * f * g) / sum(f * f * g * g) k from px join fx using (c) join fy using (r) group by i, j),
        fit as (select r, c, sum(k * f * g) v from px join fx using (c) join fy using (r) join co using (i, j) group by r, c) select {CELL}, {rounded(f'{_m} - v', 'z')} from px join fit using (r, c)""",
    )
#: Fitted to the pixels outside the mask.
register(
    "level_legendre_masked_rows", cells(lambda f: levelling.level_legendre(f, 1, 0, masking=Masking.EXCLUDE)),
    f"with {PX}, k as (select regr_slope(z, c) b, regr_intercept(z, c) a from px where m <= 0) select {CELL}, {rounded('z - a - b * c', 'z')} from px, k",
)

# --- an arc of four pixels rolled along rows

_ARC = "(select stddev_pop(z) from px) / sqrt(2.0 / 3 - pi() / 16) * (d * d / 16.0 / (1 + sqrt(1 - d * d / 16.0)))"
register(
    "revolved_arc", cells(lambda f: levelling.revolved_arc(f, 4.0)),
    f"""with {PX}, he as (select r, c, greatest(z, avg(z) over o - 2.5 * stddev_pop(z) over o) t from px window o as (partition by r order by c rows between 2 preceding and 1 following)),
    ar as (select d, {_ARC} u from (select unnest(range(-4, 5)) d)) select cast(0 as bigint) as field_id, he.r as "row", he.c as col, {rounded('min(b.t + u)', 'z')} from he, ar, he b where b.r = he.r and b.c = he.c + d group by he.r, he.c""",
)

# --- spectra

_HANN = "(0.5 - 0.5 * cos(2 * pi() * (i + 0.5) / n))"
line_query(
    "power_spectrum", lambda d: lines.power_spectrum(d, "hann"),
    f""", dv as (select line_id, i, count(*) over (partition by line_id) n, y - avg(y) over (partition by line_id) y from ln), wn as (select *, sqrt(avg({_HANN} ** 2) over (partition by line_id)) u from dv),
    fr as (select line_id, n, k, sum(y * {_HANN} / u * cos(2 * pi() * k * i / n)) re, sum(y * {_HANN} / u * sin(2 * pi() * k * i / n)) im from (select *, unnest(range(n // 2 + 1)) k from wn) group by all)
    select line_id, {whole('k', 'bin')}, {rounded('2 * pi() * k / n', 'k')}, {rounded('(re * re + im * im) / (2 * pi() * n)', 'psdf')} from fr""",
)
_SPECTRUM = f"""{PX}, dv as (select r, c i, w n, z - avg(z) over (partition by r) y from px), wn as (select *, sqrt(avg({_HANN} ** 2) over (partition by r)) u from dv),
  fr as (select r, n, k, sum(y * {_HANN} / u * cos(2 * pi() * k * i / n)) re, sum(y * {_HANN} / u * sin(2 * pi() * k * i / n)) im from (select *, unnest(range(1, n // 2 + 1)) k from wn) group by all),
  sp as (select k, ln(k) x, ln(avg((re * re + im * im) / (2 * pi() * n))) y from fr group by k)"""
register("fractal_spectrum", on_grid(fractals.spectral), f"with {_SPECTRUM} select cast(0 as bigint) as field_id, {whole('k', 'bin')}, {rounded('x', 'log_frequency')}, {rounded('y', 'log_power')} from sp")
register("fractal_spectral_dimension", on_grid(fractals.spectral_dimension), f"with {_SPECTRUM} select cast(0 as bigint) as field_id, {rounded('3.5 + regr_slope(y, x) / 2', 'dimension')} from sp")
