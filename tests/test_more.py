"""Operators of ``queries_more`` and ``queries_fields`` that SQL cannot express, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import array, field

from terrace.functions import formulas
from terrace.operators import arithmetic, geometry, grains, levelling, lines, spatial, statistics, volume


def test_two_dimensional_transform(spark):
    z = np.random.default_rng(1).standard_normal((5, 7))
    got = spatial.transform_2d(field(spark, z))
    want = np.fft.fft2(z, norm="ortho")
    assert np.allclose(array(got, "re") + 1j * array(got, "im"), want)
    assert np.allclose(array(spatial.transform_2d(got, True)), z)


def test_radial_spectrum_peaks_at_the_wave(spark):
    y, x = np.mgrid[0:24, 0:24]
    rows = {r.bin: r.psdf for r in spatial.radial_spectrum(field(spark, 5 + np.sin(2 * np.pi * (3 * x + 4 * y) / 24))).collect()}
    assert max(rows, key=rows.get) == 5 and 0 not in rows


def test_formulas_that_cannot_be_read():
    for text in ("", "1 +", "d1 d2", "sqrt(1, 2)", "pow(1)", "unknown", "import('os')", "d1.real", "'a'", "[1]", "min(d1)", "f(1)", "d1 < 2"):
        with pytest.raises(ValueError, match="."):
            formulas.column(text, {"d1": F.lit(1.0)})


def test_formula_precedence(spark):
    value = lambda text: spark.range(1).select(formulas.column(text, {}).alias("v")).first().v
    assert [value(t) for t in ("-2^2", "2^3^2", "2^-1", "7 % 4 - ~1", "-(1 + 2)*3", "1/0", "5 % 0")] == [-4, 512, 0.5, 4, -9, None, None]


def test_median_with_infinite_values(spark):
    inf = float("inf")
    values = [float(i) for i in range(20_001)] + [inf]
    frames = {"one": values, "low": [-inf] * 3 + [1.0], "high": [inf, inf, 1.0], "none": [float("nan"), None], "wide": [-1.7e308, 1.7e308, 0.0] * 5000}
    df = spark.createDataFrame([(k, v) for k, vs in frames.items() for v in vs], "k string, z double")
    got = {r.k: r.median for r in statistics.upper_median(df, ["k"], sorted_values=1000).collect()}
    assert got == {"one": 10_001.0, "low": -inf, "high": inf, "wide": 0.0}


def test_lines_of_one_sample_and_places_outside(spark):
    df = spark.createDataFrame([(1, 0, 2.5), (2, 0, 1.0), (2, 1, 3.0)], "line_id int, i int, y double")
    got = {(r.line_id, r.x): r.y for r in lines.sample(df, [0.0, 0.5, 1.0, 7.0], "linear").collect()}
    assert got == {(1, 0.0): 2.5, (2, 0.0): 1.0, (2, 0.5): 2.0, (2, 1.0): 3.0}
    assert {r.line_id: (r.tan_beta0, r.median) for r in lines.part_statistics(df).collect()} == {1: (0.0, 2.5), 2: (2.0, 3.0)}
    assert lines.part_statistics(df, 5, 9).count() == 0


def test_ellipse_of_a_tilted_grain(spark):
    y, x = np.mgrid[0:60, 0:60]
    a, b, t = 20.0, 8.0, 0.6
    u, v = (x - 30) * np.cos(t) + (y - 30) * np.sin(t), -(x - 30) * np.sin(t) + (y - 30) * np.cos(t)
    f = field(spark, 2.0 * x - y, ((u / a) ** 2 + (v / b) ** 2 <= 1).astype(float))
    r = grains.more_quantities(f, grains.number(f)).first()
    assert abs(r.ellipse_major - a) < 0.3 and abs(r.ellipse_minor - b) < 0.3 and abs(r.ellipse_angle - t) < 0.02
    assert (round(r.slope_x, 9), round(r.slope_y, 9)) == (2, -1)


def test_level_three_needs_a_triangle_and_area_keeps_the_rest(spark):
    from terrace.functions.selection import Region
    from terrace.operators import levelling

    f = field(spark, np.arange(30.0).reshape(5, 6))
    with pytest.raises(ValueError, match="one line"):
        levelling.level_three(f, [(0, 0), (1, 1), (2, 2)])
    done = array(geometry.on_area(f, Region(1, 1, 3, 2), lambda part: arithmetic.fill(part, -1.0)))
    assert (done[1:3, 1:4] == -1).all() and (done == -1).sum() == 6


def test_nearest_finds_all_that_there_are(spark):
    from terrace.operators import points

    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 1, (40, 2)).tolist() + [[900.0, 900.0]]
    cloud = spark.createDataFrame([(0, i, *p) for i, p in enumerate(xy)] + [(1, 0, 5.0, 5.0)], "surface_id int, pt_id int, x double, y double")
    asked = cloud.where("pt_id % 20 = 0")
    got = {}
    for r in points.nearest(asked, cloud, 0.01, 3).collect():
        got.setdefault((r.surface_id, r.left_id), []).append((r.rank, r.right_id))
    for i in (0, 20, 40):
        order = sorted(range(41), key=lambda j: (np.hypot(xy[i][0] - xy[j][0], xy[i][1] - xy[j][1]), j))[:3]
        assert [j for _, j in sorted(got[0, i])] == order
    assert got[1, 0] == [(1, 0)]


def test_clusters_of_each_volume_alone(spark):
    from terrace.operators import volume

    rows = [(b, lev, 0, c, float(b * 1000 + (c % 2) * 10)) for b in (0, 1) for lev in range(3) for c in range(6)]
    got = volume.clusters(spark.createDataFrame(rows, "brick_id int, lev int, row int, col int, w double"), 2).collect()
    for b in (0, 1):
        of = {r.col: r.cluster for r in got if r.brick_id == b}
        assert len(of) == 6 and of[0] == of[2] == of[4] != of[1] == of[3] == of[5]


def values_of(sheet):
    return {(r.row, r.col): r.z for r in sheet.collect()}


def test_warps_of_known_fields(spark):
    sheet = field(spark, np.array([[3 * j + i for j in range(6)] for i in range(6)], float))
    assert values_of(geometry.rotate(sheet, 0.0)) == values_of(sheet)
    turned = values_of(geometry.rotate(sheet, math.pi))
    assert all(abs(z - (3 * (5 - j) + 5 - i)) < 1e-9 for (i, j), z in turned.items() if 0 < i < 5 and 0 < j < 5)
    assert values_of(geometry.shift(sheet, 0, 0)) == values_of(sheet)
    empty = sheet.limit(0)
    assert geometry.rotate(empty, 0.3).count() == 0 and geometry.shift(empty, 1, 1).count() == 0


def test_warp_gives_pixels_without_value_no_weight(spark):
    sheet = field(spark, np.array([[1, 2, 3]], float)).withColumn("z", F.when(F.col("col") != 1, F.col("z")))
    half = values_of(geometry.affine(sheet, (1, 0, 0, 1), (0.5, 0)))
    assert half[(0, 0)] == 1 and half[(0, 1)] == 3


def test_wavelet_keeps_energy_and_ignores_an_odd_pixel(spark):
    sheet = field(spark, np.array([[(7 * i + j * j) % 11 for j in range(9)] for i in range(3)], float))
    out = spatial.wavelet_rows(sheet, 4).collect()
    kept = sum(((7 * i + j * j) % 11) ** 2 for i in range(3) for j in range(8))
    assert len(out) == 12 and abs(sum(r.low**2 + r.high**2 for r in out) - kept) < 1e-9


def test_facets_of_a_plane_are_flat_after_levelling(spark):
    flat = levelling.level_facet(field(spark, np.array([[2 * j - 5 * i for j in range(5)] for i in range(4)], float)), 2)
    z = list(values_of(flat).values())
    assert max(z) - min(z) < 1e-9
    one = field(spark, np.full((1, 1), 4.0))
    assert values_of(levelling.level_facet(one)) == {(0, 0): 4.0}


def test_trimmed_rows_ignore_a_spike(spark):
    sheet = field(spark, np.array([[0] * 9 + [1000], [5] * 10], float))
    out = values_of(levelling.align_rows(sheet, "trimmed_mean", trim=0.1))
    assert out[(0, 0)] == out[(1, 0)] == 2.5
    out = values_of(levelling.align_rows(sheet, "trimmed_differences", trim=0.1))
    assert out[(0, 0)] == out[(1, 0)]


def test_correlation_map_of_a_constant_field_is_zero_inside(spark):
    out = values_of(spatial.correlation_map(field(spark, np.ones((3, 4))), [0, 1, 0, 1, 2, 1, 0, 1, 0], 3, 3))
    assert {k for k, z in out.items() if z == 0} == {(1, 1), (1, 2)} and out[(0, 0)] == -1


def test_hough_finds_the_marked_line(spark):
    mask = field(spark, np.array([[1 if i == 3 else 0 for _ in range(20)] for i in range(8)], float)).select("field_id", "row", "col", F.col("z").alias("m"))
    best = spatial.hough_lines(mask, 18).orderBy(F.desc("votes"), "angle", "distance").first()
    assert (best.angle, best.distance, best.votes) == (9, 3, 20)


def test_profile_statistics_of_one_level(spark):
    one = spark.createDataFrame([(0, 0, 1, 2, 5.0)], "brick_id int, lev int, row int, col int, w double")
    got = {how: volume.reduce_along(one, "lev", how).first().z for how in ("ra", "skew", "kurtosis", "median", "variation")}
    assert got == {"ra": 0.0, "skew": None, "kurtosis": None, "median": 5.0, "variation": 0.0}
    assert volume.zero_at(one, 3).first().w is None and volume.level_planes(one).first().w == 0.0
