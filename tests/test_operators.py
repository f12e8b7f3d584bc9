"""Operators that SQL cannot express, edge cases, formats, generators and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace import streaming
from terrace.functions.selection import Region
from terrace.operators import arithmetic, filters, geometry, grains, levelling, lines, spatial, statistics, volume
from terrace.sources import formats, synthetic, tables

SF = "/root/testdata/sf0.001"


def field(spark, z, mask=None):
    z = np.asarray(z, float)
    rows = [(0, r, c, float(z[r, c]), float(mask[r][c]) if mask is not None else 0.0) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "field_id int, row int, col int, z double, m double")


def array(df, name="z"):
    rows = df.collect()
    out = np.full((max(r.row for r in rows) + 1, max(r.col for r in rows) + 1), np.nan)
    for r in rows:
        out[r.row, r.col] = r[name]
    return out


def test_plane_gives_its_coefficients_and_levels_to_zero(spark):
    f = synthetic.blank(spark, 5, 4, 2 + 3.0 * F.col("col") - F.col("row"))
    row = levelling.plane_coefficients(f).first()
    assert (round(row.a, 9), round(row.bx, 9), round(row.by, 9)) == (2, 3, -1)
    assert np.abs(array(levelling.level_plane(f))).max() < 1e-9
    assert np.allclose(array(levelling.level_plane(f, keep_mean=True)), array(f).mean())


def test_polynomial_is_removed_and_noise_left(spark):
    f = synthetic.blank(spark, 20, 15, 1 + 0.1 * F.col("col") * F.col("row") - 0.02 * F.pow("col", F.lit(2)))
    assert np.abs(array(levelling.level_polynomial(f, 2))).max() < 1e-8


@pytest.mark.parametrize("limit", [1, 3, 10_000])
def test_upper_median_whatever_the_bound(spark, limit):
    rng = np.random.default_rng(3)
    groups = {0: [5.0] * 9, 1: [1, 2, 4, 9, 11, 12], 2: rng.lognormal(0, 5, 501).tolist(), 3: [7.5], 4: [1.0] * 400 + [1e9]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k int, z double")
    got = {r.k: r.median for r in statistics.upper_median(df, ["k"], sorted_values=limit).collect()}
    assert got == {k: sorted(vs)[len(vs) // 2] for k, vs in groups.items()}


def test_flat_field(spark):
    row = statistics.summary(field(spark, np.full((4, 4), 7.0))).first()
    assert (row.n, row.rms, row.skew, row.kurtosis, row.median) == (16, 0, None, None, 7)
    assert np.allclose(array(arithmetic.renormalize(field(spark, np.full((4, 4), 7.0)), 5, 1)), 1)


def test_empty_field(spark):
    empty = field(spark, np.zeros((1, 1))).limit(0)
    assert statistics.summary(empty).count() == 0
    assert grains.number(empty).count() == 0
    assert filters.median(empty, 3).count() == 0


@pytest.mark.parametrize("shape", [(1, 7), (7, 1), (8, 8), (7, 11)])
def test_orders_of_neighbouring_filters(spark, shape):
    z = np.random.default_rng(1).normal(size=shape)
    f = field(spark, z)
    low, high = array(filters.opening(f, 3)), array(filters.closing(f, 3))
    assert (array(filters.minimum(f, 3)) <= low).all() and (low <= z).all() and (z <= high).all() and (high <= array(filters.maximum(f, 3))).all()
    assert np.allclose(array(geometry.flip(geometry.flip(f, rows=True, columns=True), rows=True, columns=True)), z)
    assert np.allclose(array(geometry.quarter_turn(f)), np.rot90(z, -1))


def test_gaussian_against_numpy(spark):
    z = np.random.default_rng(2).normal(size=(9, 12))
    reach = 4
    k = np.exp(-np.arange(-reach, reach + 1) ** 2 / 2.0)
    k /= k.sum()
    wide = np.pad(z, reach, mode="symmetric")
    rows = np.array([[(k * wide[r, c : c + 2 * reach + 1]).sum() for c in range(z.shape[1])] for r in range(wide.shape[0])])
    want = np.array([[(k * rows[r : r + 2 * reach + 1, c]).sum() for c in range(z.shape[1])] for r in range(z.shape[0])])
    assert np.allclose(array(filters.gaussian(field(spark, z), 1.0)), want)


@pytest.mark.parametrize("mode, numpy_mode", [("edge", "edge"), ("mirror", "symmetric"), ("periodic", "wrap")])
def test_margins_wider_than_the_field(spark, mode, numpy_mode):
    z = np.arange(6.0).reshape(2, 3)
    got = array(geometry.extend(field(spark, z), 7, 5, 4, 3, mode))
    assert np.array_equal(got, np.pad(z, ((4, 3), (7, 5)), mode=numpy_mode))


def test_nearest_resampling(spark):
    z = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(array(geometry.resample(field(spark, z), 8, 6, linear=False)), z.repeat(2, 0).repeat(2, 1))


def test_parseval(spark):
    z = np.random.default_rng(4).normal(size=(3, 16))
    f = spatial.row_transform(field(spark, z))
    assert math.isclose(f.agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).first()[0], (z**2).sum())


def test_spectrum_peaks_at_the_wave(spark):
    f = synthetic.blank(spark, 64, 3, F.sin(2 * F.pi() * F.col("col") / 8))
    assert spatial.power_spectrum(f).orderBy(F.desc("psdf")).first().bin == 8


def test_grains_of_a_small_mask(spark):
    m = [[1, 0, 1, 1], [1, 0, 0, 1], [1, 1, 1, 1], [0, 0, 0, 0], [1, 0, 1, 1]]
    f = field(spark, np.zeros((5, 4)), m)
    got = array(grains.number(f), "grain")
    assert np.array_equal(np.nan_to_num(got), [[1, 0, 1, 1], [1, 0, 0, 1], [1, 1, 1, 1], [0, 0, 0, 0], [2, 0, 3, 3]])
    ring = [[1, 1, 1, 1], [1, 0, 0, 1], [1, 1, 1, 1], [0, 0, 0, 0]]
    assert array(grains.fill_voids(field(spark, np.zeros((4, 4)), ring)), "m").sum() == 12


def test_clusters_part_different_profiles(spark):
    rows = [(0, lev, 0, c, float((c % 2) * 10 + lev)) for lev in range(4) for c in range(8)]
    got = volume.clusters(spark.createDataFrame(rows, "brick_id int, lev int, row int, col int, w double"), 2).collect()
    assert len({(r.col % 2, r.cluster) for r in got}) == 2


def test_line_of_one_sample(spark):
    df = spark.createDataFrame([(1, 0, 5.0)], "line_id int, i int, y double")
    row = lines.statistics(df).first()
    assert (row.skew, row.kurtosis, row.length, row.rt) == (0, 0, 0, 0)
    assert lines.derivative(df).first().y == 0 and lines.resample(df, 3).count() == 3


def test_noise_is_seeded_and_normal(spark):
    a = array(synthetic.white_noise(spark, 80, 60, 2.0, 5))
    assert np.array_equal(a, array(synthetic.white_noise(spark, 80, 60, 2.0, 5).repartition(3)))
    assert abs(a.std() - 2) < 0.1 and abs(a.mean()) < 0.1


def test_formats_round_trip(spark, tmp_path):
    z = np.arange(6.0).reshape(2, 3) - 2
    (tmp_path / "a.field").write_bytes(formats.pack_simple_field(z, XReal=1e-6))
    assert np.array_equal(array(formats.read_simple_fields(spark, str(tmp_path / "*.field"))), z)
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes(range(6)))
    assert np.array_equal(array(formats.read_pgm(spark, str(tmp_path / "*.pgm"))), np.arange(6).reshape(2, 3))
    (tmp_path / "b.pgm").write_bytes(formats.pack_pgm(z))
    assert array(formats.read_pgm(spark, str(tmp_path / "b.pgm"))).max() == 65535
    (tmp_path / "a.raw").write_bytes(b"??" + z.astype(">i2").tobytes())
    assert np.array_equal(array(formats.read_raw(spark, str(tmp_path / "a.raw"), 3, 2, ">i2", 2, 0.5, 1.0)), z * 0.5 + 1)
    f = field(spark, z)
    formats.write_matrix(f, str(tmp_path / "matrix"))
    assert sum(r.z for r in formats.read_matrix(spark, str(tmp_path / "matrix")).collect()) == z.sum()
    (tmp_path / "m.txt").write_text("# heights\n1 2 3\n\n4,5,x\n")
    got = formats.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.z) for r in got] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, None)]
    pts = spark.createDataFrame([(0, 1.0, 2.0, 3.5), (0, -1.0, 0.0, 2.0)], "surface_id int, x double, y double, z double")
    formats.write_points(pts, str(tmp_path / "pts"))
    assert sorted((r.x, r.y, r.z) for r in formats.read_points(spark, str(tmp_path / "pts")).collect()) == [(-1, 0, 2), (1, 2, 3.5)]


@pytest.mark.parametrize("raw", [b"junk", b"X Simple Field 1.0\nXRes = 2\n\0\0", b"X Simple Field 1.0\nXRes = 9\nYRes = 9\n\0\0\0\0"])
def test_broken_simple_fields(raw):
    with pytest.raises(ValueError):
        formats.unpack_simple_field(raw)


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    near = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6), r.low, r.high) for r in df.collect())
    assert near(streaming.run_available(spark, SF, "events.parquet")) == near(streaming.windowed(events))


def test_regions_and_compatibility(spark):
    f = tables.grid(spark, SF)
    assert geometry.crop(f, Region(0, 0, 4, 3)).count() == 12
    schema = "field_id int, xres int, yres int, xreal double, yreal double, unit_xy string, unit_z string"
    a = spark.createDataFrame([(0, 4, 3, 1.0, 1.0, "m", "m")], schema)
    b = spark.createDataFrame([(0, 4, 6, 1.0, 2.0, "m", "V")], schema)
    assert arithmetic.incompatibility(a, b).first().flags == 1 + 2 + 16
