"""Known parameters recovered, many groups at once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrace.operators import fitting


def test_curves_recovered(spark):
    rng = random.Random(3)
    true = {i: (rng.uniform(-5, 5), rng.uniform(2, 9), rng.uniform(-3, 3), rng.uniform(0.5, 2)) for i in range(12)}
    rows = [(i, x / 10, y0 + a * math.exp(-((x / 10 - x0) ** 2) / (2 * s * s))) for i, (y0, a, x0, s) in true.items() for x in range(-60, 61)]
    rows += [(0, None, 1.0), (0, 1.0, float("nan"))]
    got = fitting.fit_curves(spark.createDataFrame(rows, "curve_id int, x double, y double"), "gaussian").collect()
    assert len(got) == 12
    for r in got:
        assert (r.y0, r.a, r.x0, abs(r.s)) == pytest.approx(true[r.curve_id], abs=1e-6) and r.settled and r.n == 121 and r.rms < 1e-6


def test_noise_and_errors(spark):
    rng = random.Random(5)
    rows = [(1, x / 7, 2 + 5 * math.exp(-x / 7 / 1.5) + rng.gauss(0, 0.01)) for x in range(60)]
    r = fitting.fit_curves(spark.createDataFrame(rows, "curve_id int, x double, y double"), "exponential").first()
    for name, value in (("y0", 2), ("a", 5), ("b", -1.5)):
        assert abs(r[name] - value) < 5 * r[f"{name}_err"] and 0 < r[f"{name}_err"] < 0.1
    assert 0.005 < r.rms < 0.02


def test_shapes(spark):
    def field(of, masked=lambda r, c: 0.0):
        return spark.createDataFrame([(0, r, c, float(of(c, r)), masked(r, c)) for r in range(18) for c in range(22)], "field_id int, row int, col int, z double, m double")

    ball = field(lambda x, y: 4 + math.sqrt(900 - (x - 9.5) ** 2 - (y - 8) ** 2) - 30 if (x, y) != (3, 3) else 99.0, lambda r, c: float((c, r) == (3, 3)))
    r = fitting.fit_shape(ball, "sphere").first()
    assert (abs(1 / r.c), r.x0, r.y0, r.z0) == pytest.approx((30, 9.5, 8, 4), abs=1e-5) and r.n == 18 * 22 - 1
    dish = field(lambda x, y: 1 + 0.3 * ((x - 4) ** 2 + (y - 7) ** 2))
    r = fitting.fit_shape(dish, "paraboloid").first()
    assert (r.z0, r.a, r.x0, r.y0) == pytest.approx((1, 0.3, 4, 7), abs=1e-7)
    assert fitting.without_shape(dish, "paraboloid").agg(F.max(F.abs("z"))).first()[0] < 1e-6


def test_too_few_and_none(spark):
    few = spark.createDataFrame([(1, 0.0, 2.0)], "curve_id int, x double, y double")
    r = fitting.fit_curves(few, "line").first()
    assert r.a == pytest.approx(2) and r.a_err is None
    assert fitting.fit_curves(few.where("x > 1"), "line").count() == 0
