"""Triangles of scattered points against their definition, over many cells and in one."""

import random

import pytest

from terrace.functions import mesh
from terrace.operators import triangulation


def clouds():
    rng = random.Random(4)
    yield "random", [(rng.random() * 9, rng.random() * 4) for _ in range(150)]
    yield "grid", [(float(x), float(y)) for x in range(12) for y in range(9)]
    # A third of the points in one tiny place, some far away.
    yield "crowded", [(rng.random() * 1e-3, rng.random() * 1e-3) for _ in range(70)] + [(rng.random() * 100, rng.random() * 100) for _ in range(50)] + [(1e4, 30.0), (-5e3, 1.0)]


def frame(spark, points, z=lambda x, y: 0.0):
    return spark.createDataFrame([(1, i, x, y, z(x, y)) for i, (x, y) in enumerate(points)], "surface_id int, pt_id long, x double, y double, z double")


@pytest.mark.parametrize("kind, points", list(clouds()), ids=lambda v: v if isinstance(v, str) else "")
def test_delaunay(spark, kind, points):
    got = {(r.a, r.b, r.c) for r in triangulation.delaunay(frame(spark, points), most=15).collect()}
    whole = mesh.Mesh(points).triangles()
    want = {t[k:] + t[:k] for t in whole for k in (t.index(min(t)),)}
    assert got == want
    for a, b, c in got:
        assert mesh.orient(points[a], points[b], points[c]) > 0
        assert not any(mesh.in_circle(points[a], points[b], points[c], p) for k, p in enumerate(points) if k not in (a, b, c))


def test_places_and_degenerate_clouds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.0, 0.0), (-0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (nan, 1.0), (1.0, inf), (2.0, 2.5)]
    df = frame(spark, rows, lambda x, y: x).union(spark.createDataFrame([(1, 99, None, 1.0, 0.0)], "surface_id int, pt_id long, x double, y double, z double"))
    assert {frozenset((r.a, r.b, r.c)) for r in triangulation.delaunay(df).collect()} <= {frozenset(t) for t in ((0, 2, 3), (2, 3, 6), (0, 2, 6), (0, 3, 6))}
    for few in ([], [(1.0, 1.0)], [(1.0, 1.0), (2.0, 2.0)], [(float(i), 2.0 * i) for i in range(6)]):
        assert triangulation.delaunay(frame(spark, few)).count() == 0


def test_planes_are_read_exactly(spark):
    rng = random.Random(6)
    points = [(0.0, 0.0), (10.0, 0.0), (0.0, 8.0), (10.0, 8.0)] + [(rng.random() * 10, rng.random() * 8) for _ in range(60)]
    got = triangulation.interpolate(frame(spark, points, lambda x, y: 3 * x - 2 * y + 1), 20, 16, most=20).collect()
    assert len(got) == 320
    for r in got:
        assert r.z == pytest.approx(3 * (r.col + 0.5) / 2 - 2 * (r.row + 0.5) / 2 + 1)
