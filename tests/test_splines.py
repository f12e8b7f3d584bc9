"""Paths through points against a dense numerical walk along their cubics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_regions import field

from terrace.operators import splines


def paths(spark, points, path_id=0):
    rows = [(path_id, i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "path_id int, i int, x double, y double")


def cubics(points, slack, closed):
    """Bezier corners of every segment."""
    p = np.asarray(points, float)
    n = len(p)
    out = []
    for j in range(n if closed else n - 1):
        at = lambda k: p[k % n] if closed or 0 <= k < n else None
        before, a, b, after = at(j - 1), at(j), at(j + 1), at(j + 2)
        own = math.dist(a, b)
        u = v = None
        if before is not None:
            both = own + math.dist(before, a)
            u = a + slack * (own / both if both else 0.5) * (b - before) / 2
        if after is not None:
            both = own + math.dist(b, after)
            v = b - slack * (own / both if both else 0.5) * (after - a) / 2
        if slack == 0 or (u is None and v is None):
            u, v = (2 * a + b) / 3, (a + 2 * b) / 3
        elif u is None:
            u = ((2 - slack) * a + slack * v) / 2
        elif v is None:
            v = ((2 - slack) * b + slack * u) / 2
        out.append((a, u, v, b))
    return out


def walk(points, slack, closed, samples, fine=40000):
    t = np.linspace(0, 1, fine + 1)[:, None]
    places = [(1 - t) ** 3 * a + 3 * t * (1 - t) ** 2 * u + 3 * t * t * (1 - t) * v + t**3 * b for a, u, v, b in cubics(points, slack, closed)]
    all_of = np.concatenate([places[0][:1], *(p[1:] for p in places)])
    arc = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(all_of, axis=0).T))])
    if closed:
        at = np.arange(samples) * arc[-1] / samples
    else:
        at = np.linspace(0, arc[-1], samples) if samples > 1 else np.array([arc[-1] / 2])
    return arc[-1], np.stack([np.interp(at, arc, all_of[:, c]) for c in (0, 1)], 1)


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("slack", [0.0, 0.5, math.sqrt(0.5), 1.3])
def test_samples(spark, closed, slack, monkeypatch):
    monkeypatch.setattr(splines, "BLOCK", 3)  # so that segments and sums pass from block to block
    points = np.random.default_rng(3).normal(0, 10, (11, 2))
    length, want = walk(points, slack, closed, 37)
    got = splines.sample_uniformly(paths(spark, points), 37, slack, closed).orderBy("k").toPandas()
    assert got.k.tolist() == list(range(37))
    assert got[["x", "y"]].to_numpy() == pytest.approx(want, abs=1e-5)
    assert np.hypot(got.tx, got.ty).to_numpy() == pytest.approx(np.ones(37))
    row = splines.lengths(paths(spark, points), slack, closed).first()
    assert (row.n, row.length) == (11, pytest.approx(length, rel=1e-7))


def test_circle(spark):
    """A closed path through many points of a circle is one: its samples stand at equal angles, tangents across."""
    a = np.arange(200) * 2 * math.pi / 200
    points = np.stack([5 * np.cos(a), 5 * np.sin(a)], 1)
    got = splines.sample_uniformly(paths(spark, points), 50, 2 / 3, True).orderBy("k").toPandas()
    b = np.arange(50) * 2 * math.pi / 50
    assert got[["x", "y", "tx", "ty"]].to_numpy() == pytest.approx(np.stack([5 * np.cos(b), 5 * np.sin(b), -np.sin(b), np.cos(b)], 1), abs=1e-4)


def test_few_points_and_unusable_ones(spark):
    rows = [("one", 0, 2.0, 3.0), ("two", 0, 0.0, 0.0), ("two", 1, None, 4.0), ("two", 2, float("nan"), 4.0), ("two", 3, 6.0, 8.0), ("same", 0, 1.0, 1.0), ("same", 1, 1.0, 1.0), ("none", 0, None, None)]
    df = spark.createDataFrame(rows, "path_id string, i int, x double, y double")
    got = {(r.path_id, r.k): tuple(r)[2:] for r in splines.sample_uniformly(df, 3).collect()}
    assert {p for p, _ in got} == {"one", "two", "same"} and len(got) == 9
    assert got["two", 1] == pytest.approx((3, 4, 0.6, 0.8)) and got["two", 2] == pytest.approx((6, 8, 0.6, 0.8))
    assert got["one", 2] == (2, 3, 0, 0) and got["same", 0] == (1, 1, 0, 0)
    single = splines.sample_uniformly(df.where("path_id = 'two'"), 1).collect()
    assert [tuple(r)[1:] for r in single] == [pytest.approx((0, 3, 4, 0.6, 0.8))]
    assert {r.path_id: (r.n, r.length) for r in splines.lengths(df).collect()} == {"one": (1, 0.0), "two": (2, pytest.approx(10)), "same": (2, 0.0)}
    assert splines.sample_uniformly(df.limit(0), 3).count() == 0
    assert {r.k for r in splines.sample_uniformly(df.where("path_id = 'two'"), 5, closed=True).collect()} == set(range(5))
    with pytest.raises(ValueError, match="slackness"):
        splines.segments(df, 2.0)


def test_straighten(spark):
    z = np.add.outer(10 * np.arange(20.0), np.arange(30.0))
    got = splines.straighten(field(spark, z), paths(spark, [(4.5, 2.5), (4.5, 12.5)]), 3).toPandas()
    band = got.pivot(index="row", columns="col", values="z").to_numpy()
    # Down the rows: the first column lies to the path's left-hand side, at smaller x.
    assert band == pytest.approx(np.stack([z[2:13, c] for c in (3, 4, 5)], 1)) and got.m.sum() == 0
    across = splines.straighten(field(spark, z), paths(spark, [(2.5, 0.5), (12.5, 0.5)]), 5).toPandas()
    assert across.m.sum() == 2 * 11  # two of five lines lie off the field
    assert across[across.m > 0].z.to_numpy() == pytest.approx(across[across.m == 0].z.mean())


def test_only_segments_with_samples_are_cut(spark, monkeypatch):
    """Three samples of a path of 500 points cut a few segments, not all, and give the same places."""
    cut, pieces = [], splines._pieces
    monkeypatch.setattr(splines, "_pieces", lambda placed: (cut.append(placed.count()), pieces(placed))[1])
    paths = spark.range(500).select(F.lit(0).alias("path_id"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y"))
    got = sorted((r.k, round(r.x, 6), r.y, round(r.tx, 6)) for r in splines.sample_uniformly(paths, 3).collect())
    assert got == [(0, 0.0, 2.0, 1.0), (1, 249.5, 2.0, 1.0), (2, 499.0, 2.0, 1.0)]
    assert cut[0] <= 4
