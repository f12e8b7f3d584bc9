"""Convex outlines and scaling against plain numpy."""

import math

import numpy as np
import pytest
from test_operators import field

from terrace.operators import fractals, grains, hulls


def test_outlines_by_brute_force(spark):
    mask = np.random.default_rng(3).random((24, 31)) < 0.5
    mask[2:7, 3:12] = True
    numbered = grains.number(field(spark, np.zeros(mask.shape), mask.astype(float))).cache()
    pixels = {}
    for p in numbered.collect():
        pixels.setdefault(p.grain, []).append((p.col, p.row))
    got = {r.grain: r for r in hulls.outlines(numbered).collect()}
    assert got.keys() == pixels.keys()
    for grain, places in pixels.items():
        corners = np.unique(np.array([(x + a, y + b) for x, y in places for a in (0, 1) for b in (0, 1)], float), axis=0)
        r = got[grain]
        # Twice the area, by the hull's edges: pairs with every corner on one side, the longest of each direction.
        edges = []
        for a in corners:
            for b in corners:
                side = (b[0] - a[0]) * (corners[:, 1] - a[1]) - (b[1] - a[1]) * (corners[:, 0] - a[0])
                if (a != b).any() and (side >= 0).all() and not any((side == 0) & (np.hypot(*(corners - a).T) > np.hypot(*(b - a)))) and not any((side == 0) & (np.hypot(*(corners - b).T) > np.hypot(*(b - a)))):
                    edges.append((a, b, side.max() / np.hypot(*(b - a))))
        assert r.hull_area == pytest.approx(sum(a[0] * b[1] - a[1] * b[0] for a, b, _ in edges) / 2)
        assert r.min_bound == pytest.approx(min(w for _, _, w in edges))
        away = np.hypot(*(corners[:, None] - corners[None]).transpose(2, 0, 1))
        assert r.max_bound == pytest.approx(away.max())
        for bound, angle in ((r.min_bound, r.min_angle), (r.max_bound, r.max_angle)):
            along = corners @ (math.cos(angle), -math.sin(angle))
            assert np.ptp(along) == pytest.approx(bound) and 0 <= angle < math.pi
        # The circle holds all corners, and no wider arc than half of it is free of them: so it is the smallest.
        d = corners - (r.circle_x, r.circle_y)
        assert np.hypot(*d.T).max() == pytest.approx(r.circle_r)
        on = np.sort(np.arctan2(*d[np.hypot(*d.T) > r.circle_r * (1 - 1e-9)].T))
        assert np.diff(np.append(on, on[0] + 2 * np.pi)).max() <= np.pi + 1e-6


def test_outlines_of_a_pixel_and_of_nothing(spark):
    one = field(spark, np.zeros((3, 3)), [[0, 0, 0], [0, 1, 0], [0, 0, 0]])
    r = hulls.outlines(grains.number(one)).first()
    assert (r.hull_area, r.min_bound, r.circle_x, r.circle_y) == (1, 1, 1.5, 1.5) and r.circle_r == pytest.approx(math.sqrt(0.5))
    assert hulls.outlines(grains.number(field(spark, np.zeros((2, 2))))).count() == 0


def test_scaling_of_planes_and_constants(spark):
    y, x = np.mgrid[0:33, 0:33]
    plane = fractals.square(field(spark, 1.0 * x))
    assert fractals.triangulation_dimension(plane).first().dimension == pytest.approx(2)
    rows = {r.level: r.log_variance for r in fractals.partitioning(plane).collect()}
    share = {k: (1 - 2.0 ** (k - 5)) ** 2 for k in range(1, 5)}
    assert rows == {k: pytest.approx(math.log((4.0**k - 1) / 12 * share[k])) for k in range(1, 5)}
    flat = fractals.square(field(spark, np.full((9, 9), 2.0)))
    assert fractals.triangulation(flat).count() == 0
    assert all(r.log_variance is None for r in fractals.partitioning(flat).collect())
