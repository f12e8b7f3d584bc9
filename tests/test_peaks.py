"""Peaks, circles and blind tips against plain loops."""

import itertools
import math

import numpy as np
import pytest
from test_regions import array, field

from terrace.operators import peaks, tips


def greedy(z, count, skip, threshold):
    h, w = z.shape
    tops = [(r, c) for r, c in itertools.product(range(h), range(w)) if z[r, c] > threshold and all(z[r, c] > z[y, x] for y in range(max(r - 1, 0), min(r + 2, h)) for x in range(max(c - 1, 0), min(c + 2, w)) if (y, x) != (r, c))]
    kept = []
    for p in sorted(tops, key=lambda p: (-z[p], p)):
        if all(math.dist(p, q) > skip for q in kept):
            kept.append(p)
    return kept[:count]


def test_peaks(spark):
    z = np.random.default_rng(4).integers(0, 30, (17, 23)).astype(float)
    for skip in (1.0, 3.0, 6.5):
        got = peaks.maxima(field(spark, z), 12, skip, 5.0).orderBy("rank").collect()
        assert [(r.row, r.col) for r in got] == greedy(z, 12, skip, 5.0)
    y, x = np.mgrid[0:12, 0:12].astype(float)
    r = peaks.maxima(field(spark, 9 - (x - 5.3) ** 2 - (y - 6.2) ** 2)).collect()
    assert len(r) == 1 and (r[0].x, r[0].y) == pytest.approx((5.3, 6.2))
    assert peaks.maxima(field(spark, np.ones((4, 4)))).count() == 0


def test_circles(spark):
    m = np.zeros((20, 24))
    for dr, dc in peaks.ring(6):
        m[9 + dr, 11 + dc] = 1
    votes = array(peaks.hough_circles(field(spark, m, m), 6), m.shape)
    assert votes[9, 11] == votes.max() == len(peaks.ring(6)) == m.sum()
    want = np.zeros(m.shape)
    for (r, c), (dr, dc) in itertools.product(np.argwhere(m > 0).tolist(), peaks.ring(6)):
        if 0 <= r + dr < 20 and 0 <= c + dc < 24:
            want[r + dr, c + dc] += 1
    np.testing.assert_array_equal(votes, want)


def by_loops(z, size):
    """The same bound by plain loops, one pixel after another until nothing falls."""
    h, w = z.shape
    tip, c = np.zeros((size, size)), size // 2
    while True:
        before = tip.copy()
        for r, q in itertools.product(range(size - 1, h - size + 1), range(size - 1, w - size + 1)):
            for jx, ix in itertools.product(range(size), repeat=2):
                most = -np.inf
                for jd, id_ in itertools.product(range(size), repeat=2):
                    if z[r, q] - z[r + c - jd, q + c - id_] <= tip[jd, id_]:
                        most = max(most, z[r + jx - jd, q + ix - id_] + tip[jd, id_] - z[r, q])
                if -np.inf < most < tip[jx, ix]:
                    tip[jx, ix] = most
        if np.array_equal(tip, before):
            return tip


def test_blind_tip(spark):
    random = np.random.default_rng(7)
    surface = np.zeros((16, 17))
    surface[random.integers(4, 12, 4), random.integers(4, 13, 4)] = 6
    true = tips.paraboloid(5, 0.5)
    image = array(tips.dilate(field(spark, surface), true), surface.shape)
    got = np.array(tips.blind_estimate(field(spark, image), 5)).reshape(5, 5)
    np.testing.assert_allclose(got, by_loops(image, 5), atol=1e-12)
    assert np.all(got >= np.array(true).reshape(5, 5) - 1e-12) and got.min() < 0  # never sharper than the tip that made the image
    few = [np.array(tips.blind_estimate(field(spark, image), 5, rounds=n)) for n in (1, 2)]
    assert np.all(few[1] <= few[0])
    assert tips.blind_estimate(field(spark, image[:4, :4]), 5) == [0.0] * 25


@pytest.mark.parametrize("centre", ["mean", "median"])
def test_clusters_settle(spark, centre):
    """Every profile has the nearest of the centres of its own volume's groups, volumes apart from each other."""
    from terrace.operators import volume

    random = np.random.default_rng(3)
    profiles = {(b, i // 6, i % 6): random.normal(size=5) + 4 * (i % 3) * (b + 1) for b in range(3) for i in range(30)}
    rows = [(b, lev, r, c, float(w)) for (b, r, c), p in profiles.items() for lev, w in enumerate(p)]
    got = {(r.brick_id, r.row, r.col): r.cluster for r in volume.clusters(spark.createDataFrame(rows, "brick_id int, lev int, row int, col int, w double"), 3, centre=centre).collect()}
    assert got.keys() == profiles.keys()
    for b in range(3):
        own = {p: got[p] for p in got if p[0] == b}
        members = {k: np.sort(np.array([profiles[p] for p in own if own[p] == k]), axis=0) for k in set(own.values())}
        centres = {k: m[len(m) // 2] if centre == "median" else m.mean(axis=0) for k, m in members.items()}
        for p, k in own.items():
            apart = {j: (np.abs(profiles[p] - c).sum() if centre == "median" else ((profiles[p] - c) ** 2).sum()) for j, c in centres.items()}
            assert apart[k] <= min(apart.values()) + 1e-9
