"""Distances, the Laplace equation, watershed, edges, matching and frequency filters against plain numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import distances, edges, frequency, grains, laplace, matching, spatial, watershed


def field(spark, z, m=None, field_id=0):
    h, w = z.shape
    m = np.zeros_like(z) if m is None else m
    rows = [(field_id, r, c, float(z[r, c]) if np.isfinite(z[r, c]) else None, float(m[r, c])) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "field_id int, row int, col int, z double, m double")


def array(df, shape, value="z"):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", value).collect():
        out[r[0], r[1]] = r[2]
    return out


def shapes():
    random = np.random.default_rng(5)
    yield (random.random((13, 17)) < 0.7).astype(float)
    yield (random.random((9, 31)) < 0.95).astype(float)
    full = np.ones((12, 7))
    yield full
    full = full.copy()
    full[5, 3] = 0
    yield full
    yield np.zeros((4, 5))
    yield np.ones((1, 9))


def brute_distance(m, metric, border):
    h, w = m.shape
    grow = 1 if border else 0
    padded = np.pad(m, grow)
    outside = np.argwhere(padded <= 0) - grow
    out = np.zeros(m.shape)
    for r, c in itertools.product(range(h), range(w)):
        if m[r, c] <= 0:
            continue
        if not len(outside):
            out[r, c] = np.inf
            continue
        d = np.abs(outside - (r, c))
        dx, dy = d.max(axis=1), d.min(axis=1)
        if metric == "euclidean":
            out[r, c] = np.sqrt((d**2).sum(axis=1).min())
        elif metric == "cityblock":
            out[r, c] = d.sum(axis=1).min()
        elif metric == "chessboard":
            out[r, c] = dx.min()
        else:  # steps over edges and over corners in turn, counted one by one
            first = metric == "octagonal48"
            n = 0
            while not np.any((dx <= n) & (dx + dy <= n + (n // 2 if first else (n + 1) // 2))):
                n += 1
            out[r, c] = n
    return out


@pytest.mark.parametrize("metric", distances.METRICS)
def test_distances(spark, metric):
    for m in shapes():
        for border in (True, False):
            got = array(distances.distance_transform(field(spark, m, m), metric, border), m.shape)
            np.testing.assert_allclose(got, brute_distance(m, metric, border), rtol=1e-12)


def test_discs_and_sizes_by_distance(spark):
    m = next(shapes())
    f = field(spark, m, m)
    d = brute_distance(m, "euclidean", True)
    parts = grains.number(f)
    names = array(parts, m.shape, "grain")
    for r in distances.inscribed_discs(f, parts).collect():
        inside = names == r.grain
        assert r.radius == pytest.approx(d[inside].max()) and d[r.row, r.col] == pytest.approx(r.radius) and inside[r.row, r.col]
    np.testing.assert_array_equal(array(distances.shrink_by_distance(f, 1.0), m.shape, "m"), d > 1)
    np.testing.assert_array_equal(array(distances.grow_by_distance(f, 1.5), m.shape, "m"), brute_distance(1 - m, "euclidean", False) <= 1.5)


@pytest.mark.parametrize("corners", [False, True])
def test_numbers_of_grains(spark, corners):
    for m in shapes():
        want, n = np.zeros(m.shape), 0
        for r, c in itertools.product(*map(range, m.shape)):
            if m[r, c] > 0 and not want[r, c]:
                n, todo = n + 1, [(r, c)]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x] > 0 and not want[y, x]:
                        want[y, x] = n
                        todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if corners or not (a and b)]
        got = np.nan_to_num(array(grains.number(field(spark, m, m), corners), m.shape, "grain"))
        np.testing.assert_array_equal(got, want)


def dense_laplace(z, m):
    h, w = z.shape
    inside = [tuple(p) for p in np.argwhere(m > 0)]
    at = {p: i for i, p in enumerate(inside)}
    a, b = np.zeros((len(inside),) * 2), np.zeros(len(inside))
    for p, i in at.items():
        for d in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            q = p[0] + d[0], p[1] + d[1]
            if 0 <= q[0] < h and 0 <= q[1] < w:
                a[i, i] += 1
                if q in at:
                    a[i, at[q]] -= 1
                else:
                    b[i] += z[q]
    out = z.copy()
    for p, v in zip(inside, np.linalg.solve(a, b)):
        out[p] = v
    return out


def test_laplace(spark):
    random = np.random.default_rng(8)
    z = random.normal(size=(14, 19)) * 50
    m = (random.random(z.shape) < 0.55).astype(float)
    m[3:11, 4:15] = 1
    hidden = np.where(m > 0, np.nan, z)  # what is masked does not count
    np.testing.assert_allclose(array(laplace.fill(field(spark, hidden, m)), z.shape), dense_laplace(z, m), atol=1e-8)


def test_laplace_over_rows(spark):
    """A grain larger than allowed in one task is solved by conjugate gradients over rows of pixels, beside small ones."""
    z = np.random.default_rng(9).normal(size=(7, 8)) * 50
    m = np.zeros(z.shape)
    m[1:4, 1:7] = m[6, 7] = m[5, 0] = 1
    np.testing.assert_allclose(array(laplace.fill(field(spark, z, m), local=5, tile=3, precision=1e-9), z.shape), dense_laplace(z, m), atol=1e-6)


def test_laplace_of_planes_and_extremes(spark):
    y, x = np.mgrid[0:30, 0:25].astype(float)
    plane, m = 3 * x - 2 * y, np.zeros((30, 25))
    m[4:26, 3:22] = 1  # a large grain, solved by conjugate gradients in its task
    np.testing.assert_allclose(array(laplace.fill(field(spark, plane, m)), m.shape), plane, atol=1e-7)
    assert np.all(array(laplace.fill(field(spark, plane, np.ones_like(plane))), m.shape) == 0)
    np.testing.assert_array_equal(array(laplace.fill(field(spark, plane, np.zeros_like(plane))), m.shape), plane)
    two = field(spark, plane, m).union(field(spark, plane + 1, m, 7))
    got = laplace.fill(two)
    np.testing.assert_allclose(array(got.where("field_id = 7"), m.shape), plane + 1, atol=1e-7)


def near(p, shape):
    return [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= p[0] + a < shape[0] and 0 <= p[1] + b < shape[1]]


def flood(z):
    """Pixels in the order of value and place; each takes the basin of its least neighbour, or starts one."""
    label = {}
    for p in sorted((p for p in itertools.product(*map(range, z.shape)) if np.isfinite(z[p])), key=lambda p: (z[p], p)):
        least = min((q for q in near(p, z.shape) if q in label), key=lambda q: (z[q], q), default=None)
        label[p] = p if least is None else label[least]
    return label


def merged(z, label, depth):
    now = dict(label)
    while True:
        low = {b: (z[b], b) for b in set(now.values())}
        ways = {}
        for p, q in ((p, q) for p in now for q in near(p, z.shape) if q in now and now[p] != now[q]):
            ways.setdefault(now[p], []).append((max(z[p], z[q]), *low[now[q]]))
        joins = {b: min(w)[2] for b, w in ways.items() if min(w)[0] - z[b] <= depth}
        if not joins:
            return now
        group = {b: {b} for b in low}
        for a, b in joins.items():
            both = group[a] | group[b]
            for c in both:
                group[c] = both
        now = {p: min(group[b], key=lambda c: low[c]) for p, b in now.items()}


@pytest.mark.parametrize("kind", ["noise", "flat", "waves"])
def test_watershed(spark, kind):
    random = np.random.default_rng(3)
    y, x = np.mgrid[0:16, 0:21].astype(float)
    z = {"noise": random.normal(size=x.shape), "flat": random.integers(0, 4, x.shape).astype(float), "waves": np.sin(x / 3) * np.cos(y / 2.5)}[kind]
    if kind == "noise":
        z[5, 3:12] = np.nan  # a wall
    f = field(spark, z)
    parts = watershed.basins(f)
    want = flood(z)
    assert {(r.row, r.col): (r.bottom_row, r.bottom_col) for r in parts.collect()} == want
    for depth in (0.0, 0.8):
        joined = merged(z, want, depth)
        assert {(r.row, r.col): (r.bottom_row, r.bottom_col) for r in watershed.merge_shallow(parts, depth).collect()} == joined
        names = {b: i + 1 for i, b in enumerate(sorted(set(joined.values())))}
        numbers = watershed.watershed(f, depth)
        assert {(r.row, r.col): r.grain for r in numbers.collect()} == {p: names[b] for p, b in joined.items()}
        lines = {(r.row, r.col): r.m for r in watershed.segments(numbers).collect()}
        assert lines == {p: float(all(names[joined[q]] >= names[b] for q in near(p, z.shape) if q in joined)) for p, b in joined.items()}


def test_canny_follows_a_step(spark):
    z = np.zeros((20, 24))
    z[:, 12:] = 10
    z[8, 3] = 0.4  # a faint spot, too weak to count
    m = array(edges.canny(field(spark, z)), z.shape, "m")
    assert set(np.argwhere(m > 0)[:, 1]) == {11} or set(np.argwhere(m > 0)[:, 1]) == {12}
    assert (m > 0).sum() == 20
    # A weak part that hangs on a strong one stays, alone it goes.
    z = np.zeros((20, 24))
    z[:10, 12:] = 10
    z[10:, 12:] = 2
    assert (array(edges.canny(field(spark, z), 0.1, 0.5), z.shape, "m")[12:19] > 0).any()
    assert not (array(edges.canny(field(spark, z), 0.5, 0.5), z.shape, "m")[12:19] > 0).any()
    assert not array(edges.canny(field(spark, np.ones((5, 6)))), (5, 6), "m").any()


def test_harris_finds_a_corner(spark):
    z = np.zeros((24, 24))
    z[12:, 12:] = 1
    got = array(edges.harris(field(spark, z)), z.shape)
    assert np.abs(np.array(np.unravel_index(got.argmax(), z.shape)) - 11.5).max() <= 1.5 and got.max() > 0
    assert got[18, 11] < 0 and not got[:3].any()


def test_shift_is_recovered(spark):
    random = np.random.default_rng(11)
    z = random.normal(size=(26, 30))
    dx, dy = 2, -1
    moved = np.roll(z, (dy, dx), (0, 1))
    got = matching.cross_correlate(field(spark, z), field(spark, moved), 2, 5)
    rows = got.collect()
    assert len(rows) == (26 - 8) * (30 - 8)
    inner = [r for r in rows if 5 <= r.row < 20 and 5 <= r.col < 24]
    assert {(r.dx, r.dy) for r in inner} == {(dx, dy)} and all(r.score == pytest.approx(1) for r in inner)
    best = matching.shift_found(field(spark, z), field(spark, moved), 2, 5).first()
    assert (best.dx, best.dy) == (dx, dy)
    flat = matching.cross_correlate(field(spark, np.ones((9, 9))), field(spark, np.ones((9, 9))), 1, 3).collect()
    assert {(r.dx, r.dy, r.score) for r in flat} == {(0, 0, 0.0)}


def test_scores_against_numpy(spark):
    random = np.random.default_rng(12)
    a, b = random.normal(size=(11, 12)), random.normal(size=(11, 12))
    for r in matching.cross_correlate(field(spark, a), field(spark, b), 1, 3).collect():
        window = lambda z, y, x: z[y - 1 : y + 2, x - 1 : x + 2].ravel()
        at = {(x, y): np.corrcoef(window(a, r.row, r.col), window(b, r.row + y, r.col + x))[0, 1] for y in (-1, 0, 1) for x in (-1, 0, 1)}
        best = max(at, key=lambda s: at[s] * (1.0001 if s == (0, 0) else 1))
        assert (r.dx, r.dy) == best and r.score == pytest.approx(at[best] * (1.0001 if best == (0, 0) else 1))
        if abs(r.dx) == 1:
            assert r.x == r.dx
        else:
            lo, hi = at[-1, r.dy], at[1, r.dy]
            assert r.x == pytest.approx((lo - hi) / (lo + hi - 2 * r.score) / 2)


@pytest.mark.parametrize("shape", [(12, 17), (9, 8)])
def test_frequency_filters(spark, shape):
    random = np.random.default_rng(2)
    z = random.normal(size=shape)
    f = field(spark, z)
    plane = np.fft.fft2(z)
    fx, fy = np.meshgrid(np.fft.fftfreq(shape[1]), np.fft.fftfreq(shape[0]))
    got = spatial.transform_2d(f)
    np.testing.assert_allclose(array(got, shape, "re") + 1j * array(got, shape, "im"), np.fft.fft2(z, norm="ortho"), atol=1e-10)
    length = np.hypot(fx, fy)
    np.testing.assert_allclose(array(frequency.keep_band(f, 0.1, 0.3), shape), np.fft.ifft2(plane * ((length >= 0.1) & (length <= 0.3))).real, atol=1e-10)
    part = lambda limit: (1 - np.cos(np.clip((length - limit + 0.05) / 0.1, 0, 1) * np.pi)) / 2
    np.testing.assert_allclose(array(frequency.keep_band(f, 0.1, 0.3, 0.1), shape), np.fft.ifft2(plane * part(0.1) * (1 - part(0.3))).real, atol=1e-10)
    everything = field(spark, z, np.ones(shape))
    np.testing.assert_allclose(array(frequency.filter_by_mask(f, everything), shape), z, atol=1e-10)
    np.testing.assert_allclose(array(frequency.filter_by_mask(f, everything, keep=False), shape), 0 * z, atol=1e-10)
    spot = np.zeros(shape)
    spot[shape[0] // 2 + 2, shape[1] // 2 - 1] = 1
    kept = np.zeros(shape)
    kept[2, -1] = kept[-2, 1] = 1
    np.testing.assert_allclose(array(frequency.filter_by_mask(f, field(spark, z, spot)), shape), np.fft.ifft2(plane * kept).real, atol=1e-10)
    steps = np.hypot(fx * shape[1], fy * shape[0]) * 4 / shape[1]
    for kind, weight in (("gauss", np.exp(-2 * steps**2)), ("hat", 4 * steps**2 * np.exp(-2 * steps**2) * 8 * np.pi)):
        np.testing.assert_allclose(array(frequency.wavelet(f, 2.0, kind), shape), np.fft.ifft2(plane * weight).real, atol=1e-9)
    line = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 0.0)], "i int, y double")
    k = np.minimum(np.arange(shape[1]), shape[1] - np.arange(shape[1]))
    w = np.interp(k * 2 / (shape[1] // 2), [0, 1, 2], [1, 0.5, 0])
    np.testing.assert_allclose(array(frequency.filter_rows(f, line), shape), np.fft.ifft(np.fft.fft(z) * w).real, atol=1e-10)
    np.testing.assert_allclose(array(frequency.filter_rows(f, spark.createDataFrame([(0, 1.0), (5, 1.0)] + [(i, 1.0) for i in range(1, 5)], "i int, y double"), "y"), shape), z, atol=1e-10)


def test_lines_longer_than_a_batch(spark):
    """A line that spans many Arrow batches comes to its function whole, and several lines share a batch."""
    from terrace.plans.lines import map_lines

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(400).select((F.col("id") % 3).alias("k"), F.col("id").cast("int").alias("i"), F.when(F.col("id") % 3 == 2, "b").otherwise("a").alias("s"))
        rows = rows.union(spark.range(4).select((F.col("id") + 10).alias("k"), F.lit(1), F.lit("c")))
        got = map_lines(rows, ["s", "k"], ["i"], ["i"], lambda line: {"n": np.array([len(line["i"])]), "up": np.array([bool((np.diff(line["i"]) > 0).all())])}, "n long, up boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.s, r.k, r.n, r.up) for r in got) == [("a", 0, 134, True), ("a", 1, 133, True), ("b", 2, 133, True)] + [("c", 10 + i, 1, True) for i in range(4)]
