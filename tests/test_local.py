"""Local planes, Legendre bases and spectra by scale against numpy."""

import numpy as np
import pytest
from test_regions import array, field

from terrace.functions.selection import Masking
from terrace.operators import fractals, levelling, lines, local


@pytest.mark.parametrize("size", [1, 2, 3, 6])
def test_local_planes(spark, size):
    z = np.random.default_rng(5).normal(3, 2, (7, 9))
    got = local.planes(field(spark, z), size).toPandas().set_index(["row", "col"])
    before, after = (size - 1) // 2, size // 2
    for r in range(7):
        for c in range(9):
            y, x = np.mgrid[max(r - before, 0) : min(r + after, 6) + 1, max(c - before, 0) : min(c + after, 8) + 1]
            v = z[y, x].ravel()
            basis = np.stack([np.ones(v.size), x.ravel() - x.mean(), y.ravel() - y.mean()], 1)
            a, bx, by = np.linalg.lstsq(basis, v, rcond=None)[0]
            s0 = ((v - basis @ [a, bx, by]) ** 2).sum()
            want = [a, bx, by, np.hypot(bx, by), s0, s0 / (1 + bx * bx + by * by)]
            assert got.loc[(r, c), ["mean", "bx", "by", "slope", "s0", "s0_reduced"]].tolist() == pytest.approx(want, abs=1e-9)


def test_legendre(spark):
    y, x = np.mgrid[-1:1:23j, -1:1:31j]
    leg = np.polynomial.legendre.legval2d
    c = np.random.default_rng(6).normal(size=(5, 3))
    z = leg(x, y, c)
    fit = levelling.legendre_coefficients(field(spark, z), 4, 2).first()
    assert (fit.xres, fit.yres) == (31, 23) and np.reshape(fit.coefficients, (5, 3)) == pytest.approx(c, abs=1e-9)
    # A mask that hides what does not follow the polynomials; all pixels are levelled.
    m = (np.random.default_rng(7).random(z.shape) < 0.2).astype(float)
    left = array(levelling.level_legendre(field(spark, z + 50 * m, m), 4, 2, masking=Masking.EXCLUDE), z.shape)
    assert left == pytest.approx(50 * m, abs=1e-7)


def test_legendre_of_high_degree(spark):
    """At degree 14 powers of x and y would leave no digits."""
    y, x = np.mgrid[-1:1:40j, -1:1:40j]
    c = np.random.default_rng(8).normal(size=(15, 2))
    z = np.polynomial.legendre.legval2d(x, y, c)
    assert np.abs(array(levelling.level_legendre(field(spark, z), 14, 1), z.shape)).max() < 1e-9
    flat = levelling.level_legendre(field(spark, np.full((1, 6), 7.0)), 2, 2)  # one row: no y to fit
    assert array(flat, (1, 6)) == pytest.approx(np.zeros((1, 6)), abs=1e-9)


def test_line_spectrum(spark):
    rng = np.random.default_rng(9)
    ys = {1: rng.normal(size=16), 2: rng.normal(size=7), 3: np.array([4.0])}
    rows = [(k, i, float(v)) for k, y in ys.items() for i, v in enumerate(y)] + [(None, 0, 1.0), (2, 9, None)]
    got = lines.power_spectrum(spark.createDataFrame(rows, "line_id int, i int, y double"), "none").toPandas()
    for k, y in ys.items():
        part = got[got.line_id == k].sort_values("bin")
        assert part.psdf.to_numpy() == pytest.approx(np.abs(np.fft.rfft(y - y.mean())) ** 2 / (2 * np.pi * len(y)))


def test_spectral_dimension(spark):
    """Rows whose power falls as the square of the frequency are those of a random walk: dimension 2.5."""
    n, rng = 64, np.random.default_rng(10)
    k = np.arange(1, n // 2)
    z = sum(np.cos(2 * np.pi * f * (np.arange(n)[None, :] / n) + rng.uniform(0, 2 * np.pi, (400, 1))) / f for f in k)
    assert fractals.spectral_dimension(field(spark, z)).first().dimension == pytest.approx(2.5, abs=0.2)


@pytest.mark.parametrize(("radius", "direction"), [(3.0, "x"), (4.6, "y"), (100.0, "x"), (5.0, "xy")])
def test_revolved_arc(spark, radius, direction):
    def rolled(z, rms):
        out = np.empty_like(z)
        size = int(min(radius, z.shape[1]) + 0.5)
        arc = lambda d: rms / np.sqrt(2 / 3 - np.pi / 16) * (1 - np.sqrt(max(1 - (d / radius) ** 2, 0)))
        for r, line in enumerate(z):
            held = []
            for i, v in enumerate(line):
                near = line[max(i - size // 2, 0) : i + (size - 1) // 2 + 1]
                held.append(max(v, near.mean() - 2.5 * near.std()))
            out[r] = [min(held[j] + arc(abs(j - i)) for j in range(max(i - size, 0), min(i + size, len(line) - 1) + 1)) for i in range(len(line))]
        return out

    z = np.random.default_rng(11).normal(0, 3, (9, 14))
    z[4, 6] = -60.0
    want = z
    for axis in direction:
        want = rolled(want, want.std()) if axis == "x" else rolled(want.T, want.std()).T
    assert array(levelling.revolved_arc(field(spark, z), radius, direction), z.shape) == pytest.approx(want)
