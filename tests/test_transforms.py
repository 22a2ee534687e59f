"""Transforms, registration, pyramids, fills and similarity against numpy and planted answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import align, bands, grid, perspective, raster, spectrum


def cells(spark, *grids, name="k"):
    rows = [(i, y, x, float(g[y, x])) for i, g in enumerate(grids) for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, f"{name} int, y long, x long, value double").repartition(4)


def grid_of(df, h, w, value="value"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[value] is None else r[value]
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 12, 64, 90])
def test_transform_and_inverse(spark, n):
    rng = np.random.default_rng(n)
    z = rng.normal(size=(2, n)) + 1j * rng.normal(size=(2, n))
    df = spark.createDataFrame([(k, i, float(z[k, i].real), float(z[k, i].imag)) for k in range(2) for i in range(n)], "k int, at long, re double, im double")
    t = spectrum.fourier(df, n, ["k"])
    got = np.zeros((2, n), complex)
    for r in t.collect():
        got[r.k, r.at] = r.re + 1j * r.im
    assert np.allclose(got, np.fft.fft(z))
    back = {(r.k, r.at): r.re + 1j * r.im for r in spectrum.fourier(t, n, ["k"], inverse=True).collect()}
    assert all(abs(back[k, i] - z[k, i]) < 1e-9 for k in range(2) for i in range(n))


def test_butterflies_equal_the_definition():
    z = np.random.default_rng(0).normal(size=(3, 48)) + 0j
    assert np.allclose(spectrum.butterflies(z), np.fft.fft(z)) and np.allclose(spectrum.butterflies(z, True) / 48, np.fft.ifft(z))


def test_phase_correlation_finds_shifts(spark):
    rng = np.random.default_rng(4)
    a = rng.random((16, 24))
    shifts = [(0, 0), (3, 5), (-4, -7), (7, 11)]
    rows = [(k, y, x, float(np.roll(a, s, (0, 1))[y, x]), float(a[y, x])) for k, s in enumerate(shifts) for y in range(16) for x in range(24)]
    df = spark.createDataFrame(rows, "k int, y long, x long, a double, b double")
    got = {r.k: (r.dy, r.dx, r.peak) for r in spectrum.phase_correlation(df, 16, 24, ["k"], F.col("a"), F.col("b")).collect()}
    for k, s in enumerate(shifts):
        assert got[k][:2] == s and got[k][2] == pytest.approx(1, abs=1e-6)


def scene(y, x):
    return 0.5 + 0.2 * np.sin(x / 5.0) * np.cos(y / 7.0) + 0.15 * np.sin((x + 2 * y) / 11.0) + 0.1 * np.cos((2 * x - y) / 9.0)


def test_planted_moves_are_recovered(spark):
    h, w = 72, 80
    y, x = np.mgrid[:h, :w].astype(float)
    yc, xc = y - (h - 1) / 2, x - (w - 1) / 2
    planted = [(0.0, 0.0, 3.4, 0.0, 0.0, -2.6), (0.02, -0.03, 1.5, 0.03, -0.01, 2.2)]
    fixed = [scene(y + d * xc + e * yc + f, x + a * xc + b * yc + c) + 0.05 for a, b, c, d, e, f in planted]
    fixed[1][10:25, 40:60] += 0.4  # a part that is not in the other raster
    got = {r.k: r for r in align.align(cells(spark, *fixed), cells(spark, *[scene(y, x)] * 2), h, w, ["k"], steps=5).collect()}
    for k, (a, b, c, d, e, f) in enumerate(planted):
        r = got[k]
        for py, px in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1), (h / 2, w / 2)):
            u, v = px - (w - 1) / 2, py - (h - 1) / 2
            assert abs((r.a - a) * u + (r.b - b) * v + r.c - c) < 0.05 and abs((r.d - d) * u + (r.e - e) * v + r.f - f) < 0.05
        assert r.g == pytest.approx(0.05, abs=0.01)


def test_bands_collapse_to_the_raster(spark):
    rng = np.random.default_rng(1)
    grids = [rng.random((21, 34)), rng.random((21, 34))]
    levels = bands.laplacian(bands.gaussian(cells(spark, *grids), 21, 34, 3, ["k"]), ["k"])
    assert [x[1:] for x in levels] == [(21, 34), (10, 17), (5, 8)]
    whole = bands.collapse(levels, ["k"])
    for k, g in enumerate(grids):
        assert np.allclose(grid_of(whole.where(F.col("k") == k), 21, 34), g)


def test_blended_seams_are_soft(spark):
    h, w = 32, 32
    rows = [(f, y, x, float(f), float((x < 16) != (f == 2))) for f in (1, 2) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "frame int, y long, x long, value double, weight double")
    got = grid_of(bands.blend(df, h, w, 3), h, w)
    steps = np.abs(np.diff(got, axis=1))
    assert steps.max() < 0.35 and got[:, 0] == pytest.approx(2 - got[:, -1] + 1, abs=0.2)  # no jump of 1, the sides keep their frames
    same = bands.blend(df.withColumn("value", F.col("y") * 0.1 + F.col("x")).withColumn("weight", F.lit(0)), h, w, 3)
    assert np.allclose(grid_of(same, h, w), np.arange(h)[:, None] * 0.1 + np.arange(w))


@pytest.mark.parametrize("h,w", [(13, 9), (1, 6), (1, 1)])
def test_fill_keeps_what_is_known(spark, h, w):
    rng = np.random.default_rng(h)
    g, known = rng.random((h, w)), (rng.random((h, w)) < 0.4).astype(float)
    known[0, 0] = 1
    rows = [(y, x, float(g[y, x]) if known[y, x] else None, float(known[y, x])) for y in range(h) for x in range(w)]
    got = grid_of(bands.fill(spark.createDataFrame(rows, "y int, x int, value double, known double"), h, w, ["value"]), h, w)
    assert not np.isnan(got).any() and np.array_equal(got[known > 0], g[known > 0])
    assert got.min() >= g[known > 0].min() - 1e-9 and got.max() <= g[known > 0].max() + 1e-9
    none = bands.fill(spark.createDataFrame(rows, "y int, x int, value double, known double").withColumn("known", F.lit(0.0)), h, w, ["value"])
    assert np.isnan(grid_of(none, h, w)).all()


def test_similarity_of_equal_rasters_is_one(spark):
    rng = np.random.default_rng(2)
    df = cells(spark, rng.random((14, 15))).withColumn("other", 1 - F.col("value"))
    assert bands.structural_similarity(df, ["k"], "value", "value").collect()[0].ssim == pytest.approx(1)
    assert bands.structural_similarity(df, ["k"], "value", "other").collect()[0].ssim < 0


def test_patches_read_bilinearly(spark):
    g = np.random.default_rng(3).random((5, 6))
    p = {(r.py, r.px): r for r in align.patches(cells(spark, g), 5, 6, ["k"]).collect()}
    assert p[2, 3].p11.v == g[3, 4] and p[2, 3].p10.v == g[3, 3] and p[4, 5].p01 is None
    assert p[2, 3].p00.gx == pytest.approx((g[2, 4] - g[2, 2]) / 2) and p[0, 0].p00.gy == pytest.approx((g[1, 0] - g[0, 0]) / 2)
    assert raster.gauss_taps(1.0, 1)[1] == 1.0


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_spread_over_gaps(spark, radius):
    rng = np.random.default_rng(radius)
    g = rng.random((12, 15))
    there = rng.random((12, 15)) < 0.45
    rows = [(y, x, None if (y + x) % 9 == 0 else float(g[y, x])) for y in range(12) for x in range(15) if there[y, x]]
    df = spark.createDataFrame(rows, "y int, x int, v double")
    for least, pick in ((True, min), (False, max)):
        got = {(r.y, r.x): r.spread for r in grid.spread(df, [], "v", radius, least).collect()}
        want = {(y, x): pick((v for a, b, v in rows if v is not None and abs(a - y) <= radius and abs(b - x) <= radius), default=None) for y, x, _ in rows}
        assert got == want


def test_planted_vanishing_points(spark):
    h, w = 81, 101
    v, u = np.mgrid[:h, :w] / np.array([h - 1, w - 1]).reshape(2, 1, 1) - 0.5
    px, py = 0.1, -2.0  # lines through this point: stripes by angle about it
    stripes = np.sin(40 * np.arctan2(u - px, v - py))
    stripes[30:45, 20:60] += np.sin(9 * (u + 3 * v))[30:45, 20:60]  # lines of another direction
    flat = np.full((h, w), 0.5)
    got = {(r.k, r.family): r for r in perspective.vanishing_points(cells(spark, stripes, flat), h, w, ["k"], least=200).collect()}
    r = got[0, "V"]
    assert (r.pa / r.pc, r.pb / r.pc) == pytest.approx((px, py), abs=0.03) and not any(k == 1 for k, _ in got)
    assert abs(r.angle) == pytest.approx(np.pi / 2, abs=0.15)
    few = perspective.vanishing_points(cells(spark, stripes), h, w, ["k"], least=10**6).collect()
    assert all(r.pa is None for r in few)
