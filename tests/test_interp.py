import math

import numpy as np

from geostrata.operators import interp
from geostrata.operators.surface import from_utm, to_utm


def test_spline_reproduces_a_cubic():
    x = np.linspace(0, 10, 60)
    z = 0.2 * x**3 - x**2 + 3
    assert np.abs(interp.Spline1(x, z, s=1e-6)(x) - z).max() < 0.02
    noisy = z + np.random.default_rng(0).normal(0, 3, 60)
    smooth = interp.Spline1(x, noisy, w=np.full(60, 1 / 3))
    assert np.sqrt(((smooth(x) - z) ** 2).mean()) < 3.0
    assert np.isfinite(interp.Spline1(np.ones(3), np.array([1.0, 2.0, 3.0]))([1.0])).all()


def test_surface_spline():
    rng = np.random.default_rng(1)
    x, y = rng.random(300) * 10, rng.random(300) * 10
    z = x * 2 - y + 5
    assert np.abs(interp.Spline2(x, y, z, s=1e-6)(x, y) - z).max() < 0.01


def test_calculus_of_splines():
    x = np.linspace(0, 10, 80)
    s = interp.Spline1(x, np.sin(x), s=1e-8)
    assert np.abs(s.derivative(x) - np.cos(x)).max() < 1e-3 and np.abs(s.derivative(x[10:-10], 2) + np.sin(x[10:-10])).max() < 0.02
    assert math.isclose(s.integral(0, math.pi), 2, abs_tol=1e-5) and np.allclose(s.zeros(), [0, math.pi, 2 * math.pi, 3 * math.pi], atol=1e-4)
    a, b = np.random.default_rng(0).random((2, 400))
    z = interp.Spline2(a, b, a * b, s=1e-9)
    assert math.isclose(z.integral(0.1, 0.9, 0.1, 0.9), 0.16, abs_tol=1e-6) and np.isclose(z.profile(0.5)([0.5]), 0.25) and np.isclose(z.grid([0.5], [0.5]), 0.25)
    t = np.linspace(0, 2 * math.pi, 40, endpoint=False)
    circle = interp.Curve(np.column_stack([np.cos(t), np.sin(t)]), closed=True)(np.linspace(0, 1, 50))
    assert np.abs(np.hypot(*circle.T) - 1).max() < 1e-4


def test_rbf_passes_through_its_points():
    f = interp.Rbf([0.0, 10.0], [0.0, 10.0], [10.0, 0.0], span=5.0)
    assert np.allclose(f([0.0, 10.0], [0.0, 10.0]), [10.0, 0.0]) and f([100.0], [100.0])[0] == 0.0
    for kernel in interp.KERNELS:
        rng = np.random.default_rng(2)
        x, y, z = rng.random((3, 12))
        assert np.allclose(interp.Rbf(x, y, z, kernel, sigma=0.5, span=0.5)(x, y), z, atol=1e-6), kernel


def test_both_triangulations_have_the_same_faces(monkeypatch):
    rng = np.random.default_rng(4)
    faces = lambda t: {tuple(sorted(f)) for f in t.tolist()}
    for n in (3, 4, 8, 29, 30, 31, 36):
        for points in (rng.random((n, 2)), np.round(rng.random((n, 2)) * 4), np.column_stack([np.arange(n), np.zeros(n)])):
            q = interp._apart(points)
            assert faces(interp._few_triangles(q)) == faces(interp._inserted_triangles(q))


def test_delaunay_covers_the_hull():
    rng = np.random.default_rng(3)
    for n in (3, 10, 120):
        p = rng.random((n, 2))
        t = interp.delaunay(p)
        area = sum(interp.polygon_area(p[i]) for i in t)
        assert math.isclose(area, interp.polygon_area(interp.hull(p)), rel_tol=1e-6)
        for i in t[:40]:
            a = np.column_stack([2 * p[i], np.ones(3)])
            cx, cy, k = np.linalg.solve(a, (p[i] ** 2).sum(1))
            d = ((p - [cx, cy]) ** 2).sum(1)
            assert (np.delete(d, i) >= k + cx**2 + cy**2 - 1e-6).all()


def test_rugosity():
    flat = np.array([[0, 0, 1.0], [1, 0, 1], [0, 1, 1], [1, 1, 1], [0.5, 0.5, 1]])
    factor = 1 / (2.49127261 + 9.01659384 * math.sqrt(32.65748276))
    assert math.isclose(interp.rugosity(flat, 1.0), factor, rel_tol=1e-9)
    rough = flat.copy()
    rough[4, 2] = 2
    assert interp.rugosity(rough, 1.0) > factor
    assert math.isnan(interp.rugosity(flat[:2], 1.0)) and math.isnan(interp.rugosity(np.array([[0, 0, 0.0], [1, 1, 1], [2, 2, 2]]), 1.0))


def test_utm(spark):
    from pyspark.sql import functions as F

    x, y = to_utm(F.radians(F.lit(48.8583)), F.radians(F.lit(2.2945)), 31)
    lat, lon = from_utm(x, y, 31)
    r = spark.range(1).select(x, y, F.degrees(lat), F.degrees(lon)).first()
    assert abs(r[0] - 448251.8) < 1 and abs(r[1] - 5411943.8) < 1
    assert abs(r[2] - 48.8583) < 1e-8 and abs(r[3] - 2.2945) < 1e-8


def test_rugosity_of_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), *map(float, p)) for k, p in zip(rng.integers(0, 40, 900), rng.random((900, 3)) * [9, 9, 2], strict=True)] + [(99, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cell long, x double, y double, z double")
    got = {r["cell"]: r["rugosity"] for r in interp.cell_rugosity(df, "cell", 5.0).collect()}
    assert set(got) == {*range(40), 99} and got[99] is None
    for k in (0, 7, 39):
        p = np.array([r[1:] for r in rows if r[0] == k])
        assert math.isclose(got[k], interp.rugosity(p, len(p) / (math.pi * 25)), rel_tol=1e-9)
    assert interp.cell_rugosity(df.limit(0), "cell", 5.0).count() == 0
