"""Numerical kernels by what must hold of them."""

import time

import numpy as np
import pytest

from isogon.functions import geo, mainfield
from isogon.operators import complexity, continuation, joins, navigation, surface, windows
from isogon.plans.catalog import LOW_DEGREE

RNG = np.random.default_rng(0)
P = RNG.random((60, 2)) * 10
V = 3 * P[:, 0] - P[:, 1] + 5


@pytest.mark.parametrize("solve", [surface.solve_multiquadric, surface.solve_local])
def test_kernels_meet_their_nodes(solve):
    assert np.allclose(solve(P, V, P), V, atol=1e-4)


def test_tension_spline_keeps_a_plane():
    q = RNG.random((10, 2)) * 10
    assert np.allclose(surface.solve_tension(P, V, q), 3 * q[:, 0] - q[:, 1] + 5, atol=1e-5)


def test_local_interpolation_keeps_a_plane():
    q = 3 + RNG.random((10, 2)) * 4
    assert np.allclose(surface.solve_local(P, V, q), 3 * q[:, 0] - q[:, 1] + 5, atol=1e-6)


def test_kernel_limits():
    big = np.zeros((surface.MOST_KERNEL + 1, 2))
    for solve in (surface.solve_multiquadric, surface.solve_tension):
        with pytest.raises(ValueError):
            solve(big, big[:, 0], big[:1])


def test_support_vectors_and_swarm():
    assert np.abs(surface.fit_lssvm(P / 10, V, 1.0, 1e6)(P / 10) - V).max() < 0.01
    best, cost = surface.swarm(lambda x: ((x - [1.5, -2]) ** 2).sum(1), [(-5, 5), (-5, 5)], 30, 60, 1)
    assert np.allclose(best, [1.5, -2], atol=0.05) and cost < 0.01


def test_cosine_basis_and_sparse_recovery():
    m = surface.dct_matrix(64)
    assert np.allclose(m @ m.T, np.eye(64))
    x = np.zeros(64)
    x[[2, 7, 11]] = 5, -3, 2
    got, err = surface.reconstruct(m.T @ x, 0.6, 3, 1)
    assert np.allclose(got, m.T @ x, atol=1e-6) and err < 1e-6


def test_continuation():
    t = RNG.random((20, 30))
    assert np.allclose(continuation.continued(t, 1, 1, 0), t)
    x = np.arange(64)
    wave = np.sin(2 * np.pi * 4 * x / 64)[None].repeat(64, 0)
    up = continuation.continued(wave, 1, 1, 2.0)
    assert np.allclose(up, wave * np.exp(-2 * np.pi * 4 / 64 * 2))
    for method in continuation.METHODS:
        r = np.array([0.5, 1.0])
        assert np.all(np.isfinite(continuation.down_factor(r, method)))
    assert np.allclose(continuation.continued(up, 1, 1, 2.0, "integral"), wave, atol=0.05)
    with pytest.raises(ValueError):
        continuation.down_factor(np.ones(1), "none")


def test_regrid_is_the_identity_on_its_own_nodes():
    x, y = np.meshgrid(np.arange(5.0), np.arange(4.0))
    v = RNG.random(20)
    gx, gy, z = continuation.regrid(x.ravel(), y.ravel(), v, 1, 1)
    assert np.allclose(z.ravel(), v) and len(gx) == 5 and len(gy) == 4


def test_dipole():
    g, h = np.zeros((2, 2)), np.zeros((2, 2))
    g[1, 0] = -30000.0
    lat = np.array([0.0, 45.0, 80.0])
    x, y, z = mainfield.synthesize(g, h, lat, np.zeros(3), np.full(3, 10.0))
    phi, e2 = np.radians(lat), 1 - (mainfield.MINOR / mainfield.MAJOR) ** 2
    n = mainfield.MAJOR / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    rho, up = (n + 10) * np.cos(phi), (n * (1 - e2) + 10) * np.sin(phi)
    r, psi = np.hypot(rho, up), np.arctan2(up, rho)
    b = 30000 * (mainfield.SPHERE / r) ** 3
    assert np.allclose(np.hypot(x, z), b * np.sqrt(np.cos(psi) ** 2 + 4 * np.sin(psi) ** 2)) and np.allclose(y, 0)


def test_models():
    m = mainfield.Model(2020.0, LOW_DEGREE)
    assert m.at(2022.0).g[1, 0] == pytest.approx(-29404.5 + 13.4)
    text = ["  2020.0  TEST  1/1/2020"] + [" ".join(map(str, r)) for r in LOW_DEGREE] + ["9" * 40]
    assert np.allclose(mainfield.read_cof(text).g, m.g)
    two = mainfield.read_epochs(["   A 2000.0 1 0", "1 0 10 0 0 0", "1 1 2 3 0 0", "   B 2010.0 1 0", "1 0 30 0 1 0", "1 1 2 3 0 0"], record=None)
    assert mainfield.choose(two, 2005.0).g[1, 0] == pytest.approx(20) and mainfield.choose(two, 2012.0).g[1, 0] == pytest.approx(32)
    p, d = mainfield.schmidt(8, np.array([0.7]))
    q, _ = mainfield.schmidt(8, np.array([0.7 + 1e-6]))
    assert np.allclose((q - p) / 1e-6, d, atol=1e-4)


def test_polynomial_recovers_itself(spark):
    df = spark.createDataFrame([(float(x), float(y), float(2 * x * x - x * y + 4)) for x in range(8) for y in range(8)], "x double, y double, v double")
    fit = surface.Polynomial(2).fit(df).evaluate(df).collect()
    assert max(abs(r.fit - r.v) for r in fit) < 1e-4


def test_components_standardise():
    x = RNG.normal(size=(500, 6)) * [1, 2, 3, 4, 5, 6]
    row = {"n": 500, **{f"s_{c}": x[:, i].sum() for i, c in enumerate(complexity.FEATURES)}}
    row |= {f"p_{a}_{b}": (x[:, i] * x[:, j]).sum() for i, a in enumerate(complexity.FEATURES) for j, b in enumerate(complexity.FEATURES) if j >= i}
    mean, dev, weight = complexity.components(row, compat=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(dev, x.std(0, ddof=1)) and len(weight) == 6


def test_filters_along_a_track():
    gx, gy = np.meshgrid(np.arange(40.0), np.arange(40.0))
    z = 10 * gx + 3 * gy + 5 * np.sin(gx / 3) * gy / 10
    m = navigation.Map(gx.ravel(), gy.ravel(), z.ravel(), 1.0)
    x, y = 10 + np.arange(15.0), 12 + np.arange(15.0) * 0.7
    v = np.array([m.value(a, b) for a, b in zip(x, y, strict=True)])
    off = navigation.iccp_track(m, x + 0.6, y - 0.4, v)
    assert np.hypot(off[:, 0] - x, off[:, 1] - y).mean() < np.hypot(0.6, 0.4)
    s = navigation.sitan_track(m, x + 0.6, y - 0.4, v)
    assert len(s) == 14 and np.abs(np.array([m.value(*p) for p in s[-5:]]) - v[-5:]).mean() < np.abs(np.array([m.value(*p) for p in zip(x + 0.6, y - 0.4, strict=True)]) - v).mean()


def test_window_sizes(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(n,) for n in (5000, 1120, 100, 8, 2)], "n long").select(windows.window_size(F.col("n")).alias("w")).collect()
    assert [r.w for r in got] == [1120, 280, 25, 2, 1]


def test_average_by_size_is_the_frame(spark):
    rows = [(line, i, float((i * 37) % 101)) for line, n in ((1, 3000), (2, 50), (3, 1)) for i in range(n)]
    got = windows.moving_average_by_size(spark.createDataFrame(rows, "line_id int, seq int, v double"), 200).collect()
    v = {(a, b): c for a, b, c in rows}
    for r in got:
        h = r.window // 2
        part = [v[r.line_id, k] for k in range(r.seq - h, r.seq + h + 1) if (r.line_id, k) in v]
        assert abs(r.smooth - sum(part) / len(part)) < 1e-9
    assert {r.line_id: r.window for r in got} == {1: 200, 2: 12, 3: 1}


def test_bicubic_spline_is_the_tensor_product():
    """Cubic pieces with parabolic ends, met at the nodes and exact for a paraboloid."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(9, 12))
    f = surface.Bicubic(z, 1.0, -2.0, 0.5, 0.25)
    i, j = np.mgrid[:9, :12]
    assert np.allclose(f(1 + j.ravel() * 0.5, -2 + i.ravel() * 0.25), z.ravel())
    x, y = np.meshgrid(1 + np.arange(12) * 0.5, -2 + np.arange(9) * 0.25)
    g = surface.Bicubic(2 * x * x - x * y + 3 * y * y + 1, 1.0, -2.0, 0.5, 0.25)
    a, b = rng.uniform(1, 6.5, 50), rng.uniform(-2, 0, 50)
    assert np.allclose(g(a, b), 2 * a * a - a * b + 3 * b * b + 1)
    e = 1e-5  # slopes go on across a node
    assert np.allclose((f(np.array([3 + e]), np.array([-1.1])) - f(np.array([3.0]), np.array([-1.1]))) / e, (f(np.array([3.0]), np.array([-1.1])) - f(np.array([3 - e]), np.array([-1.1]))) / e, atol=1e-3)


def test_map_holes_are_filled():
    x, y = np.meshgrid(np.arange(6.0), np.arange(5.0))
    keep = ~((x == 2) & (y == 2))
    m = navigation.Map(x[keep], y[keep], (x + 10 * y)[keep], 1.0)
    assert abs(m.z[2, 2] - 22) < 1e-9


def test_gauss_kruger_on_the_meridian(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(geo.gauss_kruger(F.lit(0.0), F.lit(117.0)).alias("a"), geo.gauss_kruger(F.lit(45.0), F.lit(117.0)).alias("b")).first()
    assert abs(r.a.x) < 1e-6 and abs(r.a.y - 500000) < 1e-6 and abs(r.b.x - 4984944.378) < 0.01


def test_continuation_report(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(9, 11)) * 5 + 100
    rows = [(1, j * 2.0, i * 1.0, float(z[i, j])) for i in range(9) for j in range(11)]
    got = {r.part: r for r in continuation.accuracy_report(spark.createDataFrame(rows, "grid_id int, x double, y double, v double"), 0.4, 2.0, 1.0, "tikhonov").collect()}
    down = continuation.continued(continuation.continued(z, 2.0, 1.0, 0.4), 2.0, 1.0, 0.4, "tikhonov")
    for part, want in (("a", z), ("b", down), ("a - b", z - down)):
        r = got[part]
        assert np.allclose([r.max, r.min, r.mean, r.spread], [want.max(), want.min(), want.mean(), want.std()]) and r.n == 99


def test_grid_variation_and_weak_fields(spark):
    """Beyond 55 degrees the polar grid counts; at a pole nothing has a declination."""
    from pyspark.sql import functions as F

    p = spark.createDataFrame([(1, 60.0, 20.0), (2, -60.0, 20.0), (3, 30.0, 117.0), (4, 90.0, 10.0)], "id int, lat double, lon double").withColumns({"height": F.lit(0.0), "year": F.lit(2020.0)})
    got = {r.id: r for r in mainfield.result_table(p, [mainfield.Model(2020.0, LOW_DEGREE)]).collect()}
    assert abs(got[1].gv - (got[1].decl - 20)) < 1e-9 and abs(got[2].gv - (got[2].decl + 20)) < 1e-9
    assert abs(got[3].gv - got[3].decl) < 1e-9  # on a central meridian
    assert got[4].decl is None and got[4].gv is None and got[4].f > 0
    c = spark.range(1).select(geo.convergence(F.lit(45.0), F.lit(119.0)).alias("a"), geo.utm_zone(F.lit(60.0), F.lit(4.0)).alias("b"), geo.utm_zone(F.lit(75.0), F.lit(10.0)).alias("c"), geo.utm_zone(F.lit(-5.0), F.lit(180.0)).alias("d")).first()
    assert abs(c.a - 1.4144) < 1e-3 and (c.b.zone, c.c.zone, c.d.zone, c.d.hemisphere) == (32, 33, 1, "S")


def test_dms_and_subareas(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("-0,30,0",), ("10,59,60",), ("12,34,56",), ("x",), (None,)], "t string").select(geo.from_dms(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [-0.5, None, 12 + 34 / 60 + 56 / 3600, None, None]
    r = spark.range(1).select(geo.to_dms(F.lit(-0.99999)).alias("a"), geo.to_dms(F.lit(0.0)).alias("b")).first()
    assert (r.a, r.b) == ("-1,0,0", "0,0,0")


def test_far_queries_find_their_nearest(spark):
    from isogon.operators import joins

    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, -1e6)], "id int, x double, y double")
    p = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "id int, x double, y double")
    got = {(r.q_id, r["rank"]): r.p_id for r in joins.nearest(q, p, 2, 0.01).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (2, 1): 4, (2, 2): 3}
    assert joins.nearest(q, p.limit(0), 2, 0.01).count() == 0 and joins.nearest(q.limit(0), p, 2, 0.01).count() == 0


def test_random_sample_is_exact(spark):
    from isogon.operators import filters

    df = spark.range(1000)
    for n in (1, 3, 7, 1000, 1001):
        got = [r.id for r in filters.random_sample(df, n, 5).collect()]
        assert len(got) == len(set(got)) == 1000 // n


def test_nearest_far_from_all_points(spark):
    """Queries far from a small cloud: what each compares with stays a part of the points."""
    rng = np.random.default_rng(8)
    places = np.round(rng.random((30_000, 2)) * 2, 2)  # places twice and more, equal distances
    asked = np.vstack([rng.random((40, 2)) * 2, rng.random((40, 2)) * 4000 - 2000, [[np.nan, 0.0]]])
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)] + [(-1, None, 0.0)], "id long, x double, y double")
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(asked)], "id long, x double, y double")
    began = time.time()
    got = {(r.q_id, r["rank"]): (r.p_id, r.d2) for r in joins.nearest(q, p, 7, 1e-5).collect()}
    assert time.time() - began < 60
    assert len(got) == 80 * 7
    for i, (a, b) in enumerate(asked[:80]):
        d2 = (a - places[:, 0]) ** 2 + (b - places[:, 1]) ** 2
        for k, j in enumerate(np.lexsort((np.arange(len(places)), d2))[:7]):
            assert got[i, k + 1] == (j, d2[j])


def test_field_beyond_the_pole(spark):
    """The same place and field, seen with north and east turned about."""
    at = lambda lat, lon: mainfield.synthesize(m.g, m.h, np.array([lat]), np.array([lon]), np.array([0.5])).ravel()
    m = mainfield.Model(2020.0, LOW_DEGREE)
    for lat, lon in ((100.0, 30.0), (-130.0, 10.0), (265.0, 70.0)):
        assert np.allclose(at(lat, lon) * [-1, -1, 1], at(180.0 - lat, lon + 180.0))
        assert np.allclose(at(lat + 360, lon), at(lat, lon))
    p = spark.createDataFrame([(1, 100.0), (2, 90.0), (3, -90.0), (4, 270.0005), (5, 80.0)], "id int, lat double").selectExpr("id", "lat", "30D AS lon", "0.5D AS height", "2020D AS year")
    assert {r.id for r in mainfield.result_table(p, [m]).where("decl IS NOT NULL").collect()} == {1, 5}


def test_gradients_by_small_steps(spark):
    """Near the pole too, against differences along arcs of the ellipsoid."""
    m = mainfield.Model(2020.0, LOW_DEGREE)
    p = spark.createDataFrame([(40.0,), (-70.0,), (89.99,), (95.0,)], "lat double").selectExpr("lat", "30D AS lon", "0.5D AS height", "2020D AS year")
    for r in mainfield.gradients(p, [m]).collect():
        along, across = (float(v[0]) + 0.5 for v in mainfield.curvatures(np.array([r.lat])))
        for got, (da, db), size in ((r.d_north, (1e-3, 0.0), along), (r.d_east, (0.0, 1e-3), across * np.cos(np.radians(r.lat)))):
            up, back = (mainfield.synthesize(m.g, m.h, np.array([r.lat + s * da]), np.array([30.0 + s * db]), np.array([0.5])).ravel() for s in (1, -1))
            assert np.allclose([got.x, got.y, got.z], (up - back) / (np.radians(2e-3) * size), rtol=1e-5, atol=1e-3)


def test_places_in_the_turn_of_others(spark):
    from pyspark.sql import functions as F

    rows = [(50.0, -170.0, 50.0, 190.0), (85.0, 30.0, 95.0, 210.0), (-50.0, 10.0, -50.0, 10.0), (-80.0, 20.0, 260.0, 560.0), (10.0, 180.0, 10.0, -180.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, near_lat double, near_lon double")
    got = df.select("near_lat", "near_lon", geo.in_turn_of(F.col("lat"), F.col("lon"), F.col("near_lat"), F.col("near_lon")).alias("t")).collect()
    want = {(50.0, 190.0): (50.0, 190.0), (95.0, 210.0): (95.0, 210.0), (-50.0, 10.0): (-50.0, 10.0), (260.0, 560.0): (260.0, 560.0), (10.0, -180.0): (10.0, -180.0)}
    assert {(r.near_lat, r.near_lon): (r.t.lat, r.t.lon) for r in got} == want
