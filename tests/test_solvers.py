"""Kernels and loops against numpy, and the properties they must have."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorium.functions import angles, scalars
from factorium.functions import spatial as sp
from factorium.operators import bundle, coo, graph, linear, normal, optimize, polynomial, trajectory
from factorium.sources import graph_text, sinks
from factorium.streaming import incremental as inc

RNG = np.random.default_rng(7)


def spd(n):
    a = RNG.normal(size=(n, n))
    return a @ a.T + n * np.eye(n)


def test_dense_kernels():
    a, b = spd(12), RNG.normal(size=12)
    x = np.linalg.solve(a, b)
    l = linear.cholesky(a)  # noqa: E741
    assert np.allclose(linear.solve_cholesky(a, b), x) and np.allclose(linear.solve_lu(a, b), x)
    assert np.allclose(linear.solve_lower(l, b), np.linalg.solve(l, b)) and np.allclose(linear.solve_upper(l.T, b), np.linalg.solve(l.T, b))
    assert np.allclose(linear.schur_solve(a, b, 6), x)
    v = RNG.normal(size=12)
    up = linear.update_factor(l, v)
    assert np.allclose(up @ up.T, a + np.outer(v, v)) and np.allclose(linear.update_factor(up, v, -1.0), l)
    assert linear.cholesky(-a) is None
    inv = np.linalg.inv(a)
    head, tail = linear.schur_marginals(a, 6)
    assert np.allclose(head, inv[:6, :6]) and np.allclose(tail, inv[6:, 6:]) and np.allclose(linear.marginal_columns(a, [2, 5]), inv[:, [2, 5]])
    assert np.allclose(linear.solve_least_squares(a[:, :5], b), np.linalg.lstsq(a[:, :5], b, rcond=None)[0])


def test_distributed_kernels(spark):
    a, b = spd(15), RNG.normal(size=15)
    m = linear.as_matrix(spark, a)
    x = linear.conjugate_gradient(m, linear.as_vector(spark, b), steps=40)
    assert np.allclose(linear.dense_vector(x, 15), np.linalg.solve(a, b), atol=1e-6)
    want = sorted(np.linalg.eigvalsh(a), key=lambda v: -abs(v))[:3]
    assert np.allclose([r.value for r in linear.symmetric_eigenvalues(m, 3).orderBy("rank").collect()], want)
    assert np.allclose(sorted(linear.lanczos(m, 15, 15, 1e-9))[-2:], sorted(want)[-2:])
    rows = RNG.normal(size=(60, 3))
    t = spark.createDataFrame([tuple(map(float, r)) for r in rows], ["a", "b", "c"]).repartition(5)
    r = np.linalg.qr(rows, mode="r")
    assert np.allclose(linear.tall_qr(t, ["a", "b", "c"]), r * np.where(np.diag(r) < 0, -1, 1)[:, None])
    with pytest.raises(ValueError):
        linear.dense(m, 10**6)


def test_components_trees_and_sets(spark):
    r = random.Random(3)
    n = 30
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(28)}
    v = spark.range(n).select(F.col("id").alias("v"))
    e = spark.createDataFrame([(a, b, r.randrange(1, 9)) for a, b in sorted(pairs)], "a long, b long, weight long")
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    weights, tree = {(x.a, x.b): x.weight for x in e.collect()}, []
    for a, b in sorted(pairs, key=lambda p: (-weights[p], p)):
        if find(a) != find(b):
            tree.append((a, b))
            top[max(find(a), find(b))] = min(find(a), find(b))
    assert {x.v: x.component for x in graph.components(v, e).collect()} == {i: min(j for j in range(n) if find(j) == find(i)) for i in range(n)}
    got = {(x.a, x.b) for x in graph.maximum_spanning_tree(v, e).collect()}
    assert got == set(tree)
    few = e.where("a < 8 AND b < 8")  # the rounds of joins must agree with the driver
    v8 = v.where("v < 8")
    assert sorted(map(tuple, graph.components(v8, few, small=0).collect())) == sorted(map(tuple, graph.components(v8, few).collect()))
    assert sorted(map(tuple, graph.maximum_spanning_tree(v8, few, small=0).collect())) == sorted(map(tuple, graph.maximum_spanning_tree(v8, few).collect()))
    chosen = {x.v for x in graph.maximal_independent_set(v, e).collect()}
    near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in range(n)}
    assert not any(a in chosen and b in chosen for a, b in pairs) and all(i in chosen or near[i] & chosen for i in range(n))
    assert sorted((x.x, x.y, x.z) for x in graph.triangles(e).collect()) == [t for t in combinations(range(n), 3) if all(p in pairs for p in combinations(t, 2))]
    assert not graph.is_connected(v, e).first().connected
    order = [x.v for x in graph.schur_ordering(v, spark.createDataFrame([(i,) for i in sorted(chosen)], "v long")).orderBy("place").collect()]
    assert set(order[n - len(chosen) :]) == chosen


def ring(spark, n=12):
    """A closed polygon with small errors."""
    t = 2 * np.pi / n
    rows = [(i, i, (i + 1) % n, 1.0 + 0.02 * np.sin(i), 0.01 * np.cos(3 * i), t + 0.01 * np.sin(2 * i)) for i in range(n)]
    return spark.createDataFrame([(e, a, b, float(x), float(y), float(z)) for e, a, b, x, y, z in rows], "eid long, v0 long, v1 long, dx double, dy double, dt double")


def plain_newton(edges, n, steps, info=45.0):
    """The same in numpy with numeric Jacobians."""
    rows = [tuple(r)[1:] for r in edges.orderBy("eid").collect()]
    start = {r.v: np.array([r.x, r.y, r.t]) for r in optimize.initial_states(edges).collect()}
    x = np.concatenate([start[i] for i in range(n)])

    def residual(x):
        out = []
        for a, b, dx, dy, dt in rows:
            (xa, ya, ta), (xb, yb, tb) = x[3 * a : 3 * a + 3], x[3 * b : 3 * b + 3]
            c, s = np.cos(ta), np.sin(ta)
            e = dt - np.fmod(tb - ta, 2 * np.pi)
            e = (e + np.pi) % (2 * np.pi) - np.pi
            out += [dx - (c * (xb - xa) + s * (yb - ya)), dy - (c * (yb - ya) - s * (xb - xa)), e]
        return np.array(out)

    for _ in range(steps):
        j = np.stack([(residual(x + d) - residual(x - d)) / 2e-6 for d in np.eye(len(x)) * 1e-6], -1)
        h = info * j.T @ j
        h[:3, :3] += np.eye(3)
        x = x + np.linalg.solve(h, -info * j.T @ residual(x))
    return x, info * float(residual(x) @ residual(x))


def test_newton_is_numpy_and_damped_steps_fall(spark):
    e = ring(spark, 6)
    x, chi = plain_newton(e, 6, 3)
    s = optimize.gauss_newton(optimize.PoseGraph(e), 3, 1e-9)
    got = np.array([[r.x, r.y] for r in s.states.orderBy("v").collect()])
    assert np.isclose(s.chi2, chi, rtol=1e-5) and np.allclose(got, x.reshape(-1, 3)[:, :2], atol=1e-4)
    lm = optimize.levenberg_marquardt(optimize.PoseGraph(e), 3, 1e-9)
    assert all(b <= a for a, b in zip(lm.history, lm.history[1:])) and lm.chi2 < lm.history[0]
    few = ring(spark, 3)
    schur = optimize.gauss_newton(optimize.PoseGraph(few), 1, 1e-9, solver="schur")
    cg = optimize.gauss_newton(optimize.PoseGraph(few), 1, 1e-9, solver="cg")
    assert np.isclose(schur.chi2, cg.chi2, rtol=1e-3)
    sigma, at = optimize.marginals_of(optimize.PoseGraph(e), s.states)
    a, b = ((r.x, r.y, r.t) for r in s.states.orderBy("v").limit(2).collect())
    cov = optimize.relative_covariance(sigma, a, b, at[0], at[1])
    assert np.all(np.linalg.eigvalsh(cov) > 0)


def test_damped_steps_beyond_the_dense_limit(spark, monkeypatch):
    """With states and systems as tables the steps are those of the dense path; a constant vertex stays."""
    g = optimize.PoseGraph(ring(spark, 4))
    fixed = optimize.PoseGraph(g.edges, constant=[2])
    want = [optimize.levenberg_marquardt(x, 2, 1e-9) for x in (g, fixed)]
    monkeypatch.setattr(optimize, "DENSE_LIMIT", 9)
    for x, s in zip((g, fixed), want):
        got = optimize.levenberg_marquardt(x, 2, 1e-9)
        assert got.iterations == s.iterations and np.allclose(got.history, s.history, rtol=1e-6)
        states = [[tuple(r) for r in y.states.orderBy("v").collect()] for y in (got, s)]
        assert np.allclose(*states, atol=1e-6)


def test_gradients_go_on_until_the_tolerance(spark, monkeypatch):
    n = 20
    a = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    m, b = linear.as_matrix(spark, a), linear.as_vector(spark, np.eye(n)[0])
    with pytest.warns(UserWarning, match="in 5 steps"):
        linear.conjugate_gradient(m, b, steps=5)
    assert np.allclose(linear.dense_vector(linear.conjugate_gradient(m, b), n), np.linalg.solve(a, np.eye(n)[0]), atol=1e-8)
    asked = []
    solve = optimize.conjugate_gradient
    monkeypatch.setattr(optimize, "conjugate_gradient", lambda *x, **k: asked.append(k) or solve(*x, **k))
    optimize.gauss_newton(optimize.PoseGraph(ring(spark, 3)), 1, 1e-9, solver="cg")
    assert asked and not any("steps" in k or "tolerance" in k for k in asked)


def test_spatial_algebra():
    a, b, c = (RNG.uniform(-1, 1, (50, 6)) for _ in range(3))
    close = lambda p, q: np.allclose(p[:, :3], q[:, :3], atol=1e-9) and np.allclose(sp.axis_angle_to_matrix(p[:, 3:]), sp.axis_angle_to_matrix(q[:, 3:]), atol=1e-9)
    assert close(sp.compose(a, sp.relative(a, b)), b) and close(sp.compose(sp.compose(a, b), c), sp.compose(a, sp.compose(b, c)))
    assert close(sp.compose(a, sp.inverse(a)), np.zeros((50, 6)))
    assert np.allclose(sp.quaternion_to_axis_angle(sp.axis_angle_to_quaternion(a[:, 3:])), a[:, 3:])
    assert np.allclose(sp.matrix_to_rpy(sp.rpy_to_matrix(a[:, 3:])), a[:, 3:])
    assert np.allclose(sp.pose_error(sp.relative(a, b), a, b), 0, atol=1e-9)
    assert np.allclose(sp.matrix_to_axis_angle(sp.axis_angle_to_matrix(np.array([[0, 0, np.pi - 1e-7], [np.pi - 1e-9, 0, 0]]))), [[0, 0, np.pi - 1e-7], [np.pi - 1e-9, 0, 0]], atol=1e-6)


def test_camera_jacobians():
    cam, k = np.array([0.1, -0.2, -5.0, 0.1, 0.2, -0.1]), np.array([500.0, 510.0, 320.0, 240.0, 0.1])
    for _ in range(5):
        p = RNG.uniform(-1, 1, 3)
        jc, jp = sp.projection_jacobians(cam, k, p)
        assert np.allclose(jp, sp.numeric_jacobian(lambda x: sp.project(cam, k, x), p, delta=1e-6), rtol=1e-3, atol=1e-2)
        assert np.allclose(jc, sp.numeric_jacobian(lambda x: sp.project(x, k, p), cam, sp.compose, 1e-6), rtol=1e-3, atol=1e-2)
    a, b = np.zeros((1, 6)), np.array([[1.0, 0.2, 0.1, 0.02, 0.1, 0.03]])
    kk, p = np.array([[500.0, 500, 320, 240, 0]]), np.array([[0.3, 0.2, 6.0]])
    assert abs(sp.epipolar_error(a, b, kk, kk, sp.project(a, kk, p), sp.project(b, kk, p))[0]) < 1e-6


def test_kabsch_and_structure(spark):
    a = RNG.normal(size=(40, 3))
    r = sp.axis_angle_to_matrix(np.array([0.3, -0.5, 0.8]))
    b = 1.7 * a @ r.T + [1, 2, 3]
    got, t, s = sp.kabsch(a, b, True)
    assert np.allclose(got, r) and np.isclose(s, 1.7) and np.allclose(t, [1, 2, 3])
    frame = lambda x: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "idx long, x double, y double, z double")
    pairs = trajectory.pair(frame(a), frame(b))
    rr, tt, ss = trajectory.alignment(pairs, True)
    assert np.allclose(rr, r) and np.isclose(ss, 1.7)
    assert trajectory.absolute_error(trajectory.transform(pairs, rr, tt, ss)).first().rmse < 1e-6
    with pytest.raises(Exception, match="length"):
        trajectory.pair(frame(a), frame(b[:-1])).collect()
    mean = sp.average_structure([a, b, a @ r.T])
    assert np.allclose(sp.kabsch(mean, a, True)[2] * (mean - mean.mean(0)) @ sp.kabsch(mean, a, True)[0].T, a - a.mean(0), atol=1e-6)


CUBIC = [(-0.894531, -0.789062), (-0.589844, -0.792969), (-0.460937, -0.71875), (0.554687, 0.277344), (0.777344, -0.167969), (0.468751, 0.527344), (0.167969, 0.332032), (0.0117185, -0.0429685), (0.902344, -0.761719), (-0.195313, -0.472657)]


def test_polynomials(spark):
    x, y = map(np.array, zip(*CUBIC))
    t = spark.createDataFrame([(float(a), float(b)) for a, b in CUBIC], "x double, y double")
    for powers in ([1, 2, 3], [0, 1, 2, 3]):
        basis = np.stack([x**p for p in powers], -1)
        assert np.allclose(polynomial.fit(t, "x", "y", powers), np.linalg.lstsq(basis, y, rcond=None)[0])
    line = spark.createDataFrame([(float(i), float(2.0 * i + 1 + 0.01 * np.sin(i) + (50.0 if i == 7 else 0.0))) for i in range(20)], "x double, y double")
    c, steps = polynomial.fit_robust(line, "x", "y", [0, 1])
    assert abs(c[1] - 2) < 0.01 and abs(c[0] - 1) < 0.1 and steps <= 25
    assert np.allclose(polynomial.real_roots([-6, 11, -6, 1]), [1, 2, 3]) and polynomial.real_roots([1, 0, 1]) == [] and np.allclose(polynomial.real_roots([4, 0, -5, 0, 1]), [-2, -1, 1, 2])


def test_distortion():
    r = np.linspace(0.01, 0.8, 30)
    u = r * (1 + 0.1 * r**2 - 0.02 * r**4)
    assert np.allclose(sp.undistort_newton(u, 0.1, -0.02), r)
    k = sp.fit_inverse_distortion(0.1, -0.02, 0.8)
    assert np.allclose(u + k[0] * u**3 + k[1] * u**5 + k[2] * u**7, r, atol=1e-4)


def test_jacobian_columns(spark):
    p = [0.3, -0.2, 0.7, 1.5, 0.9, -1.1]
    row = spark.createDataFrame([tuple(p)], [f"{e}_{k}" for e in "ab" for k in "xyt"])
    for f, jac in ((angles.relative, angles.relative_jacobians), (angles.compose, angles.compose_jacobians)):
        ja, jb = jac(angles.pose2("a"), angles.pose2("b"))
        got = np.array([row.select(*[x.cast("double") for r in j for x in r]).first() for j in (ja, jb)]).reshape(2, 3, 3)

        def value(v, f=f):
            t = spark.createDataFrame([tuple(map(float, v))], row.columns)
            return np.array(t.select(*f(angles.pose2("a"), angles.pose2("b"))).first())

        num = np.stack([(value(np.add(p, d)) - value(p)) / 1e-6 for d in np.eye(6) * 1e-6], -1)
        assert np.allclose(got[0], num[:, :3], atol=1e-4) and np.allclose(got[1], num[:, 3:], atol=1e-4)


def test_erf_is_close(spark):
    from math import erf

    x = [i / 10 for i in range(-30, 31)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(scalars.erf(F.col("x"))).collect()]
    assert max(abs(g - erf(v)) for g, v in zip(got, x)) < 2e-7


def test_sparse_steps_beyond_the_dense_limit(spark, monkeypatch):
    """Larger systems are factored by levels, without conjugate gradients, to the steps of the dense path; those that don't fit still go by tables."""
    g = optimize.PoseGraph(ring(spark, 4))
    fixed = optimize.PoseGraph(g.edges, constant=[2])
    run = lambda x: [f(x, 2, 1e-9) for f in (optimize.levenberg_marquardt, optimize.gauss_newton)]
    same = lambda a, b: a.iterations == b.iterations and np.allclose(a.history, b.history, rtol=1e-6) and np.allclose(*[[tuple(r) for r in y.states.orderBy("v").collect()] for y in (a, b)], atol=1e-6)
    want = [run(x) for x in (g, fixed)]
    tables = optimize.levenberg_marquardt(g, 2, 1e-9, solver="cg")
    assert same(tables, want[0][0])
    monkeypatch.setattr(optimize, "DENSE_LIMIT", 9)
    with monkeypatch.context() as m:
        m.setattr(optimize, "_table_system", None)
        assert all(same(a, b) for x, w in zip((g, fixed), want) for a, b in zip(run(x), w))
    states = optimize.initial_states(g.edges)
    assert isinstance(optimize._driver(g, states, "dense", None), optimize._Sparse)
    for limit in ("SPARSE_EDGES", "SPARSE_SIZE"):
        with monkeypatch.context() as m:
            m.setattr(optimize, limit, 5)
            assert optimize._driver(g, states, "dense", None) is None


def test_long_chains_are_led_without_joins(spark, monkeypatch):
    """More edges than once went to the driver, in thousands of levels: no table is written, and a plain search gives the same."""
    import pyarrow as pa

    monkeypatch.setattr(optimize, "settle", None)
    k = np.arange(40_500)
    v0, v1 = np.concatenate((k, k[:-20])), np.concatenate((k + 1, k[20:]))
    z = RNG.uniform(-2, 2, (len(v0), 3))
    edges = spark.createDataFrame(pa.table({"eid": np.arange(len(v0)), "v0": v0, "v1": v1, **{f"d{c}": z[:, i] for i, c in enumerate("xyt")}}))
    near = {}
    for e, (a, b) in enumerate(zip(v0.tolist(), v1.tolist())):
        near.setdefault(a, []).append((e, b, False))
        near.setdefault(b, []).append((e, a, True))
    want, front = {0: (0.0, 0.0, 0.0)}, [0]
    while front:
        reached = {}
        for v in front:
            for e, b, back in near[v]:
                if b not in want:
                    reached[b] = min(reached.get(b, (e, v, back)), (e, v, back))
        for b, (e, v, back) in reached.items():
            (x, y, t), (dx, dy, dt) = want[v], z[e]
            h = t - dt if back else t
            x1, y1 = np.cos(h) * dx - np.sin(h) * dy, np.sin(h) * dx + np.cos(h) * dy
            want[b] = (x - x1, y - y1, np.fmod(h, 2 * np.pi)) if back else (x + x1, y + y1, np.fmod(t + dt, 2 * np.pi))
        front = list(reached)
    got = optimize.initial_states(edges).toArrow().sort_by("v")
    assert got.column("v").to_pylist() == sorted(want)
    assert np.allclose(np.stack([got.column(c).to_numpy() for c in "xyt"], -1), [want[v] for v in sorted(want)], atol=1e-6)
    assert not optimize.initial_states(edges.limit(0)).count()


def test_sparse_systems_are_those_of_sums(spark, monkeypatch):
    """Chi-square and system come from one linearization a state, with loops, repeated edges, ends that are no vertices, measurements that are null, constant vertices and robust weights."""
    rows = [tuple(r) for r in ring(spark, 6).collect()] + [(20, 3, 1, 0.5, -1.0, 0.3), (21, 1, 3, 0.4, 1.0, -0.3), (22, 2, 2, 0.1, 0.2, 0.3), (23, 4, 99, 1.0, 1.0, 1.0), (24, 0, 1, None, 1.0, 1.0)]
    edges = spark.createDataFrame(rows, "eid long, v0 long, v1 long, dx double, dy double, dt double")
    states = spark.createDataFrame([(v, *RNG.normal(size=3).tolist()) for v in range(6)], "v long, x double, y double, t double")
    for more in ({}, {"robust": 0.2}, {"constant": [0, 4]}):
        g = optimize.PoseGraph(edges, **more)
        dense = optimize._Dense(g, states, "dense", None)
        a, b, largest = dense.assemble()
        want = dense.chi2()
        with monkeypatch.context() as m:
            m.setattr(optimize, "systems", None)
            m.setattr(optimize, "chi2_of", None)
            sparse, passes, plain = optimize._Sparse(g, states), [], optimize.linearized
            m.setattr(optimize, "linearized", lambda *x: passes.append(1) or plain(*x))
            assert np.isclose(sparse.chi2(), want)
            (i, j, r, c, x), right, top = sparse.assemble()
            assert len(passes) == 1
        full = np.zeros_like(a)
        full[3 * i + r, 3 * j + c] = full[3 * j + c, 3 * i + r] = x
        assert np.allclose(full, a) and np.allclose(right, b) and np.isclose(top, largest)


@pytest.mark.parametrize("n, e", [(1, 0), (5, 3), (30, 60), (40, 10)])
def test_levels_solve_as_numpy(n, e):
    """Several components, loops, repeated edges and ends that are no vertices."""
    from factorium.operators.levels import Levels

    ids = np.sort(RNG.choice(1000, n, replace=False))
    v0, v1 = RNG.choice(np.append(ids, 5000), e), RNG.choice(ids, e)
    tree, a, b = Levels(ids, v0, v1), np.zeros((3 * n, 3 * n)), RNG.normal(size=(n, 3))
    for v, w in zip(v0, v1):
        if v != 5000:
            at = np.concatenate([3 * np.searchsorted(ids, u) + np.arange(3) for u in (v, w)])
            j = RNG.normal(size=(3, 6))
            a[np.ix_(at, at)] += j.T @ j
    entries = np.array([(i, j, r, c, a[3 * i + r, 3 * j + c]) for i in range(n) for j in range(i, n) for r in range(3) for c in range(3) if a[3 * i + r, 3 * j + c]]).reshape(-1, 5).T
    x = tree.solve(*entries[:4].astype(int), entries[4], b, 0.5)
    assert np.allclose((a + 0.5 * np.eye(3 * n)) @ x, b.ravel())
    assert tree.solve(*entries[:4].astype(int), entries[4], b, -1e6) is None


def test_factors_in_pieces(monkeypatch):
    """A factor of which one level at a time is held solves as the whole one does."""
    from factorium.operators import levels

    n = 60
    v0, v1 = np.append(np.arange(n - 1), np.arange(n - 5)), np.append(np.arange(1, n), np.arange(5, n))
    i, j = np.append(np.arange(n), v0), np.append(np.arange(n), v1)
    entries = np.repeat(i, 9), np.repeat(j, 9), *np.divmod(np.tile(np.arange(9), len(i)), 3)
    x = np.concatenate([(m + m.T).ravel() + 40 * np.eye(3).ravel() * (k < n) for k, m in enumerate(RNG.normal(size=(len(i), 3, 3)))])
    b, found = RNG.normal(size=(n, 3)), []
    for most in (10**9, 700, 1):
        monkeypatch.setattr(levels, "PIECE", most)
        tree = levels.Levels(np.arange(n), v0, v1)
        found.append((len(tree.cuts) - 1, tree.solve(*entries, x, b, 0.5)))
        assert tree.solve(*entries, x, b, -100.0) is None
    pieces, got = zip(*found)
    assert pieces[0] == 1 < pieces[1] < pieces[2] == len(tree.levels)
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2])


def test_the_smaller_factor_is_taken(spark):
    """A chain of hundreds of poses has no full matrix on the driver, unless it is asked for."""
    g = optimize.PoseGraph(ring(spark, 150))
    states = optimize.initial_states(g.edges)
    assert isinstance(optimize._driver(g, states, "dense", None), optimize._Sparse)
    assert isinstance(optimize._driver(g, states, "schur", None), optimize._Dense)


def test_bundle_adjustment(spark):
    k = [500.0, 500.0, 320.0, 240.0, 0.0]
    cams = np.array([[0, 0, -6, 0, 0, 0], [1, 0, -6, 0, -0.15, 0], [-1, 0.5, -6, 0.05, 0.15, 0.02]], dtype=float)
    pts = RNG.uniform(-1, 1, (20, 3))
    o = bundle.BundleOptimizer(spark)
    for i, c in enumerate(cams):
        o.add_camera(i, c + (0.01 if i == 2 else 0.0), k)
    for i, p in enumerate(pts):
        o.add_point(i, p + RNG.normal(size=3) * 0.02)
        for c in range(3):
            o.add_projection(i, c, sp.project(cams[c], np.array(k), p))
    done = bundle.bundle_adjust(*o.frames(), iterations=6, threshold=1e-8, constant=[0, 1])
    o.result = done
    assert all(b < a for a, b in zip(done.history, done.history[1:])) and done.chi2 < 1e-3 * done.history[0]
    assert len(o.dump()) == 23


def test_bundle_steps_are_those_of_the_whole_system(monkeypatch):
    """Points seen 0 to 7 times, by one camera twice too, in small pieces: the passes over a batch solve the undivided system."""
    import pyarrow as pa

    monkeypatch.setattr(bundle, "PIECE", 4)
    ids = np.array([3, 5, 9])
    pose = np.array([[0, 0, -6, 0, 0, 0], [1, 0, -6, 0, -0.15, 0], [-1, 0.5, -6, 0.05, 0.15, 0.02]], dtype=float)
    k = np.tile([500.0, 500.0, 320.0, 240.0, 0.1], (3, 1))
    st, n = bundle._Cameras(ids, pose, k), np.array([3, 0, 1, 7, 2, 0])
    xyz, cam = RNG.uniform(-1, 1, (len(n), 3)), RNG.integers(0, 3, n.sum())
    own = np.repeat(np.arange(len(n)), n)
    uv, w = sp.project(pose[cam], k[cam], xyz[own]) + RNG.normal(size=(len(cam), 2)), np.array([[2.0, 0.3], [0.3, 1.0]])
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(x))
    ones = np.ones(len(cam))
    b = pa.RecordBatch.from_pydict({"point": pa.array(np.arange(len(n))), **{c: pa.array(xyz[:, i]) for i, c in enumerate("xyz")}, "n": pa.array(n, pa.int32()), "cam": lists(ids[cam]), "u": lists(uv[:, 0]), "v": lists(uv[:, 1]), "i00": lists(2 * ones), "i01": lists(0.3 * ones), "i11": lists(ones)})
    jc, jp = sp.projection_jacobians(pose[cam], k[cam], xyz[own])
    j, r, alpha = np.zeros((2 * len(cam), 18 + 3 * len(n))), (uv - sp.project(pose[cam], k[cam], xyz[own])).ravel(), 0.7
    for e, (c, p) in enumerate(zip(cam, own)):
        j[2 * e : 2 * e + 2, 6 * c : 6 * c + 6], j[2 * e : 2 * e + 2, 18 + 3 * p : 21 + 3 * p] = jc[e], jp[e]
    big = np.kron(np.eye(len(cam)), w)
    h, g = j.T @ big @ j + alpha * np.eye(j.shape[1]), j.T @ big @ r
    want = np.linalg.solve(h, g)
    a, red, mine = np.zeros((18, 18)), np.zeros(18), np.zeros(18)
    for out in bundle._reduce(st, alpha)(iter([b])):
        for key, s in zip(out.column("key").to_pylist(), out.column("s").to_pylist()):
            if key >= 9:
                i = 6 * (key - 9)
                red[i : i + 6] += s[:6]
                mine[i : i + 6] += s[6:12]
            else:
                p, q = 6 * (key // 3), 6 * (key % 3)
                a[p : p + 6, q : q + 6] += np.reshape(s, (6, 6))
                if p != q:
                    a[q : q + 6, p : p + 6] += np.reshape(s, (6, 6)).T
    x = np.linalg.solve(a + alpha * np.eye(18), red)
    assert np.allclose(x, want[:18]) and np.allclose(mine, g[:18])
    moved = pa.Table.from_batches(bundle._back_substitute(st, x.reshape(3, 6), st, alpha)(iter([b]))).to_pandas()
    d = want[18:].reshape(-1, 3)
    assert np.allclose(moved[["x", "y", "z"]], xyz + d) and np.allclose(moved["step"], (d * d).sum(1)) and np.isclose(moved["gain"].sum(), want[18:] @ (alpha * want[18:] + g[18:]))
    (m,) = bundle._measure(st)(iter([b]))
    assert np.isclose(m.column("chi2")[0].as_py(), r @ big @ r)


def test_bundle_leaves_out_what_has_no_state(spark):
    """Unseen points stay, edges of unknown cameras or points don't count."""
    k, e = [500.0, 500.0, 320.0, 240.0, 0.0], bundle.BundleOptimizer(spark)
    for c in range(2):
        e.add_camera(c, [c - 0.5, 0, -6, 0, 0, 0], k)
    for p in range(4):
        e.add_point(p, [0.1 * p, 0.2, 0.3])
    for p, c in [(0, 0), (0, 1), (1, 0), (1, 1), (2, 7), (9, 0)]:
        e.add_projection(p, c, [330.0 + p, 250.0])
    done = e.optimize(2, 1e-9)
    points = {r.point: (r.x, r.y, r.z) for r in done.points.collect()}
    assert sorted(points) == [0, 1, 2, 3] and points[2] == (0.2, 0.2, 0.3) and done.chi2 < done.history[0]


def test_bad_lines(spark):
    lines = spark.createDataFrame([(0, "EDGE2 0 1 1 2"), (1, "VERTEX2 0 1 2 x"), (2, "VERTEX2 1 0 0 0"), (3, "")], "line long, value string")
    assert sorted((r.line, r.ok) for r in graph_text.parse(lines, strict=False).collect()) == [(0, False), (1, False), (2, True)]
    with pytest.raises(Exception, match="cannot read line"):
        graph_text.parse(lines).collect()
    graph_text.register("MY_TOKEN", graph_text.Token("edge", "Mine", 1, 2))
    own = spark.createDataFrame([(0, "my_token 4 1.5 2")], "line long, value string")
    assert tuple(graph_text.parse(own).select("type", "ids", "z").first()) == ("Mine", [4], [1.5, 2.0])
    with pytest.raises(Exception, match="no such type"):
        graph_text.routed(graph_text.parse(own), ["Pose2D"]).collect()


def test_reconstruction_readers(spark, tmp_path):
    (tmp_path / "b.out").write_text("# Bundle file v0.3\n1 1\n500 0 0\n1 0 0\n0 1 0\n0 0 1\n0 0 0\n1 2 3\n255 0 0\n1 0 5 10.5 -3\n")
    (tmp_path / "m.nvm").write_text("NVM_V3\n\n1\nimg.jpg 500 1 0 0 0 0 0 0 0 0\n\n1\n1 2 3 9 9 9 1 0 4 7.5 8\n")
    for read, file in ((sinks.read_bundler, "b.out"), (sinks.read_nvm, "m.nvm")):
        rows = read(spark, str(tmp_path / file)).collect()
        assert [r.kind for r in rows] == ["camera", "point", "observation"] and rows[1]["values"] == [1.0, 2.0, 3.0] and rows[2].cam == 0
    poses = tmp_path / "p.txt"
    poses.write_text("1 2 3 0 0 0.5\n")
    p = sinks.read_poses(spark, str(poses), invert=True).first().p
    assert np.allclose(sp.compose(np.array(p), np.array([1, 2, 3, 0, 0, 0.5])), 0, atol=1e-9)


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(1, "VERTEX2", [1.0, 2.0, 0.5]), (0, "VERTEX2", [0.0, 0.0, 0.0])], "id long, token string, state array<double>")
    sinks.write_states(s, str(tmp_path / "s"))
    back = graph_text.vertices(graph_text.parse(graph_text.read_lines(spark, str(tmp_path / "s"))))
    assert sorted((r.id, r.state) for r in back.collect()) == [(0, [0.0, 0.0, 0.0]), (1, [1.0, 2.0, 0.5])]
    m = spark.createDataFrame([(0, 1, 2.5), (2, 0, 1.0)], "i long, j long, x double")
    sinks.write_matrix(m, 3, 2, str(tmp_path / "m"))
    lines = graph_text.read_lines(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, coo.from_matrix_market(lines).collect())) == [(0, 1, 2.5), (2, 0, 1.0)]
    assert sinks.matlab_vector("v", [1, 2.5]) == "v = [1 2.5];" and sinks.block_layout([3, 2]) == "5 2\n0 3 5\n"
    assert sinks.matlab_sparse(m, "A", 3, 2).orderBy("n").first().value == "A(3,1) = 1.0;"


SQUARE = [(0, 0, 1, 1.02765, -0.00745597, 0.00483283), (1, 1, 2, -0.0120155, 1.00436, 1.56679), (2, 2, 3, 0.0440195, 0.988477, -1.56353), (3, 3, 0, 0.0139844, -1.02344, -0.00780158)]
EDGES = "eid long, v0 long, v1 long, dx double, dy double, dt double"


def test_policy_steps():
    p = inc.Policy(nonlinear=3, linear=1, need_closure=True)
    c = inc.Counters()
    assert [inc.decide(p, c, 1, 1, False) for _ in range(3)] == [inc.NONE] * 3
    assert inc.decide(p, c, 1, 0, True) == inc.NONLINEAR
    assert inc.decide(inc.Policy(nonlinear=3, linear=1, need_closure=False), c, 1, 1, False) == inc.LINEAR
    c.delayed = True
    assert inc.decide(p, c, 1, 9, True) == inc.NONE
    assert inc.decide(inc.Policy(nonlinear=0, linear=0, need_closure=False), inc.Counters(), 1, 5, True) == inc.NONE


def test_online_equals_batch(spark, tmp_path):
    done = []
    s = inc.OnlineSolver(inc.Policy(nonlinear=1, threshold=0.01), on_solution=lambda sol, i: done.append(i))
    schema = spark.createDataFrame([], EDGES).schema
    source = tmp_path / "in"
    for i, e in enumerate(SQUARE):
        spark.createDataFrame([e], schema).coalesce(1).write.mode("append").parquet(str(source))
    q = s.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(source)), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    final = s.finish(spark)
    batch = optimize.gauss_newton(optimize.PoseGraph(spark.createDataFrame(SQUARE, EDGES)), 10, 1e-6)
    assert len(s.edges) == 4 and abs(final.chi2 - batch.chi2) < 1e-2 * max(1.0, batch.chi2)


def test_replaced_edges_and_delay(spark):
    s = inc.OnlineSolver(inc.Policy(nonlinear=1, need_closure=False))
    s.delay()
    assert s.add(spark.createDataFrame(SQUARE[:3], EDGES)) == inc.NONE
    s.add(spark.createDataFrame([(1, 1, 2, 0.0, 1.0, 1.5)], EDGES))
    assert s.changed_from == 1 and s.edges[1][3] == 0.0
    s.enable()
    assert s.add(spark.createDataFrame(SQUARE[3:], EDGES)) in (inc.LINEAR, inc.NONLINEAR, inc.NONE)


def test_normal_blocks_are_numpy(spark):
    e = spark.createDataFrame([(0, 0, 1, 2.0, 3.0), (1, 1, 2, -1.0, 0.5), (2, 0, 2, 1.5, 1.0)], "eid long, v0 long, v1 long, p double, q double")
    j0, j1 = [[F.col("p"), F.lit(1.0)]], [[F.col("q"), F.lit(-1.0)]]
    got = {(r.bi, r.bj, r.r, r.c): r.x for r in normal.blocks(e, ["v0", "v1"], [j0, j1], [[F.lit(2.0)]]).collect()}
    h = np.zeros((6, 6))
    for _, a, b, p, q in e.collect():
        j = np.zeros(6)
        j[2 * a : 2 * a + 2], j[2 * b : 2 * b + 2] = [p, 1], [q, -1]
        h += 2 * np.outer(j, j)
    assert all(np.isclose(h[2 * i + r, 2 * j + c], x) for (i, j, r, c), x in got.items()) and len(got) == 6 * 4


def test_lines_are_numbered_over_files_and_parts(spark, tmp_path):
    """Without gaps, in the order of the files' names, though the larger file is read first and in several parts."""
    want = [f"a {i}" for i in range(100)] + [f"b {i}" for i in range(3000)]
    (tmp_path / "a.txt").write_text("".join(f"{x}\n" for x in want[:100]))
    (tmp_path / "b.txt").write_text("".join(f"{x}\n" for x in want[100:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = [tuple(r) for r in graph_text.read_lines(spark, str(tmp_path)).orderBy("line").collect()]
        limited = graph_text.fields(graph_text.read_lines(spark, str(tmp_path)), line_limit=2000).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(want))
    assert limited == 2000


def test_relative_errors_are_of_the_motions(spark):
    """Against poses as matrices; a trajectory that is only moved and turned as a whole has none."""
    r = np.random.default_rng(3)
    a, b = r.normal(size=(40, 3)), r.normal(size=(40, 3))
    matrix = lambda p: np.array([[np.cos(p[2]), -np.sin(p[2]), p[0]], [np.sin(p[2]), np.cos(p[2]), p[1]], [0, 0, 1]])

    def off(i, j):
        motion = [np.linalg.inv(matrix(s[i])) @ matrix(s[j]) for s in (a, b)]
        e = np.linalg.inv(motion[0]) @ motion[1]
        return np.hypot(e[0, 2], e[1, 2]), np.degrees(abs(np.arctan2(e[1, 0], e[0, 0])))

    columns = "idx long, " + ", ".join(f"{s}_{k} double" for s in "ab" for k in "xyt")
    poses = spark.createDataFrame([(i, *map(float, a[i]), *map(float, b[i])) for i in range(40)], columns)
    want = np.array([off(i, i - 3) for i in range(3, 40)])
    got = trajectory.relative_error(poses, 3).first()
    assert got.n == 37 and np.allclose([got.translation, got.rotation], want.sum(axis=0))
    assert np.allclose([got.rmse_translation, got.rmse_rotation], np.sqrt((want**2).mean(axis=0)))
    total = sum(off(i, j)[0] ** 2 for i in range(40) for j in range(i))
    assert np.isclose(trajectory.relative_error_all(poses.selectExpr("1 AS g", "*"), ["g"]).first().squared_translation, total / 40)
    moved = np.array([matrix((2, 1, 0.7)) @ matrix(p) for p in a])
    same = spark.createDataFrame([(i, *map(float, a[i]), float(m[0, 2]), float(m[1, 2]), float(np.arctan2(m[1, 0], m[0, 0]))) for i, m in enumerate(moved)], columns)
    assert trajectory.relative_error(same, 1).first().rmse_rotation < 1e-6


@pytest.mark.parametrize("block", [2, 2000])
def test_shared_landmarks_split_and_whole(spark, block):
    rnd = random.Random(3)
    rows = [(rnd.randrange(9), 0) for _ in range(40)] + [(rnd.randrange(30), rnd.randrange(1, 12)) for _ in range(80)] + [(None, 0), (None, 1), (4, None), (5, None)]
    sees = spark.createDataFrame(rows, "cam long, landmark long")
    weight, shared = {}, {}
    for (c, m), (d, k) in combinations([r for r in rows if None not in r], 2):
        if m == k:
            at = (min(c, d), max(c, d))
            weight[at] = weight.get(at, 0) + 1
            if c != d:
                shared.setdefault(at, set()).add(m)
    assert {(r.lo, r.hi): r.weight for r in graph.covisibility(sees, block).collect()} == weight
    assert {(r.lo, r.hi): r.shared for r in graph.co_observation(sees, block).collect()} == {k: len(v) for k, v in shared.items()}
    assert graph.covisibility(sees.limit(0), block).count() == graph.co_observation(sees.limit(0), block).count() == 0


def test_spatial_lines_become_states(spark):
    turns = np.vstack((RNG.uniform(-3, 3, size=(20, 3)), np.zeros((1, 3)), [[1e-9, 0, 0]]))
    quats = np.vstack((RNG.normal(size=(20, 4)), [[0, 0, 0, 1], [0, 0, 0, -2]]))
    at = RNG.normal(size=(22, 3))
    line = lambda *x: " ".join(map(str, x))
    info = [1.0] * 21
    text = [line("EDGE3", i, i + 1, *p.tolist(), *t.tolist(), *info) for i, (p, t) in enumerate(zip(at, turns))]
    text += [line("EDGE3", 5, 5, *at[0].tolist(), *turns[0].tolist(), *info), line("EDGE3:AXISANGLE", 100, 101, 1.0, 2.0, 3.0, 0.1, 0.2, 0.3, *info)]
    text += [line("VERTEX3", 200 + i, *p.tolist(), *t.tolist()) for i, (p, t) in enumerate(zip(at, turns))]
    text += [line("VERTEX_CAM", 300 + i, *p.tolist(), *q.tolist(), 500.0, 501.0, 3.0, 4.0, 0.1) for i, (p, q) in enumerate(zip(at, quats))]
    text += [line("VERTEX_SCAM", 400, *at[0].tolist(), *quats[0].tolist(), 500.0, 501.0, 3.0, 4.0, 0.1, 0.25), line("VERTEX_XYZ", 500, 1.0, 2.0, 3.0), line("VERTEX_SPHERON:QUAT", 501, 1.0, 2.0, 3.0, 0.0, 0.0, 0.6, 0.8)]
    records = graph_text.parse(spark.createDataFrame(list(enumerate(text)), "line long, value string"))
    edges = {r.ids[0]: r for r in graph_text.edges_3d(records).collect()}
    assert len(edges) == 23 and {r.type for r in edges.values()} == {"Pose3D"}
    want = np.hstack((at, sp.rpy_to_axis_angle(turns)))
    assert np.allclose([edges[i].z for i in range(22)], want, atol=1e-7) and edges[100].z == [1.0, 2.0, 3.0, 0.1, 0.2, 0.3]
    states = {r.id: r.state for r in graph_text.vertices(records).collect()}
    assert np.allclose([states[200 + i] for i in range(22)], want, atol=1e-7)
    cameras = np.hstack((sp.camera_from_file(at, quats), np.tile([500.0, 501.0, 3.0, 4.0, 0.1], (22, 1))))
    assert np.allclose([states[300 + i] for i in range(22)], cameras, atol=1e-7)
    assert np.allclose(states[400], [*cameras[0], 0.25]) and states[500] == [1.0, 2.0, 3.0] and states[501] == [1.0, 2.0, 3.0, 0.0, 0.0, 0.6, 0.8]


def test_first_guesses_by_driver_and_by_joins(spark):
    rnd = random.Random(11)
    rows = [(i, i, i + 1) for i in range(20)] + [(100 - i, a, b) for i in range(40) for a, b in [sorted(rnd.sample(range(21), 2))]]
    rows += [(7, 3, 9), (7, 3, 9), (200, 40, 41)]
    data = [(e, a, b, rnd.uniform(-2, 2), rnd.uniform(-2, 2), rnd.uniform(-3, 3)) for e, a, b in rows]
    edges = spark.createDataFrame(data, "eid long, v0 long, v1 long, dx double, dy double, dt double")
    driver, joins = ({r.v: (r.x, r.y, r.t) for r in optimize.initial_states(edges, small=n).collect()} for n in (1000, 0))
    assert set(driver) == set(joins) == set(range(21))
    assert all(np.allclose(driver[v], joins[v]) for v in driver)
