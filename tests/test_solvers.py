"""Iterative solvers, gradient checks, shapes and files against numpy or worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import graph, kernels, shapes, solvers
from loamgrid.sources import files
from loamgrid.sources.fixtures import write_bytes
from loamgrid.sources.scratch import new_path

PAIR = "i long, j long, value double"


def test_jacobi_solve(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(8, 8)) + 30 * np.eye(8)
    b = rng.normal(size=8)
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(8) for j in range(8)], PAIR)
    rhs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "i long, b double")
    got = {r["i"]: r["x"] for r in solvers.jacobi_solve(m, rhs).collect()}
    assert np.allclose([got[i] for i in range(8)], np.linalg.solve(a, b), atol=1e-8)


def test_jacobi_solve_says_when_it_fails(spark):
    rhs = spark.createDataFrame([(0, 1.0), (1, 1.0)], "i long, b double")
    with pytest.raises(ArithmeticError, match="no solution"):
        solvers.jacobi_solve(spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 3.0), (1, 1, 1.0)], PAIR), rhs, rounds=4)
    with pytest.raises(ArithmeticError, match="diagonal"):
        solvers.jacobi_solve(spark.createDataFrame([(0, 0, 1.0)], PAIR), rhs)
    assert solvers.jacobi_solve(spark.createDataFrame([], PAIR), rhs.where("false")).count() == 0


@pytest.fixture(scope="module")
def grid(spark):
    cells = spark.range(30).select(F.col("id").alias("cell"), F.floor(F.col("id") / 6).alias("row"), (F.col("id") % 6).alias("col"), F.sin(F.col("id") * 1.3).alias("a"))
    return cells, graph.generator(cells, ["a"], beta=0.1, gamma=(0.2, 0.5), delta=(0.1, 0.4)), spark.createDataFrame([(1, 3), (2, 29)], "target long, cell long")


def test_gmres_times(grid):
    _, e, targets = grid
    both = solvers.gmres_times(e, targets).join(kernels.hitting_times(e, targets).withColumnRenamed("ht", "h"), ["target", "cell"]).collect()
    assert len(both) == 60 and all(r["ht"] == pytest.approx(r["h"], rel=1e-6, abs=1e-9) for r in both)


def test_gradient_check_finds_a_wrong_gradient(grid, monkeypatch):
    cells, _, targets = grid
    how = dict(beta=0.1, gamma=(0.2, 0.5), delta=(0.1, 0.4))
    assert all(r["worst"] < 1e-5 for r in solvers.gradient_check(cells, ["a"], targets, **how).collect())
    right = kernels.hitting_sensitivity
    monkeypatch.setattr(solvers, "hitting_sensitivity", lambda e, t: right(e, t).withColumn("d_gamma", F.col("d_gamma") * 1.01))
    assert {r["parameter"]: r["worst"] > 1e-3 for r in solvers.gradient_check(cells, ["a"], targets, **how).collect()} == {"beta": False, "gamma": True, "delta": False}


def test_gradient_covariance(grid):
    _, e, targets = grid
    g = kernels.hitting_sensitivity(e, targets)
    frame = g.toPandas()
    for r in solvers.gradient_covariance(g).collect():
        want = np.cov(frame[frame.target == r["target"]][[f"d_{r['p']}", f"d_{r['q']}"]].to_numpy().T)
        assert r["cov"] == pytest.approx(want[0, 1])


@pytest.mark.parametrize("mirrored", [False, True])
def test_procrustes(spark, mirrored):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 2))
    b = (a * [1, -1 if mirrored else 1]) @ np.array([[0.6, 0.8], [-0.8, 0.6]]) * 3 + rng.normal(size=(20, 2)) * 0.2 + 5
    table = spark.createDataFrame([(k, *map(float, (*x, *y))) for k, (x, y) in enumerate(zip(a, b))], "id long, x double, y double, u double, v double")
    a0, b0 = a - a.mean(0), b - b.mean(0)
    u, s, vt = np.linalg.svd(b0.T @ a0)
    want = b0 @ (u @ vt) * s.sum() / (b0**2).sum() + a.mean(0)
    got = shapes.procrustes(table, "id").orderBy("id").collect()
    assert np.allclose([(r["px"], r["py"]) for r in got], want)


def test_procrustes_of_one_spot(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 2.0, 4.0, 5.0, 5.0), (3, None, 1.0, 1.0, 1.0)], "id long, x double, y double, u double, v double")
    assert {tuple(r) for r in shapes.procrustes(one, "id").collect()} == {(1, 1.0, 2.0), (2, 1.0, 2.0)}


def test_local_surface(spark):
    rng = np.random.default_rng(4)
    p, radius = rng.uniform(0, 10, size=(80, 2)), 3.0
    z = np.sin(p[:, 0]) + p[:, 1]
    points = spark.createDataFrame([(k, float(x), float(y), float(v)) for k, ((x, y), v) in enumerate(zip(p, z))], "b_id long, bx double, by double, z double")
    at = spark.createDataFrame([(k, float(k), 5.0) for k in range(2, 9)] + [(99, 500.0, 500.0)], "a_id long, ax double, ay double")
    got = {r["a_id"]: r["z"] for r in shapes.local_surface(points, at, radius).collect()}
    assert set(got) == set(range(2, 9))
    for k, v in got.items():
        d = p - [k, 5.0]
        r = np.hypot(*d.T)
        w = np.sqrt(np.where(r < radius, (1 - (r / radius) ** 3) ** 3, 0))
        fit = np.linalg.lstsq(np.c_[np.ones(len(d)), d] * w[:, None], z * w, rcond=None)[0]
        assert v == pytest.approx(fit[0])


def test_local_surface_on_a_line_is_the_mean(spark):
    points = spark.createDataFrame([(1, -1.0, 0.0, 2.0), (2, 1.0, 0.0, 4.0), (3, 0.0, 0.5, None)], "b_id long, bx double, by double, z double")
    at = spark.createDataFrame([(7, 0.0, 0.0)], "a_id long, ax double, ay double")
    assert shapes.local_surface(points, at, 2.0).first()["z"] == pytest.approx(3.0)


def test_alignment_stats(spark):
    rows = [(1, "AC-GT", "ACG-A"), (2, "", ""), (3, "A", "AC"), (4, None, "A"), (5, "--", "AC"), (6, "-", "-")]
    got = {r["id"]: tuple(r)[3:] for r in shapes.alignment_stats(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b").collect()}
    none = (None,) * 5
    assert got == {1: (2, 1, 1, 1, 2 / 3), 2: (0, 0, 0, 0, None), 3: none, 4: none, 5: (0, 0, 2, 0, None), 6: (0, 0, 1, 1, None)}


def test_wkt(spark):
    rows = [(1, "point (1 2)"), (2, "LINESTRING Z (0 0 9, 1e1 -1.5 9)"), (3, "POLYGON EMPTY"), (4, None), (5, "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))"), (6, "nonsense")]
    got = [tuple(r) for r in files.wkt_vertices(spark.createDataFrame(rows, "id long, w string"), "id", "w").orderBy("id", "ring", "k").collect()]
    assert got == [(1, 0, 0, 0, 1.0, 2.0), (2, 0, 0, 0, 0.0, 0.0), (2, 0, 0, 1, 10.0, -1.5), (5, 0, 0, 0, 0.0, 0.0), (5, 0, 0, 1, 1.0, 1.0), (5, 0, 1, 0, 2.0, 2.0), (5, 0, 1, 1, 3.0, 3.0)]


def test_files(spark):
    path = new_path(spark, "files")
    write_bytes(spark, b"x", f"{path}/a.txt")
    with pytest.warns(UserWarning, match="b.txt"):
        assert files.existing(spark, [f"{path}/a.txt", f"{path}/b.txt"]) == [f"{path}/a.txt"]
    assert files.latest_file(spark, path, "*.txt").first()["path"].endswith("/a.txt")
    assert files.latest_file(spark, path, "*.json").count() == 0
