"""Tiled hitting times, nearest points and kriging against slow versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import graph, knn, kriging, shapes
from loamgrid.operators.dissection import hitting_times_tiled


def dense_times(edges, goals, n):
    """By one dense system; null where a cell may get to one that doesn't reach the goals."""
    rate = np.zeros((n, n))
    for i, j, r in edges:
        rate[i, j] += r
    step, free = rate > 0, ~np.isin(np.arange(n), goals)

    def spread(seen, within):
        while True:
            more = seen | (within & step[:, seen].any(1))
            if (more == seen).all():
                return seen
            seen = more

    lost = spread(~spread(~free, np.ones(n, bool)), free)
    at = np.flatnonzero(free & ~lost)
    h = np.full(n, np.nan)
    h[at] = np.linalg.solve(np.diag(rate.sum(1)[at]) - rate[np.ix_(at, at)], np.ones(len(at)))
    h[list(goals)] = 0
    return h


def lattice(rows, cols, drop, seed):
    rng, e = np.random.default_rng(seed), []
    for k in range(rows * cols):
        r, c = divmod(k, cols)
        for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            if 0 <= r + a < rows and 0 <= c + b < cols and rng.random() >= drop:
                e.append((k, (r + a) * cols + c + b, float(rng.lognormal())))
    n = rows * cols
    return e + [(0, n - 1, 0.3), (n // 2, 3, 1.5), (n // 2, 3, 0.5)]  # far and repeated edges


def tables(spark, e, goals, cols, n):
    edges = spark.createDataFrame(e, "i long, j long, rate double")
    targets = spark.createDataFrame([(t, c) for t, cs in goals.items() for c in cs], "target long, cell long")
    return edges, targets, spark.createDataFrame([(k, k // cols, k % cols) for k in range(n)], "cell long, row long, col long")


@pytest.mark.parametrize("rows,cols,drop,tile", [(9, 7, 0, 3), (21, 17, 0.3, 4)])
def test_tiled_times(spark, rows, cols, drop, tile):
    n, e = rows * cols, lattice(rows, cols, drop, 3)
    goals = {0: [n // 3], 1: [0, n - 1], 2: list(range(5))}
    got = hitting_times_tiled(*tables(spark, e, goals, cols, n), tile=tile).toPandas()
    there = sorted({x for i, j, _ in e for x in (i, j)})
    for t, cs in goals.items():
        h = got[got.target == t].set_index("cell").ht
        assert sorted(h.index) == there
        np.testing.assert_allclose(h[there], dense_times(e, cs, n)[there], rtol=1e-10)


def test_tiled_times_keep_their_precision(spark):
    """Chain with a drift away from the target: times grow to 1e24 and each is right to many digits."""
    n, up, down = 40, 4.0, 1.0
    e = [(k, k + 1, up) for k in range(n - 1)] + [(k, k - 1, down) for k in range(1, n)]
    edges, targets, cells = tables(spark, e, {5: [0]}, n, n)
    got = hitting_times_tiled(edges, targets, cells, tile=4).toPandas().set_index("cell").ht
    step = [0.0] * n  # time to get from k to k - 1
    for k in range(n - 1, 0, -1):
        step[k] = 1 / down + (up / down * step[k + 1] if k < n - 1 else 0)
    np.testing.assert_allclose(got.sort_index(), np.cumsum(step), rtol=1e-12)
    assert got.max() > 1e22


def test_tiled_times_of_blocked_cells_and_odd_rows(spark):
    e = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0), (1, 1, 5.0), (0, 1, None), (3, 0, -1.0)]
    edges, targets, cells = tables(spark, e, {0: [0], 7: [99]}, 4, 4)
    got = {(r["target"], r["cell"]): r["ht"] for r in hitting_times_tiled(edges, targets, cells, cells.where("cell = 2").select("cell")).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): None, (0, 3): None}
    assert hitting_times_tiled(edges.where("false"), targets, cells).collect() == []
    assert hitting_times_tiled(edges, targets, cells.where("false")).collect() == []


def test_tiles_change_nothing(spark):
    cells = spark.range(30 * 40).select(F.col("id").alias("cell"), F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"), (F.col("id") % 7 / 3.0).alias("a"))
    e = graph.generator(cells, ["a"], beta=0.2, gamma=(0.1, 0.3), delta=(0.2, -0.1))
    targets = cells.where("cell % 401 = 0").select((F.col("cell") % 2).alias("target"), "cell")
    a, b = (hitting_times_tiled(e, targets, cells, tile=k).orderBy("target", "cell").toPandas() for k in (8, 64))
    np.testing.assert_allclose(a.ht, b.ht, rtol=1e-11)
    assert graph.solved(e, hitting_times_tiled(e, targets, cells, tile=16), targets).where("not solved or not reached").count() == 0


@pytest.mark.parametrize("k", [1, 5, 60])
def test_k_nearest(spark, k):
    rng = np.random.default_rng(5)
    b = np.concatenate([rng.normal(0, 1, (50, 2)), rng.normal(0, 1e-6, (40, 2)), np.zeros((20, 2)), [[1e6, -1e6], [-3e5, 7]]])
    a = np.concatenate([rng.normal(0, 2, (20, 2)), [[1e6, 1e6], [0, 0], [0, 0]]])
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(99, None, 1.0)], "a_id long, ax double, ay double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)] + [(900, 1.0, None)], "b_id long, bx double, by double")
    got = knn.k_nearest(left, right, k).collect()
    want = set()
    for i, p in enumerate(a):
        d2 = ((b - p) ** 2).sum(1)
        want |= {(i, int(j), place + 1) for place, j in enumerate(np.lexsort((np.arange(len(b)), d2))[:k])}
    assert {(r["a_id"], r["b_id"], r["place"]) for r in got} == want and len(got) == len(want)
    assert knn.k_nearest(left, right.where("false"), k).collect() == []


def test_kriging(spark):
    rng = np.random.default_rng(8)
    xy, z = rng.uniform(0, 10, (40, 2)), rng.normal(size=40)
    at = np.concatenate([rng.uniform(0, 10, (15, 2)), xy[:5]])
    known = spark.createDataFrame([(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(xy, z))] + [(70, 1.0, 1.0, None)], "b_id long, bx double, by double, z double")
    targets = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "a_id long, ax double, ay double")
    for nugget, k in ((0.0, 40), (0.3, 12)):
        got = [r["z"] for r in kriging.kriging_weights(known.where("z is not null").select("b_id", "bx", "by"), targets, neighbours=k, width=2.5, nugget=nugget).join(known, "b_id").groupBy("a_id").agg(F.sum(F.col("weight") * F.col("z")).alias("z")).orderBy("a_id").collect()]
        for p, v in zip(at, got):
            d0 = np.linalg.norm(xy - p, axis=1)
            near = np.argsort(d0)[:k]
            c = np.exp(-np.linalg.norm(xy[near][:, None] - xy[near][None], axis=2) / 2.5) + nugget * np.eye(len(near))
            one = np.ones(len(near))
            # generalised least squares mean plus the residuals' simple kriging: another way to the same value
            inverse = np.linalg.inv(c)
            mean = one @ inverse @ z[near] / (one @ inverse @ one)
            assert v == pytest.approx(mean + np.exp(-d0[near] / 2.5) @ inverse @ (z[near] - mean), abs=1e-9)
    exact = {r["a_id"]: r["z"] for r in kriging.krige(known, targets, neighbours=8, width=3.0).collect()}
    assert [exact[15 + i] for i in range(5)] == pytest.approx(list(z[:5]), abs=1e-9)


def test_variogram_width(spark):
    """A variogram of known form gives its numbers back."""
    d = np.arange(1, 30) / 2
    bins = spark.createDataFrame([(i, 10 + i, float(x), float(0.5 + 4 * (1 - np.exp(-x / 3.0)))) for i, x in enumerate(d)], "bin long, n long, distance double, gamma double")
    width, sill, nugget = kriging.fit_width(bins)
    assert width == pytest.approx(3, rel=0.05) and sill == pytest.approx(4, rel=0.02) and nugget == pytest.approx(0.5, abs=0.1)
    with pytest.raises(ValueError):
        kriging.fit_width(bins.where("false"))


def test_loess_of_all_points_is_a_plane(spark):
    pts = spark.createDataFrame([(i, float(i % 6), float(i // 6), 2.0 * (i % 6) - (i // 6) + 1) for i in range(36)], "b_id long, bx double, by double, z double")
    at = spark.createDataFrame([(0, 2.3, 1.1), (1, 9.0, -4.0)], "a_id long, ax double, ay double")
    for share in (0.3, 1.0):
        got = {r["a_id"]: r["z"] for r in shapes.loess(pts, at, share).collect()}
        assert got[0] == pytest.approx(2 * 2.3 - 1.1 + 1, abs=1e-9) and got[1] == pytest.approx(18 + 4 + 1, abs=1e-7)
    assert shapes.loess(pts, at, 1e-9).count() == 2  # one point
