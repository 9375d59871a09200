"""Properties of the operators on small made-up tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import counts, graph, kernels, knn, raster, relations, sampling, spectral, stats
from loamgrid.operators.components import connected_components
from loamgrid.sources import fixtures, readers
from loamgrid.sources.scratch import new_path


def random_counts(seed=23, sites=60, inds=4):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sites):
        for i in range(inds):
            d = int(rng.poisson(3))
            rows.append((s, i, int(rng.binomial(d, 0.6)), d))
    return rows


def naive_pi(rows, i, j):
    by = {(s, k): (x, d) for s, k, x, d in rows}
    num = den = 0
    for s in {r[0] for r in rows}:
        (x, d), (y, e) = by[s, i], by[s, j]
        if i == j:
            num, den = num + 2 * x * (d - x), den + d * (d - 1)
        else:
            num, den = num + x * (e - y) + (d - x) * y, den + d * e
    return num / den


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_divergence_does_not_depend_on_partitions(spark, parts):
    rows = random_counts()
    df = spark.createDataFrame(rows, "site long, ind long, x long, d long").repartition(parts)
    got = {(r["i"], r["j"]): r["pi"] for r in counts.pairwise_divergence(df).collect()}
    assert len(got) == 10
    for (i, j), pi in got.items():
        assert pi == pytest.approx(naive_pi(rows, i, j), abs=1e-12)


def test_histogram_keeps_every_read(spark):
    df = spark.createDataFrame(random_counts(), "site long, ind long, x long, d long")
    h = counts.coverage_histogram(df, "d", 5).collect()
    assert len(h) == 4 * 6 and sum(r["n"] for r in h) == df.count()


def test_weighted_median_modes(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 4.0, 1.0), ("a", 9.0, 0.0), ("b", 5.0, 1.0)], "k string, x double, w double")
    as_coded = {r["k"]: r["wmedian"] for r in stats.weighted_median(df, "x", "w", ["k"]).collect()}
    # k is the second row: cw 3 > 2, a = (2 - 3) / 1 = -1, so 2 * 2 - 1 * 4
    assert as_coded == {"a": 0.0, "b": None}
    assert {r["k"]: r["wmedian"] for r in stats.weighted_median(df, "x", "w", ["k"], conventional=True).collect()} == {"a": 2.0, "b": 5.0}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 400)], "a long, b long"))
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[500] == got[400] == 400


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 100, (40, 2)), rng.uniform(0, 100, (7, 2))
    got = {r["i"]: r["j"] for r in knn.nearest(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(a)], "i long, x double, y double"), spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(b)], "j long, u double, v double"), a_cols=("i", "x", "y"), b_cols=("j", "u", "v")).collect()}
    assert got == {k: int(((b - p) ** 2).sum(1).argmin()) for k, p in enumerate(a)}


def grid(spark, n=6):
    return spark.range(n * n).select(F.col("id").alias("cell"), F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"), (F.col("id") % 5 - 2).cast("double").alias("a"))


def test_hitting_times_solve_the_equation(spark):
    cells = grid(spark)
    e = graph.generator(cells, ["a"], beta=0.2, gamma=(0.1, 0.3), delta=(0.2, -0.1))
    targets = cells.where("cell in (0, 1)").select(F.lit(9).cast("long").alias("target"), "cell")
    h = kernels.hitting_times(e, targets)
    r = graph.equation_residuals(e, h.toDF("target", "cell", "h")).where("cell not in (0, 1)")
    assert r.agg(F.max(F.abs("r"))).first()[0] < 1e-8
    assert h.where("cell in (0, 1)").agg(F.max("ht")).first()[0] == 0


def test_block_factors_agree_with_a_dense_solve(spark):
    cells = grid(spark, 5)
    e = graph.generator(cells, ["a"], beta=0.0, gamma=(0.1, 0.3), delta=(0.2, -0.1)).toPandas()
    g = kernels.Generator(e["i"].to_numpy(), e["j"].to_numpy(), e["rate"].to_numpy())
    free = np.arange(25) > 2
    m = np.zeros((25, 25))
    m[e["i"], e["j"]] = e["rate"]
    m -= np.diag(m.sum(1))
    h = g.solve(np.full(25, -1.0), free)
    assert np.allclose(h[free], np.linalg.solve(m[np.ix_(free, free)], np.full(22, -1.0)), rtol=1e-9)
    assert (h[~free] == 0).all()


def test_gradient_matches_differences(spark):
    cells = grid(spark, 4)
    targets = cells.where("cell = 0").select(F.lit(1).cast("long").alias("target"), "cell")
    model = lambda g, d: graph.generator(cells, ["a"], beta=0.1, gamma=(0.2, g), delta=(0.1, d))
    s = kernels.hitting_sensitivity(model(0.3, 0.2), targets).toPandas().set_index("cell").sort_index()
    ht = lambda g, d: kernels.hitting_times(model(g, d), targets).toPandas().set_index("cell").sort_index()["ht"]
    eps = 1e-5
    assert np.allclose((ht(0.3 + eps, 0.2) - ht(0.3 - eps, 0.2)) / (2 * eps), s["d_gamma"], rtol=1e-4, atol=1e-5)
    assert np.allclose((ht(0.3, 0.2 + eps) - ht(0.3, 0.2 - eps)) / (2 * eps), s["d_delta"], rtol=1e-4, atol=1e-5)
    assert np.allclose(s["d_beta"], -s["ht"])


def test_interpolation_returns_the_truth(spark):
    cells = grid(spark, 5)
    e = graph.generator(cells, ["a"], beta=0.0, gamma=(0.1, 0.3), delta=(0.2, -0.1))
    targets = cells.where("cell = 3").select(F.lit(1).cast("long").alias("target"), "cell")
    truth = kernels.hitting_times(e, targets)
    got = kernels.interpolate_times(e, truth.where("cell % 3 = 1"), targets, 0.5)
    both = truth.join(got.select("cell", F.col("ht").alias("got")), "cell")
    assert both.agg(F.max(F.abs(F.col("ht") - F.col("got")))).first()[0] < 1e-4


def test_blocked_cells_are_null(spark):
    cells = grid(spark, 4)
    e = graph.generator(cells, ["a"], beta=0.0, gamma=(0.1, 0.3), delta=(0.2, -0.1))
    targets = cells.where("cell = 0").select(F.lit(1).cast("long").alias("target"), "cell")
    wall = cells.where("col = 1").select("cell")
    h = {r["cell"]: r["ht"] for r in kernels.hitting_times(e, targets, wall).collect()}
    assert all(h[c] is None for c in h if c % 4 >= 1) and h[4] is not None


def test_f_pvalue():
    # F(1, n-2) is the square of Student's t; t = 2.228 with 10 degrees leaves 0.05
    assert kernels.beta_fraction(5, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)


def test_independent_set_is_maximal(spark):
    nodes = spark.range(60)
    edges = spark.range(59).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    chosen = {r["id"] for r in sampling.independent_set(nodes, edges).collect()}
    assert not any(k in chosen and k + 1 in chosen for k in range(59))
    assert all({k - 1, k, k + 1} & chosen for k in range(60))


def test_clump_and_boundary(spark):
    cells = grid(spark, 4).where("col <> 1")
    assert raster.clump(cells).select("clump").distinct().count() == 2
    inside = spark.createDataFrame([(7, 0)], "target long, cell long")
    assert {r["cell"] for r in raster.boundary(grid(spark, 4), inside).collect()} == {1, 4}


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("upper", [True, False])
def test_packed_triangle(spark, diagonal, upper):
    n = 6
    m = np.arange(n * n).reshape(n, n)
    m = m + m.T
    keep = [(i, j) for j in range(n) for i in range(n) if (i < j if upper else i > j) or diagonal and i == j]
    values = spark.createDataFrame([(k, int(m[i, j])) for k, (i, j) in enumerate(keep)], "at long, value long")
    got = readers.packed_triangle(values, n, diagonal=diagonal, upper=upper).collect()
    assert {(r["i"], r["j"]): r["value"] for r in got} == {(i, j): int(m[i, j]) for i in range(n) for j in range(n) if diagonal or i != j}


def test_binary_counts_round_trip(spark):
    m = np.random.default_rng(5).integers(0, 256, (77, 12)).astype(np.uint8)
    path = new_path(spark, "bin-test")
    fixtures.write_bytes(spark, m.tobytes(), f"{path}/x.bin")
    assert readers.counts_binary(spark, path, 3).where("site = 76").count() == 3
    got = {(r["site"], r["ind"]): [r[b] for b in "ACGT"] for r in readers.counts_binary(spark, path, 3).collect()}
    assert len(got) == 77 * 3
    for (s, i), v in got.items():
        assert v == [None if x == 255 else int(x) for x in m[s, 4 * i : 4 * i + 4]]


def test_principal_components_of_a_line(spark):
    x = [0.0, 1.0, 3.0, 7.0]
    pairs = spark.createDataFrame([(i, j, x[i] * x[j]) for i in range(4) for j in range(i, 4)], "id1 long, id2 long, value double")
    r = spectral.top_eigenvectors(pairs, 1).orderBy("id").collect()
    assert r[0]["share1"] == pytest.approx(1) and [v["pc1"] for v in r] == sorted(v["pc1"] for v in r)


def test_every_cell_walks(spark):
    """The query's walkers start in all cells with an edge; hits and meetings against plain loops over the paths."""
    from loamgrid.plans import bind_graph, bindings
    from loamgrid.plans.registry import Tables

    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    starts = {r["i"] for r in bind_graph.edges(t).select("i").distinct().collect()}
    assert len(starts) > 50
    assert {r["walker"] for r in bindings.QUERIES["num_random_walk"](spark, sf).collect()} == starts
    paths, hits = {}, {}
    for r in bind_graph.walks(t).collect():
        paths.setdefault(r["walker"], {})[r["step"]] = r["cell"]
    for w, path in paths.items():
        assert path[0] == w and sorted(path) == list(range(101))
        for s in range(101):
            hits.setdefault((w, path[s]), s)
    meet = {}
    for s in range(101):
        where = {}
        for w in sorted(paths):
            for v in where.setdefault(paths[w][s], []):
                meet.setdefault((v, w), s)
            where[paths[w][s]].append(w)
    assert {(r["walker"], r["cell"]): r["step"] for r in bindings.QUERIES["num_walk_hits"](spark, sf).collect()} == hits
    assert {(r["walker1"], r["walker2"]): r["step"] for r in bindings.QUERIES["num_walk_coalescence"](spark, sf).collect()} == meet


def test_ranked(spark):
    from loamgrid.operators.relations import ranked

    rows = [(k, k % 7) for k in range(500)] + [(None, 3)]
    got = {(r["id"], r["g"]): r["place"] for r in ranked(spark.createDataFrame(rows, "id long, g long"), F.desc("g"), "id").collect()}
    want = sorted(rows, key=lambda r: (-r[1], -1 if r[0] is None else r[0]))
    assert got == {r: k + 1 for k, r in enumerate(want)}
    assert ranked(spark.createDataFrame([], "id long"), "id").count() == 0
