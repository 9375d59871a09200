"""Findings of round 4."""

import numpy as np
from pyspark.sql import functions as F

from loamgrid.operators import graph, kernels, strips
from loamgrid.plans import bindings
from tests.oracle import rows as rows_of

WEIGHTS = graph.weight_names(["a", "b"])


def by_cell(df, *columns):
    return {(r["target"], r["cell"]): [np.nan if r[c] is None else r[c] for c in columns] for r in df.collect()}


def test_hessian_of_times(spark, monkeypatch):
    """Derivatives by all weights: against differences of the gradient, and by strips as from the whole model."""
    monkeypatch.setattr(strips, "ROWS", 0)  # strips of 16 rows
    rng = np.random.default_rng(3)
    rows = [(4 * r + c, r, c, float(rng.normal()), float(rng.normal())) for r in range(36) for c in range(4) if (r, c) not in ((5, 1), (16, 2), (20, 0))]
    cells = spark.createDataFrame(rows, "cell long, row long, col long, a double, b double").localCheckpoint()
    targets = spark.createDataFrame([(0, 2), (0, 8), (1, 4 * 30 + 2)], "target long, cell long")
    at = {"beta": 0.3} | dict(zip(WEIGHTS, (0.1, 0.5, -0.3, 0.1, 0.4, 0.2)))

    def derivatives(p, *more):
        w = [p[x] for x in WEIGHTS]
        return kernels.hitting_sensitivity(graph.generator(cells, ["a", "b"], beta=p["beta"], gamma=w[:3], delta=w[3:], parts=True), targets, *more, weights=WEIGHTS)

    names = ["beta", *WEIGHTS]
    first = [f"d_{p}" for p in names]
    second = [f"d2_{p}_{q}" for k, p in enumerate(names) for q in names[k:]]
    got = by_cell(derivatives(at, cells), "ht", *first, *second)
    want = by_cell(derivatives(at), "ht", *first, *second)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-7, atol=1e-7) for k in want)
    way = dict(zip(names, rng.normal(size=len(names))))  # a change of all weights at once
    up, down = (by_cell(derivatives({p: at[p] + d * way[p] for p in names}), "ht", *first) for d in (1e-4, -1e-4))
    change = {c: (np.array(up[c]) - np.array(down[c])) / 2e-4 for c in up}
    place = lambda k, m: 1 + len(names) + second.index(f"d2_{names[min(k, m)]}_{names[max(k, m)]}")
    ways = np.array(list(way.values()))
    along = {c: np.array([ways @ x[1 : 1 + len(names)], *[ways @ [x[place(k, m)] for m in range(len(names))] for k in range(len(names))]]) for c, x in got.items()}
    most = np.abs(list(change.values())).max(0)
    assert all(np.all(np.abs(change[c] - along[c]) <= 1e-5 * most) for c in change)


def test_first_cross_where_half_falls_between_events(spark, tmp_path):
    """Half of six tenths is reached by three, not crossed, whatever the rounding; nor does the order of additions matter."""
    import duckdb

    rows = [(k, 1, 0.1) for k in range(6)] + [(10, 2, 0.3), (11, 2, 0.2), (12, 2, 0.1), (13, 2, 0.6), (20, 3, 1.0), (21, 3, float("nan")), (30, 4, None), (31, 4, 2.5)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = bindings.QUERIES["win_first_cross"](spark, str(tmp_path)).toPandas()
    assert dict(zip(got["user_id"], got["event_id"])) == {1: 3, 2: 13, 4: 31}
    assert rows_of(got) == rows_of(con.sql(bindings.ORACLE_SQL["win_first_cross"]).df())


def test_walks_by_tiles(spark, monkeypatch):
    """Walks by tiles are those of the whole model, which is collected nowhere, nor is a grid broadcast."""
    monkeypatch.setattr(kernels, "TILE", 8)
    rng = np.random.default_rng(5)
    rows = [(40 * r + c, r, c, float(rng.normal())) for r in range(30) for c in range(30) if rng.random() > 0.2]
    cells = spark.createDataFrame(rows, "cell long, row long, col long, a double").localCheckpoint()
    edges = graph.generator(cells, ["a"], beta=0.3, gamma=(0.1, 0.5), delta=(0.1, 0.4))
    assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()
    edges = edges.localCheckpoint()
    walkers = cells.select(F.col("cell").alias("walker"), "cell")
    kind = {"steps": 6, "seed": 2}
    want = sorted(map(tuple, kernels.walked_paths(edges, walkers, **kind).collect()))
    monkeypatch.setattr(kernels, "_generator", None)
    paths = kernels.walked_paths(edges, walkers, cells=cells, **kind)
    assert sorted(map(tuple, paths.collect())) == want and len(want) == len(rows)
    first = {(w, c): path.index(c) for w, path in want for c in path}
    assert {(r["walker"], r["cell"]): r["step"] for r in kernels.first_hits(paths).collect()} == first


def test_pairs_of_prj_sym_are_not_shuffled(spark):
    p = bindings.QUERIES["prj_sym"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in p and "HashJoin" not in p


def test_surface_broadcasts_nothing(spark):
    """Places and points are as many as a grid's cells, whatever the size of its file."""
    p = bindings.QUERIES["ras_loess"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in p and p.count("SortMergeJoin") == 1


def test_pair_files_are_compressed(spark, tmp_path, monkeypatch):
    """The files of a pair table are several times smaller than its plain text, and read back whole."""
    import os

    from loamgrid.plans import bind_fitting, bind_sources

    for name, module, most in (("src_pair_csv", bind_sources, 8), ("snk_pair_csv", bind_sources, 8), ("src_sub_hts", bind_fitting, 8), ("snk_sub_hts", bind_fitting, 8)):
        path = f"{tmp_path}/{name}"
        monkeypatch.setattr(module, "new_path", lambda spark, name, path=path: path)
        rows = bindings.QUERIES[name](spark, "/root/testdata/sf0.1").count()
        parts = [f for f in os.listdir(path) if f.startswith("part-")]
        assert rows in (500_500, 499_500) and all(f.endswith((".csv.gz", ".zstd.parquet")) for f in parts)
        assert sum(os.path.getsize(f"{path}/{f}") for f in parts) < most * rows


def test_spline_without_its_matrix(spark, monkeypatch):
    """The same surface as from the whole matrix, which isn't made; with points on one place that one is less exact."""
    rng = np.random.default_rng(7)
    spots = [(float(x), float(y), float(v)) for x, y, v in zip(*rng.uniform(0, 50, (2, 600)), rng.normal(size=600) * 100)]
    at = spark.createDataFrame([(k, float(k % 20) * 2.6, float(k // 20) * 2.6) for k in range(400)], "cell long, x double, y double")
    surface = lambda known: {r["cell"]: r["z"] for r in kernels.smooth_surface(spark.createDataFrame(known, "x double, y double, z double"), at).collect()}
    twice = spots + [(x, y, v + 3) for x, y, v in spots[:5]]
    want, want_twice = surface(spots), surface(twice)
    monkeypatch.setattr(kernels, "DENSE", 100)
    monkeypatch.setattr(np, "eye", None)  # of the whole matrix
    got, got_twice = surface(spots), surface(twice)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 and abs(got_twice[k] - want_twice[k]) < 0.01 for k in want)
