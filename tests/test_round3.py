"""Ties of the first crossing, cells without an edge, paths that Spark takes for small."""

import duckdb
from pyspark.sql import functions as F

from loamgrid.plans import bind_graph, bindings
from loamgrid.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_first_cross_among_equal_sums(spark, tmp_path):
    """Of equal sums the first event counts."""
    rows = [(k, 1, 1.0) for k in range(6)] + [(10, 2, 5.0), (11, 2, 0.0), (12, 2, 0.0)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: r["event_id"] for r in bindings.QUERIES["win_first_cross"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 10}


def test_blocked_cells_without_edges(spark, tmp_path):
    """A blocked cell whose neighbours are all blocked is in no edge that is left, so it has no row."""
    where = {(1, 1): 50, (0, 1): 50, (1, 0): 50, (1, 2): 50, (2, 1): 50}
    rows = [(50 * r + c, 1500.0, where.get((r, c), 10)) for r in range(4) for c in range(19, 22)] + [(50 * r + c, 1500.0, where.get((r, c), 10)) for r in range(4) for c in range(4)]
    part = spark.createDataFrame(rows, "p_partkey long, p_retailprice double, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{SF}/region.parquet").coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    con = duckdb.connect()
    for t in ("part", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(map(tuple, con.sql(bindings.ORACLE_SQL["num_hit_blocked_analytic"]).fetchall()))
    got = sorted((r["target"], r["cell"], r["reached"], r["solved"]) for r in bindings.QUERIES["num_hit_blocked_analytic"](spark, str(tmp_path)).collect())
    assert got == want and 51 not in {r[1] for r in got}


def test_paths_are_not_broadcast(spark):
    """Paths have a hundred times the walkers' rows, which Spark can't know."""
    for name in ("num_random_walk", "num_walk_coalescence"):
        p = bindings.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p.split("MapInPandas")[0]
    assert bind_graph.walks(Tables(spark, SF)).groupBy("walker").count().where("count <> 101").count() == 0
