"""Pair tables of a roster: dealt to tasks, not moved afterwards; order statistics of distances without them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import graph, relations
from loamgrid.plans import bindings

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_small_tables(spark):
    """Spark takes no table for small by itself."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("both", [False, True])
def test_pairs_are_dealt_to_tasks(spark, both):
    ids = spark.range(1100).coalesce(1).union(spark.createDataFrame([(None,)], "id long"))
    for diagonal in (False, True):
        p = relations.all_pairs(ids, "id", diagonal=diagonal, both=both)
        assert p.rdd.getNumPartitions() == 5
        sizes = [r["count"] for r in p.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == (1100 * 1099 // (1 if both else 2)) + 1100 * diagonal
        assert len(sizes) == 5 and p.distinct().count() == sum(sizes)


@pytest.mark.parametrize("name", ["jn_inner_pair", "jn_double_lookup", "flt_same_group", "flt_pc_split", "num_pca", "num_pca_dist", "agg_between_within", "agg_local_weights", "flt_isolated", "num_obj_direct"])
def test_pairs_do_not_move(spark, no_small_tables, name):
    p = plan(bindings.QUERIES[name](spark, SF))
    assert "SortMergeJoin" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" in p


def test_double_centre(spark):
    m = np.random.default_rng(1).random((9, 9))
    m = m + m.T
    d = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(9) for j in range(9)], "id1 long, id2 long, value double")
    want = m - m.mean(0)[None] - m.mean(1)[:, None] + m.mean()
    got = graph.double_centre(d).collect()
    assert len(got) == 81 and all(abs(r["c"] - want[r["id1"], r["id2"]]) < 1e-12 for r in got)


def test_contigs_of_one_roster(spark, no_small_tables):
    """A task holds a contig's partners, not all pairs of an individual's contigs."""
    p = plan(bindings.QUERIES["agg_contig_cor"](spark, SF))
    assert "collect_list" not in p and "Generate" not in p


@pytest.mark.parametrize("seed, n, spread", [(1, 1, 3), (2, 2, 1), (3, 40, 6), (4, 60, 1000), (5, 31, 2)])
def test_distances_without_pairs(spark, seed, n, spread):
    """Quantiles and weighted medians of distances, with many ties, as from the table of pairs."""
    from loamgrid.operators import apart, stats

    rng = np.random.default_rng(seed)
    v, w = rng.integers(-spread, spread + 1, n), rng.integers(1, 4, n)
    roster = spark.createDataFrame([(i, int(v[i]), int(w[i])) for i in range(n)] + [(n, None, 1)], "id long, v long, w long")
    apart_ = np.abs(v[:, None] - v[None])
    got = {r["id"]: r for r in apart.quantiles(roster, {"a": 0.4, "b": 0.025, "c": 0.5, "d": 1.0}).collect()}
    assert len(got) == n
    for i in range(n):
        assert [got[i][k] for k in "abcd"] == pytest.approx(list(np.quantile(apart_[i], [0.4, 0.025, 0.5, 1.0])), abs=1e-12)
    every = apart_[np.triu_indices(n)]
    assert apart.pair_quantiles(roster, [0.0, 0.025, 0.5, 0.975]) == pytest.approx(list(np.quantile(every, [0.0, 0.025, 0.5, 0.975])), abs=1e-12)
    d = spark.createDataFrame([(i, float(apart_[i, j]), int(w[j])) for i in range(n) for j in range(n) if i != j], "id long, x double, w long")
    want = {r["id"]: r["wmedian"] for r in stats.weighted_median(d, "x", "w", ["id"]).collect()}
    found = {r["id"]: r["wmedian"] for r in apart.weighted_medians(roster).collect()}
    assert found.keys() == want.keys() and all(found[k] == (want[k] if want[k] is None else pytest.approx(want[k], abs=1e-12)) for k in want)


@pytest.mark.parametrize("name", ["agg_quantile", "agg_tail_pairs", "agg_residual_outlier", "agg_scenario_summary", "flt_accessible", "prj_winsorize"])
def test_quantiles_hold_no_pairs(spark, name):
    p = plan(bindings.QUERIES[name](spark, SF)).lower()
    assert "percentile" not in p and "window" not in p


@pytest.mark.parametrize("name", ["prj_fill", "prj_pair_midpoint", "flt_nonself", "flt_upper_tri", "flt_same_group", "jn_double_lookup"])
def test_pairs_of_a_row_are_handed_on_by_stretches(spark, no_small_tables, name):
    """A join by itself holds all pairs of a row before it hands on the first, and tries the half that isn't wanted as well."""
    p = plan(bindings.QUERIES[name](spark, SF))
    assert p.index("Generate inline") < p.index("Coalesce") < p.index("BroadcastNestedLoopJoin")
    assert "__last" in p[p.index("BroadcastNestedLoopJoin") :].split("\n")[0]


@pytest.mark.parametrize("name", ["flt_same_group", "jn_double_lookup", "flt_pc_split"])
def test_samples_are_looked_up_before_they_are_paired(spark, no_small_tables, name):
    p = plan(bindings.QUERIES[name](spark, SF))
    assert "BroadcastHashJoin" not in p[: p.index("BroadcastNestedLoopJoin")]


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("diagonal", [False, True])
def test_pairs_across_stretches(spark, monkeypatch, both, diagonal):
    """Ids of text, some twice, nulls beside them, many more than a stretch holds; a roster beyond the broadcast; an empty one."""
    monkeypatch.setattr(relations, "STRETCH", 4)
    monkeypatch.setattr(relations, "PAIR_ROWS", 9)
    roster = [(f"s{k % 37}", k if k % 5 else None) for k in range(41)]
    df = spark.createDataFrame([*roster, (None, 1)], "id string, v long")
    wanted = (lambda a, b: diagonal or a != b) if both else (lambda a, b: a < b or (diagonal and a == b))
    want = sorted(((a, v, b, w) for a, v in roster for b, w in roster if wanted(a, b)), key=repr)
    take = lambda d: sorted(((r["id1"], r["v_1"], r["id2"], r["v_2"]) for r in relations.all_pairs(d, "id", diagonal=diagonal, both=both, columns=("v",)).collect()), key=repr)
    assert take(df) == want and take(df.where("false")) == []
    monkeypatch.setattr(relations, "ROSTER", 10)
    assert take(df) == want


def test_ends_of_pairs(spark):
    """The first match of a sample by the order, null without one; the pairs themselves are all there."""
    ids = spark.createDataFrame([(k,) for k in range(5)], "id long")
    dim = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (3, 1, "c"), (4, 1, None)], "key long, at long, name string")
    got = {(r["id1"], r["id2"]): (r["name_1"], r["name_2"]) for r in relations.looked_up_pairs(ids, "id", dim, "key", "at", "name", diagonal=True).collect()}
    want = {(r["id1"], r["id2"]): (r["name_1"], r["name_2"]) for r in relations.double_lookup(relations.all_pairs(ids, "id", diagonal=True), dim, ("id1", "id2"), "key", "at", "name").collect()}
    assert len(got) == 15 and got == want and got[0, 3] == ("a", "c") and got[1, 4] == (None, None)
