"""Trees and scales of larger rosters, planes through a share of many points."""

import time

import numpy as np
import pytest

from loamgrid.operators import fitting, kernels, knn, kriging, relations, shapes


def full_search(d):
    """Merges of neighbour joining, each by a search of the whole matrix."""
    ids, out = list(range(len(d))), []
    while len(ids) > 2:
        n, s = len(ids), d.sum(1)
        q = (n - 2) * d - s[:, None] - s[None]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), n)
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        out += [(ids[i], d[i, j] / 2 + (s[i] - s[j]) / (2 * (n - 2))), (ids[j], d[i, j] / 2 - (s[i] - s[j]) / (2 * (n - 2)))]
        d = np.block([[d[np.ix_(keep, keep)], new[keep, None]], [new[None, keep], np.zeros((1, 1))]])
        ids = [ids[k] for k in keep] + [-len(out) // 2]
    return out, d[0, 1]


@pytest.mark.parametrize("seed", range(12))
def test_bounded_search_finds_the_same_pairs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(8, 90))
    x = rng.random((n, 3)) if seed % 2 else rng.integers(0, 40, (n, 1)).astype(float)  # the others with many ties
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want, last = full_search(d.copy())
    got = fitting._joined(np.arange(n), d.copy())
    merges = lambda rows: [sorted(rows[k : k + 2]) for k in range(0, len(rows) - 4, 2)]  # noqa: E731  of four nodes or three, pairs tie
    mine = merges(list(zip(got["node"].tolist()[: len(want)], got["length"].tolist())))
    for one, other in zip(mine, merges(want), strict=True):
        assert [k for k, _ in one] == [k for k, _ in other] and np.allclose([v for _, v in one], [v for _, v in other])
    assert len(got) == len(want) + 1 and got["length"].sum() == pytest.approx(sum(b for _, b in want) + last)


def test_tree_of_a_larger_roster(spark):
    """A merge searches a few rows; with a search of the whole matrix for each, 1,500 leaves took more than the 12 s allowed here."""
    x = np.random.default_rng(3).integers(0, 10**6, 1500).astype(float)
    roster = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "id long, v double")
    p = roster.selectExpr("id as id1", "v as v1").crossJoin(roster.selectExpr("id as id2", "v as v2")).where("id1 < id2").selectExpr("id1", "id2", "abs(v1 - v2) as value")
    p.count()
    start = time.time()
    tree = fitting.neighbour_joining(p).toPandas()
    assert time.time() - start < 12
    assert (tree["node"] >= 0).sum() == 1500 and tree["length"].sum() == pytest.approx(x.max() - x.min())


def gathered_scales(v, x, rounds):
    """The fit of all pairs in one matrix."""
    n = len(v)
    i, j = np.triu_indices(n, 1)
    pi, d = np.abs(v[i] - v[j]), np.abs(x[i] - x[j])
    i, j, pi, d = i[pi > 0], j[pi > 0], pi[pi > 0], d[pi > 0]
    m = np.zeros((len(pi), n))
    m[np.arange(len(pi)), i] = m[np.arange(len(pi)), j] = 1
    base, c, a = pi.mean(), np.ones(n), 0.0
    for _ in range(rounds):
        a = ((pi / (c[i] * c[j]) - base) @ d) / (d @ d)
        c = np.exp(np.linalg.lstsq(m, np.log(pi / np.maximum(a * d + base, 1e-12)), rcond=None)[0])
    return c, a


@pytest.mark.parametrize("n, ties", [(7, False), (8, False), (30, True), (1, False)])
def test_scales_of_a_roster_without_its_pair_table(spark, monkeypatch, n, ties):
    """Pairs of equal values don't count; no table of pairs is made."""
    monkeypatch.setattr(relations, "all_pairs", None)
    rng = np.random.default_rng(n)
    v, x = (rng.integers(0, 4, n) if ties else rng.permutation(n) + 1.0) * 1.0, rng.random(n)
    roster = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(v, x))], "id long, v double, x double")
    got = kernels.scale_by_individual(roster, "id", ["v", "x"], lambda p, q: abs(p["v"] - q["v"]), lambda p, q: abs(p["x"] - q["x"]), rounds=4, tolerance=0).orderBy("id").collect()
    if n == 1:
        assert got == []
        return
    c, a = gathered_scales(v, x, 4)
    assert np.allclose([r["c"] for r in got], c) and got[0]["a"] == pytest.approx(a)


def test_planes_without_a_table_of_neighbours(spark, monkeypatch):
    """The broadcast points give the planes of the table of neighbours, which isn't made: it has places times neighbours rows."""
    rng = np.random.default_rng(5)
    pts = [(k, float(rng.integers(0, 9)), float(rng.integers(0, 30)), float(rng.integers(0, 100))) for k in range(80)] + [(80, None, 1.0, 2.0), (81, 3.0, 3.0, None)]
    at = spark.createDataFrame([(k, float(rng.integers(-3, 12)), float(rng.integers(-3, 33))) for k in range(60)] + [(60, None, 1.0)], "a_id long, ax double, ay double")
    points = spark.createDataFrame(pts, "b_id long, bx double, by double, z double")
    made = []
    right = shapes.k_nearest
    monkeypatch.setattr(shapes, "k_nearest", lambda *a: made.append(1) or right(*a))
    for share in (0.3, 0.02, 1.0):
        got = {r["a_id"]: r["z"] for r in shapes.loess(points, at, share).collect()}
        assert not made
        with monkeypatch.context() as m:
            m.setattr(shapes, "ROSTER", 0)
            want = {r["a_id"]: r["z"] for r in shapes.loess(points, at, share).collect()}
        made.clear()
        assert len(want) == 60 and got == pytest.approx(want)
    assert shapes.loess(points.where("false"), at, 0.5).count() == 0


def test_places_of_a_task_are_bounded(spark, monkeypatch):
    """More places are more tasks, whatever the number of shuffle partitions."""
    monkeypatch.setattr(knn, "PLACES", 10)
    at = spark.range(200).selectExpr("id as a_id", "id % 20 as ax", "id div 20 as ay")
    known = spark.range(30).selectExpr("id as b_id", "cast(id % 6 as double) as bx", "cast(id div 6 as double) as by", "1.0 as z")
    got = kriging.krige(known, at, neighbours=3, width=2.0)
    assert got.rdd.getNumPartitions() == 20 and got.count() == 200
    assert knn.k_nearest(at, known, 3).count() == 600
