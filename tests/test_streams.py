"""Samples and windows of streams, batch after batch, and aggregates of the user's own."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import custom, raster, relations, spectral
from loamgrid.sources.scratch import new_path
from loamgrid.streaming import scans


def source(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_sample_goes_on_after_a_restart(spark):
    """Three runs over a growing folder, with one state: the sample is that of one run, and what comes after the range is left alone."""
    path, out, state = (new_path(spark, x) for x in ("in", "out", "state"))
    rows = spark.range(900).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("at"))
    sample = lambda p: scans.range_samples(source(spark, p, rows.schema), "k", "at", low=20, high=180, size=7, seed=1)
    first = lambda n, m: rows.where((F.col("at") >= n) & (F.col("at") < m)).coalesce(1).write.mode("append").parquet(path)
    first(0, 100)
    run = lambda: scans.run_available(spark, sample(path), mode="append", path=out, state=state).collect()
    first(100, 181)
    assert run() == []
    first(181, 240)
    got = run()
    # late rows of the range change nothing once it has passed
    rows.where("at between 20 and 60").select("k", (F.col("at") + 0).alias("at")).coalesce(1).write.mode("append").parquet(path)
    first(240, 300)
    after = run()
    want = {(k, a) for k in range(3) for a in sorted(range(20, 181), key=lambda a: (hashlib.md5(f"{a}-1".encode()).hexdigest(), a))[:7]}
    assert {tuple(r) for r in got} == {tuple(r) for r in after} == want and len(after) == 21


def test_late_rows_miss_their_window(spark):
    path, out, state = (new_path(spark, x) for x in ("in", "out", "state"))
    day = dt.datetime(2024, 1, 1)

    def run(*hours):
        spark.createDataFrame([(day + dt.timedelta(hours=h), "a") for h in hours], "ts timestamp, k string").coalesce(1).write.mode("append").parquet(path)
        s = scans.windowed_counts(source(spark, path, "ts timestamp, k string"), "ts", "k")
        return {(r["start"], r["n"]) for r in scans.run_available(spark, s, mode="append", path=out, state=state).collect()}

    assert run(1, 2, 24.5) == set()  # the day ends an hour later
    assert run(3, 26) == {(day, 3)}  # the third row was still in time
    assert run(4, 50) == {(day, 3), (day + dt.timedelta(days=1), 2)}  # the fourth is late


def test_batches_are_written_once(spark):
    """A batch that is run again takes the place of its first run."""
    path, out = new_path(spark, "in"), new_path(spark, "out")
    rows = spark.range(5).select(F.lit("a").alias("k"), F.col("id").alias("at"))
    rows.write.parquet(path)
    for state in (new_path(spark, "s1"), new_path(spark, "s2")):  # the second state knows of no batch and runs the first again
        r = scans.run_available(spark, source(spark, path, rows.schema).select("k", "at"), mode="append", path=out, state=state)
        assert r.count() == 5


def test_custom_aggregate(spark):
    """Exact medians of small whole numbers by counts, over many batches, with nulls and a null key."""
    mode = custom.Aggregate(["v"], lambda c: dict(zip(*map(list, np.unique(c["v"], return_counts=True)))), lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}, lambda s: (int(max(sorted(s), key=s.get)), int(sum(s.values()))), "most long, n long")
    d = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") % 7 % 4).alias("v")).union(spark.createDataFrame([("only null", None)], "k string, v long"))
    got = {r["k"]: (r["most"], r["n"]) for r in custom.aggregate_by(d.repartition(6), ["k"], mode).collect()}
    want = {}
    for r in d.collect():
        if r["v"] is not None:
            want.setdefault(r["k"], []).append(r["v"])
    assert got == {k: (max(sorted(set(v)), key=v.count), len(v)) for k, v in want.items()} and None in got
    assert custom.aggregate_by(d.where("false"), ["k"], mode).collect() == []
    custom.register("of the test", mode)
    with pytest.raises(ValueError):
        custom.register("of the test", mode)


@pytest.mark.parametrize("centred", [True, False])
def test_top_eigenvectors(spark, centred):
    rng = np.random.default_rng(0)
    n = 40
    m = rng.normal(size=(n, n))
    m = m + m.T + np.outer(np.arange(n), np.arange(n)) / 5
    d = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(i, n)], "id1 long, id2 long, value double")
    r = spectral.top_eigenvectors(d, 3, centred=centred).orderBy("id").toPandas()
    c = m - m.mean(0) - m.mean(1)[:, None] + m.mean() if centred else m
    w, v = np.linalg.eigh(c)
    for k, o in enumerate(np.argsort(-abs(w))[:3]):
        x = v[:, o] * np.sign(v[np.argmax(abs(v[:, o]).round(9)), o])
        np.testing.assert_allclose(r[f"pc{k + 1}"], x, atol=1e-6)
        assert r[f"value{k + 1}"][0] == pytest.approx(w[o], rel=1e-9) and r[f"share{k + 1}"][0] == pytest.approx(w[o] ** 2 / (c**2).sum(), rel=1e-9)
    two = spectral.top_eigenvectors(d.where("id2 < 2"), 4, centred=False).collect()
    assert len(two) == 2 and two[0]["pc3"] is None and spectral.top_eigenvectors(d.where("false"), 2).collect() == []


def slow_cells(x1, y1, x2, y2):
    """Cells of very many points of a segment, and of its exact crossings."""
    from fractions import Fraction as Q

    a, b, c, d = (Q(v) for v in (x1, y1, x2, y2))
    cuts = {Q(0), Q(1)}
    for p, q in ((a, c), (b, d)):
        lo, hi = sorted((p, q))
        cuts |= {(k - p) / (q - p) for k in range(int(lo) - 1, int(hi) + 2) if q != p and 0 <= (k - p) / (q - p) <= 1}
    cuts = sorted(cuts)
    at = cuts + [(s + t) / 2 for s, t in zip(cuts, cuts[1:])]
    return {((b + (d - b) * t) // 1, (a + (c - a) * t) // 1) for t in at}


def test_segments_through_corners(spark):
    rng = np.random.default_rng(7)
    fixed = [(0, 0, 3, 3), (3, 3, 0, 0), (0, 3, 3, 0), (3, 0, 0, 3), (0.5, 0.5, 0.5, 4), (1, 2, 5, 2), (2, 5, 2, 1), (1, 1, 1, 1), (-2.5, -1, 2.5, 1), (0, 0, 6, 2), (6, 2, 0, 0), (0, 2, 6, 0), (-3, 0, 3, -2)]
    made = [tuple(float(v) for v in rng.integers(-16, 17, 4) / rng.choice([1, 2, 4, 8])) for _ in range(60)]
    segments = [(i, *map(float, s)) for i, s in enumerate(fixed + made)]
    d = spark.createDataFrame([*segments, (999, None, 1.0, 2.0, 3.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in relations.segment_cells(d).collect():
        got.setdefault(r["id"], set()).add((r["row"], r["col"]))
    assert got == {i: slow_cells(*s) for i, *s in segments}


@pytest.mark.parametrize("tile", [3, 8, 64])
@pytest.mark.parametrize("offsets", [raster.ROOK, raster.QUEEN])
def test_clumps_by_tiles(spark, tile, offsets):
    """A spiral, islands and noise, against a flood fill."""
    rng = np.random.default_rng(2)
    there = rng.random((25, 31)) < 0.55
    there[0, :] = there[:, -1] = there[-1, :] = True
    d = spark.createDataFrame([(int(r) * 100 + int(c), int(r) - 7, int(c) - 4) for r, c in zip(*np.nonzero(there))], "cell long, row long, col long")
    want, left = {}, {(int(r), int(c)) for r, c in zip(*np.nonzero(there))}
    while left:
        todo = [min(left)]
        found = set(todo)
        while todo:
            r, c = todo.pop()
            more = {(r + a, c + b) for a, b in offsets} & left - found
            found |= more
            todo += more
        want |= {r * 100 + c: min(x * 100 + y for x, y in found) for r, c in found}
        left -= found
    assert {r["cell"]: r["clump"] for r in raster.clump(d, offsets, tile=tile).collect()} == want
    assert raster.clump(d.where("false"), offsets).collect() == []
