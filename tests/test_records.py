"""Fixed-width records: ranges, seeks, damaged files, and writing by tasks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from loamgrid.sources import cube, records


@pytest.fixture
def folder(tmp_path):
    """Three files of 5, 0 and 7 records of three bytes."""
    for name, first, n in (("a.bin", 0, 5), ("b.bin", 5, 0), ("c.bin", 5, 7)):
        (tmp_path / name).write_bytes(bytes(range(3 * first, 3 * (first + n))))
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    return str(tmp_path)


def test_all_records(spark, folder):
    got = records.read_records(spark, folder, ["x", "y", "z"], "u1", split=6).orderBy("at").collect()
    assert [tuple(r) for r in got] == [("a.bin" if k < 5 else "c.bin", k if k < 5 else k - 5, k, 3 * k, 3 * k + 1, 3 * k + 2) for k in range(12)]
    assert records.read_records(spark, folder, ["x", "y", "z"], "u1", split=6).rdd.getNumPartitions() == 6
    assert records.read_records(spark, f"{folder}/c.bin", ["x", "y", "z"], "u1").where("at = 6").collect()[0]["x"] == 33


def test_conditions_become_runs(folder):
    files = records.listed(folder, 3)
    assert [(os.path.basename(p), b, n) for p, b, n in files] == [("a.bin", 0, 5), ("b.bin", 5, 0), ("c.bin", 5, 7)]

    def runs(*filters):
        found, rest = records.bounds(filters)
        return [(os.path.basename(p), first, n) for part in records.planned(files, found, 3, 3000) for p, _, first, n in part.runs], rest

    assert runs(In(("at",), (3, 7, 10))) == ([("a.bin", 3, 1), ("c.bin", 2, 1), ("c.bin", 5, 1)], [])
    assert runs(In(("at",), (3, 4, 5, 6, 99, -1))) == ([("a.bin", 3, 2), ("c.bin", 0, 2)], [])
    assert runs(GreaterThan(("at",), 3), LessThanOrEqual(("at",), 6)) == ([("a.bin", 4, 1), ("c.bin", 0, 2)], [])
    assert runs(EqualTo(("record",), 1)) == ([("a.bin", 1, 1), ("c.bin", 1, 1)], [])
    assert runs(EqualTo(("record",), 1), EqualTo(("at",), 6)) == ([("c.bin", 1, 1)], [])
    other = EqualTo(("x",), 4), IsNotNull(("at",))
    assert runs(*other)[1] == list(other) and len(runs(*other)[0]) == 2
    assert runs(GreaterThan(("at",), 100)) == ([], [])


def test_few_records_of_a_large_file(spark, tmp_path):
    """A file of 5 GB, most of it a hole: three records are three runs of one task, and only they are read."""
    path, width = tmp_path / "large.bin", 24
    n = 5 * 10**9 // width
    with open(path, "wb") as f:
        for k in (0, n // 2, n - 1):
            f.seek(k * width)
            f.write(np.array([k, -k, 0.5], "<f8").tobytes())
    df = records.read_records(spark, str(path), ["a", "b", "c"])
    assert df.rdd.getNumPartitions() == -(-n // (records.SPLIT // width))
    few = df.where(F.col("record").isin(0, n // 2, n - 1))
    assert few.rdd.getNumPartitions() == 1
    assert [tuple(r) for r in few.select("record", "a", "b", "c").orderBy("record").collect()] == [(k, float(k), float(-k), 0.5) for k in (0, n // 2, n - 1)]


def test_damaged_files_are_errors(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(bytes(48))
    (tmp_path / "short.bin").write_bytes(bytes(47))
    with pytest.raises(Exception, match="short.bin has 47 bytes"):
        records.read_records(spark, str(tmp_path), ["x", "y"], "<f8").collect()
    with pytest.raises(Exception, match="nowhere"):
        records.read_records(spark, f"{tmp_path}/nowhere", ["x"], "u1").collect()


@pytest.mark.parametrize("kind", ["u1", "<u2", "<i8", "<f4", "<f8"])
def test_round_trip(spark, tmp_path, kind):
    path = f"{tmp_path}/out"
    rows = spark.range(1000).select("id", (F.col("id") * 7 % 1000).alias("key"), F.when(F.col("id") != 3, F.col("id") * 70).alias("v"))
    records.write_records(rows, ["v", "key"], ["key"], path, kind, parts=5)
    assert sorted(x for x in os.listdir(path) if x[0] != ".") == [f"part-{k:06d}.bin" for k in range(5)]
    got = records.read_records(spark, path, ["v", "key"], kind).orderBy("at").collect()
    want = rows.orderBy("key").collect()
    assert len(got) == 1000
    most = np.iinfo(kind).max if kind[-2] in "ui" else None
    for g, w in zip(got, want):
        if most is None:
            assert g["key"] == w["key"] and (np.isnan(g["v"]) if w["v"] is None else g["v"] == w["v"])
        else:
            assert (g["key"], g["v"]) == (min(w["key"], most), most if w["v"] is None else min(w["v"], most))


def test_chunked_cube(spark, tmp_path):
    path = f"{tmp_path}/cube"
    rows = spark.range(20000).where("id % 3 > 0").select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ind")).select("pos", "ind", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("base")).withColumn("n", F.when(F.col("base") < 3, F.col("pos") * 10 + F.col("ind") - F.col("base")))
    cube.write_cube(rows, path, {"pos": 200, "ind": 2, "base": 4}, "n", attributes={"units": "reads"})
    assert cube.describe(spark, path)["attributes"] == {"units": "reads"}
    assert cube.describe(spark, path)["sizes"] == {"pos": 20000, "ind": 5, "base": 4}
    slab = cube.read_slab(spark, path, pos=(7000, 7199), ind=(1, 2))
    want = rows.where("pos between 7000 and 7199 and ind between 1 and 2 and n is not null")
    assert slab.exceptAll(want).count() == want.exceptAll(slab).count() == 0 and want.count() == slab.count() > 0
    assert cube.chunks(spark, path, pos=(7000, 7199)).count() * 100 == cube.chunks(spark, path).count()
    assert cube.read_slab(spark, path).count() == rows.where("n is not null").count()
    assert cube.read_slab(spark, path, pos=(99999, 100000)).collect() == []
    plan = cube.chunks(spark, path, pos=(7000, 7199))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c0)" in plan
