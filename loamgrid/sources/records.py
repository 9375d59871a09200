"""Files of fixed-width records as a data source: read by ranges of records, written by tasks.

A file is cut into ranges of records of about ``SPLIT`` bytes, a task each. Conditions on ``record`` and ``at`` choose the
ranges before anything is read, so a few records take as many seeks. A file whose length is no multiple of a record's width
is damaged, and an error.

Files are opened by Arrow's file systems (local or mounted paths, HDFS, S3, GCS), on the executors.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "fixed-width-records"
#: Bytes of a task's share, and of one read.
SPLIT, READ = 32 << 20, 4 << 20
KINDS = {"u1": "long", "<u2": "long", "<i4": "long", "<i8": "long", "<f4": "double", "<f8": "double"}


@dataclass
class Runs(InputPartition):
    """Runs of records: (file, number of its first record in the sequence, first record, how many)."""

    runs: list


@dataclass
class Written(WriterCommitMessage):
    staged: str
    name: str


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def listed(path: str, width: int) -> list[tuple[str, int, int]]:
    """(file, number of records before it, its records), by name; names with a leading dot or underscore don't count."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.base_name)
    out, before = [], 0
    for f in files:
        if f.size % width:
            raise ValueError(f"{f.path} has {f.size} bytes, no multiple of the {width} of a record: it is cut short or of another format")
        out.append((f.path, before, f.size // width))
        before += f.size // width
    return out


def bounds(filters) -> tuple[dict[str, tuple[float, float, set | None]], list]:
    """Of each number column the least and greatest value and the only values, and the conditions that stay."""
    found, rest = {"record": (0, float("inf"), None), "at": (0, float("inf"), None)}, []
    for f in filters:
        column = f.attribute[0] if len(f.attribute) == 1 else None
        if column not in found:
            rest.append(f)
            continue
        low, high, only = found[column]
        if isinstance(f, EqualTo):
            only = {f.value} if only is None else only & {f.value}
        elif isinstance(f, In):
            only = set(f.value) if only is None else only & set(f.value)
        elif isinstance(f, GreaterThanOrEqual):
            low = max(low, f.value)
        elif isinstance(f, GreaterThan):
            low = max(low, f.value + 1)
        elif isinstance(f, LessThanOrEqual):
            high = min(high, f.value)
        elif isinstance(f, LessThan):
            high = min(high, f.value - 1)
        else:
            rest.append(f)
            continue
        found[column] = low, high, only
    return found, rest


def planned(files, found, width: int, split: int = SPLIT) -> list[Runs]:
    """Runs of the wanted records in shares of about ``split`` bytes."""
    runs = []
    for path, before, n in files:
        low = max(found["record"][0], found["at"][0] - before, 0)
        high = min(found["record"][1], found["at"][1] - before, n - 1)
        only = found["record"][2]
        if found["at"][2] is not None:
            here = {x - before for x in found["at"][2]}
            only = here if only is None else only & here
        if only is None:
            if low <= high:
                runs.append((path, before, int(low), int(high - low + 1)))
            continue
        for k in sorted(x for x in only if low <= x <= high):
            if runs and runs[-1][0] == path and runs[-1][2] + runs[-1][3] == k:
                runs[-1] = (path, before, runs[-1][2], runs[-1][3] + 1)
            else:
                runs.append((path, before, int(k), 1))
    out, share, size, most = [], [], 0, max(1, split // width)
    for path, before, first, n in runs:
        while n:
            take = min(n, most - size)
            share.append((path, before, first, take))
            first, n, size = first + take, n - take, size + take
            if size == most:
                out.append(Runs(share))
                share, size = [], 0
    return out + [Runs(share)] if share else out


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.names = options["path"], options["kind"], json.loads(options["names"])
        self.width = np.dtype(self.kind).itemsize * len(self.names)
        self.split = int(options.get("split", SPLIT))
        self.found = bounds([])[0]

    def pushFilters(self, filters):
        self.found, rest = bounds(filters)
        return rest

    def partitions(self):
        return planned(listed(self.path, self.width), self.found, self.width, self.split)

    def read(self, partition):
        system, _ = opened(self.path)
        names, whole = ["file", "record", "at", *self.names], KINDS[self.kind] == "long"
        most = max(1, READ // self.width)
        for path, before, first, n in partition.runs if partition else []:
            with system.open_input_file(path) as f:
                f.seek(first * self.width)
                while n:
                    k = min(n, most)
                    raw = f.read(k * self.width)
                    if len(raw) < k * self.width:
                        raise EOFError(f"{path} ended within record {first + len(raw) // self.width}")
                    m = np.frombuffer(raw, self.kind).reshape(k, len(self.names)).astype(np.int64 if whole else np.float64)
                    at = np.arange(first, first + k)
                    file = pa.array([path.rsplit("/", 1)[-1]]).take(pa.array(np.zeros(k, np.int64)))
                    yield pa.RecordBatch.from_arrays([file, pa.array(at), pa.array(at + before), *(pa.array(m[:, c]) for c in range(len(self.names)))], names=names)
                    first, n = first + k, n - k


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.kind, self.names = options["path"], options["kind"], json.loads(options["names"])

    def write(self, iterator):
        system, inner = opened(self.path)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        staged = f"{inner}/_staged/{name}-{uuid.uuid4().hex}"  # each attempt by itself; only one is committed
        system.create_dir(f"{inner}/_staged", recursive=True)
        limits = np.iinfo(self.kind) if self.kind[-2] in "ui" else None
        with system.open_output_stream(staged) as out:
            for b in iterator:
                missing = float("nan") if limits is None else int(limits.max)
                m = np.column_stack([b.column(n).fill_null(missing).to_numpy(zero_copy_only=False) for n in self.names])
                if limits is not None:
                    m = np.clip(m, limits.min, limits.max)
                out.write(np.ascontiguousarray(m.astype(self.kind)).tobytes())
        return Written(staged, name)

    def commit(self, messages):
        system, inner = opened(self.path)
        for m in messages:
            if m is not None:
                system.move(m.staged, f"{inner}/{m.name}")
        if system.get_file_info(f"{inner}/_staged").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_staged")

    def abort(self, messages):
        system, inner = opened(self.path)
        if system.get_file_info(f"{inner}/_staged").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_staged")


class FixedWidthRecords(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        kind = KINDS[self.options["kind"]]
        return "file string, record long, at long, " + ", ".join(f"`{n}` {kind}" for n in json.loads(self.options["names"]))

    def reader(self, schema):
        return RecordReader(dict(self.options))

    def writer(self, schema, overwrite):
        return RecordWriter(dict(self.options))


def read_records(spark: SparkSession, path: str, names: list[str], kind: str = "<f8", *, split: int = SPLIT) -> DataFrame:
    """``file, record, at`` and a column for each name: the records of a file, or of all files of a folder.

    ``record`` counts from 0 within its file, ``at`` through all files by their names. ``kind``: a numpy type of ``KINDS``.
    Raises on a file that doesn't hold whole records.
    """
    spark.dataSource.register(FixedWidthRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(kind=kind, names=json.dumps(names), split=split).load(path)


def write_records(df: DataFrame, names: list[str], order, path: str, kind: str = "<f8", *, parts: int | None = None) -> None:
    """The columns ``names`` as records in the order of the columns ``order``: a file for each range of it, named in turn.

    Whole numbers are cut off at the ends of their kind, whose greatest also stands for a null; a null is a NaN otherwise.
    """
    df.sparkSession.dataSource.register(FixedWidthRecords)
    n = parts or max(1, df.sparkSession.sparkContext.defaultParallelism)
    number = "double" if kind[-2] == "f" else "long"
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).selectExpr(*[f"cast(`{c}` AS {number}) AS `{c}`" for c in names])
    ranged.write.format(FORMAT).options(kind=kind, names=json.dumps(names)).mode("append").save(path)
