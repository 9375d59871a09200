"""Arrays of several dimensions in fixed chunks, as a table of chunks.

A chunk is a block of the array, packed and compressed in one row with the numbers of its place; rows are written in the
order of the chunks, in small groups. The files' own statistics of those numbers are the index: a slab reads the groups
that may hold its chunks, and unpacks its chunks only.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks that are compared by one entry of the index, about, in bytes before compression.
GROUP_BYTES = 1 << 20


def write_cube(df: DataFrame, path: str, chunks: dict[str, int], value: str, *, attributes: dict | None = None) -> None:
    """Write whole numbers ``value`` at the places given by the columns of ``chunks``, in blocks of these sizes.

    Places are whole numbers from 0; a null value is a missing one, as is a place without a row; of several values of one
    place the least is kept. Raises on a null or negative place, or if something is at the path.
    """
    spark, dims = df.sparkSession, list(chunks)
    shape = tuple(chunks[d] for d in dims)
    place = [F.floor(F.col(d) / chunks[d]).cast("long").alias(f"c{k}") for k, d in enumerate(dims)]
    within = sum((F.col(d) % chunks[d] * int(np.prod(shape[k + 1 :], dtype=int)) for k, d in enumerate(dims)), F.lit(0)).cast("long")
    bad = " or ".join(f"{d} is null or {d} < 0" for d in dims)
    checked = df.withColumn("__at", F.when(F.expr(bad), F.raise_error(F.lit("a place is null or negative"))).otherwise(within))
    rows = checked.where(F.col(value).isNotNull()).select(*place, F.col("__at").alias("at"), F.col(value).cast("long").alias("v"))
    keys = [f"c{k}" for k in range(len(dims))]

    def pack(key, part):
        at, v = part.column("at").to_numpy(), part.column("v").to_numpy()
        order = np.lexsort((v, at))[::-1]  # the least value is written last
        block, there = np.zeros(int(np.prod(shape)), np.int64), np.zeros(int(np.prod(shape)), bool)
        block[at[order]], there[at] = v[order], True
        raw = np.packbits(there).tobytes() + block.tobytes()
        return pa.table({**{c: pa.array([x.as_py()], pa.int64()) for c, x in zip(keys, key)}, "n": pa.array([int(there.sum())], pa.int64()), "data": pa.array([zstandard.ZstdCompressor(level=3).compress(raw)], pa.binary())})

    packed = rows.groupBy(*keys).applyInArrow(pack, ", ".join(f"{c} long" for c in keys) + ", n long, data binary")
    ordered = packed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.option("compression", "none").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/chunks")
    sizes = df.agg(*[(F.max(d) + 1).alias(d) for d in dims]).first().asDict()
    about = json.dumps({"dims": dims, "chunks": chunks, "sizes": sizes, "value": value, "attributes": attributes or {}})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")


def describe(spark: SparkSession, path: str) -> dict:
    """Names, chunk sizes and sizes of the dimensions, the value's name and the attributes."""
    return json.loads(spark.read.text(f"{path}/about").first()["value"])


def chunks(spark: SparkSession, path: str, **ranges: tuple[int, int]) -> DataFrame:
    """The chunks that hold a slab, still packed."""
    about = describe(spark, path)
    out = spark.read.parquet(f"{path}/chunks")
    for d, (low, high) in ranges.items():
        k = about["dims"].index(d)
        out = out.where(F.col(f"c{k}").between(low // about["chunks"][d], high // about["chunks"][d]))
    return out


def read_slab(spark: SparkSession, path: str, **ranges: tuple[int, int]) -> DataFrame:
    """A row for each value there is with the dimensions ``ranges`` from the first to the last number, both included."""
    about = describe(spark, path)
    dims = about["dims"]
    shape = tuple(about["chunks"][d] for d in dims)
    size = int(np.prod(shape))

    def unpack(batches):
        for b in batches:
            for row in b.to_pylist():
                raw = zstandard.ZstdDecompressor().decompress(row["data"])
                there = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8)), count=size))
                places = [x + row[f"c{k}"] * shape[k] for k, x in enumerate(np.unravel_index(there, shape))]
                keep = np.ones(len(there), bool)
                for d, (low, high) in ranges.items():
                    keep &= (places[dims.index(d)] >= low) & (places[dims.index(d)] <= high)
                v = np.frombuffer(raw, np.int64, size, -(-size // 8))[there[keep]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in places), pa.array(v)], names=[*dims, about["value"]])

    found = chunks(spark, path, **ranges).drop("n")
    return found.mapInArrow(unpack, ", ".join(f"`{d}` long" for d in dims) + f", `{about['value']}` long")
