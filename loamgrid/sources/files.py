"""Which files there are, and shapes given as text."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that are there, in their order; a warning names each of the others."""
    conf, kept = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            kept.append(path)
        else:
            warnings.warn(f"{path} is not there and is left out", stacklevel=2)
    return kept


def latest_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, changed``: the file of a folder that was changed last (of several the greatest path); contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    last = F.max(F.struct("modificationTime", "path")).alias("last")
    return files.agg(last).where("last is not null").select("last.path", F.col("last.modificationTime").alias("changed"))


def wkt_vertices(df: DataFrame, key: str, wkt: str) -> DataFrame:
    """``key, part, ring, k, x, y``: vertices of (multi)polygons, (multi)lines and points given as well-known text, all counted from 0.

    In a polygon ring 0 is the outer one; the lines of a multiline are its rings. Empty shapes and null have no rows.
    """
    kind = r"(?is)^\s*(MULTI)?(POLYGON|LINESTRING|POINT)\s*(?:ZM|Z|M)?\s*\((.*)\)\s*$"
    body = F.regexp_extract(wkt, kind, 3)
    nested = F.upper(F.concat(F.regexp_extract(wkt, kind, 1), F.regexp_extract(wkt, kind, 2)))
    parts = F.when(nested == "MULTIPOLYGON", F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")).otherwise(F.array(body))
    part = df.where(body != "").select(F.col(key), F.posexplode(parts).alias("part", "__part"))
    ring = part.select(key, "part", F.posexplode(F.split("__part", r"\)\s*,\s*\(")).alias("ring", "__ring"))
    vertex = ring.select(key, "part", "ring", F.posexplode(F.split(F.regexp_replace("__ring", r"[()]", ""), ",")).alias("k", "__v"))
    at = F.split(F.trim("__v"), r"\s+")
    return vertex.select(key, *[F.col(c).cast("long").alias(c) for c in ("part", "ring", "k")], at[0].cast("double").alias("x"), at[1].cast("double").alias("y"))
