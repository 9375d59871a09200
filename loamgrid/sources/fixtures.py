"""Small binary files for tests of the binary readers, written through Spark's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """One file of bytes at a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
