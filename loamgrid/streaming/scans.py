"""Streaming twins of the block-wise scans: histograms and per-key coverage over a stream of rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.expressions import hash_text
from ..sources.scratch import new_path


def running_histogram(stream: DataFrame, key: str, value, width: float) -> DataFrame:
    """Counts by key and equal-width bin: partial sums per batch, merged in the state."""
    return stream.groupBy(key, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def running_coverage(stream: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """First and last place, rows and sum of each key: the carry-over between blocks is the state."""
    return stream.groupBy(key).agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n"), F.sum(value).alias("total"))


def windowed_counts(stream: DataFrame, time: str, key: str, *, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


SAMPLE_STATE = "past boolean, marks array<string>, places array<long>"


def range_samples(stream: DataFrame, key: str, place: str, *, low: int, high: int, size: int, seed: int = 0) -> DataFrame:
    """``key, place``: for each key a sample of ``size`` places from ``low`` to ``high``, sent once a place beyond them has come.

    Rows of a key are taken to come in the order of their places, as a file has them: what comes after the range has passed
    is not looked at, so the state ends there. The sample is that of the least hashes of the place and the seed, whatever the
    batches, and the same after a restart from the checkpoint. Keys whose range never passes send nothing; a place that comes
    twice counts once; rows with a null are left out.
    """
    kind = stream.schema[key].dataType.simpleString()
    marked = stream.where(F.col(key).isNotNull() & F.col(place).isNotNull()).select(F.col(key).alias("key"), F.col(place).cast("long").alias("place"), hash_text(place, seed=seed).alias("mark"))

    def keep(names, batches, state):
        past, marks, places = state.get if state.exists else (False, [], [])
        held, done = dict(zip(places, marks)), past
        for b in batches:
            if past:
                continue
            inside = b[(b["place"] >= low) & (b["place"] <= high)]
            held.update(zip(inside["place"].tolist(), inside["mark"].tolist()))
            held = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[:size])
            done = done or bool((b["place"] > high).any())
        if done and not past:
            yield pd.DataFrame({key: [names[0]] * len(held), place: sorted(held)})
            held = {}
        state.update((done, list(held.values()), list(held)))

    grouped = marked.groupBy("key")
    return grouped.applyInPandasWithState(keep, f"{key} {kind}, {place} long", SAMPLE_STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, result: DataFrame, *, mode: str = "complete", path: str | None = None, state: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into a table in the shared folder, and read it.

    Each batch has a folder of its own number, which a batch that is run again writes anew; of a complete result the last
    batch counts. With the same ``path`` and ``state`` a later run goes on where the last one ended.
    """
    path, state = path or new_path(spark, "stream"), state or new_path(spark, "stream-state")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/epoch={epoch}")

    q = result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(path).select(*result.columns)
