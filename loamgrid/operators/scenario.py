"""Comparison of scenarios and collation of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .relations import small


def pair_scenario(pairs: DataFrame, *, share: float = 0.4, limits: DataFrame | None = None) -> DataFrame:
    """Per reference the mean, greatest, least and relative change over its nearby references.

    ``pairs``: id1 <= id2, base, alt. Nearby are those whose base value is below
    the ``share`` quantile of the reference's row, itself included. Where these quantiles are known, ``limits``
    (id1, q) gives them, and ``pairs`` has both orders of each pair.
    """
    m, q = pairs.select("id1", "id2", "base", "alt"), limits
    if q is None:
        m = m.union(m.where("id1 <> id2").select("id2", "id1", "base", "alt"))
        q = m.groupBy("id1").agg(F.percentile("base", F.lit(share)).alias("q"))
    q = materialise(q, "limits")
    d = F.col("alt") - F.col("base")
    near = m.join(small(q), "id1").where("base < q")
    out = near.groupBy("id1").agg(F.avg(d).alias("mean"), F.avg(d / (1.0 + F.col("base"))).alias("rel"), F.max(d).alias("hi"), F.min(d).alias("lo"))
    return q.select("id1").join(out, "id1", "left")


def scenario_summary(refs: DataFrame, *, over: float = 1500.0) -> DataFrame:
    """One row of metrics over the references of ``pair_scenario``."""
    big, pos = F.col("mean") > over, F.col("mean") > 0
    return refs.agg(
        F.count("*").alias("n_refs"), F.count_if(big).alias("area_over"), F.avg(F.when(big, F.col("mean"))).alias("mean_over"),
        F.count_if(pos).alias("area_pos"), F.avg(F.when(pos, F.col("mean"))).alias("mean_pos"),
        F.max("hi").alias("top"), F.min("lo").alias("low"), F.avg("rel").alias("relative"),
    )


def collate(runs: list[DataFrame]) -> DataFrame:
    """Runs of differing columns under each other; what a run lacks is null."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
