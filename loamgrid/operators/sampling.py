"""Samples drawn by hash, so that a retried task draws the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hash_text, hash_uniform
from ..sources.scratch import materialise


def fixed_sample(df: DataFrame, n: int, keys: list[str], *, seed: int = 0) -> DataFrame:
    """n rows: those of the least hash (a top-n, kept per task before it is merged)."""
    h = hash_text(*keys, seed=seed)
    return df.withColumn("__h", h).orderBy("__h", *keys).limit(n).drop("__h")


def stratified_sample(df: DataFrame, n: int, by: list[str], keys: list[str], *, seed: int = 0) -> DataFrame:
    """At most n rows of each stratum, by least hash."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hash_text(*keys, seed=seed), *keys))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def block_sample(df: DataFrame, at: str, size: int, share: float, *, seed: int = 0) -> DataFrame:
    """Whole blocks of consecutive places, each drawn with chance ``share``."""
    return df.where(hash_uniform(F.floor(F.col(at) / size), seed=seed) < share)


def independent_set(nodes: DataFrame, conflicts: DataFrame, *, seed: int = 0) -> DataFrame:
    """A maximal set of nodes without conflicts (a, b): in rounds, every node whose hash is the least among its rivals joins."""
    priority = lambda c: F.struct(hash_text(c, seed=seed), F.col(c))
    both = conflicts.union(conflicts.select("b", "a")).toDF("id", "rival").where("id <> rival").distinct()
    left, chosen = nodes.select("id").distinct(), None
    edges = materialise(both, "conflicts")
    while left.take(1):
        best = edges.groupBy("id").agg(F.min(priority("rival")).alias("rival_best"))
        wins = left.join(best, "id", "left").where(F.col("rival_best").isNull() | (priority("id") < F.col("rival_best"))).select("id")
        wins = materialise(wins, "chosen")
        chosen = wins if chosen is None else chosen.union(wins)
        out = wins.union(edges.join(wins, "id", "left_semi").select("rival")).distinct()
        left = materialise(left.join(out, "id", "left_anti"), "left")
        edges = materialise(edges.join(out, "id", "left_anti").join(out.toDF("rival"), "rival", "left_anti").select("id", "rival"), "conflicts")
    return chosen if chosen is not None else left
