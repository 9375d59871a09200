"""Clusters of vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(df: DataFrame, id_col: str, vector_col: str, *, k: int, seed: int = 1) -> DataFrame:
    """``id, cluster`` by k-means with a fixed seed."""
    rows = df.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select(id_col, F.col("prediction").alias("cluster"))
