"""Raster layers as cell tables: ``cell, row, col`` and one column per layer, null where missing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..sources.scratch import materialise
from .components import connected_components

ROOK = ((-1, 0), (1, 0), (0, -1), (0, 1))
QUEEN = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


def neighbours(cells: DataFrame, offsets=ROOK) -> DataFrame:
    """``i, row, col`` of each cell's neighbouring places."""
    steps = F.explode(F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in offsets]))
    return cells.select(F.col("cell").alias("i"), steps.alias("s")).select("i", "s.row", "s.col")


def rook_edges(cells: DataFrame, offsets=ROOK) -> DataFrame:
    """Directed edges ``i, j`` between neighbouring cells of the table."""
    # merged: Spark would broadcast a grid whose file is small, however many cells it has
    return neighbours(cells, offsets).join(cells.select("row", "col", F.col("cell").alias("j")).hint("merge"), ["row", "col"]).select("i", "j")


def region_adjacency(cells: DataFrame, region: str) -> DataFrame:
    """Unordered pairs of regions that touch."""
    of = cells.select("cell", F.col(region).alias("__r"))
    e = rook_edges(cells).join(of.toDF("i", "r1"), "i").join(of.toDF("j", "r2"), "j")
    return e.where("r1 < r2").select(F.col("r1").alias(f"{region}1"), F.col("r2").alias(f"{region}2")).distinct()


def crop(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return cells.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def mask(cells: DataFrame, by: DataFrame, layers, *, inverse: bool = False, mask_value=None) -> DataFrame:
    """Null the layers where the mask's ``m`` is missing (or equals ``mask_value``); ``inverse`` swaps."""
    out = F.col("m").isNull() if mask_value is None else F.coalesce(F.col("m") == mask_value, F.lit(False))
    gone = ~out if inverse else out
    return cells.join(by.select("cell", "m"), "cell", "left").withColumns({x: F.when(~gone, F.col(x)) for x in layers}).drop("m")


def block_mean(cells: DataFrame, layer: str, k: int, *, strict: bool = False) -> DataFrame:
    """Mean over k x k blocks; ``strict`` gives null for a block with a missing or absent cell."""
    b = cells.groupBy(F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")).agg(F.avg(layer).alias("mean"), F.count(layer).alias("n"))
    return b.withColumn("mean", F.when(F.col("n") == k * k, F.col("mean"))) if strict else b


def bilinear(cells: DataFrame, layer: str, targets: DataFrame) -> DataFrame:
    """Layer at target points ``id, y, x`` (in cells) from the four cells around; null if one is missing."""
    y0, x0 = F.floor("y"), F.floor("x")
    corner = lambda a, b: F.struct((y0 + a).alias("row"), (x0 + b).alias("col"), ((F.col("y") - y0 if a else 1 - (F.col("y") - y0)) * (F.col("x") - x0 if b else 1 - (F.col("x") - x0))).alias("w"))
    four = targets.select("id", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select("id", "c.*").where("w > 0")
    got = four.join(cells.select("row", "col", F.col(layer).alias("v")), ["row", "col"], "left")
    return got.groupBy("id").agg(F.when(F.count("*") == F.count("v"), F.sum(F.col("w") * F.col("v"))).alias("value"))


def disaggregate(cells: DataFrame, layer: str, k: int) -> DataFrame:
    """Each cell as k x k cells of the same value."""
    steps = F.explode(F.array(*[F.struct((F.col("row") * k + a).alias("row"), (F.col("col") * k + b).alias("col")) for a in range(k) for b in range(k)]))
    return cells.select(steps.alias("s"), layer).select("s.row", "s.col", layer)


#: Side of the tiles that are labelled one by one.
TILE = 64


def _clumps_of_tile(offsets):
    def label(rows: pd.DataFrame) -> pd.DataFrame:
        """The least cell of each cell's clump within the tile."""
        cell = np.sort(rows["cell"].to_numpy())
        rows = rows.sort_values("cell")
        r, c = rows["row"].to_numpy() - rows["row"].min(), rows["col"].to_numpy() - rows["col"].min()
        at = np.full((r.max() + 3, c.max() + 3), -1)
        at[r + 1, c + 1] = np.arange(len(cell))
        near = [at[r + 1 + a, c + 1 + b] for a, b in offsets]
        i = np.concatenate([np.flatnonzero(x >= 0) for x in near])
        j = np.concatenate([x[x >= 0] for x in near])
        best = np.arange(len(cell))
        while True:
            least = best.copy()
            np.minimum.at(least, i, best[j])
            np.minimum.at(least, best[i], best[j])  # the root of a cell takes the neighbour's root too
            least = least[least]
            if (least == best).all():
                return pd.DataFrame({"cell": cell, "row": rows["row"].to_numpy(), "col": rows["col"].to_numpy(), "label": cell[best]})
            best = least

    return label


def clump(cells: DataFrame, offsets=ROOK, *, tile: int = TILE) -> DataFrame:
    """``cell, clump``: connected components of the table's cells (one a place), named by their least cell.

    Tiles are labelled one by one; cells at a tile's edge meet their neighbours in the next one, and components are made of
    those pairs of labels alone, so the rounds of the search follow the tiles that a clump crosses and not its cells.
    """
    kind = cells.schema["cell"].dataType.simpleString()
    part = [F.floor(F.col(c) / tile).alias(n) for c, n in (("row", "tr"), ("col", "tc"))]
    rows = cells.select(F.col("cell").cast("long").alias("cell"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *part)
    local = materialise(rows.groupBy("tr", "tc").applyInPandas(_clumps_of_tile(offsets), "cell long, row long, col long, label long"), "local")
    reach = max(max(abs(a), abs(b)) for a, b in offsets)
    low = lambda c: F.pmod(F.col(c), F.lit(tile))
    edge = local.where((low("row") < reach) | (low("row") >= tile - reach) | (low("col") < reach) | (low("col") >= tile - reach))
    across = neighbours(edge.select(F.col("label").alias("cell"), "row", "col"), offsets).join(edge.select("row", "col", F.col("label").alias("b")), ["row", "col"])
    names = connected_components(across.select(F.col("i").alias("a"), "b")).toDF("label", "clump")
    return local.join(names, "label", "left").select(F.col("cell").cast(kind).alias("cell"), F.coalesce("clump", "label").cast(kind).alias("clump"))


def keep_biggest(cells: DataFrame, clumps: DataFrame) -> DataFrame:
    """The cells of the largest clump (the least name among equals)."""
    best = clumps.groupBy("clump").agg(F.count("*").alias("n")).agg(F.max_by("clump", F.struct(F.col("n"), -F.col("clump"))).alias("clump"))
    return cells.join(clumps.join(F.broadcast(best), "clump", "left_semi").select("cell"), "cell", "left_semi")


def within(cells: DataFrame, marked: DataFrame, radius: float) -> DataFrame:
    """Least squared distance of each cell to the marked cells, where within the radius."""
    from .relations import within_distance

    m = marked.select(F.col("cell").alias("m"), F.col("col").alias("mx"), F.col("row").alias("my"))
    return within_distance(cells.select("cell", "col", "row"), m, radius, a_cols=("cell", "col", "row"), b_cols=("m", "mx", "my")).groupBy("cell").agg(F.min("d2").alias("d2"))


def boundary(cells: DataFrame, inside: DataFrame) -> DataFrame:
    """Cells outside a neighbourhood that touch it: ``target, cell``; ``inside``: target, cell."""
    e = rook_edges(cells)
    out = inside.join(e, F.col("cell") == F.col("i")).select("target", F.col("j").alias("cell")).distinct()
    return out.join(inside, ["target", "cell"], "left_anti")


def zscore(cells: DataFrame, layers) -> DataFrame:
    """Centre and scale each layer by its mean and sample sd over all cells."""
    stats = cells.agg(*[F.avg(x).alias(f"__m_{x}") for x in layers], *[F.stddev_samp(x).alias(f"__s_{x}") for x in layers])
    both = cells.crossJoin(F.broadcast(stats))
    return both.withColumns({f"{x}_z": (F.col(x) - F.col(f"__m_{x}")) / F.nullif(F.col(f"__s_{x}"), F.lit(0.0)) for x in layers}).drop(*[f"__{k}_{x}" for k in "ms" for x in layers])


def cell_of(x: Column | str, y: Column | str, ncol: int) -> Column:
    return F.floor(col(y)) * ncol + F.floor(col(x))


def xy_of(cell: Column | str, ncol: int) -> tuple[Column, Column]:
    """Middle of a cell."""
    return col(cell) % ncol + 0.5, F.floor(col(cell) / ncol) + 0.5


def cached(cells: DataFrame, name: str = "cells") -> DataFrame:
    return materialise(cells, name)
