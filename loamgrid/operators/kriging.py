"""Kriging in neighbourhoods, with an empirical variogram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import dealt, k_nearest
from .relations import within_distance

#: Places whose systems are solved at once.
BATCH = 2000


def variogram(points: DataFrame, lag: float, bins: int) -> DataFrame:
    """``bin, n, distance, gamma``: mean distance and half mean squared difference of pairs of points by distance.

    ``points``: id, x, y, z. Bin b holds the distances from b * lag to below (b + 1) * lag; pairs meet by squares of the
    largest distance. Points without a value don't count; two on one spot are a pair of distance 0; bins without a pair
    have no row.
    """
    p = points.where("z is not null")
    near = within_distance(p, p.toDF(*[c + "2" for c in p.columns]), lag * bins, a_cols=("id", "x", "y"), b_cols=("id2", "x2", "y2")).where("id < id2")
    value = p.select("id", F.col("z").cast("double").alias("z"))
    pairs = near.join(value, "id").join(value.toDF("id2", "z2"), "id2")
    d = F.sqrt("d2")
    by_bin = pairs.groupBy(F.floor(d / lag).alias("bin")).agg(F.count("*").alias("n"), F.avg(d).alias("distance"), (F.avg((F.col("z") - F.col("z2")) * (F.col("z") - F.col("z2"))) / 2).alias("gamma"))
    return by_bin.where(F.col("bin") < bins)


def fit_width(bins: DataFrame) -> tuple[float, float, float]:
    """Width, sill and nugget of ``nugget + sill * (1 - exp(-d / width))``, by least squares weighted by the bins' pairs.

    ``bins``: a variogram, a bounded number of rows. The width is searched on a grid, the others are linear.
    """
    rows = [r for r in bins.collect() if r["distance"] > 0]
    if not rows:
        raise ValueError("no pair of points has a distance within the variogram's range")
    d, g, w = (np.array([r[c] for r in rows], float) for c in ("distance", "gamma", "n"))
    best = None
    for width in d.max() * np.geomspace(0.02, 5, 120):
        a = np.c_[1 - np.exp(-d / width), np.ones(len(d))] * np.sqrt(w)[:, None]
        for cols in ((0, 1), (0,)):
            x = np.zeros(2)
            x[list(cols)] = np.linalg.lstsq(a[:, cols], g * np.sqrt(w), rcond=None)[0]
            off = ((a @ x - g * np.sqrt(w)) ** 2).sum()
            if x.min() >= 0 and (best is None or off < best[0]):
                best = off, float(width), float(x[0]), float(x[1])
    if best is None:
        raise ValueError("the variogram doesn't rise with distance")
    return best[1:]


def kriging_weights(known: DataFrame, targets: DataFrame, *, neighbours: int, width: float, nugget: float = 0.0) -> DataFrame:
    """``a_id, b_id, weight, penalty``: ordinary kriging weights of each target's nearest known points.

    ``known``: b_id, bx, by, no two on one spot; ``targets``: a_id, ax, ay. The covariance at a distance is
    ``exp(-d / width)``, with ``nugget`` added between a point and itself, both relative to the sill. ``penalty`` is the
    multiplier that makes the weights add up to 1.
    """
    near = dealt(k_nearest(targets, known, neighbours).join(known, "b_id").join(targets, "a_id"), targets.count(), "a_id")
    real = lambda c: F.col(c).cast("double")
    each = near.groupBy("a_id").agg(F.collect_list(F.struct("place", "b_id", (real("bx") - real("ax")).alias("x"), (real("by") - real("ay")).alias("y"))).alias("near"))  # of ``neighbours`` rows

    def solve(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                lists = part.column("near")
                flat = lists.flatten()
                n = np.diff(lists.offsets.to_numpy())
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                weight, penalty = np.empty(len(flat)), np.empty(len(flat))
                for k in np.unique(n):
                    rows = np.flatnonzero(n == k)
                    i = first[rows][:, None] + np.arange(k)
                    px, py = x[i], y[i]
                    d = np.hypot(px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :])
                    system = np.ones((len(rows), k + 1, k + 1))
                    system[:, :k, :k] = np.exp(-d / width) + nugget * np.eye(k)
                    system[:, k, k] = 0
                    right = np.ones((len(rows), k + 1, 1))
                    right[:, :k, 0] = np.exp(-np.hypot(px, py) / width)
                    w = np.linalg.solve(system, right)[:, :, 0]
                    weight[i] = w[:, :k]
                    penalty[i] = w[:, k:]
                ids = part.column("a_id").take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                yield pa.RecordBatch.from_arrays([ids, flat.field("b_id"), pa.array(weight), pa.array(penalty)], names=["a_id", "b_id", "weight", "penalty"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return each.mapInArrow(solve, f"a_id {kind(targets, 'a_id')}, b_id {kind(known, 'b_id')}, weight double, penalty double")


def krige(known: DataFrame, targets: DataFrame, *, neighbours: int = 16, width: float | None = None, nugget: float = 0.0, lag: float = 1.0, bins: int = 15) -> DataFrame:
    """``a_id, z`` at each target, from the nearest known points (b_id, bx, by, z); without a ``width`` one is fitted to the variogram.

    Without a nugget the values of known points are given back. Known points on one spot count as one, of their mean;
    without known points there is no row.
    """
    spots = known.where("z is not null").groupBy("bx", "by").agg(F.min("b_id").alias("b_id"), F.avg("z").alias("z"))
    if width is None:
        width, sill, own = fit_width(variogram(spots.select(F.col("b_id").alias("id"), F.col("bx").alias("x"), F.col("by").alias("y"), "z"), lag, bins))
        nugget = own / sill if sill else 0.0
    w = kriging_weights(spots.select("b_id", "bx", "by"), targets, neighbours=neighbours, width=width, nugget=nugget)
    return dealt(w.join(spots.select("b_id", "z"), "b_id"), targets.count(), "a_id").groupBy("a_id").agg(F.sum(F.col("weight") * F.col("z")).alias("z"))
