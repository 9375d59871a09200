"""Point configurations, local surfaces and aligned sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import k_nearest
from .relations import ROSTER, within_distance

#: Places whose planes a task fits.
PLACES = 5000


def procrustes(points: DataFrame, key: str) -> DataFrame:
    """``key, px, py``: points (u, v) moved, scaled and turned, or mirrored, to lie nearest to (x, y) in least squares.

    One pass for the moments; in the plane the best turn and the best mirror image have closed forms, and the one with the
    larger trace wins. Rows with a null don't count; where all (u, v) coincide the result is the centre.
    """
    p = points.select(key, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]).na.drop()
    c = lambda a, b: F.covar_pop(a, b).alias(a + b)
    m = p.agg(*[F.avg(a).alias(f"m{a}") for a in ("x", "y", "u", "v")], c("x", "u"), c("x", "v"), c("y", "u"), c("y", "v"), (F.var_pop("u") + F.var_pop("v")).alias("spread"))
    turn = F.struct((F.col("xu") + F.col("yv")).alias("a"), (F.col("yu") - F.col("xv")).alias("b"), F.lit(1.0).alias("side"))
    mirror = F.struct((F.col("xu") - F.col("yv")).alias("a"), (F.col("yu") + F.col("xv")).alias("b"), F.lit(-1.0).alias("side"))
    size = lambda s: s["a"] * s["a"] + s["b"] * s["b"]
    m = m.withColumn("way", F.when(size(turn) >= size(mirror), turn).otherwise(mirror))
    q = p.crossJoin(F.broadcast(m.select("mx", "my", "mu", "mv", "way", "spread")))  # one row
    du, dv = F.col("u") - F.col("mu"), (F.col("v") - F.col("mv")) * F.col("way.side")
    part = lambda e: F.coalesce(e / F.nullif(F.col("spread"), F.lit(0.0)), F.lit(0.0))
    return q.select(key, (F.col("mx") + part(F.col("way.a") * du - F.col("way.b") * dv)).alias("px"), (F.col("my") + part(F.col("way.b") * du + F.col("way.a") * dv)).alias("py"))


def local_surface(points: DataFrame, at: DataFrame, radius: float) -> DataFrame:
    """``a_id, z``: at each place (a_id, ax, ay) the value of the plane fitted to the points (b_id, bx, by, z) within ``radius``.

    Tricube weights; where the points lie on a line or on one spot their weighted mean; places without a point have no row.
    """
    near = within_distance(at, points.where("z is not null"), radius, keep=("ax", "ay", "bx", "by", "z")).where(F.col("d2") < radius * radius)
    return _planes(near, F.lit(float(radius * radius)))


def loess(points: DataFrame, at: DataFrame, share: float) -> DataFrame:
    """``a_id, z``: like ``local_surface``, each plane fitted to the nearest ``share`` of the points; the furthest of them has no weight.

    At least one point; those of a place that all lie as far away as the furthest count alike. Up to ``ROSTER`` points are
    broadcast and nothing but the places is moved; the work is places times neighbours.
    """
    there = points.where("z is not null")
    n = there.count()
    k = max(1, int(n * share + 1e-5))
    if n <= ROSTER:
        return _streamed_planes(there, at, k)
    near = k_nearest(at, there, k)
    reach = near.groupBy("a_id").agg(F.max("d2").alias("reach"), F.min("d2").alias("least"))
    near = near.join(reach, "a_id").where("d2 < reach or least = reach").join(at, "a_id").join(there, "b_id")
    return _planes(near.withColumn("d2", F.when(F.col("least") == F.col("reach"), 0.0).otherwise(F.col("d2"))), F.greatest("reach", F.lit(1e-300)))


def _streamed_planes(points: DataFrame, at: DataFrame, k: int) -> DataFrame:
    """``loess`` by the ``k`` nearest points of a broadcast roster: a task holds one place's neighbours at a time.

    Points are sorted along the longer side; the k nearest along it bound the reach, so only those within it are looked at.
    """
    real = lambda c: F.col(c).cast("double").alias(c)
    p = points.select("b_id", real("bx"), real("by"), real("z")).toPandas().dropna(subset=["bx", "by"])
    long, short = ("ax", "ay") if not len(p) or np.ptp(p["bx"]) >= np.ptp(p["by"]) else ("ay", "ax")
    p = p.sort_values("b" + long[1])
    shared = at.sparkSession.sparkContext.broadcast((p["b_id"].to_numpy(), p["b" + long[1]].to_numpy(), p["b" + short[1]].to_numpy(), p["z"].to_numpy()))

    def fit(u: float, v: float) -> float:
        ids, along, across, z = shared.value
        n = min(k, len(along))
        # the k nearest along the axis, by bisection of where they start
        low, high = 0, len(along) - n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if u - along[mid] > along[mid + n] - u else (low, mid)
        d2 = (along[low : low + n] - u) ** 2 + (across[low : low + n] - v) ** 2
        most = np.sqrt(d2.max()) * (1 + 1e-12)
        near = slice(np.searchsorted(along, u - most, "left"), np.searchsorted(along, u + most, "right"))
        x, y, z = along[near] - u, across[near] - v, z[near]
        d2 = x * x + y * y
        reach = np.partition(d2, n - 1)[n - 1]
        if d2.min() == reach:  # all as far: they count alike
            use = np.flatnonzero(d2 == reach)
            use = use[np.argsort(ids[near][use], kind="stable")[:n]]
            w = np.ones(len(use))
        else:
            use = np.flatnonzero(d2 < reach)
            r = d2[use] / reach
            w = (1 - r * np.sqrt(r)) ** 3
        x, y, z = x[use], y[use], z[use]
        wx, wy = w * x, w * y
        m, sx, sy, xx, xy, yy, sz, xz, yz = w.sum(), wx.sum(), wy.sum(), wx @ x, wx @ y, wy @ y, w @ z, wx @ z, wy @ z
        det = m * (xx * yy - xy * xy) - sx * (sx * yy - sy * xy) + sy * (sx * xy - sy * xx)
        top = sz * (xx * yy - xy * xy) - xz * (sx * yy - sy * xy) + yz * (sx * xy - sy * xx)
        return top / det if abs(det) > 1e-9 * m * (xx + yy) * (xx + yy) else sz / m

    def run(batches):
        for b in batches:
            b = b[b["ax"].notna() & b["ay"].notna()] if len(shared.value[0]) else b[:0]
            yield pd.DataFrame({"a_id": b["a_id"], "z": np.array([fit(u, v) for u, v in zip(b[long], b[short])], float)})

    kind = at.schema["a_id"].dataType.simpleString()
    places = at.select("a_id", real("ax"), real("ay")).where("ax is not null and ay is not null")
    return places.repartition(max(1, -(-places.count() // PLACES)), "a_id").mapInPandas(run, f"a_id {kind}, z double")


def _planes(near: DataFrame, reach2) -> DataFrame:
    """``a_id, z`` of planes fitted to the points near each place, with tricube weights up to a squared distance."""
    u = F.pow(F.col("d2") / reach2, 1.5)
    w, x, y = F.pow(1 - u, 3), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = near.select("a_id", "z", w.alias("w"), x.alias("x"), y.alias("y"))
    s = lambda name, e: F.sum(F.col("w") * e).alias(name)
    X, Y, Z = F.col("x"), F.col("y"), F.col("z")
    m = t.groupBy("a_id").agg(s("n", F.lit(1.0)), s("x", X), s("y", Y), s("xx", X * X), s("xy", X * Y), s("yy", Y * Y), s("z", Z), s("xz", X * Z), s("yz", Y * Z))
    n, sx, sy, xx, xy, yy, z, xz, yz = (F.col(c) for c in ("n", "x", "y", "xx", "xy", "yy", "z", "xz", "yz"))
    flat, cx, cy = xx * yy - xy * xy, sx * yy - sy * xy, sx * xy - sy * xx
    det = n * flat - sx * cx + sy * cy
    top = z * flat - xz * cx + yz * cy
    return m.select("a_id", F.when(F.abs(det) > 1e-9 * n * (xx + yy) * (xx + yy), top / det).otherwise(z / n).alias("z"))


def alignment_stats(df: DataFrame, a: str, b: str, *, gap: str = "-") -> DataFrame:
    """The table with ``matches, mismatches, gaps_a, gaps_b, identity`` of two aligned texts, column by column.

    Identity is the share of matches among columns without a gap, null without one; all are null where a text is null or
    the lengths differ.
    """
    same = F.length(a) == F.length(b)
    two = F.when(same & (F.length(a) > 0), F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))).when(same, F.array())
    n = lambda f: F.when(F.col("__two").isNotNull(), F.size(F.filter("__two", f))).cast("long")
    both = lambda p: (p["a"] != gap) & (p["b"] != gap)
    out = df.withColumn("__two", two.cast("array<struct<a:string,b:string>>"))
    out = out.withColumn("matches", n(lambda p: both(p) & (p["a"] == p["b"]))).withColumn("mismatches", n(lambda p: both(p) & (p["a"] != p["b"])))
    out = out.withColumn("gaps_a", n(lambda p: p["a"] == gap)).withColumn("gaps_b", n(lambda p: p["b"] == gap)).drop("__two")
    return out.withColumn("identity", F.col("matches") / F.nullif(F.col("matches") + F.col("mismatches"), F.lit(0)))
