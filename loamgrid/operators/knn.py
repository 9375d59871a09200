"""k nearest points of the plane by a pyramid of squares.

Points are counted in squares of several sizes, each with the box that its points fill. Going from large squares to small
ones, every place keeps the squares that may hold one of its k nearest points: squares are taken by the furthest corner of
their box until k points are in, and those whose nearest edge is beyond that corner go. Only the points of the smallest
squares that are left meet the place. So a far outlier costs a few squares, and a crowd of points is split until its squares
are small.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Points of a smallest square, about; a square of more than ``CROWD`` times as many makes the squares smaller.
LEAF, CROWD = 8, 16
#: Exponents of the number of squares a side: at first (two at most), and at last.
FIRST, LAST = 2, 28
#: Places of a task at most, about: so its memory doesn't grow with the table.
PLACES = 20_000


def dealt(df: DataFrame, places: int, *keys: str) -> DataFrame:
    """The rows of ``places`` places dealt to tasks by their keys."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-places // PLACES)), *keys)


def k_nearest(a: DataFrame, b: DataFrame, k: int, *, a_cols=("a_id", "ax", "ay"), b_cols=("b_id", "bx", "by")) -> DataFrame:
    """``a_id, b_id, d2, place``: the k nearest b of each a, with the squared distance; the least id first among equals.

    Cases: rows with a null coordinate don't count; with fewer than k points all are given; a is its own neighbour where it
    is in b; several points on one spot are neighbours one by one, by id.
    """
    (ai, ax, ay), (bi, bx, by) = a_cols, b_cols
    real = lambda c, out: F.col(c).cast("double").alias(out)
    spot = Window.partitionBy("x", "y").orderBy("id")
    points = b.select(F.col(bi).alias("id"), real(bx, "x"), real(by, "y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    points = materialise(points.withColumn("n", F.row_number().over(spot)).where(F.col("n") <= k).drop("n"), "points")
    size = points.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count("*").alias("n")).first()
    places = a.select(F.col(ai).alias("aid"), real(ax, "px"), real(ay, "py")).where("px is not null and py is not null and not isnan(px) and not isnan(py)")
    if not size["n"]:
        return places.select(F.col("aid").alias(ai), F.lit(None).cast(b.schema[bi].dataType).alias(bi), F.lit(0.0).alias("d2"), F.lit(1).alias("place")).where("false")
    depth = FIRST + 2 * max(0, ceil((log(size["n"] / LEAF, 4) if size["n"] > LEAF else 0) - FIRST + 1) // 2)
    while True:
        scale = (2**depth) / (size["side"] or 1.0)
        q = lambda c, low: F.least(F.floor((F.col(c) - low) * scale), F.lit(2**depth - 1)).cast("long")
        placed = points.withColumns({"qx": q("x", size["x"]), "qy": q("y", size["y"])})
        squares = placed.groupBy("qx", "qy").agg(F.count("*").alias("n"), F.count_distinct("x", "y").alias("spots"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
        squares = materialise(squares, "squares")
        if depth >= LAST or squares.agg(F.max("spots")).first()[0] <= CROWD * LEAF:
            break
        depth += 4
    away = lambda low, high, p: F.greatest(F.col(low) - F.col(p), F.col(p) - F.col(high), F.lit(0.0))
    across = lambda low, high, p: F.greatest(F.col(p) - F.col(low), F.col(high) - F.col(p))
    sq = lambda c: c * c
    box = ["n", "x1", "x2", "y1", "y2"]

    def level(up: int) -> DataFrame:
        """Squares 2**up times as large a side."""
        if not up:
            return squares.select("qx", "qy", *box)
        return squares.groupBy(F.shiftright("qx", up).alias("qx"), F.shiftright("qy", up).alias("qy")).agg(F.sum("n").alias("n"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))

    many = places.count()

    def may_hold(state: DataFrame) -> DataFrame:
        state = dealt(state, many, "px", "py")
        by = Window.partitionBy("px", "py")
        full = F.sum("n").over(by.orderBy("far", "qx", "qy").rowsBetween(Window.unboundedPreceding, 0))
        state = state.withColumn("far", sq(across("x1", "x2", "px")) + sq(across("y1", "y2", "py"))).withColumn("near", sq(away("x1", "x2", "px")) + sq(away("y1", "y2", "py")))
        bound = F.min(F.when(F.col("full") >= k, F.col("far"))).over(by)
        state = state.withColumn("full", full).withColumn("bound", bound)
        return state.where("bound is null or near <= bound * 1.000000000001").select("px", "py", "qx", "qy")

    top = level(depth - FIRST).agg(F.collect_list(F.struct("qx", "qy", *box)).alias("all"))  # at most 16 squares
    spots = places.select("px", "py").distinct()
    state = may_hold(spots.crossJoin(F.broadcast(top)).select("px", "py", F.inline("all")))
    for up in range(depth - FIRST - 2, -1, -2):
        inner = level(up).withColumns({"ux": F.shiftright("qx", 2), "uy": F.shiftright("qy", 2)})
        state = state.select("px", "py", F.col("qx").alias("ux"), F.col("qy").alias("uy")).join(inner, ["ux", "uy"])
        state = may_hold(state)
    met = state.join(placed, ["qx", "qy"]).select("px", "py", "id", (sq(F.col("x") - F.col("px")) + sq(F.col("y") - F.col("py"))).alias("d2"))
    met = dealt(met, many, "px", "py").withColumn("place", F.row_number().over(Window.partitionBy("px", "py").orderBy("d2", "id"))).where(F.col("place") <= k)
    return places.join(met, ["px", "py"]).select(F.col("aid").alias(ai), F.col("id").alias(bi), "d2", "place")


def nearest(a: DataFrame, b: DataFrame, *, a_cols=("a_id", "ax", "ay"), b_cols=("b_id", "bx", "by")) -> DataFrame:
    """The nearest b of each a (least id among equals); null where there is none."""
    found = k_nearest(a, b, 1, a_cols=a_cols, b_cols=b_cols).drop("place")
    return a.select(a_cols[0]).join(found, a_cols[0], "left")
