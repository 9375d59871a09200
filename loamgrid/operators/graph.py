"""Movement models on grid graphs: rates, Jacobi steps, objectives as joins and sums.

A model's edges are a table ``i, j, rate`` without a diagonal; the total rate
out of a cell is kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import linear_combination, logistic
from ..sources.scratch import materialise
from .raster import rook_edges
from .relations import small


def weight_names(layers) -> list[str]:
    """Names of a model's weights but for beta: ``gamma0`` (of the constant), ``gamma1``.., ``delta0``.."""
    return [f"{kind}{k}" for kind in ("gamma", "delta") for k in range(len(layers) + 1)]


def generator(cells: DataFrame, layers, *, beta: float, gamma, delta, parts: bool = False) -> DataFrame:
    """``i, j, rate`` = exp(beta) rho(gamma L_i) rho(delta (L_i + L_j)) over rook neighbours; layers without nulls.

    ``gamma`` and ``delta`` start with the constant's weight. Also ``gi`` and
    ``dij``: factors of the rate's derivatives in the first layer's weights.
    With ``parts`` also what the derivatives in all weights are made of (``kernels.slope``, ``kernels.bend``): for gamma and
    delta 1 - rho as ``gamma_rest`` and the layers that a weight multiplies as ``gamma_layer0`` (the constant) and so on.
    """
    value = lambda cols, w: F.lit(float(w[0])) + linear_combination(cols, w[1:])
    side = lambda end: cells.select(F.col("cell").alias(end), *[F.col(x).alias(f"{x}_{end}") for x in layers]).hint("merge")
    e = rook_edges(cells).join(side("i"), "i").join(side("j"), "j")
    source = logistic(value([f"{x}_i" for x in layers], gamma))
    edge = logistic(value([F.col(f"{x}_i") + F.col(f"{x}_j") for x in layers], (2 * delta[0], *delta[1:])))  # the constant layer counts at both ends
    first = layers[0]
    made = []
    if parts:
        made = [(1 - source).alias("gamma_rest"), (1 - edge).alias("delta_rest"), F.lit(1.0).alias("gamma_layer0"), F.lit(2.0).alias("delta_layer0")]
        for k, x in enumerate(layers, 1):
            made += [F.col(f"{x}_i").alias(f"gamma_layer{k}"), (F.col(f"{x}_i") + F.col(f"{x}_j")).alias(f"delta_layer{k}")]
    return e.select("i", "j", (F.exp(F.lit(float(beta))) * source * edge).alias("rate"), (F.col(f"{first}_i") * (1 - source)).alias("gi"), ((F.col(f"{first}_i") + F.col(f"{first}_j")) * (1 - edge)).alias("dij"), *made)


def stationary(cells: DataFrame, layers, gamma) -> DataFrame:
    """Relative stationary weight of each cell: 1 / rho(gamma L)."""
    return cells.select("cell", (1 / logistic(F.lit(float(gamma[0])) + linear_combination(layers, gamma[1:]))).alias("weight"))


def out_rates(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("rate").alias("out"))


def jacobi(edges: DataFrame, targets: DataFrame, steps: int, start: DataFrame | None = None) -> DataFrame:
    """``target, cell, h`` after fixed Jacobi steps ``h <- (G h + 1) / D``, zero on the target set, from zero or ``start``."""
    out = out_rates(edges)
    goals = targets.select("target").distinct()
    cells = out.select(F.col("i").alias("cell"), "out")
    frame = materialise(cells.crossJoin(F.broadcast(goals)).join(targets.select("target", "cell", F.lit(True).alias("hit")), ["target", "cell"], "left"), "frame")
    h = start if start is not None else frame.select("target", "cell", F.lit(0.0).alias("h"))
    for _ in range(steps):
        near = edges.join(h.select(F.col("cell").alias("j"), "target", "h"), "j").groupBy("target", F.col("i").alias("cell")).agg(F.sum(F.col("rate") * F.col("h")).alias("s"))
        h = materialise(frame.join(near, ["target", "cell"], "left").select("target", "cell", F.when(F.col("hit"), 0.0).otherwise((F.coalesce("s", F.lit(0.0)) + 1) / F.col("out")).alias("h")), "h")
    return h


def drop_into(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges without those into blocked cells."""
    return edges.join(blocked.select(F.col("cell").alias("j")), "j", "left_anti")


def equation_residuals(edges: DataFrame, h: DataFrame) -> DataFrame:
    """``target, cell, r`` = (G - D) h + 1."""
    near = edges.join(h.select(F.col("cell").alias("j"), "target", "h"), "j").groupBy("target", F.col("i").alias("cell")).agg(F.sum(F.col("rate") * F.col("h")).alias("s"), F.sum("rate").alias("out"))
    return near.join(h, ["target", "cell"]).select("target", "cell", (F.col("s") - F.col("out") * F.col("h") + 1).alias("r"))


def solved(edges: DataFrame, h: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, cell, reached, solved``: whether a time is given, and whether it is 0 on the targets and solves ``(G - D) h = -1`` elsewhere."""
    near = edges.join(h.select(F.col("cell").alias("j"), "target", F.col("ht").alias("hj")), "j").groupBy("target", F.col("i").alias("cell")).agg(F.sum(F.col("rate") * F.col("hj")).alias("s"), F.sum("rate").alias("out"))
    rows = h.select("target", "cell", "ht").join(targets.select("target", "cell", F.lit(True).alias("goal")).distinct(), ["target", "cell"], "left").join(near, ["target", "cell"], "left")
    flow = F.col("out") * F.col("ht")
    ok = F.when(F.col("ht").isNull(), True).when(F.col("goal"), F.col("ht") == 0).otherwise(F.coalesce(F.abs(F.col("s") - flow + 1) <= 1e-6 * (1 + flow), F.lit(False)))
    return rows.select("target", "cell", F.col("ht").isNotNull().alias("reached"), ok.alias("solved"))


def commute_objective(h: DataFrame, observed: DataFrame, t: float) -> DataFrame:
    """Sum over observed pairs of ((h_ij + h_ji) / 2 - obs + T)^2; null observations don't count. ``h``: i, j, h."""
    both = h.join(h.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("h").alias("back")), ["i", "j"])
    return commute_sum(both.join(observed, ["i", "j"]), t)


def commute_sum(both: DataFrame, t: float) -> DataFrame:
    """The objective of a table that has both times of each pair beside its observation: ``h``, ``back``, ``obs``."""
    r = (F.col("h") + F.col("back")) / 2 - F.col("obs") + t
    return both.where("obs is not null").agg(F.sum(r * r).alias("objective"), F.count("*").alias("n"))


def hit_first(h: DataFrame, j: int, k: int) -> DataFrame:
    """``cell, p``: chance to hit j before k = (h_k + h_j(k) - h_j) / (h_k(j) + h_j(k)); ``h``: target, cell, h."""
    hj = h.where(F.col("target") == j).select("cell", F.col("h").alias("hj"))
    hk = h.where(F.col("target") == k).select("cell", F.col("h").alias("hk"))
    at = hj.where(F.col("cell") == k).select(F.col("hj").alias("hj_k")).crossJoin(hk.where(F.col("cell") == j).select(F.col("hk").alias("hk_j")))
    return hj.join(hk, "cell").crossJoin(F.broadcast(at)).select("cell", ((F.col("hk") + F.col("hj_k") - F.col("hj")) / F.nullif(F.col("hk_j") + F.col("hj_k"), F.lit(0.0))).alias("p"))


def double_centre(pairs: DataFrame, value: str = "value") -> DataFrame:
    """``id1, id2, c``: a full symmetric table less row and column means plus the grand mean.

    The table is read once for its row means, which are its column means too; they are broadcast if the roster is small, so no pair moves.
    """
    row = materialise(pairs.groupBy("id1").agg(F.avg(value).alias("r1"), F.sum(value).alias("s"), F.count(value).alias("n")), "means")
    grand = row.agg((F.sum("s") / F.sum("n")).alias("g"))
    rows = row.count()
    both = pairs.join(small(row.select("id1", "r1"), rows), "id1").join(small(row.select(F.col("id1").alias("id2"), F.col("r1").alias("r2")), rows), "id2")
    return both.crossJoin(F.broadcast(grand)).select("id1", "id2", (F.col(value) - F.col("r1") - F.col("r2") + F.col("g")).alias("c"))


def covariance_from_distances(pairs: DataFrame, value: str = "value") -> DataFrame:
    """row mean + column mean - grand mean - d."""
    return double_centre(pairs, value).select("id1", "id2", (-F.col("c")).alias("s"))
