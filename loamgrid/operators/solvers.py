"""Linear systems by iteration to a residual, and checks and summaries of a model's gradient."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .fitting import _settled, gmres
from .graph import generator
from .kernels import RESIDUAL, _generator, hitting_sensitivity, hitting_times

PARAMETERS = ("beta", "gamma", "delta")


def jacobi_solve(matrix: DataFrame, rhs: DataFrame, *, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """``i, x`` with A x = b by Jacobi steps x <- (b - R x) / D, until no x moves by more than ``tolerance`` of the largest.

    ``matrix``: i, j, value (absent: 0); ``rhs``: i, b. A round is a join and a sum by row, written to the shared folder.
    Raises if the steps don't settle, or if a row has no diagonal.
    """
    diagonal = matrix.where("i = j").groupBy("i").agg(F.sum("value").alias("d"))
    rest = materialise(matrix.where("i <> j").select("i", "j", "value"), "rest")
    frame = materialise(rhs.join(diagonal, "i", "left"), "frame")
    if frame.where("d is null or d = 0").take(1):
        raise ArithmeticError("a row has no diagonal")
    x = frame.select("i", (F.col("b") / F.col("d")).alias("x"))
    for _ in range(rounds):
        pull = rest.join(x.select(F.col("i").alias("j"), F.col("x").alias("xj")), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("xj")).alias("s"))
        step = frame.join(pull, "i", "left").join(x.withColumnRenamed("x", "old"), "i")
        x = materialise(step.select("i", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("x"), "old"), "x")
        moved = x.agg(F.max(F.abs(F.col("x") - F.col("old"))).alias("by"), F.max(F.abs("x")).alias("size")).first()
        x = x.select("i", "x")
        if moved["by"] is None or moved["by"] <= tolerance * moved["size"]:
            return x
    raise ArithmeticError(f"no solution in {rounds} rounds: last moved by {moved['by']:.3g}")


def gmres_times(edges: DataFrame, targets: DataFrame, *, restart: int = 2, rounds: int = 60) -> DataFrame:
    """``target, cell, ht`` like ``hitting_times``, by restarted GMRES on rows scaled by a cell's total rate; raises above the residual.

    Preconditioned by the factors of the block tridiagonal system, so its steps don't grow with the grid.
    """
    shared = edges.sparkSession.sparkContext.broadcast(_generator(edges))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        g = shared.value
        goal = np.isin(g.cells, rows["cell"].to_numpy())
        free = g.reaching(goal, ~goal)
        h = np.zeros(len(g.cells))
        if free.any():
            out, factors = g.out[free], g.factor(free)

            def full(v: np.ndarray) -> np.ndarray:
                x = np.zeros(len(g.cells))
                x[free] = v
                return x

            settled = _settled(out, RESIDUAL / 10)
            product = lambda v: g.times(full(v))[free] / out
            h[free] = gmres(product, -1 / out, restart=restart, rounds=rounds, tolerance=0, before=lambda r: factors(full(r * out))[free], done=lambda x, r: settled(x, r * out))
            off = (np.abs(g.times(h) + 1) / (1 + g.out * np.abs(h)))[free].max()
            if not off <= RESIDUAL:
                raise ArithmeticError(f"residual {off:.3g} beside a cell's flow")
        return pd.DataFrame({"target": rows["target"].iloc[0], "cell": g.cells, "ht": np.where(free | goal, h, np.nan)})

    out = targets.groupBy("target").applyInPandas(solve, "target long, cell long, ht double")
    return out.withColumn("ht", F.when(~F.isnan("ht"), F.col("ht")))


def gradient_check(cells: DataFrame, layers: list[str], targets: DataFrame, *, beta: float, gamma, delta, step: float = 1e-4) -> DataFrame:
    """``target, parameter, worst``: largest difference of the gradient of hitting times from a central difference, relative to the largest change.

    The parameters are the rate's scale and the weights of the first layer at the source and at the edge.
    """

    def times(k: int, by: float) -> DataFrame:
        b, g, d = beta + by * (k == 0), list(gamma), list(delta)
        g[1] += by * (k == 1)
        d[1] += by * (k == 2)
        return hitting_times(generator(cells, layers, beta=b, gamma=g, delta=d), targets)

    slope = hitting_sensitivity(generator(cells, layers, beta=beta, gamma=gamma, delta=delta), targets)
    out = None
    for k, name in enumerate(PARAMETERS):
        up, down = times(k, step).withColumnRenamed("ht", "up"), times(k, -step).withColumnRenamed("ht", "down")
        near = up.join(down, ["target", "cell"]).join(slope.select("target", "cell", f"d_{name}"), ["target", "cell"])
        change = (F.col("up") - F.col("down")) / (2 * step)
        one = near.groupBy("target").agg((F.max(F.abs(change - F.col(f"d_{name}"))) / F.max(F.abs(change))).alias("worst"))
        one = one.select("target", F.lit(name).alias("parameter"), "worst")
        out = one if out is None else out.union(one)
    return out


def gradient_covariance(gradient: DataFrame) -> DataFrame:
    """``target, p, q, cov, cor``: covariance over cells of the derivatives in each two parameters; cells without a time don't count."""
    there = gradient.where(" and ".join(f"not isnan(d_{p}) and d_{p} is not null" for p in PARAMETERS))
    two = [(p, q) for a, p in enumerate(PARAMETERS) for q in PARAMETERS[a:]]
    row = lambda p, q: F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.covar_samp(f"d_{p}", f"d_{q}").alias("cov"), F.corr(f"d_{p}", f"d_{q}").alias("cor"))
    return there.groupBy("target").agg(F.array(*[row(p, q) for p, q in two]).alias("all")).select("target", F.inline("all"))
