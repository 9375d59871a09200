"""Robust and ordered statistics, regressions, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import col, ratio


def weighted_median(df: DataFrame, value: str, weight: str, by: list[str], *, conventional: bool = False) -> DataFrame:
    """Weighted median of each group.

    Rows of weight 0 or null are dropped. With k the first place where the
    running weight exceeds half, the result is ``(1-a) x_k + a x_{k+1}`` with
    ``a = (W/2 - cw_k) / w_{k+1}``, null where k is the last place: as the
    original computes it (a <= 0, so it lies at x_k or below). ``conventional``
    gives x_k.
    """
    rows = df.where(col(weight).isNotNull() & (col(weight) != 0) & col(value).isNotNull()).select(*by, col(value).alias("x"), col(weight).alias("w"))
    order = Window.partitionBy(*by).orderBy("x", "w")
    run = rows.select(*by, "x", "w", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cw"), F.lead("x").over(order).alias("x2"), F.lead("w").over(order).alias("w2"), F.sum("w").over(Window.partitionBy(*by)).alias("total"))
    past = run.where(F.col("cw") > F.col("total") / 2)
    first = past.groupBy(*by).agg(F.min(F.struct("cw", "x", "x2", "w2", "total")).alias("__first")).select(*by, "__first.*")
    if conventional:
        return first.select(*by, F.col("x").alias("wmedian"))
    a = (F.col("total") / 2 - F.col("cw")) / F.col("w2")
    return first.select(*by, ((1 - a) * F.col("x") + a * F.col("x2")).alias("wmedian"))


def fit_scores(df: DataFrame, residual: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted median of absolute residuals and root of the weighted mean square."""
    mad = weighted_median(df.withColumn("__a", F.abs(col(residual))), "__a", weight, by).withColumnRenamed("wmedian", "mad")
    mse = df.groupBy(*by).agg(F.sqrt(ratio(F.sum(col(weight) * col(residual) * col(residual)), F.sum(weight))).alias("mse"))
    return mad.join(mse, by)


def ols(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Slope, intercept, r2 of y on x, and the slope without intercept, from one pass of sums."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), ratio(F.sum(col(x) * col(y)), F.sum(col(x) * col(x))).alias("slope0"), F.count("*").alias("n"))


def ols_f(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Coefficients, r2 and F statistic of y on x."""
    o = ols(df, y, x, by)
    return o.select(*by, "slope", "intercept", "r2", "n", ratio(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")).alias("f"))


def add_f_pvalue(df: DataFrame, f: str = "f", n: str = "n", out: str = "p") -> DataFrame:
    """P-value of an F(1, n-2) statistic: the incomplete beta function by its continued fraction, in Arrow batches."""
    from .kernels import f_pvalue

    return f_pvalue(df, f, n, out)


def adjust_trend(df: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """y less the linear trend in x over all rows, plus the mean of y."""
    t = df.agg(F.regr_slope(y, x).alias("__b"), F.avg(x).alias("__m"))
    return df.crossJoin(F.broadcast(t)).withColumn(out, col(y) - F.col("__b") * (col(x) - F.col("__m"))).drop("__b", "__m")


def autocorrelation(df: DataFrame, series: str, at: str, value: str, lags: int) -> DataFrame:
    """Autocorrelation of each series up to a lag, by its mean and lag-0 sum; ``at``: consecutive integers."""
    of = Window.partitionBy(series)
    centred = df.select(series, at, (col(value) - F.avg(value).over(of)).alias("z"))
    order = Window.partitionBy(series).orderBy(at)
    rows = centred
    for k in range(lags + 1):
        rows = rows.withColumn(f"p{k}", F.col("z") * (F.lead("z", k).over(order) if k else F.col("z")))
    sums = rows.groupBy(series).agg(*[F.sum(f"p{k}").alias(f"s{k}") for k in range(lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), ratio(f"s{k}", "s0").alias("acf")) for k in range(lags + 1)]))
    return sums.select(series, pairs.alias("x")).select(series, "x.lag", "x.acf")


def forward_mean(df: DataFrame, series: str, at: str, value: str, n: int) -> DataFrame:
    """Mean of each row and the n - 1 after it; null where fewer follow."""
    w = Window.partitionBy(series).orderBy(at).rowsBetween(0, n - 1)
    return df.withColumn("mean", F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def runs(df: DataFrame, series: str, at: str, key: str) -> DataFrame:
    """Maximal runs of equal keys in a series: first and last place, length."""
    order = Window.partitionBy(series).orderBy(at)
    new = F.when(F.lag(key).over(order).eqNullSafe(col(key)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(series, "run", key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def all_correlations(long: DataFrame, item: str, layer: str, value: str) -> DataFrame:
    """Pearson correlation of every pair of layers over the items that have both."""
    a = long.select(F.col(item), F.col(layer).alias("layer1"), F.col(value).alias("v1"))
    b = long.select(F.col(item), F.col(layer).alias("layer2"), F.col(value).alias("v2"))
    both = a.join(b, item).where(F.col("layer1") < F.col("layer2")).where("v1 is not null and v2 is not null")
    return both.groupBy("layer1", "layer2").agg(F.corr("v1", "v2").alias("r"), F.count("*").alias("n"))


def kmer_entropy(df: DataFrame, id_col: str, text: str, *, window: int = 500, k: int = 6) -> DataFrame:
    """Per window of a text: entropy of its k-mers, and of the counts of their counts."""
    n = F.char_length(text)
    pieces = df.where(n >= k).select(id_col, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / window).cast("int")), lambda i: F.substring(F.col(text), i * window + 1, F.lit(window)))).alias("win", "piece"))
    m = F.char_length("piece")
    mers = pieces.where(m >= k).select(id_col, "win", F.explode(F.transform(F.sequence(F.lit(1), m - k + 1), lambda i: F.substring(F.col("piece"), i, F.lit(k)))).alias("mer"))
    c = mers.groupBy(id_col, "win", "mer").agg(F.count("*").alias("c"))
    cc = c.groupBy(id_col, "win", "c").agg(F.count("*").alias("cc"))
    total = cc.groupBy(id_col, "win").agg(F.sum(F.col("c") * F.col("cc")).alias("n_mers"), F.sum("cc").alias("n_kinds"), F.sum(F.col("cc") * F.col("c") * F.ln("c")).alias("a"), F.sum(F.col("cc") * F.ln("cc")).alias("b"))
    entropy = lambda s, n: F.ln(n) - ratio(s, n)
    return total.select(id_col, "win", "n_mers", entropy("a", "n_mers").alias("h_kmers"), entropy("b", "n_kinds").alias("h_counts"))


def local_weights(pairs: DataFrame, radius: float, *, distance: str = "d") -> DataFrame:
    """Per id of a symmetric table: 1 / neighbours within the radius, and 1 / sum exp(-d / radius)."""
    return pairs.groupBy("id1").agg(ratio(F.lit(1), F.count_if(col(distance) < radius)).alias("w_count"), ratio(F.lit(1), F.sum(F.exp(-col(distance) / radius))).alias("w_exp"))
