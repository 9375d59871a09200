"""Site-by-individual allele counts: coverage, divergence, covariance, clinality.

The canonical table is long: ``site, ind`` and counts. Operators on pairs of
individuals gather a site's individuals in an array (bounded by the number of
individuals) and expand the pairs there: one shuffle by site, then a partial
aggregate by pair, instead of the two shuffles of a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import col, coverage, homozygosity, major_base, ratio

BASES = ("A", "C", "G", "T")


def site_pairs(counts: DataFrame, columns, *, site: str = "site", ind: str = "ind", diagonal: bool = True) -> DataFrame:
    """``site, i, j`` with i >= j and each column as ``<c>_i, <c>_j``."""
    held = counts.groupBy(site).agg(F.sort_array(F.collect_list(F.struct(F.col(ind).alias("ind"), *[F.col(c) for c in columns]))).alias("all"))
    one = held.select(site, F.explode("all").alias("a"), "all")
    keep = (lambda b: b.ind <= F.col("a.ind")) if diagonal else (lambda b: b.ind < F.col("a.ind"))
    two = one.select(site, "a", F.explode(F.filter("all", keep)).alias("b"))
    return two.select(site, F.col("a.ind").alias("i"), F.col("b.ind").alias("j"), *[F.col(f"a.{c}").alias(f"{c}_i") for c in columns], *[F.col(f"b.{c}").alias(f"{c}_j") for c in columns])


def site_stats(counts: DataFrame, bases=BASES, *, site: str = "site") -> DataFrame:
    """Per site: individuals with reads, greatest, least and sd of coverage, base totals, mean heterozygosity (-1 if none)."""
    d = coverage(*bases)
    het = 1 - F.avg(homozygosity(*bases))
    return counts.groupBy(site).agg(
        F.count_if(d > 0).alias("n_ind"), F.max(d).alias("max_cov"), F.min(d).alias("min_cov"), F.stddev_samp(d).alias("sd_cov"),
        *[F.sum(b).alias(f"total_{b}") for b in bases], F.coalesce(het, F.lit(-1.0)).alias("het"),
    )


def coverage_histogram(counts: DataFrame, depth, top: int, *, ind: str = "ind", low: int = 0) -> DataFrame:
    """``ind, bin, n`` for every bin low..top; the last holds all depths of ``top`` and more."""
    counted = counts.groupBy(ind, F.least(col(depth), F.lit(top)).alias("bin")).agg(F.count("*").alias("n"))
    grid = counts.select(ind).distinct().withColumn("bin", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(top).cast("long"))))
    return grid.join(counted, [ind, "bin"], "left").fillna(0, ["n"])


def depth_histogram(counts: DataFrame, depth, low: int, high: int, *, ind: str = "ind") -> DataFrame:
    """``ind, depth, n`` of the depths low..high that occur; others are left out."""
    return counts.select(ind, col(depth).alias("depth")).where(F.col("depth").between(low, high)).groupBy(ind, "depth").agg(F.count("*").alias("n"))


def scaffold_coverage(counts: DataFrame, depth, individuals, *, chrom: str = "chr", pos: str = "pos", ind: str = "ind", low: int | None = None, high: int | None = None) -> DataFrame:
    """Per scaffold: first and last position, sites, and each individual's summed depth; sites outside (low, high) don't count."""
    rows = counts.select(chrom, pos, ind, col(depth).alias("d"))
    if low is not None or high is not None:
        total = F.sum("d").over(Window.partitionBy(chrom, pos))
        rows = rows.withColumn("total", total)
        rows = rows.where((F.col("total") > (low if low is not None else -1)) & (F.col("total") < (high if high is not None else 2**62)))
    sums = [F.coalesce(F.sum(F.when(F.col(ind) == i, F.col("d"))), F.lit(0)).alias(f"ind{i}") for i in individuals]
    return rows.groupBy(chrom).agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count_distinct(pos).alias("num_sites"), *sums)


def missing_rate(counts: DataFrame, depth, n_sites: Column | int, *, ind: str = "ind") -> DataFrame:
    """Share of sites without a read of each individual; sites that are absent count as missing."""
    return counts.groupBy(ind).agg((1 - ratio(F.count_if(col(depth) > 0), F.lit(n_sites))).alias("missing"))


def weighted_mean(counts: DataFrame, x, other, *, ind: str = "ind", as_coded: bool = True) -> DataFrame:
    """sum x (x + y) / sum y as the original computes it, or over sum (x + y)."""
    den = F.sum(col(other)) if as_coded else F.sum(col(x) + col(other))
    return counts.groupBy(ind).agg(ratio(F.sum(col(x) * (col(x) + col(other))), den).alias("wmean"))


def pairwise_divergence(counts: DataFrame, *, x: str = "x", d: str = "d", site: str = "site", ind: str = "ind", where: Column | None = None, by_depth: bool = False) -> DataFrame:
    """``i, j, weight, pi``: integer sums, one division; the diagonal draws reads without replacement."""
    rows = counts.where(where) if where is not None else counts
    p = site_pairs(rows.select(site, ind, F.col(x).alias("x"), F.col(d).alias("d")), ["x", "d"], site=site, ind=ind)
    same = F.col("i") == F.col("j")
    num = F.when(same, 2 * F.col("x_i") * (F.col("d_i") - F.col("x_i"))).otherwise(F.col("x_i") * (F.col("d_j") - F.col("x_j")) + (F.col("d_i") - F.col("x_i")) * F.col("x_j"))
    w = F.when(same, F.col("d_i") * (F.col("d_i") - 1)).otherwise(F.col("d_i") * F.col("d_j"))
    keys = ["i", "j", *(["d_i", "d_j"] if by_depth else [])]
    out = p.groupBy(*keys).agg(F.sum(w).alias("weight"), F.sum(num).alias("num"), F.count("*").alias("n_sites"))
    return out.select(*keys, "weight", "n_sites", ratio("num", "weight").alias("pi"))


def genotype_pairs(posteriors: DataFrame, cols=("pr", "ph", "pa"), *, site: str = "site", ind: str = "ind") -> DataFrame:
    """Mean expected divergence of pairs from genotype probabilities; the diagonal is the mean chance of a heterozygote."""
    from ..functions.expressions import genotype_divergence

    p = site_pairs(posteriors, list(cols), site=site, ind=ind)
    pi = F.when(F.col("i") == F.col("j"), F.col(f"{cols[1]}_i")).otherwise(genotype_divergence([f"{c}_i" for c in cols], [f"{c}_j" for c in cols]))
    return p.groupBy("i", "j").agg(F.avg(pi).alias("pi"), F.count("*").alias("n_sites"))


def divergence_estimators(counts: DataFrame, *, x: str = "x", d: str = "d") -> DataFrame:
    """Pair divergence by three weightings: by read pairs, with replacement, and a plain mean over sites."""
    p = site_pairs(counts.select("site", "ind", F.col(x).alias("x"), F.col(d).alias("d")).where("d > 1"), ["x", "d"])
    same = F.col("i") == F.col("j")
    mixed = F.col("x_i") * (F.col("d_j") - F.col("x_j")) + (F.col("d_i") - F.col("x_i")) * F.col("x_j")
    num = F.when(same, 2 * F.col("x_i") * (F.col("d_i") - F.col("x_i"))).otherwise(mixed)
    w = F.when(same, F.col("d_i") * (F.col("d_i") - 1)).otherwise(F.col("d_i") * F.col("d_j"))
    return p.groupBy("i", "j").agg(ratio(F.sum(num), F.sum(w)).alias("without"), ratio(F.sum(mixed), F.sum(F.col("d_i") * F.col("d_j"))).alias("with_replacement"), F.avg(ratio(num, w)).alias("unweighted"))


def weighted_covariance(counts: DataFrame, *, x: str = "x", d: str = "d", max_depth: int = 12, root: bool = False) -> DataFrame:
    """``i, j, cov``: read-pair weights, or ``root`` weights sqrt(d_i d_j) on frequencies."""
    rows = counts.select("site", "ind", F.col(x).alias("x"), F.col(d).alias("d")).where((F.col("d") > 0) & (F.col("d") <= max_depth))
    p = site_pairs(rows, ["x", "d"])
    xi, xj, di, dj = (F.col(c) for c in ("x_i", "x_j", "d_i", "d_j"))
    if root:
        w = F.sqrt((di * dj).cast("double"))
        c, z1, z2 = w * xi * xj / (di * dj), w * xi / di, w * xj / dj
    else:
        same = F.col("i") == F.col("j")
        p = p.where(~same | (di >= 2))
        w = F.when(same, di * (di - 1)).otherwise(di * dj).cast("double")
        c = F.when(same, xi * xi * (di - 1) / di).otherwise((xi * xj).cast("double"))
        z1 = F.when(same, xi * (di - 1)).otherwise(xj * di).cast("double")
        z2 = F.when(same, xi * (di - 1)).otherwise(xi * dj).cast("double")
    s = p.groupBy("i", "j").agg(F.sum(w).alias("w"), F.sum(c).alias("c"), F.sum(z1).alias("z1"), F.sum(z2).alias("z2"))
    return s.select("i", "j", (ratio("c", "w") - ratio("z1", "w") * ratio("z2", "w")).alias("cov"))


def centred_covariance(counts: DataFrame, *, x: str = "x", d: str = "d") -> DataFrame:
    """Root-weighted covariance of frequencies centred by the site's overall frequency."""
    rows = counts.select("site", "ind", F.col(x).alias("x"), F.col(d).alias("d")).where("d > 0")
    of = Window.partitionBy("site")
    rows = rows.withColumn("f", ratio("x", "d") - ratio(F.sum("x").over(of), F.sum("d").over(of)))
    p = site_pairs(rows, ["f", "d"])
    w = F.sqrt((F.col("d_i") * F.col("d_j")).cast("double"))
    return p.groupBy("i", "j").agg(ratio(F.sum(w * F.col("f_i") * F.col("f_j")), F.sum(w)).alias("cov"))


def subsampled_covariance(counts: DataFrame, *, x: str = "x", d: str = "d", seed: int = 1) -> DataFrame:
    """Covariance of one allele drawn per individual and site, by a hash so that a retry draws alike."""
    from ..functions.expressions import hash_uniform

    drawn = counts.where(F.col(d) > 0).select("site", "ind", (hash_uniform("site", "ind", seed=seed) < ratio(x, d)).cast("long").alias("z"))
    p = site_pairs(drawn, ["z"])
    s = p.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum(F.col("z_i") * F.col("z_j")).alias("c"), F.sum("z_i").alias("a"), F.sum("z_j").alias("b"))
    return s.select("i", "j", "n", (ratio("c", "n") - ratio("a", "n") * ratio("b", "n")).alias("cov"))


def pc_projection(counts: DataFrame, vector: DataFrame, *, x: str = "x", d: str = "d", ind: str = "ind", value: str = "v") -> DataFrame:
    """Per site the five sums A..E: frequencies, with the vector, the vector and its squares over present individuals, and their number."""
    rows = counts.join(vector, ind).withColumn("p", F.when(F.col(d) > 0, ratio(x, d)).otherwise(0.0))
    there = F.col(d) > 0
    return rows.groupBy("site").agg(F.sum("p").alias("sum_freq"), F.sum(F.col("p") * F.col(value)).alias("freq_prod"), F.sum(F.when(there, F.col(value))).alias("sum_weights"), F.sum(F.when(there, F.col(value) * F.col(value))).alias("sum_weights_sq"), F.count_if(there).alias("num_nonzero"))


def clinality(sums: DataFrame) -> DataFrame:
    """Covariance and correlation of site frequency with the vector, from ``pc_projection``."""
    n = F.col("num_nonzero")
    m, f = ratio("sum_weights", n), ratio("sum_freq", n)
    var = ratio(F.col("sum_weights_sq") - m * F.col("sum_weights"), n - 1)
    cov = ratio("freq_prod", n) - m * f
    out = sums.select("site", f.alias("freq"), cov.alias("cov"), var.alias("var"))
    return out.select("site", "freq", "cov", ratio("cov", F.sqrt(F.greatest(F.col("freq") * (1 - F.col("freq")) * F.col("var"), F.lit(0.0)))).alias("cor"))


def major_divergence(counts: DataFrame, bases=BASES) -> DataFrame:
    """Share of sites where two individuals' major bases differ, over sites where both have reads."""
    called = counts.select("site", "ind", major_base(*bases).alias("m")).where("m is not null")
    return site_pairs(called, ["m"]).groupBy("i", "j").agg(F.count("*").alias("n"), ratio(F.count_if(F.col("m_i") != F.col("m_j")), F.count("*")).alias("divergence"))


def confusion(counts: DataFrame, bases=BASES) -> DataFrame:
    """Major base against observed bases, rows normalised."""
    total = counts.groupBy("site").agg(*[F.sum(b).alias(b) for b in bases]).withColumn("major", major_base(*bases)).where("major is not null")
    sums = total.groupBy("major").agg(*[F.sum(b).alias(b) for b in bases])
    return sums.select("major", *[ratio(b, coverage(*bases)).alias(b) for b in bases])


def error_rates(counts: DataFrame, bases=BASES, *, ind: str = "ind") -> DataFrame:
    """Minor reads over reads of each individual, with standard error and its two-sided double."""
    d = coverage(*bases)
    s = counts.groupBy(ind).agg(F.sum(d - F.greatest(*map(col, bases))).alias("minor"), F.sum(d).alias("coverage"))
    e = ratio("minor", "coverage")
    se = F.sqrt(e * (1 - e) / F.nullif(F.col("coverage").cast("double"), F.lit(0.0)))
    return s.select(ind, "minor", "coverage", e.alias("error"), se.alias("se"), (e - 2 * se).alias("low"), (e + 2 * se).alias("high"))


def frequency_by_group(counts: DataFrame, groups: DataFrame, *, x: str = "x", d: str = "d", group: str = "grp", names=(0, 1)) -> DataFrame:
    """Mean frequency per site in each group of individuals."""
    rows = counts.join(groups, "ind").withColumn("p", ratio(x, d))
    return rows.groupBy("site").agg(*[F.avg(F.when(F.col(group) == g, F.col("p"))).alias(f"freq_{g}") for g in names])
