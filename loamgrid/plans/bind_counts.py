"""Queries over allele counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import counts as K
from .domain import COUNTS, N_IND, counts
from .registry import query

R = lambda c, n=6: F.round(c, n)
BASES = ("A", "C", "G", "T")
W = "WITH " + COUNTS
MAJOR = "CASE WHEN d > 0 THEN CASE greatest(A, C, G, T) WHEN A THEN 'A' WHEN C THEN 'C' WHEN G THEN 'G' ELSE 'T' END END"
PAIR = W + ", p AS (SELECT a.site, a.ind AS i, b.ind AS j, a.x AS xi, b.x AS xj, a.d AS di, b.d AS dj FROM c a JOIN c b ON a.site = b.site AND b.ind <= a.ind)"


@query("prj_coverage", W + " SELECT site, ind, (A + C + G + T)::BIGINT AS d FROM c")
def _(t):
    return counts(t).select("site", "ind", X.coverage(*BASES).alias("d"))


@query("prj_major_global", W + f", s AS (SELECT site, sum(A)::BIGINT AS A, sum(C)::BIGINT AS C, sum(G)::BIGINT AS G, sum(T)::BIGINT AS T, sum(d)::BIGINT AS d FROM c GROUP BY site) SELECT site, {MAJOR} AS major FROM s")
def _(t):
    s = counts(t).groupBy("site").agg(*[F.sum(b).alias(b) for b in BASES])
    return s.select("site", X.major_base(*BASES).alias("major"))


@query("prj_major_individual", W + f" SELECT site, ind, {MAJOR} AS major FROM c")
def _(t):
    return counts(t).select("site", "ind", X.major_base(*BASES).alias("major"))


@query("prj_major_minor_pairs", W + " SELECT site, ind, greatest(A, C, G, T) AS major, d - greatest(A, C, G, T) AS minor FROM c")
def _(t):
    return counts(t).select("site", "ind", X.major_count(*BASES).alias("major"), (X.coverage(*BASES) - X.major_count(*BASES)).alias("minor"))


@query("prj_major_freq", W + " SELECT site, ind, round(x / d, 9) AS f0, round(CASE WHEN T > 0 THEN G / T END, 9) AS f_na FROM c")
def _(t):
    return counts(t).select("site", "ind", R(X.major_frequency("x", "d", 0.0), 9).alias("f0"), R(X.major_frequency("G", "T"), 9).alias("f_na"))


@query("prj_homozygosity", W + " SELECT site, ind, round(CASE WHEN d >= 2 THEN (A*(A-1) + C*(C-1) + G*(G-1) + T*(T-1)) / (d*(d-1)) END, 9) AS hom FROM c")
def _(t):
    return counts(t).select("site", "ind", R(X.homozygosity(*BASES), 9).alias("hom"))


@query("prj_pi_read_pair", W + """ SELECT a.site, a.ind AS i, b.ind AS j, round(CASE WHEN a.ind = b.ind THEN CASE WHEN a.d > 1 THEN 1 - (a.A*(a.A-1) + a.C*(a.C-1) + a.G*(a.G-1) + a.T*(a.T-1)) / (a.d*(a.d-1)) END
  ELSE 1 - (a.A*b.A + a.C*b.C + a.G*b.G + a.T*b.T) / (a.d*b.d) END, 9) AS pi FROM c a JOIN c b ON a.site = b.site AND b.ind <= a.ind""")
def _(t):
    p = K.site_pairs(counts(t), BASES)
    xs, ys = [f"{b}_i" for b in BASES], [f"{b}_j" for b in BASES]
    pi = F.when(F.col("i") == F.col("j"), X.read_pair_divergence(xs, ys, same=True)).otherwise(X.read_pair_divergence(xs, ys))
    return p.select("site", "i", "j", R(pi, 9).alias("pi"))


POST = W + ", q AS (SELECT site, ind, A / d AS pr, C / d AS ph, (G + T) / d AS pa FROM c)"
GENO_PI = "a.pr*b.pa + (a.pr*b.ph + a.ph*b.pr + a.ph*b.ph + a.ph*b.pa + a.pa*b.ph) / 2 + a.pa*b.pr"


def posteriors(t):
    return counts(t).select("site", "ind", X.ratio("A", "d").alias("pr"), X.ratio("C", "d").alias("ph"), X.ratio(F.col("G") + F.col("T"), "d").alias("pa"))


@query("prj_geno_pi", POST + f" SELECT a.site, a.ind AS i, b.ind AS j, round({GENO_PI}, 6) AS pi FROM q a JOIN q b ON a.site = b.site AND b.ind < a.ind")
def _(t):
    p = K.site_pairs(posteriors(t), ["pr", "ph", "pa"], diagonal=False)
    return p.select("site", "i", "j", R(X.genotype_divergence(("pr_i", "ph_i", "pa_i"), ("pr_j", "ph_j", "pa_j"))).alias("pi"))


@query("agg_geno_pwp", POST + f" SELECT a.ind AS i, b.ind AS j, count(*) AS n_sites, round(avg(CASE WHEN a.ind = b.ind THEN a.ph ELSE {GENO_PI} END), 6) AS pi FROM q a JOIN q b ON a.site = b.site AND b.ind <= a.ind GROUP BY ALL")
def _(t):
    return K.genotype_pairs(posteriors(t)).select("i", "j", "n_sites", R("pi").alias("pi"))


GROUP_FREQ = W + ", f AS (SELECT site, sum(d)::BIGINT AS total, sum(x) FILTER (WHERE ind < 3) / sum(d) FILTER (WHERE ind < 3) AS n, sum(x) FILTER (WHERE ind >= 3) / sum(d) FILTER (WHERE ind >= 3) AS s FROM c GROUP BY site)"


def group_frequencies(t):
    g = F.col("ind") < 3
    part = lambda c, w: F.sum(F.when(w, F.col(c)))
    return counts(t).groupBy("site").agg(F.sum("d").alias("total"), X.ratio(part("x", g), part("d", g)).alias("n"), X.ratio(part("x", ~g), part("d", ~g)).alias("s"))


@query("prj_snp_type", GROUP_FREQ + " SELECT site, CASE WHEN total < 25 THEN 'small' WHEN n > 0 AND n < 1 AND s > 0 AND s < 1 THEN 'ns' ELSE 'other' END AS snp, sign(n - s)::DOUBLE AS polarity FROM f")
def _(t):
    return group_frequencies(t).select("site", X.snp_type("total", "n", "s", 25).alias("snp"), F.signum(F.col("n") - F.col("s")).alias("polarity"))


@query("prj_genotype_color", W + " SELECT site, ind, CASE WHEN x = d THEN 'major' WHEN x = 0 THEN 'minor' ELSE 'both' END AS cls, CASE WHEN d < 3 THEN 'pale' ELSE 'full' END AS tone FROM c")
def _(t):
    cls = F.when(F.col("x") == F.col("d"), "major").when(F.col("x") == 0, "minor").otherwise("both")
    return counts(t).select("site", "ind", cls.alias("cls"), F.when(F.col("d") < 3, "pale").otherwise("full").alias("tone"))


@query("prj_het_correct", W + " SELECT site, ind, round(2 * (x / d - 2 * 0.01 * 0.99) / (0.99 * 0.99 + 0.01 * 0.01), 6) AS h FROM c")
def _(t):
    return counts(t).select("site", "ind", R(X.corrected_heterozygosity(X.ratio("x", "d"), F.lit(0.01))).alias("h"))


PWP = "round(CASE WHEN i = j THEN sum(2*xi*(di-xi)) / nullif(sum(di*(di-1)), 0) ELSE sum(xi*(dj-xj) + (di-xi)*xj) / nullif(sum(di*dj), 0) END, 9)"
PWP_W = "(CASE WHEN i = j THEN sum(di*(di-1)) ELSE sum(di*dj) END)::BIGINT"


@query("agg_pwp", PAIR + f" SELECT i, j, {PWP_W} AS weight, {PWP} AS pi FROM p GROUP BY i, j")
def _(t):
    return K.pairwise_divergence(counts(t)).select("i", "j", "weight", R("pi", 9).alias("pi"))


for _name, _rule in (("exact2", "d = 2"), ("exact3", "d = 3"), ("max9", "d < 10")):

    @query(f"agg_pwp_{_name}", PAIR.replace("FROM c a JOIN c b", f"FROM (SELECT * FROM c WHERE {_rule}) a JOIN (SELECT * FROM c WHERE {_rule}) b") + f" SELECT i, j, {PWP_W} AS weight, {PWP} AS pi FROM p GROUP BY i, j")
    def _(t, rule=_rule):
        return K.pairwise_divergence(counts(t), where=F.expr(rule)).select("i", "j", "weight", R("pi", 9).alias("pi"))


@query("agg_pwp_by_cov", PAIR + f" SELECT i, j, di AS d_i, dj AS d_j, count(*) AS n_sites, coalesce({PWP}, -1) AS pi FROM p WHERE di <= 12 AND dj <= 12 GROUP BY i, j, di, dj")
def _(t):
    out = K.pairwise_divergence(counts(t), where=F.col("d") <= 12, by_depth=True)
    return out.select("i", "j", "d_i", "d_j", "n_sites", F.coalesce(R("pi", 9), F.lit(-1.0)).alias("pi"))


@query("agg_pwp_estimators", PAIR + """ SELECT i, j, round(CASE WHEN i = j THEN sum(2*xi*(di-xi)) / sum(di*(di-1)) ELSE sum(xi*(dj-xj) + (di-xi)*xj) / sum(di*dj) END, 9) AS without,
  round(sum(xi*(dj-xj) + (di-xi)*xj) / sum(di*dj), 9) AS with_replacement,
  round(avg(CASE WHEN i = j THEN 2*xi*(di-xi) / (di*(di-1)) ELSE (xi*(dj-xj) + (di-xi)*xj) / (di*dj) END), 6) AS unweighted FROM p WHERE di > 1 AND dj > 1 GROUP BY i, j""")
def _(t):
    return K.divergence_estimators(counts(t)).select("i", "j", R("without", 9).alias("without"), R("with_replacement", 9).alias("with_replacement"), R("unweighted").alias("unweighted"))


COV = """ SELECT i, j, round(c / w - (z1 / w) * (z2 / w), 6) AS cov FROM (SELECT i, j, {} FROM p WHERE di <= 12 AND dj <= 12 {} GROUP BY i, j)"""
DIAG = "CASE WHEN i = j THEN {} ELSE {} END"


@query("agg_wcov", PAIR + COV.format(", ".join(f"sum({DIAG.format(*x)}) AS {n}" for n, x in {"w": ("di*(di-1)", "di*dj"), "c": ("xi*xi*(di-1)/di", "xi*xj"), "z1": ("xi*(di-1)", "xj*di"), "z2": ("xi*(di-1)", "xi*dj")}.items()), "AND (i <> j OR di >= 2)"))
def _(t):
    return K.weighted_covariance(counts(t)).select("i", "j", R("cov").alias("cov"))


@query("agg_wcov_sqrt", PAIR + COV.format("sum(sqrt(di*dj)) AS w, sum(sqrt(di*dj)*xi*xj/(di*dj)) AS c, sum(sqrt(di*dj)*xi/di) AS z1, sum(sqrt(di*dj)*xj/dj) AS z2", ""))
def _(t):
    return K.weighted_covariance(counts(t), root=True).select("i", "j", R("cov").alias("cov"))


@query("agg_wcov_norm", W + """, f AS (SELECT site, ind, d, x / d - sum(x) OVER (PARTITION BY site) / sum(d) OVER (PARTITION BY site) AS f FROM c)
 SELECT a.ind AS i, b.ind AS j, round(sum(sqrt(a.d*b.d)*a.f*b.f) / sum(sqrt(a.d*b.d)), 6) AS cov FROM f a JOIN f b ON a.site = b.site AND b.ind <= a.ind GROUP BY ALL""")
def _(t):
    return K.centred_covariance(counts(t)).select("i", "j", R("cov").alias("cov"))


@query("agg_subsampled_cov", W + """, z AS (SELECT site, ind, (('0x' || substr(md5(site || '-' || ind || '-1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < x / d)::BIGINT AS z FROM c WHERE d > 0)
  SELECT a.ind AS i, b.ind AS j, count(*) AS n, round(sum(a.z * b.z) / count(*)::DOUBLE - sum(a.z) / count(*)::DOUBLE * (sum(b.z) / count(*)::DOUBLE), 9) AS cov FROM z a JOIN z b ON a.site = b.site AND a.ind >= b.ind GROUP BY ALL""")
def _(t):
    return K.subsampled_covariance(counts(t)).select("i", "j", "n", F.round("cov", 9).alias("cov"))


@query("agg_site_stats", W + """ SELECT site, count(*) FILTER (WHERE d > 0) AS n_ind, max(d) AS max_cov, min(d) AS min_cov, round(stddev_samp(d), 6) AS sd_cov, sum(A)::BIGINT AS total_A, sum(C)::BIGINT AS total_C, sum(G)::BIGINT AS total_G, sum(T)::BIGINT AS total_T,
  round(coalesce(1 - avg(CASE WHEN d >= 2 THEN (A*(A-1) + C*(C-1) + G*(G-1) + T*(T-1)) / (d*(d-1)) END), -1), 6) AS het FROM c GROUP BY site""")
def _(t):
    s = K.site_stats(counts(t))
    return s.select("site", "n_ind", "max_cov", "min_cov", R("sd_cov").alias("sd_cov"), *[f"total_{b}" for b in BASES], R("het").alias("het"))


HIST = W + ", h AS (SELECT ind, least(d, {0}) AS bin, count(*) AS n FROM c GROUP BY ALL) SELECT i.ind, b.bin, coalesce(h.n, 0)::BIGINT AS n FROM (SELECT DISTINCT ind FROM c) i CROSS JOIN (SELECT unnest(range({1}, {0} + 1)) AS bin) b LEFT JOIN h ON h.ind = i.ind AND h.bin = b.bin"


@query("agg_cov_hist", HIST.format(30, 0))
def _(t):
    return K.coverage_histogram(counts(t), "d", 30)


@query("agg_depth_hist_sparse", HIST.format(12, 0))
def _(t):
    return K.coverage_histogram(counts(t), "d", 12)


@query("agg_bam_depth_hist", HIST.format(100, 1))
def _(t):
    return K.coverage_histogram(counts(t), "d", 100, low=1)


@query("agg_depth_hist_long", W + " SELECT ind, d AS depth, count(*) AS n FROM c WHERE d BETWEEN 1 AND 900 GROUP BY ALL")
def _(t):
    return K.depth_histogram(counts(t), "d", 1, 900)


def scaffolds(t):
    return counts(t).withColumn("chr", F.floor(F.col("site") / 100)).withColumnRenamed("site", "pos")


IND_SUMS = ", ".join(f"coalesce(sum(d) FILTER (WHERE ind = {i}), 0)::BIGINT AS ind{i}" for i in range(N_IND))


@query("agg_scaffold_coverage", W + f' SELECT site // 100 AS chr, min(site) AS start, max(site) AS "end", count(DISTINCT site) AS num_sites, {IND_SUMS} FROM c GROUP BY 1')
def _(t):
    return K.scaffold_coverage(scaffolds(t), "d", range(N_IND))


@query("flt_depth_open", W + f', k AS (SELECT *, sum(d) OVER (PARTITION BY site) AS total FROM c) SELECT site // 100 AS chr, min(site) AS start, max(site) AS "end", count(DISTINCT site) AS num_sites, {IND_SUMS} FROM k WHERE total > 20 AND total < 35 GROUP BY 1')
def _(t):
    return K.scaffold_coverage(scaffolds(t), "d", range(N_IND), low=20, high=35)


@query("agg_missing_rate", W + " SELECT ind, round(1 - count(*) FILTER (WHERE d > 0) / (SELECT count(DISTINCT site) FROM c), 9) AS missing FROM c GROUP BY ind")
def _(t):
    c = counts(t)
    n = c.agg(F.count_distinct("site").alias("n")).first()["n"]
    return K.missing_rate(c, "d", n).select("ind", R("missing", 9).alias("missing"))


@query("agg_colmeans", W + " SELECT " + ", ".join(f"round(avg({b}), 9) AS mean_{b}" for b in BASES) + " FROM c")
def _(t):
    return counts(t).agg(*[R(F.avg(b), 9).alias(f"mean_{b}") for b in BASES])


@query("agg_weighted_mean", W + " SELECT ind, round(sum(x*d) / nullif(sum(d-x), 0), 9) AS wmean, round(sum(x*d) / sum(d), 9) AS wmean_total FROM c GROUP BY ind")
def _(t):
    c = counts(t).withColumn("other", F.col("d") - F.col("x"))
    both = K.weighted_mean(c, "x", "other").join(K.weighted_mean(c, "x", "other", as_coded=False).withColumnRenamed("wmean", "wmean_total"), "ind")
    return both.select("ind", R("wmean", 9).alias("wmean"), R("wmean_total", 9).alias("wmean_total"))


VECTOR = ", v AS (SELECT DISTINCT ind, (ind - 2)::DOUBLE AS v FROM c)"
SUMS = W + VECTOR + ", k AS (SELECT site, sum(x / d) AS a, sum(x / d * v) AS b, sum(v) AS cc, sum(v * v) AS dd, count(*) AS n FROM c JOIN v USING (ind) WHERE d > 0 GROUP BY site)"


def vector(t):
    """A small known vector over individuals in place of a principal component."""
    return counts(t).select("ind").distinct().withColumn("v", (F.col("ind") - 2).cast("double"))


@query("agg_pc_projection", SUMS + " SELECT site, round(a, 6) AS sum_freq, round(b, 6) AS freq_prod, cc AS sum_weights, dd AS sum_weights_sq, n AS num_nonzero FROM k")
def _(t):
    s = K.pc_projection(counts(t), vector(t))
    return s.select("site", R("sum_freq").alias("sum_freq"), R("freq_prod").alias("freq_prod"), "sum_weights", "sum_weights_sq", "num_nonzero")


@query("agg_clinality_cor", SUMS + """, m AS (SELECT site, a / n AS f, b / n - (cc / n) * (a / n) AS cov, (dd - cc / n * cc) / nullif(n - 1, 0) AS var FROM k)
 SELECT site, round(f, 6) AS freq, round(cov, 6) AS cov, round(cov / nullif(sqrt(greatest(f * (1 - f) * var, 0)), 0), 4) AS cor FROM m""")
def _(t):
    return K.clinality(K.pc_projection(counts(t), vector(t))).select("site", R("freq").alias("freq"), R("cov").alias("cov"), R("cor", 4).alias("cor"))


@query("agg_mt_divergence", W + f", m AS (SELECT site, ind, {MAJOR} AS m FROM c) SELECT a.ind AS i, b.ind AS j, count(*) AS n, round(count(*) FILTER (WHERE a.m <> b.m) / count(*), 9) AS divergence FROM m a JOIN m b ON a.site = b.site AND b.ind <= a.ind WHERE a.m IS NOT NULL AND b.m IS NOT NULL GROUP BY ALL")
def _(t):
    return K.major_divergence(counts(t)).select("i", "j", "n", R("divergence", 9).alias("divergence"))


@query("agg_confusion", W + f", s AS (SELECT site, sum(A) AS A, sum(C) AS C, sum(G) AS G, sum(T) AS T, sum(d) AS d FROM c GROUP BY site), m AS (SELECT *, {MAJOR} AS major FROM s) SELECT major, " + ", ".join(f"round(sum({b}) / sum(d), 9) AS {b}" for b in BASES) + " FROM m GROUP BY major")
def _(t):
    return K.confusion(counts(t)).select("major", *[R(b, 9).alias(b) for b in BASES])


@query("agg_error_rate", W + """, e AS (SELECT ind, sum(d - greatest(A, C, G, T))::BIGINT AS minor, sum(d)::BIGINT AS coverage FROM c GROUP BY ind), f AS (SELECT *, minor / coverage AS e FROM e)
 SELECT ind, minor, coverage, round(e, 9) AS error, round(sqrt(e * (1 - e) / coverage), 9) AS se, round(e - 2 * sqrt(e * (1 - e) / coverage), 9) AS low, round(e + 2 * sqrt(e * (1 - e) / coverage), 9) AS high FROM f""")
def _(t):
    return K.error_rates(counts(t)).select("ind", "minor", "coverage", *[R(c, 9).alias(c) for c in ("error", "se", "low", "high")])


@query("agg_hap_score", W + ", f AS (SELECT site FROM c GROUP BY site HAVING sum(x) > 0.2 * sum(d)) SELECT ind, count(*) AS n, round(count(*) FILTER (WHERE 2 * x > d) / count(*), 9) AS score FROM c JOIN f USING (site) GROUP BY ind")
def _(t):
    c = counts(t)
    common = c.groupBy("site").agg(F.sum("x").alias("sx"), F.sum("d").alias("sd")).where("sx > 0.2 * sd").select("site")
    return c.join(common, "site").groupBy("ind").agg(F.count("*").alias("n"), R(X.ratio(F.count_if(2 * F.col("x") > F.col("d")), F.count("*")), 9).alias("score"))


@query("agg_freq_by_group", W + " SELECT site, round(avg(x / d) FILTER (WHERE ind < 3), 6) AS freq_0, round(avg(x / d) FILTER (WHERE ind >= 3), 6) AS freq_1 FROM c GROUP BY site")
def _(t):
    groups = counts(t).select("ind").distinct().withColumn("grp", (F.col("ind") >= 3).cast("int"))
    return K.frequency_by_group(counts(t), groups).select("site", R("freq_0").alias("freq_0"), R("freq_1").alias("freq_1"))


@query("flt_depth_closed", W + ", k AS (SELECT site, sum(d)::BIGINT AS total FROM c GROUP BY site) SELECT site, total FROM k WHERE total BETWEEN 20 AND 35")
def _(t):
    return counts(t).groupBy("site").agg(F.sum("d").alias("total")).where(F.col("total").between(20, 35))


@query("flt_cov_cap", W + " SELECT ind, count(*) FILTER (WHERE d BETWEEN 1 AND 12) AS upto12, count(*) FILTER (WHERE d = 2) AS two, count(*) FILTER (WHERE d = 3) AS three, count(*) FILTER (WHERE d < 10) AS below10 FROM c GROUP BY ind")
def _(t):
    d = F.col("d")
    return counts(t).groupBy("ind").agg(F.count_if(d.between(1, 12)).alias("upto12"), F.count_if(d == 2).alias("two"), F.count_if(d == 3).alias("three"), F.count_if(d < 10).alias("below10"))


@query("flt_min_group_size", W + ", k AS (SELECT *, site // 100 AS chr FROM c) SELECT site, ind, d FROM k WHERE chr IN (SELECT chr FROM k GROUP BY chr HAVING count(*) >= 597)")
def _(t):
    k = counts(t).withColumn("chr", F.floor(F.col("site") / 100))
    return k.join(k.groupBy("chr").agg(F.count("*").alias("n")).where("n >= 597"), "chr", "left_semi").select("site", "ind", "d")


@query("flt_high_minor_sites", W + ", k AS (SELECT site, sum(d - greatest(A, C, G, T))::BIGINT AS minor, sum(d)::BIGINT AS d FROM c GROUP BY site) SELECT site, minor, d FROM k WHERE minor < 0.5 * d")
def _(t):
    k = counts(t).groupBy("site").agg(F.sum(X.coverage(*BASES) - X.major_count(*BASES)).alias("minor"), F.sum("d").alias("d"))
    return k.where("minor < 0.5 * d")


@query("agg_mean_cov_from_hist", W + " SELECT ind, round(sum(CASE WHEN d < 8 THEN d ELSE 0 END) / count(*), 9) AS mean_cov FROM c GROUP BY ind")
def _(t):
    h = K.coverage_histogram(counts(t), "d", 8)
    return h.groupBy("ind").agg(R(X.ratio(F.sum(F.when(F.col("bin") < 8, F.col("bin") * F.col("n"))), F.sum("n")), 9).alias("mean_cov"))


@query("agg_poisson_lambda", W + """, h AS (SELECT d AS k, count(*) AS n FROM c GROUP BY d), y AS (SELECT k, ln(n) + ln(factorial(k::INT)::DOUBLE) AS y FROM h WHERE k BETWEEN 2 AND 18)
 SELECT m AS top, round(exp(regr_slope(y, k)), 5) AS lambda FROM y JOIN (SELECT unnest(range(3, 9)) AS m) ON k <= m GROUP BY m""")
def _(t):
    h = counts(t).groupBy(F.col("d").alias("k")).agg(F.count("*").alias("n")).where("k between 2 and 18")
    y = h.select("k", (F.ln("n") + F.ln(F.factorial(F.col("k").cast("int")))).alias("y"))
    tops = t.spark.range(3, 9).toDF("top")
    return y.join(F.broadcast(tops), F.col("k") <= F.col("top")).groupBy("top").agg(R(F.exp(F.regr_slope("y", "k")), 5).alias("lambda"))


@query("agg_scaffold_summary", W + """, s AS (SELECT site, sum(x)::BIGINT AS x, sum(d)::BIGINT AS d FROM c GROUP BY site)
 SELECT site // 100 AS chr, count(*) FILTER (WHERE x > 0 AND x < d) AS segregating, round(avg(2 * (x / d) * (1 - x / d)), 6) AS mean_het, round(sum(2 * (x / d) * (1 - x / d)) / (max(site) - min(site) + 1), 6) AS het_density FROM s GROUP BY 1""")
def _(t):
    s = counts(t).groupBy("site").agg(F.sum("x").alias("x"), F.sum("d").alias("d"))
    p = X.ratio("x", "d")
    het = 2 * p * (1 - p)
    return s.groupBy(F.floor(F.col("site") / 100).alias("chr")).agg(F.count_if((F.col("x") > 0) & (F.col("x") < F.col("d"))).alias("segregating"), R(F.avg(het)).alias("mean_het"), R(F.sum(het) / (F.max("site") - F.min("site") + 1)).alias("het_density"))


@query("agg_threshold_counts", W + ", s AS (SELECT site, sum(x) / sum(d) AS p FROM c GROUP BY site) SELECT site // 100 AS chr, " + ", ".join(f"count(*) FILTER (WHERE p > {q}) AS over{k}" for k, q in enumerate((0.3, 0.4, 0.5, 0.6))) + " FROM s GROUP BY 1")
def _(t):
    s = counts(t).groupBy("site").agg(X.ratio(F.sum("x"), F.sum("d")).alias("p"))
    return s.groupBy(F.floor(F.col("site") / 100).alias("chr")).agg(*[F.count_if(F.col("p") > q).alias(f"over{k}") for k, q in enumerate((0.3, 0.4, 0.5, 0.6))])


@query("agg_both_outliers", W + ", s AS (SELECT site, sum(x) / sum(d) AS p, sum(d) AS d FROM c GROUP BY site) SELECT site // 100 AS chr, count(*) FILTER (WHERE p > 0.6) AS by_p, count(*) FILTER (WHERE d > 40) AS by_d FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE p > 0.6) > 0 AND count(*) FILTER (WHERE d > 40) > 0")
def _(t):
    s = counts(t).groupBy("site").agg(X.ratio(F.sum("x"), F.sum("d")).alias("p"), F.sum("d").alias("d"))
    return s.groupBy(F.floor(F.col("site") / 100).alias("chr")).agg(F.count_if(F.col("p") > 0.6).alias("by_p"), F.count_if(F.col("d") > 40).alias("by_d")).where("by_p > 0 and by_d > 0")


@query("agg_grid_loglik", W + """, s AS (SELECT d, x, count(*) AS n FROM c GROUP BY ALL), e AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS p)
 SELECT p, round(sum(n * (x * ln(p) + (d - x) * ln(1 - p))), 4) AS loglik FROM s, e GROUP BY p""")
def _(t):
    s = counts(t).groupBy("d", "x").agg(F.count("*").alias("n"))
    p = F.explode(F.array(*[F.lit(q) for q in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)])).alias("p")
    return s.select("*", p).groupBy("p").agg(R(F.sum(F.col("n") * (F.col("x") * F.ln("p") + (F.col("d") - F.col("x")) * F.ln(1 - F.col("p")))), 4).alias("loglik"))
