"""Queries of model fits, small solvers and scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import fitting as Q
from ..operators import graph as N
from ..operators import kernels as K
from ..operators import raster as A
from ..operators import relations as J
from ..sources import readers as I
from ..sources.records import write_records
from ..sources.scratch import new_path
from .domain import COUNTS, GRID, PAIRS, counts, grid, pairs, places
from .bind_graph import REACHED
from .registry import query

R = lambda c, n=6: F.round(c, n)
TRUE = (0.3, 0.2, 0.5, 0.1, 0.4)


def coarse(t):
    """The raster in blocks of 4 x 4: the resolution at which models are fitted."""
    b = A.block_mean(grid(t), "l2", 4).where("mean is not null")
    return b.select((F.col("row") * 13 + F.col("col")).alias("cell"), "row", "col", ((F.col("mean") - 25) / 15.0).alias("a"))


def goals(t):
    r = t.region.select(F.col("r_regionkey").cast("long").alias("target"))
    return coarse(t).where("col = 5").join(F.broadcast(r), F.floor(F.col("row") / 2) == F.col("target")).select("target", "cell")


def model_edges(t):
    return N.generator(coarse(t), ["a"], beta=TRUE[0], gamma=TRUE[1:3], delta=TRUE[3:])


def every_time(t):
    """The times of all cells."""
    return K.hitting_times(model_edges(t), goals(t)).where("ht > 0")


def observed(t):
    """The times at the stations, columns four apart."""
    return every_time(t).join(coarse(t).where("col % 4 = 2").select("cell"), "cell", "left_semi")


RECOVERED = "SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS k, unnest([" + ", ".join(map(str, TRUE)) + "]::DOUBLE[]) AS p"


def fitted(rounds):
    last = rounds.orderBy(F.desc("round")).limit(1)
    return last.select(F.posexplode(F.array(*[R(f"p{k}", 3) for k in range(5)])).alias("k", "p")).select(F.col("k").cast("long").alias("k"), "p")


#: The fit recovers the parameters that the observations were made with.
@query("num_fit_trust", RECOVERED)
def _(t):
    return fitted(Q.fit_trust(coarse(t), ["a"], goals(t), every_time(t), [0.0, 0.0, 0.0, 0.0, 0.0]))


@query("num_fit_alternating")
def _(t):
    return Q.fit_alternating(coarse(t), ["a"], goals(t), observed(t), [0.2, 0.1, 0.4, 0.1, 0.3], rounds=2)


@query("num_mcmc", "SELECT c AS chain, s AS step, true AS finite FROM range(3) a(c), range(15) b(s)")
def _(t):
    return Q.mcmc(coarse(t), ["a"], goals(t), observed(t), TRUE, chains=3, steps=15, scale=50.0, outcome=True)


def hood(t):
    return coarse(t).where("row between 2 and 4 and col between 2 and 4").select(F.lit(1).cast("long").alias("target"), "cell")


@query("num_hit_local")
def _(t):
    return Q.local_exit(model_edges(t), hood(t))


@query("num_obj_integral")
def _(t):
    h = K.hitting_times(model_edges(t), goals(t)).where("target = 1")
    return Q.integral_objective(model_edges(t), hood(t), h)


@query("num_interp_sym")
def _(t):
    w = N.stationary(coarse(t), ["a"], TRUE[1:3]).select("cell", F.col("weight").alias("pi"))
    return Q.symmetric_interpolation(model_edges(t), w, observed(t).where("target = 1"), goals(t).where("target = 1"), 1.0)


COARSE = "WITH RECURSIVE " + GRID + """, k AS (SELECT row // 4 * 13 + col // 4 AS cell, row // 4 AS row, col // 4 AS col FROM g WHERE l2 IS NOT NULL GROUP BY ALL),
 e AS (SELECT a.cell AS i, b.cell AS j FROM k a JOIN k b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), t AS (SELECT r_regionkey::BIGINT AS target, cell FROM region JOIN k ON k.row // 2 = r_regionkey AND k.col = 5)"""


@query("num_multigrid", COARSE + REACHED)
def _(t):
    return N.solved(model_edges(t), Q.multigrid(coarse(t), ["a"], goals(t), TRUE, ncol=13), goals(t))


@query("num_hit_lbfgs", COARSE + REACHED)
def _(t):
    return N.solved(model_edges(t), Q.nonnegative_times(model_edges(t), goals(t)), goals(t))


@query("num_linear_layer_fit")
def _(t):
    c = coarse(t).withColumn("one", F.lit(1.0))
    h = K.hitting_times(model_edges(t), goals(t)).where("ht is not null")
    return Q.layer_fit(model_edges(t), h.where("ht > 0"), ["one", "a"], c)


@query("num_footprints")
def _(t):
    return Q.footprints(coarse(t), ["a"], TRUE, goals(t).where("target = 1"), parts=5)


@query("num_top_eigen")
def _(t):
    return Q.top_singular(model_edges(t), goals(t).where("target = 1"))


@query("num_loess")
def _(t):
    return Q.loess(t.supplier, ["s_nationkey"], "s_suppkey", "s_acctbal")


#: Distances along a line are additive, so the tree's lengths add up to the line's.
@query("num_nj_tree", "SELECT count(*) AS leaves, (max(round(s_acctbal * 100)::BIGINT) - min(round(s_acctbal * 100)::BIGINT))::DOUBLE AS total FROM supplier")
def _(t):
    tree = Q.neighbour_joining(pairs(t))
    return tree.agg(F.count_if(F.col("node") >= 0).alias("leaves"), R(F.sum("length"), 2).alias("total"))


# binary sources


def _doubles(t, columns, rows, order, name):
    path = new_path(t.spark, name)
    write_records(rows, columns, [order], path)
    return path


@query("src_geno_binary", "WITH " + COUNTS + ", s AS (SELECT site, sum(A)::DOUBLE AS A, sum(C)::DOUBLE AS C, sum(d)::DOUBLE AS d FROM c GROUP BY site) SELECT row_number() OVER (ORDER BY site) - 1 AS record, round(A / d, 9) AS pr, round(C / d, 9) AS ph, round((d - A - C) / d, 9) AS pa FROM s")
def _(t):
    s = counts(t).groupBy("site").agg(F.sum("A").alias("A"), F.sum("C").alias("C"), F.sum("d").alias("d"))
    d = F.col("d").cast("double")
    p = s.select("site", (F.col("A") / d).alias("pr"), (F.col("C") / d).alias("ph"), ((d - F.col("A") - F.col("C")) / d).alias("pa"))
    path = _doubles(t, ["pr", "ph", "pa"], p, "site", "geno")
    return I.records_of_doubles(t.spark, path, ["pr", "ph", "pa"]).select(F.col("at").alias("record"), R("pr", 9).alias("pr"), R("ph", 9).alias("ph"), R("pa", 9).alias("pa"))


PC = ["intercept", "pc1", "pc2", "pc3", "pc4"]


@query("src_pc_5bin", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS record, 1.0::DOUBLE AS intercept, s_acctbal AS pc1, s_suppkey::DOUBLE AS pc2, -s_acctbal AS pc3, s_nationkey / 4.0::DOUBLE AS pc4 FROM supplier")
def _(t):
    b = F.col("s_acctbal")
    pcs = t.supplier.select("s_suppkey", F.lit(1.0).alias("intercept"), b.alias("pc1"), F.col("s_suppkey").cast("double").alias("pc2"), (-b).alias("pc3"), (F.col("s_nationkey") / 4.0).alias("pc4"))
    return I.records_of_doubles(t.spark, _doubles(t, PC, pcs, "s_suppkey", "pc"), PC).select(F.col("at").alias("record"), *PC)


@query("src_raster", "WITH " + GRID + " SELECT cell, row, col, l1::DOUBLE AS value FROM g")
def _(t):
    path = _doubles(t, ["l1"], grid(t), "cell", "layer")
    return I.raster_binary(t.spark, path, 50).select("cell", "row", "col", "value")


@query("src_sub_hts", "WITH " + PAIRS + " SELECT id1 AS row, id2 AS col, value AS distance FROM p")
def _(t):
    path = new_path(t.spark, "sub")
    pairs(t).toDF("row", "col", "distance").write.option("sep", " ").option("header", "true").option("compression", "gzip").csv(path)
    return t.spark.read.csv(path, sep=" ", header=True, schema="row long, col long, distance long")


@query("snk_sub_hts", "WITH " + PAIRS + " SELECT id1 AS row, id2 AS col, value::DOUBLE AS distance FROM p WHERE id1 <> id2")
def _(t):
    path = new_path(t.spark, "sub-out")
    pairs(t).where("id1 <> id2").toDF("row", "col", "distance").write.option("compression", "zstd").parquet(path)
    return t.spark.read.parquet(path).withColumn("distance", F.col("distance").cast("double"))


# scalar function families


@query("fn_string", "SELECT c_custkey, split_part(c_name, '#', 2) AS tail, lpad(c_custkey::VARCHAR, 8, '0') AS padded, regexp_extract(c_name, '(\\d+)', 1) AS digits, substr(c_mktsegment, 2, 3) AS mid, concat_ws('-', c_mktsegment, c_nationkey::VARCHAR) AS tag FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.regexp_extract("c_name", r"(\d+)", 1).alias("digits"), F.substring("c_mktsegment", 2, 3).alias("mid"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("tag"))


@query("fn_numeric", "SELECT p_partkey, round(exp(p_size / 50.0::DOUBLE), 9) AS e, round(ln(1 + p_size::DOUBLE), 9) AS l1p, round(sqrt(p_retailprice), 9) AS r, sign(p_size - 25)::DOUBLE AS s, p_partkey // 7 AS q, p_partkey % 7 AS m, factorial(p_size % 10)::BIGINT AS f FROM part")
def _(t):
    z = F.col("p_size")
    return t.part.select("p_partkey", R(F.exp(z / 50.0), 9).alias("e"), R(F.log1p(z.cast("double")), 9).alias("l1p"), R(F.sqrt("p_retailprice"), 9).alias("r"), F.signum(z - 25).alias("s"), F.expr("p_partkey div 7").alias("q"), (F.col("p_partkey") % 7).alias("m"), F.factorial(z % 10).alias("f"))


@query("fn_site_code", "SELECT l_orderkey, l_linenumber, (l_partkey // 100) * 10000000 + l_partkey AS code FROM lineitem")
def _(t):
    code = X.pack_site(F.floor(F.col("l_partkey") / 100), F.col("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", code.alias("code"))


@query("fn_array", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS at, len(embedding)::BIGINT AS n, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), 'sum')::BIGINT AS positive FROM embeddings")
def _(t):
    v = F.col("embedding")
    return t.embeddings.select("vec_id", F.array_position(v, F.array_max(v)).alias("at"), F.size(v).cast("long").alias("n"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"))


@query("fn_missing", "SELECT count(*) AS n, count(quality) AS there, count(*) FILTER (WHERE quality IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.agg(F.count("*").alias("n"), F.count("quality").alias("there"), F.count_if(F.col("quality").isNull()).alias("missing"))


@query("fn_json", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS js FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(t):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", k.alias("k"), F.col("event_type").alias("t")).where("k is not null").select("event_id", F.to_json(F.struct("k", "t")).alias("js"))


@query("fn_distance", "WITH " + PAIRS + " SELECT a.id AS id1, b.id AS id2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM s a JOIN s b ON a.id < b.id")
def _(t):
    return J.all_pairs(places(t), "id", columns=("x", "y")).select("id1", "id2", R(X.distance("x_1", "y_1", "x_2", "y_2")).alias("d"))


