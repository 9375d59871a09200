"""Queries of iterative solvers, gradient checks, shapes, surfaces and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as N
from ..operators import kernels as K
from ..operators import knn
from ..operators import kriging as Y
from ..operators import shapes as H
from ..operators import solvers as L
from ..sources import files as E
from ..sources import fixtures
from ..sources.scratch import materialise, new_path
from .bind_fitting import COARSE, TRUE, coarse, goals, model_edges
from .bind_graph import REACHED, cells, edges, targets
from .domain import GRID, PAIRS, grid, places
from .registry import query

R = lambda c, n=6: F.round(c, n) + 0.0


#: A ring of suppliers, 20 on the diagonal and -1 to both sides, whose right side is made from the balances.
@query("num_jacobi_generic", "SELECT s_suppkey AS i, round(s_acctbal, 2) AS x FROM supplier")
def _(t):
    n = t.supplier.agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"))
    s = t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("true")).crossJoin(F.broadcast(n))
    side = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d")
    a = s.select("i", side, "n", "low").select("i", (F.pmod(F.col("i") - F.col("low") + F.col("d"), "n") + F.col("low")).alias("j"), F.when(F.col("d") == 0, 20.0).otherwise(-1.0).alias("value"))
    b = a.join(s.select(F.col("i").alias("j"), "true"), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("true")).alias("b"))
    return L.jacobi_solve(a, b).select("i", R("x", 2).alias("x"))


@query("num_gmres", COARSE + REACHED)
def _(t):
    return N.solved(model_edges(t), L.gmres_times(model_edges(t), goals(t)), goals(t))


@query("num_gradcheck", COARSE + " SELECT target, unnest(['beta', 'gamma', 'delta']) AS parameter, true AS agrees FROM (SELECT DISTINCT target FROM t)")
def _(t):
    check = L.gradient_check(coarse(t), ["a"], goals(t), beta=TRUE[0], gamma=TRUE[1:3], delta=TRUE[3:])
    return check.select("target", "parameter", (F.col("worst") < 1e-5).alias("agrees"))


@query("num_colinearity")
def _(t):
    return L.gradient_covariance(K.hitting_sensitivity(edges(t), targets(t), cells(t)))


#: The places mirrored, scaled and moved come back to where they were.
@query("num_spacemix", "WITH " + PAIRS + " SELECT id, x::DOUBLE AS px, y::DOUBLE AS py FROM s")
def _(t):
    p = places(t).select("id", "x", "y", (3 * F.col("y") + 7).alias("u"), (3 * F.col("x") - 2).alias("v"))
    return H.procrustes(p, "id").select("id", R("px").alias("px"), R("py").alias("py"))


COLUMNS = "len(list_filter(range(1, length(a) + 1), lambda i: {}))::BIGINT"
NO_GAP = "a[i] <> '-' AND b[i] <> '-' AND a[i] {} b[i]"


@query("num_align", f"""WITH c AS (SELECT c_custkey, translate(c_name, '1', '-') AS a, translate(reverse(c_name), '0', '-') AS b FROM customer), n AS (SELECT c_custkey, {COLUMNS.format(NO_GAP.format("="))} AS matches,
 {COLUMNS.format(NO_GAP.format("<>"))} AS mismatches, {COLUMNS.format("a[i] = '-'")} AS gaps_a, {COLUMNS.format("b[i] = '-'")} AS gaps_b FROM c) SELECT *, round(matches / nullif(matches + mismatches, 0)::DOUBLE, 9) AS identity FROM n""")
def _(t):
    c = t.customer.select("c_custkey", F.translate("c_name", "1", "-").alias("a"), F.translate(F.reverse("c_name"), "0", "-").alias("b"))
    return H.alignment_stats(c, "a", "b").drop("a", "b").withColumn("identity", F.round("identity", 9))


#: Local planes give back a plane.
@query("ras_loess", "WITH " + GRID + " SELECT cell, (2 * row - 3 * col + 5)::DOUBLE AS z FROM g WHERE l2 IS NULL")
def _(t):
    g = grid(t)
    known = g.where("l2 is not null").select(F.col("cell").alias("b_id"), F.col("col").alias("bx"), F.col("row").alias("by"), (2.0 * F.col("row") - 3.0 * F.col("col") + 5.0).alias("z"))
    return H.local_surface(known, g.where("l2 is null").select(F.col("cell").alias("a_id"), F.col("col").alias("ax"), F.col("row").alias("ay")), 4.5).select(F.col("a_id").alias("cell"), R("z").alias("z"))


#: Stations of the suppliers on the raster.
STATIONS = "WITH " + GRID + ", k AS (SELECT s_suppkey AS id, (s_suppkey % 10) * 5 AS x, (s_suppkey // 10) * 4 AS y, round(s_acctbal * 100)::BIGINT AS v FROM supplier)"
NEAR = STATIONS + ", n AS (SELECT g.cell, k.id, k.x, k.y, k.v, (g.col - x) ** 2 + (g.row - y) ** 2 AS d2, row_number() OVER (PARTITION BY g.cell ORDER BY (g.col - x) ** 2 + (g.row - y) ** 2, k.id) AS place FROM g CROSS JOIN k)"
WIDTH = 12.0


def stations(t):
    return places(t).select(F.col("id").alias("b_id"), (F.col("x") * 5.0).alias("bx"), (F.col("y") * 4.0).alias("by"), F.col("v").cast("double").alias("z"))


def spots(t):
    return grid(t).select(F.col("cell").alias("a_id"), F.col("col").cast("double").alias("ax"), F.col("row").cast("double").alias("ay"))


#: Two neighbours have weights in closed form.
@query("ras_krig_two", NEAR + f""" SELECT a.cell, round((w * a.v + (1 - w) * b.v) / 100, 4) AS z FROM (SELECT a.cell, a.id AS i, b.id AS j, 0.5 + (exp(-sqrt(a.d2) / {WIDTH}) - exp(-sqrt(b.d2) / {WIDTH})) / (2 * (1 - exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / {WIDTH}))) AS w
 FROM n a JOIN n b ON a.cell = b.cell AND a.place = 1 AND b.place = 2) q JOIN n a ON a.cell = q.cell AND a.id = i JOIN n b ON b.cell = q.cell AND b.id = j""")
def _(t):
    z = Y.krige(stations(t), spots(t), neighbours=2, width=WIDTH)
    return z.select(F.col("a_id").alias("cell"), R(F.col("z") / 100, 4).alias("z"))


#: Kriging gives the stations' values back, and its weights solve their equations everywhere.
@query("ras_krig", STATIONS + " SELECT g.cell, k.v::DOUBLE AS at_station, true AS solved FROM g LEFT JOIN k ON k.x = g.col AND k.y = g.row")
def _(t):
    known, at = stations(t), spots(t)
    w = materialise(Y.kriging_weights(known, at, neighbours=12, width=WIDTH), "weights")
    own = knn.dealt(w.join(known, "b_id").join(at, "a_id"), at.count(), "a_id")
    other = own.select("a_id", F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("weight").alias("other"))
    like = lambda x1, y1, x2, y2: F.exp(-F.sqrt((F.col(x1) - F.col(x2)) * (F.col(x1) - F.col(x2)) + (F.col(y1) - F.col(y2)) * (F.col(y1) - F.col(y2))) / WIDTH)
    off = own.join(other, "a_id").groupBy("a_id", "b_id").agg((F.sum(F.col("other") * like("bx", "by", "cx", "cy")) + F.first("penalty") - F.first(like("ax", "ay", "bx", "by"))).alias("off"))
    ok = off.groupBy("a_id").agg((F.max(F.abs("off")) < 1e-9).alias("ok"))
    z = own.groupBy("a_id").agg(F.sum(F.col("weight") * F.col("z")).alias("z"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("one"), F.max((F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))).alias("there"))
    return z.join(ok, "a_id").select(F.col("a_id").alias("cell"), F.when(F.col("there"), R("z", 4)).alias("at_station"), (F.col("ok") & F.col("one")).alias("solved"))


@query("ras_variogram", STATIONS + " SELECT bin, count(*) AS n, round(avg(d), 9) AS distance, round(avg((v1 - v2) ** 2) / 2e6, 4) AS gamma FROM (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, floor(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 3.0)::BIGINT AS bin, a.v AS v1, b.v AS v2 FROM k a JOIN k b ON a.id < b.id) WHERE bin < 8 GROUP BY bin")
def _(t):
    p = stations(t).select(F.col("b_id").alias("id"), F.col("bx").alias("x"), F.col("by").alias("y"), "z")
    return Y.variogram(p, 3.0, 8).select("bin", "n", R("distance", 9).alias("distance"), R(F.col("gamma") / 1e6, 4).alias("gamma"))


SHARE = 0.3
TRICUBE = "power(1 - power(d2 / reach, 1.5), 3)"
SUMS = ", ".join(f"sum(w * {e}) AS {n}" for n, e in (("n", "1"), ("sx", "x"), ("sy", "y"), ("xx", "x * x"), ("xy", "x * y"), ("yy", "y * y"), ("z", "v"), ("xz", "x * v"), ("yz", "y * v")))


@query("ras_loess_share", NEAR + f""", k2 AS (SELECT greatest(1, floor(count(*) * {SHARE} + 1e-5)) AS k FROM k), r AS (SELECT cell, max(d2) AS reach FROM n, k2 WHERE place <= k GROUP BY cell),
 w AS (SELECT n.cell, {TRICUBE} AS w, n.x - g.col AS x, n.y - g.row AS y, n.v::DOUBLE AS v FROM n JOIN r ON n.cell = r.cell JOIN g ON g.cell = n.cell, k2 WHERE place <= k AND d2 < reach), m AS (SELECT cell, {SUMS} FROM w GROUP BY cell),
 e AS (SELECT *, z * (xx * yy - xy * xy) - xz * (sx * yy - sy * xy) + yz * (sx * xy - sy * xx) AS top, n * (xx * yy - xy * xy) - sx * (sx * yy - sy * xy) + sy * (sx * xy - sy * xx) AS det FROM m)
 SELECT cell, round(CASE WHEN abs(det) > 1e-9 * n * (xx + yy) * (xx + yy) THEN top / det ELSE z / n END / 100, 4) AS z FROM e""")
def _(t):
    return H.loess(stations(t), spots(t), SHARE).select(F.col("a_id").alias("cell"), R(F.col("z") / 100, 4).alias("z"))


# files


@query("flt_file_exists", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = new_path(t.spark, "parts")
    t.nation.write.partitionBy("n_regionkey").json(path)
    there = E.existing(t.spark, [f"{path}/n_regionkey={k}" for k in range(8)])
    return t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").option("basePath", path).json(there)


@query("srt_latest_file", "SELECT replace(r_name, ' ', '_') || '.json' AS file FROM (SELECT r_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name) ORDER BY n DESC, file DESC LIMIT 1")
def _(t):
    """A file for each region, changed at a second that is its number of customers, beside one that isn't asked for."""
    path = new_path(t.spark, "runs")
    jvm, conf = t.spark.sparkContext._jvm, t.spark.sparkContext._jsc.hadoopConfiguration()
    each = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    files = [(f"{r['r_name'].replace(' ', '_')}.json", 1000 * r["n"]) for r in each.collect()]  # a row a region
    for name, changed in [*files, ("log.txt", 10**12)]:
        fixtures.write_bytes(t.spark, b"{}", f"{path}/{name}")
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        p.getFileSystem(conf).setTimes(p, changed, changed)
    return E.latest_file(t.spark, path, "*.json").select(F.element_at(F.split("path", "/"), -1).alias("file"))


WKT = "'MULTIPOLYGON (((' || s_suppkey || ' 0, 9 0, 9 9, ' || s_suppkey || ' 0), (1 1, 2 1.5, 1 1)), ((-3 4, 5e0 6, -3 4)))'"


@query("src_ogr", """WITH v AS (SELECT unnest([0, 0, 0, 0, 0, 0, 0, 1, 1, 1])::BIGINT AS part, unnest([0, 0, 0, 0, 1, 1, 1, 0, 0, 0])::BIGINT AS ring, unnest([0, 1, 2, 3, 0, 1, 2, 0, 1, 2])::BIGINT AS k, unnest([NULL, 9, 9, NULL, 1, 2, 1, -3, 5, -3])::DOUBLE AS x, unnest([0, 0, 9, 0, 1, 1.5, 1, 4, 6, 4])::DOUBLE AS y)
 SELECT s_suppkey, part, ring, k, coalesce(x, s_suppkey::DOUBLE) AS x, y FROM supplier, v""")
def _(t):
    path = new_path(t.spark, "shapes")
    t.supplier.select("s_suppkey", F.expr(WKT).alias("wkt")).write.option("sep", "\t").csv(path)
    shapes = t.spark.read.option("sep", "\t").schema("s_suppkey long, wkt string").csv(path)
    return E.wkt_vertices(shapes, "s_suppkey", "wkt")
