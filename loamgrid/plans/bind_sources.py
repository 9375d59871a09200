"""Queries that write the domain's formats to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import cube
from ..sources import readers as I
from ..sources import writers as O
from ..sources.records import write_records
from ..sources.scratch import new_path
from .domain import COUNTS, GRID, N_IND, PAIRS, counts, grid, pairs
from .registry import query

W, P, G = "WITH " + COUNTS, "WITH " + PAIRS, "WITH " + GRID
BASES = ("A", "C", "G", "T")
INDS = range(N_IND)


def wide_counts(t):
    return counts(t).groupBy("site").agg(*[F.coalesce(F.sum(F.when(F.col("ind") == i, F.col(b))), F.lit(0)).alias(f"ind{i}_{b}") for i in INDS for b in BASES])


GRID_OF_COUNTS = W + ", a AS (SELECT s.site, i.ind FROM (SELECT DISTINCT site FROM c) s, (SELECT DISTINCT ind FROM c) i) SELECT a.site, 'ind' || a.ind AS ind, " + ", ".join(f"coalesce({b}, 0)::BIGINT AS {b}" for b in BASES) + " FROM a LEFT JOIN c ON c.site = a.site AND c.ind = a.ind"


@query("src_counts_text", GRID_OF_COUNTS)
def _(t):
    path = new_path(t.spark, "counts")
    wide_counts(t).write.option("sep", "\t").option("header", "true").option("compression", "gzip").csv(path)
    return I.counts_text(t.spark, path)


@query("src_scaffold_range", "SELECT l_orderkey, l_linenumber, l_partkey AS pos FROM lineitem WHERE l_partkey BETWEEN 300 AND 399")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pos"))
    return rows.where(F.col("pos").between(300, 399))


@query("src_pos_grep", "SELECT l_partkey // 100 AS chr, l_partkey AS pos, count(*) AS n FROM lineitem WHERE l_partkey // 100 = 4 AND l_partkey BETWEEN 420 AND 460 GROUP BY ALL")
def _(t):
    rows = t.lineitem.select(F.floor(F.col("l_partkey") / 100).alias("chr"), F.col("l_partkey").alias("pos"))
    return I.site_range(rows, 4, 420, 460).groupBy("chr", "pos").agg(F.count("*").alias("n"))


#: Records of all individuals' counts, in the order of the sites.
RECORDS = GRID_OF_COUNTS.replace(W, W + ", o AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS at FROM c GROUP BY site)").replace("SELECT a.site, 'ind' || a.ind AS ind", "SELECT o.at AS site, a.ind::BIGINT AS ind").replace("FROM a LEFT JOIN c", "FROM a JOIN o ON o.site = a.site LEFT JOIN c")


def binary_counts(t):
    path, names = new_path(t.spark, "bin"), [f"ind{i}_{b}" for i in INDS for b in BASES]
    write_records(wide_counts(t), names, ["site"], path, "u1")
    return I.counts_binary(t.spark, path, N_IND).drop("file")


@query("src_bin_random_access", RECORDS + " WHERE o.at IN (3, 77, 500, 1499, 1500)")
def _(t):
    """Conditions on the record's number reach the source: five records in four reads."""
    return binary_counts(t).where(F.col("site").isin(3, 77, 500, 1499, 1500))


@query("src_pos_maf_paste", W + ", s AS (SELECT site, sum(x)::BIGINT AS x, sum(d)::BIGINT AS d FROM c GROUP BY site) SELECT p_partkey AS site, p_brand AS brand, x, d FROM part JOIN s ON s.site = p_partkey")
def _(t):
    s = counts(t).groupBy("site").agg(F.sum("x").alias("x"), F.sum("d").alias("d"))
    return t.part.select(F.col("p_partkey").alias("site"), F.col("p_brand").alias("brand")).join(s, "site")


@query("src_mafs_regex", "SELECT p_partkey // 100 AS scaffold, p_partkey AS pos, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS major, CASE (p_size + 1) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS minor FROM part")
def _(t):
    base = lambda k: F.element_at(F.array(*map(F.lit, BASES)), (k % 4 + 1).cast("int"))
    line = F.concat_ws("\t", F.concat(F.lit("scaffold_"), F.floor(F.col("p_partkey") / 100).cast("string")), F.col("p_partkey").cast("string"), base(F.col("p_size")), base(F.col("p_size") + 1), F.lit("0.1"))
    path = new_path(t.spark, "mafs")
    t.part.select(line.alias("value")).union(t.spark.createDataFrame([("chromo\tposition",)], "value string")).write.option("compression", "gzip").text(path)
    return I.frequency_lines(t.spark.read.text(path))


@query("src_bam_readcount", W + " SELECT site AS pos, ind AS sample, base, n FROM (SELECT site, ind, 'A' AS base, A AS n FROM c UNION ALL SELECT site, ind, 'C', C FROM c UNION ALL SELECT site, ind, 'G', G FROM c UNION ALL SELECT site, ind, 'T', T FROM c) WHERE n > 0")
def _(t):
    cell = lambda i: F.concat_ws(" ", *[F.concat(F.lit(f"{b}:"), F.col(f"ind{i}_{b}").cast("string"), F.lit(":60")) for b in BASES])
    path = new_path(t.spark, "readcount")
    wide_counts(t).select(F.concat_ws("\t", F.col("site").cast("string"), *[cell(i) for i in INDS]).alias("value")).write.text(path)
    return I.read_counts(t.spark.read.text(path)).where("n > 0").withColumn("sample", F.col("sample").cast("long"))


@query("src_pair_csv", P + " SELECT id1, id2, value::DOUBLE AS value FROM p")
def _(t):
    path = new_path(t.spark, "pairs")
    O.write_pair_csv(pairs(t), path)
    return I.pair_csv(t.spark, path)


@query("src_packed_triangle", P + " SELECT id1 AS i, id2 AS j, value FROM p UNION ALL SELECT id2, id1, value FROM p WHERE id1 <> id2")
def _(t):
    packed = pairs(t).select((F.col("id2") * (F.col("id2") + 1) / 2 + F.col("id1")).cast("long").alias("at"), "value")
    return I.packed_triangle(packed, 0)


@query("src_full_hts", "SELECT c_nationkey::BIGINT AS cell, c_mktsegment AS target, count(*) AS ht FROM customer GROUP BY ALL")
def _(t):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("cell")).pivot("c_mktsegment", segments).agg(F.count(F.lit(1)))
    return I.wide_to_long(wide, "cell", "target", "ht").where("ht is not null")


@query("src_json_config", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("src_fasta", "SELECT 'item' || item_id AS id, regexp_replace(text, '\\s', '', 'g') AS seq FROM benchmark WHERE text NOT LIKE '%>%'")
def _(t):
    path = new_path(t.spark, "fasta")
    rows = t.benchmark.where(~F.col("text").contains(">"))
    rows.select(F.concat(F.lit(">item"), F.col("item_id").cast("string"), F.lit("\n"), "text").alias("value")).write.text(path)
    return I.fasta(t.spark, path)


@query("src_ibd_table", "SELECT l_suppkey::VARCHAR AS id1, 1 AS hap1, l_partkey::VARCHAR AS id2, 2 AS hap2, l_returnflag AS chrom, l_orderkey AS start, l_orderkey + l_linenumber AS \"end\", l_discount AS LOD FROM lineitem")
def _(t):
    path = new_path(t.spark, "ibd")
    li = t.lineitem
    li.select("l_suppkey", F.lit(1), "l_partkey", F.lit(2), "l_returnflag", "l_orderkey", F.col("l_orderkey") + F.col("l_linenumber"), "l_discount").toDF(*"abcdefgh").write.option("sep", "\t").csv(path)
    return I.ibd_segments(t.spark, path)


@query("src_run_dirs", "SELECT n_regionkey::BIGINT AS run, n_nationkey::BIGINT AS iter, (n_nationkey * 1.5)::DOUBLE AS score FROM nation")
def _(t):
    path = new_path(t.spark, "runs")
    rows = t.nation.select((F.col("n_nationkey") * 1.5).cast("string").alias("value"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("i"))
    # directories run_<r>/iter_<i> are written by partition; the reader finds both numbers in the path
    rows.select("value", F.concat(F.lit("run_"), F.col("r")).alias("a"), F.concat(F.lit("iter_"), F.col("i")).alias("b")).write.partitionBy("a", "b").text(path)
    lines = t.spark.read.option("recursiveFileLookup", "true").text(path).withColumn("file", F.input_file_name())
    return lines.select(F.regexp_extract("file", r"run_(\d+)", 1).cast("long").alias("run"), F.regexp_extract("file", r"iter_(\d+)", 1).cast("long").alias("iter"), F.col("value").cast("double").alias("score"))


@query("src_counts_bin", RECORDS)
def _(t):
    return binary_counts(t)



@query("snk_counts_bin", W + " SELECT site, ind, least(d, 255)::BIGINT AS d FROM c")
def _(t):
    path = new_path(t.spark, "sat")
    O.saturate(counts(t).select("site", "ind", "d"), ["d"]).write.parquet(path)
    return t.spark.read.parquet(path).withColumn("d", F.col("d").cast("long"))


@query("snk_pair_csv", P + " SELECT id1, id2, value::DOUBLE AS value FROM p")
def _(t):
    path = new_path(t.spark, "upper")
    O.write_pair_csv(pairs(t).union(pairs(t).where("id1 <> id2").select("id2", "id1", "value")), path)
    return I.pair_csv(t.spark, path)


@query("snk_full_hts", "SELECT c_nationkey::BIGINT AS cell, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS MACHINERY FROM customer GROUP BY 1")
def _(t):
    long = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("cell"), F.col("c_mktsegment").alias("target")).agg(F.count("*").alias("value"))
    return O.hitting_wide(long, ["BUILDING", "MACHINERY"]).fillna(0)


@query("snk_json_config", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def _(t):
    path = new_path(t.spark, "json")
    O.write_lines(O.config_json(t.nation.select("n_nationkey", "n_name")), path)
    return t.spark.read.text(path)


@query("snk_bed", "SELECT 'scaffold_' || p_partkey // 100 || chr(9) || (p_partkey - 1) || chr(9) || p_partkey AS value FROM part WHERE p_size > 40")
def _(t):
    path = new_path(t.spark, "bed")
    O.write_lines(O.bed_lines(t.part.where("p_size > 40").select(F.floor(F.col("p_partkey") / 100).alias("chr"), F.col("p_partkey").alias("pos"))), path)
    return t.spark.read.text(path)


@query("snk_append_partition", "SELECT o_orderstatus AS freqbin, count(*) AS n, count(DISTINCT o_custkey) AS m FROM orders GROUP BY 1")
def _(t):
    path = new_path(t.spark, "parts")
    for half in (0, 1):
        O.write_parquet_by(t.orders.where(F.col("o_orderkey") % 2 == half).select("o_custkey", F.col("o_orderstatus").alias("freqbin")), path, "freqbin")
    return t.spark.read.parquet(path).groupBy("freqbin").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("m"))


@query("snk_fasta", W + ", m AS (SELECT site, ind, CASE WHEN 2 * x > d THEN 'A' WHEN 2 * x < d THEN 'C' ELSE 'N' END AS b FROM c) SELECT 'ind' || ind AS id, string_agg(b, '' ORDER BY site) AS seq FROM m GROUP BY ind")
def _(t):
    call = F.when(2 * F.col("x") > F.col("d"), "A").when(2 * F.col("x") < F.col("d"), "C")
    rows = counts(t).select("site", F.concat(F.lit("ind"), F.col("ind").cast("string")).alias("ind"), call.alias("base"))
    return O.fasta_records(rows)


@query("snk_raster", G + " SELECT cell, l1 FROM g")
def _(t):
    path = new_path(t.spark, "raster")
    grid(t).select("cell", "l1").write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query("snk_netcdf", W + ", l AS (SELECT site AS pos, ind, unnest([0, 1, 2, 3]) AS base, unnest([A, C, G, T]) AS n FROM c) SELECT pos, ind, base::BIGINT AS base, n::BIGINT AS n FROM l WHERE pos BETWEEN 250 AND 449 AND ind BETWEEN 1 AND 4")
def _(t):
    """A cube of counts in chunks of 100 sites by 2 individuals; a slab of it reads 3 x 3 chunks."""
    path = new_path(t.spark, "cube")
    each = F.posexplode(F.array(*BASES)).alias("base", "n")
    cube.write_cube(counts(t).select(F.col("site").alias("pos"), "ind", each), path, {"pos": 100, "ind": 2, "base": 4}, "n", attributes={"units": "reads"})
    return cube.read_slab(t.spark, path, pos=(250, 449), ind=(1, 4))
