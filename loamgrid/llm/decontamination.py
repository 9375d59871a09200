"""Benchmark decontamination by a distributed positional inverted index.

The index holds postings (term, document, position) of the training texts for
every term that a benchmark item uses. A query is answered in three steps:

1. Term frequencies come from the index. In each window of an item the rarest
   terms are its anchors; their postings, moved by their place in the item, give
   alignments (document, item, shift) where enough anchors agree.
2. At these alignments the postings of all the item's terms are intersected.
3. Runs of consecutive agreeing positions as long as a window are exact phrase
   matches; they cover document words.

Proximity matches start at the places where an item's ``RAREST`` different terms
lie close together; only there its other terms are looked up.

Items are told apart by their words, not by their ids, and documents by their
rows; ids come back at the end.

Everything is DataFrame operations. The benchmark side is broadcast only after
its words were counted (``BROADCAST_TERMS``); beyond that the joins shuffle. The
filter by candidate documents is broadcast only up to ``BROADCAST_DOCS`` rows.

Cases: a null or empty text has no words; a very long text is read whole, its
words go through one row at a time; each row is a document of its own, be its
doc_id null or shared; an item without words matches nothing; words of an item
with a null id are hit, but no id is listed; items that share an id are one item
that occurs where any of its texts does; items that share a text all occur;
anchors of equal frequency are taken in the order of their places, which changes
no result; further columns are ignored, whatever their names; empty tables give
empty or hit-free results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 10
#: Anchors of a window that must agree before the whole alignment is looked at.
ANCHORS = 2
#: Different terms of an item that must lie close before its others are looked up, and words beside an item's length.
RAREST, SLOP = 3, 5
BROADCAST_TERMS = 500_000
BROADCAST_DOCS = 1_000_000

#: ASCII characters that are not part of a word: all but digits and letters.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
SEPARATOR_RUN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Stands in the index for a document's end; its position is the document's length. No word is empty.
END = ""


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the plain ``lower`` where it gives the same."""
    other = text.rlike("[\\p{javaUpperCase}\\p{javaTitleCase}&&[^A-Z]]")
    same = (F.octet_length(text) == F.char_length(text)) | ~other
    return F.when(same, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def bench_words(text: Column) -> Column:
    bare = F.btrim(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR_RUN))


def item_names(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, words, ids``: the different texts of the benchmark, numbered, with the ids that have them; written once."""
    named = items.select(F.col(item_col).cast("string").alias("id"), bench_words(F.col(text_col)).alias("words")).where("size(words) > 0")
    texts = named.groupBy("words").agg(F.collect_set("id").alias("ids"))
    return materialise(texts.select(F.monotonically_increasing_id().alias("item"), "words", "ids"), "items")


def item_words(names: DataFrame) -> DataFrame:
    """``item, len, q, term``: the words of each text of the benchmark with their places."""
    return names.select("item", F.size("words").alias("len"), F.posexplode("words").alias("q", "term"))


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def build_index(docs: DataFrame, terms: DataFrame, *, small: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``doc, pos, term`` of the listed terms, and an ``END`` posting per document, with the ``doc_id`` of row ``doc``."""
    words = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("doc_id"), F.concat(bench_words(F.col(text_col)), F.array(F.lit(END))).alias("words"))
    listed = terms.select("term").union(terms.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    postings = words.select("doc", "doc_id", F.posexplode("words").alias("pos", "term"))
    return materialise(postings.join(_hint(listed, small), "term", "left_semi"), "postings")


def anchors(items: DataFrame, frequency: DataFrame, window: int = WINDOW, per_window: int = ANCHORS) -> DataFrame:
    """``item, q, term, need``: for each window of an item its rarest terms' places."""
    placed = items.join(frequency, "term", "left").fillna(0, ["n"])
    size = F.least(F.col("len"), F.lit(window))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - size + 1), F.least(F.col("q"), F.col("len") - size)))
    each = placed.select("item", "q", "term", "n", "len", starts.alias("start"))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "q"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= per_window)
    return best.select("item", "q", "term", F.least(F.lit(per_window), F.col("len")).alias("need")).distinct()


def alignments(index: DataFrame, marks: DataFrame, *, small: bool) -> DataFrame:
    """``doc, item, shift`` where at least ``need`` anchors of the item agree."""
    found = index.join(_hint(marks, small), "term").select("doc", "item", (F.col("pos") - F.col("q")).alias("shift"), "need")
    return found.groupBy("doc", "item", "shift").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("doc", "item", "shift")


def _of(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings ``doc, pos, term`` of the documents of these rows."""
    some = rows.select("doc").distinct()
    few = some.count() <= BROADCAST_DOCS
    return index.where(F.col("term") != END).select("doc", "pos", "term").join(_hint(some, few), "doc", "left_semi")


def term_counts(index: DataFrame) -> DataFrame:
    """``term, n`` of the index."""
    return materialise(index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n")), "terms")


def phrase_matches(index: DataFrame, items: DataFrame, frequency: DataFrame, *, window: int = WINDOW, per_window: int = ANCHORS) -> DataFrame:
    """``doc, item, start, length``: maximal runs of document words equal to at least a window of an item."""
    small = items.count() <= BROADCAST_TERMS
    marks = anchors(items, frequency, window, per_window)
    found = materialise(alignments(index, marks, small=small), "alignments")
    wanted = found.join(_hint(items, small), "item").select("doc", "item", "shift", "q", "len", (F.col("q") + F.col("shift")).alias("pos"), "term")
    agreeing = wanted.join(_of(index, found), ["doc", "pos", "term"]).select("doc", "item", "shift", "len", "q")
    island = F.col("q") - F.row_number().over(Window.partitionBy("doc", "item", "shift").orderBy("q"))
    runs = agreeing.withColumn("island", island).groupBy("doc", "item", "shift", "island").agg(F.min("q").alias("q"), F.count("*").alias("length"), F.max("len").alias("len"))
    return runs.where(F.col("length") >= F.least(F.col("len"), F.lit(window))).select("doc", "item", (F.col("q") + F.col("shift")).alias("start"), "length")


def proximity_matches(index: DataFrame, items: DataFrame, frequency: DataFrame, *, slop: int = SLOP) -> DataFrame:
    """``doc, item, start``: places from which all different terms of an item lie within ``len + slop`` words.

    The search starts where the rarest terms lie close together; ``start`` is the
    first place of a span that holds the rarest one and begins with a term of the item.
    """
    small = items.count() <= BROADCAST_TERMS
    terms = items.groupBy("item", "len", "term").agg(F.min("q").alias("q")).join(frequency, "term", "left").fillna(0, ["n"])
    of = Window.partitionBy("item")
    ranked = materialise(terms.select("item", "term", (F.col("len") + slop).alias("width"), F.count("*").over(of).alias("n_terms"), F.row_number().over(of.orderBy("n", "q")).alias("rank")), "ranked")
    bucket = F.floor(F.col("pos") / F.col("width")).alias("bucket")
    around = F.explode(F.sequence(F.floor(F.col("at") / F.col("width")) - 1, F.floor(F.col("at") / F.col("width")) + 1)).alias("bucket")
    hits = index.select("doc", "pos", "term").join(_hint(ranked.where(F.col("rank") <= RAREST), small), "term")
    hits = materialise(hits.select("doc", "item", "pos", "width", "rank", "n_terms", bucket), "hits")
    rare = hits.where("rank = 1").select("doc", "item", F.col("pos").alias("at"), "width", "n_terms").select("*", around)
    close = rare.join(hits.select("doc", "item", "pos", "rank", "bucket"), ["doc", "item", "bucket"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("width"))
    places = close.groupBy("doc", "item", "at", "width", "n_terms").agg(F.count_distinct("rank").alias("n")).where(F.col("n") >= F.least(F.lit(RAREST), "n_terms"))
    places = materialise(places.drop("n"), "places")
    wanted = places.join(_hint(ranked.select("item", "term"), small), "item").select("*", around)
    near = _of(index, places).join(_hint(ranked.select("term", "width").distinct(), small), "term").select("doc", "pos", "term", "width", bucket)
    near = wanted.join(near, ["doc", "term", "width", "bucket"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("width"))
    near = near.groupBy("doc", "item", "at", "width", "n_terms").agg(F.collect_list(F.struct("pos", "term")).alias("near"))
    within = lambda s: F.size(F.array_distinct(F.transform(F.filter("near", lambda x: (x.pos >= s.pos) & (x.pos < s.pos + F.col("width"))), lambda x: x.term)))
    starts = F.filter("near", lambda s: (s.pos <= F.col("at")) & (s.pos + F.col("width") > F.col("at")) & (within(s) == F.col("n_terms")))
    return near.select("doc", "item", F.explode(F.transform(starts, lambda s: s.pos)).alias("start")).distinct()


def _ids(found: DataFrame, names: DataFrame, out: str) -> DataFrame:
    """``doc`` and the sorted ids of the items found there."""
    listed = found.select("doc", "item").distinct().join(names.select("item", "ids"), "item").select("doc", F.explode("ids").alias("id"))
    return listed.groupBy("doc").agg(F.array_sort(F.collect_set("id")).alias(out))


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, slop: int | None = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, items, near_items`` of each document.

    ``items``: sorted ids of the items with an exact window in it; ``near_items``: of those whose terms lie within
    ``slop`` words more than the item has (``slop`` None: not searched, empty).
    """
    names = item_names(items, item_col=item_col, text_col=item_text_col)
    words = item_words(names)
    small = words.count() <= BROADCAST_TERMS
    index = build_index(docs, words, small=small, id_col=id_col, text_col=text_col)
    frequency = term_counts(index)
    runs = materialise(phrase_matches(index, words, frequency, window=window), "runs")
    places = runs.select("doc", F.explode(F.expr("sequence(start, start + cast(length as int) - 1)")).alias("at"))
    out = index.where(F.col("term") == END).select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = out.join(places.groupBy("doc").agg(F.count_distinct("at").alias("n_hit")), "doc", "left").join(_ids(runs, names, "items"), "doc", "left")
    none = F.array().cast("array<string>")
    if slop is None:
        out = out.withColumn("near_items", none)
    else:
        out = out.join(_ids(proximity_matches(index, words, frequency, slop=slop), names, "near_items"), "doc", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def oracle() -> str:
    """DuckDB SQL of the query over documents and benchmark."""
    def words(x):
        return f"list_filter(string_split_regex(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents),
b AS (SELECT item_id, {words("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + k - 1], ' ') AS g, k FROM
       (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, s)),
h AS (SELECT p.doc_id, p.i, g.k, g.item_id FROM p JOIN g ON p.g = g.g AND p.k = g.k),
n AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM d),
f AS (SELECT t, count(*) AS n FROM o GROUP BY t),
bt AS (SELECT item_id, w, len(w) + {SLOP} AS width, unnest(list_distinct(w)) AS t FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
rare AS (SELECT item_id, w, width, arg_min(bt.t, coalesce(f.n, 0)) AS t, count(*) AS n_terms FROM bt LEFT JOIN f ON f.t = bt.t GROUP BY ALL),
places AS (SELECT o.doc_id, item_id, w, width, n_terms, pos AS at FROM rare JOIN o ON o.t = rare.t),
near AS (SELECT p.*, o.pos, o.t FROM places p JOIN o ON o.doc_id = p.doc_id AND abs(o.pos - p.at) < width AND list_contains(p.w, o.t)),
spans AS (SELECT x.doc_id, x.item_id, x.w, x.at, x.pos FROM near x JOIN near y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.w = y.w AND x.at = y.at
           AND y.pos >= x.pos AND y.pos < x.pos + x.width AND x.pos <= x.at AND x.pos + x.width > x.at GROUP BY ALL HAVING count(DISTINCT y.t) = any_value(x.n_terms)),
near_items AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated, coalesce(q.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN near_items q USING (doc_id)"""
