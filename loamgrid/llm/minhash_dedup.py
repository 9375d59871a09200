"""Near-duplicates by MinHash with tensored banding.

Two small collections of bands, 12 of three minhashes and 9 of two, are computed
for a text: 54 minhashes. A table key combines a band of the first collection
with a band of the second, so there are 108 tables of 5 minhashes each, where
separate tables would need 540.

Texts with equal shingle sets are one class from the start. Classes that share a
key are candidates. Every link is confirmed on the full sets; components follow
the confirmed links. The candidates of a bucket are never listed in full:

1. two rounds of stars: each bucket of several components names a pivot (its most
   popular member, then one by hash), and each member is compared with the one
   pivot of another component that it shares most tables with. A round has a pair
   a class at most;
2. the members of buckets that still hold several components are thinned exactly.
   Only a shingle that occurs in two components can be common to a pair across
   components; a class whose count of such shingles is too small for a link with
   any member of its buckets goes, which lessens the shingles of the others, so
   this is repeated;
3. what is left falls into groups connected by buckets. All pairs across the
   components of a group are compared on full sets, in cells of two blocks of
   bounded rows and bytes, and only links leave a cell.

Steps 1 and 2 move rows in proportion to the table. Step 3 takes work with the
square of a group of classes that share more than the similarity asks with other
components and still aren't linked with them; it has no limit, so no link is lost.

A pair of similarity s is a candidate with chance
``(1 - (1 - s**3)**12) * (1 - (1 - s**2)**9)``: 0.9997 at 0.8.

Cases: a text without words, empty or null has no set and is linked with
nothing; a row without doc_id is linked with nothing and has no component; rows
that share a doc_id are one document, linked with whatever any of its texts is
linked with; equal sets are linked, and the least doc_id names a component, so
ties have no effect; a very long text is read whole, its set takes 8 bytes a word
in a worker; further columns are ignored, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import BROADCAST_IDS, materialise, session, worker_memo

#: (bands, minhashes in a band) of the two collections.
COLLECTIONS = ((12, 3), (9, 2))
N_HASHES = sum(g * r for g, r in COLLECTIONS)
#: Rounds of stars, and rounds of thinning at most.
STAR_ROUNDS, THINNING_ROUNDS = 2, 3
#: A block of a cell: classes and bytes of their sets, about.
BLOCK_ROWS, BLOCK_BYTES = 256, 16 << 20
MEMO_ENTRIES = 500_000
#: Multipliers of the minhashes: odd numbers from a fixed generator.
MULTIPLIERS = np.random.default_rng(20240607).integers(1, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(a, b):
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    hashes = worker_memo("word hashes", WordHashes)
    if len(hashes) > MEMO_ENTRIES:
        hashes.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    acc = h[: len(h) - k + 1] + np.uint64(k)
    for j in range(1, k):
        acc = _mix(acc, h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``N_HASHES`` minhashes of 32 bits."""
    out = np.full(N_HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (np.multiply.outer(MULTIPLIERS, shingles[at : at + 2048]) >> np.uint64(32)).min(1), out)
    return out.astype(np.uint32)


def bands(signatures: np.ndarray) -> list[np.ndarray]:
    """Hash of each band: for each collection an array (texts, bands)."""
    out, at = [], 0
    for number, (groups, rows) in enumerate(COLLECTIONS):
        s = signatures[:, at : at + groups * rows].reshape(-1, groups, rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(groups, dtype=np.uint64) + np.uint64(1 + 1000 * number), s.shape[:2])
        for r in range(rows):
            h = _mix(h, s[..., r])
        out.append(h)
        at += groups * rows
    return out


def tensor_keys(signatures: np.ndarray) -> np.ndarray:
    """The table keys of each text: every band of one collection with every band of the other."""
    one, two = bands(signatures)
    return _mix(one[:, :, None], two[:, None, :]).reshape(len(signatures), -1)


def _signatures(batches, k: int):
    for b in batches:
        n, fp, sig = [], [], []
        for t in b.column(1):
            s = shingle_set(t.as_py(), k)
            n.append(len(s))
            fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "fp", "sig"])


def _lists(h: np.ndarray) -> pa.Array:
    flat = pa.array(h.view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), flat)


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _keys(batches):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(tensor_keys(_matrix(b.column(1), N_HASHES)))], names=["cid", "keys"])


def _sets(batches, k: int):
    for b in batches:
        sets = [shingle_set(t.as_py(), k) for t in b.column(1)]
        fp = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        at = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["rep", "fp", "set"])


def _confirm(batches, percent: int):
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = 0
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def links_of_cell(cid, comp, n, shared, block, flat, at, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a cell: a spanning forest of those on full sets.

    ``flat`` holds the sets one after the other from ``at``; ``shared`` is a bound of what a class has in common with
    others. Pairs lie across the two blocks, or within the one.
    """
    label, found, one_block = np.unique(comp, return_inverse=True)[1], [], len(set(block.tolist())) < 2
    _, flat = np.unique(flat, return_inverse=True)
    mark, starts = np.zeros(len(flat) + 1, np.int64), at[:-1]
    for i in range(len(cid) - 1):
        rest = slice(i + 1, None)
        bound = np.minimum(shared[i], shared[rest])
        maybe = (label[rest] != label[i]) & (100 * bound >= percent * (n[i] + n[rest] - bound))
        if not one_block:
            maybe &= block[rest] != block[i]
        if not maybe.any():
            continue
        mine = flat[at[i] : at[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[flat[at[i + 1] :]], starts[rest] - at[i + 1])
        mark[mine] = 0
        for j in np.flatnonzero(maybe & (100 * both >= percent * (n[i] + n[rest] - both))) + i + 1:
            if label[i] != label[j]:
                found.append((int(cid[i]), int(cid[j])))
                label[label == label[j]] = label[i]
    return found


def _cell(table: pa.Table, percent: int) -> pa.Table:
    t = table.combine_chunks()
    of = lambda c: t.column(c).to_numpy()
    sets = t.column("set").combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    at = sets.offsets.to_numpy()
    flat = sets.values.to_numpy()[at[0] : at[-1]]
    links = links_of_cell(of("cid"), of("comp"), of("n"), of("shared"), of("block"), flat, (at - at[0]).astype(np.int64), percent)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _short(rows: DataFrame) -> DataFrame:
    """To be broadcast if it has no more than ``BROADCAST_IDS`` rows."""
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows


class _Components:
    """Components of classes by the links found so far."""

    def __init__(self):
        self.labels: DataFrame | None = None

    def of(self, rows: DataFrame, node: str, out: str) -> DataFrame:
        """Add the component of a column of classes."""
        if self.labels is None:
            return rows.withColumn(out, F.col(node))
        return rows.join(self.labels.toDF(node, "__label"), node, "left").withColumn(out, F.coalesce("__label", node)).drop("__label")

    def add(self, links: DataFrame) -> None:
        """Join the components of linked classes ``a, b``."""
        if not links.take(1):
            return
        joined = self.of(self.of(links, "a", "la"), "b", "lb")
        roots = connected_components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        known = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        known = self.of(known, "node", "label").select("node", "label")
        if self.labels is not None:
            known = self.labels.union(known.join(self.labels.select("node"), "node", "left_anti"))
        self.labels = materialise(known.join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def _members(classes: DataFrame) -> DataFrame:
    """``key, cid, n, popularity`` of the buckets with several classes; popularity sums the sizes of a class's buckets."""
    keyed = classes.select("cid", "sig").mapInArrow(_keys, "cid long, keys array<long>")
    rows = keyed.select("cid", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = materialise(rows.join(buckets, "key").select("key", "cid", "size"), "members")
    popular = rows.groupBy("cid").agg(F.sum("size").alias("popularity")).join(classes.select("cid", "n"), "cid")
    return materialise(rows.select("key", "cid").join(popular, "cid"), "members")


def _mixed(members: DataFrame, buckets: DataFrame) -> DataFrame:
    return members.join(buckets.where("lo != hi").drop("lo", "hi"), "key")


def _star(members: DataFrame, components: _Components, order) -> tuple[DataFrame, DataFrame]:
    """The members of buckets of several components, and each one's pair with a pivot, if it has any."""
    labelled = components.of(members, "cid", "comp")
    pivot = F.max(F.struct(order.alias("order"), F.col("cid").alias("pivot"), F.col("comp").alias("pivot_comp"))).alias("top")
    buckets = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot)
    mixed = materialise(_mixed(labelled, buckets).select("key", "cid", "n", "popularity", "comp", "top.pivot", "top.pivot_comp"), "mixed")
    shared = mixed.where("comp != pivot_comp").groupBy("cid", "pivot").agg(F.count("*").alias("tables"))
    best = shared.groupBy("cid").agg(F.max(F.struct("tables", "pivot")).alias("best"))
    return mixed.select("key", "cid", "n", "popularity"), best.select(F.col("cid").alias("a"), F.col("best.pivot").alias("b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    held = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return materialise(held.mapInArrow(lambda it: _confirm(it, percent), "a long, b long"), "links")


def _thinned(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``key, cid, n, comp, shared`` of the classes that may be linked across components; ``members``: key, cid, n, comp."""
    before = None
    for _ in range(THINNING_ROUNDS):
        buckets = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"))
        members = materialise(_mixed(members.select("key", "cid", "n", "comp"), buckets), "mixed")
        rest = materialise(members.groupBy("cid").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.min("least").alias("least")), "rest")
        left = rest.count()
        if not left:
            break
        spread = sets.join(rest.select("cid", "comp"), "cid").select("cid", "comp", F.explode("set").alias("shingle"))
        across = spread.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("shingle")
        shared = spread.select("cid", "shingle").join(across, "shingle").groupBy("cid").agg(F.count("*").alias("shared"))
        # the other set has `least` shingles at least, percent / 100 of this one's, and all that are shared
        other = F.greatest("least", F.ceil(F.col("n") * percent / 100), "shared")
        may = rest.join(shared, "cid").where(100 * F.col("shared") >= percent * (F.col("n") + other - F.col("shared")))
        members = materialise(members.drop("least").join(may.select("cid", "shared"), "cid"), "thinned")
        if before is not None and left > 0.9 * before:
            break
        before = left
    return members


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components of groups that are connected by buckets; ``members`` as of ``_thinned``."""
    star = members.join(members.groupBy("key").agg(F.min("cid").alias("first")), "key")
    groups = connected_components(star.select(F.col("cid").alias("a"), F.col("first").alias("b"))).toDF("cid", "group")
    rows = materialise(members.groupBy("cid").agg(*(F.first(c).alias(c) for c in ("n", "comp", "shared"))).join(groups, "cid"), "groups")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, 8 * F.sum("n") / BLOCK_BYTES))
    rows = rows.join(rows.groupBy("group").agg(blocks.alias("blocks")), "group").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "cid", "comp", "n", "shared", "block")
    return materialise(cells.join(sets, "cid").groupBy("group", "lo", "hi").applyInArrow(lambda t: _cell(t, percent), "a long, b long"), "links")


def _class_sets(texts: DataFrame, wanted: DataFrame, repeated: bool, k: int) -> DataFrame:
    """``cid, set`` of the classes ``cid, rep, fp``, from the texts of their least documents."""
    wanted = _short(wanted)
    found = texts.join(wanted.select("rep").distinct(), "rep", "left_semi").mapInArrow(lambda it: _sets(it, k), "rep long, fp binary, set array<long>")
    found = found.join(wanted, ["rep", "fp"]).select("cid", "set")
    return materialise(found.dropDuplicates(["cid"]) if repeated else found, "sets", "none")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, linked at a Jaccard similarity of ``percent`` / 100."""
    session(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = materialise(texts.mapInArrow(lambda it: _signatures(it, k), "doc_id long, n long, fp binary, sig binary"), "signatures")
    named = signed.where("doc_id is not null")
    classes = named.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # written once, so that an id stays with its class
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    components = _Components()
    repeated = materialise(named.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("rows > 1"), "repeated")
    several = bool(repeated.take(1))
    if several:
        texts_of = named.join(repeated.where("lo != hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", "fp").distinct().join(classes.select("fp", "cid"), "fp")
        first = texts_of.groupBy("doc_id").agg(F.min("cid").alias("a"))
        components.add(materialise(texts_of.join(first, "doc_id").select("a", F.col("cid").alias("b")).where("a != b").distinct(), "links"))
    members = _members(classes)
    sets = _class_sets(texts, classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "rep", "fp"), several, k)
    for number in range(STAR_ROUNDS):
        members, pairs = _star(members, components, F.xxhash64("cid") if number else F.col("popularity"))
        components.add(_confirmed(pairs, sets, percent))
    rest = _thinned(components.of(members.select("key", "cid", "n"), "cid", "comp"), sets, percent)
    if rest.take(1):
        components.add(_across(rest, sets, percent))
    # a class of one document that is linked with nothing needs no look-up
    labelled = components.of(classes.select("fp", "cid", "rep", "last"), "cid", "label")
    large = labelled.groupBy("label").agg(F.min("rep").alias("component"), F.max("last").alias("last"), F.count("*").alias("classes")).where("classes > 1 or component != last")
    own = materialise(labelled.join(large.select("label", "component"), "label").select("fp", "component"), "components")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(own, "fp", "left")
    component = F.coalesce("component", "doc_id")
    if several:
        by_doc = repeated.where("hi is not null").select("doc_id", F.col("hi").alias("fp")).join(own.withColumnRenamed("component", "of_doc"), "fp").select("doc_id", "of_doc")
        out, component = out.join(by_doc, "doc_id", "left"), F.coalesce("component", "of_doc", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def oracle(k: int, percent: int) -> str:
    """DuckDB SQL of the same classes and components, over all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({k}, len(w)) - 1], ' ') AS g, least({k}, len(w)) AS len FROM (SELECT doc_id, w, unnest(range(1, len(w) - least({k}, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.len = b.len AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= {percent} * (p.n + q.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, doc_id = c.c AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = doc_id"""
