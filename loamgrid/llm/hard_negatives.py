"""Hard negatives by a Voronoi-partitioned nearest-neighbour join of anchors and rows.

Inner products become distances: rows are scaled integers x, lifted to
``(x, sqrt(M**2 - |x|**2))`` with M the largest norm, anchors are stretched to
``(q M / |q|, 0)``; a row's distance falls as its score rises. Bounded numbers of
pivots are drawn from the rows, and every row and anchor belongs to its nearest.
The anchors of one pivot, in chunks, form a group. Bounds tell which rows a group
might need, and only those are copied to it:

* positives: the nearest rows of each cell and label give, by the triangle
  inequality, a distance within which all anchors of a group have enough rows of
  their label; rows that lie further from the group aren't sent;
* negatives: an anchor's positives give the scores that its negatives must have; a
  bounded sample of rows raises the lowest of these to a score that enough rows
  reach. Rows whose distance can't fall in a group's range aren't sent.

A group's rows are dealt to blocks of bounded size, each block is joined exactly, in
integers, and the blocks' best rows are merged for each anchor. Bounds have a slack
for rounding and only ever leave out rows that can't be in the result.

Cases: rows with a null label or vector, or a null or non-finite component, take no
part; a null id comes last among equal scores and is no anchor; shorter vectors
count as ended by zeros, an empty one scores 0; repeated rows are rows of their own,
as anchors too; equal scores go by the smaller id; anchors without a row of their
label have no result; a score must fit 64 bits, else an error is raised; further
columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, session

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
#: Anchors that call for another pivot, and bounds of their number.
ANCHORS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 4, 256
#: Anchors of a group and rows of a block, about; anchors that are scored at once; rows of the sample that gives bounds.
GROUP_ANCHORS, BLOCK_ROWS, AT_ONCE, SAMPLE = 1024, 8192, 128, 4096
#: Groups whose limits are broadcast at most.
BROADCAST_GROUPS = 50_000
SLACK = 1e-6
NO_ID = 2**63 - 1


def matrix(column: pa.Array, dtype: str, dim: int) -> np.ndarray:
    """Packed vectors of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


class Space:
    """Pivots and the lifting of rows and anchors."""

    def __init__(self, pivots: np.ndarray, radius: float, dim: int, dtype: str, whole: bool):
        self.radius, self.dim, self.dtype, self.whole = radius, dim, dtype, whole
        self.pivots = self.lifted(pivots)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.c_[x, np.sqrt(np.maximum(0, self.radius**2 - (x * x).sum(1)))]

    def stretched(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        norm = np.sqrt((q * q).sum(1, keepdims=True))
        return np.c_[q * np.divide(self.radius, norm, out=np.zeros_like(norm), where=norm > 0), np.zeros(len(q))]

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        d2 = (points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def distance_of(self, score: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Distance of a row with a score from each anchor."""
        norm = np.sqrt((q.astype(float) ** 2).sum(1))
        stretch = np.divide(self.radius, norm, out=np.zeros_like(norm), where=norm > 0)
        own = np.where(norm > 0, self.radius**2, 0)
        return np.sqrt(np.maximum(0, own + self.radius**2 - 2 * stretch * score))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact inner products: by floating point where no sum can pass 2**53, else in 64-bit integers."""
        if self.whole:
            return (q.astype(float) @ x.astype(float).T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T


def _packed(batches, dim: int, dtype: str):
    for b in batches:
        flat, ends = b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(0).offsets.to_numpy()
        n = np.diff(ends)
        out = np.zeros((b.num_rows, dim), dtype)
        row = np.repeat(np.arange(b.num_rows), n)
        out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)] = flat
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([r.tobytes() for r in out], pa.binary())], names=[*b.schema.names[1:], "v"])


def _placed(batches, space: Space):
    """Nearest pivot of each row as a row, and as an anchor."""
    for b in batches:
        x = matrix(b.column("v"), space.dtype, space.dim)
        cols = []
        for points in (space.lifted(x), space.stretched(x)):
            d = space.to_pivots(points)
            cols += [pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1, initial=np.inf))]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "cell", "dist", "acell", "adist"])


def _sent(batches, space: Space):
    """A row for each group that it might serve; ``groups``: structs of group, pivot, nearest and furthest distance, blocks."""
    keep = ["rid", "vid", "label", "v"]
    for b in batches:
        x = matrix(b.column("v"), space.dtype, space.dim)
        d = space.to_pivots(space.lifted(x))
        lists = b.column("groups")
        flat, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), n)
        field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        far = d[row, field("pivot")]
        near = np.flatnonzero((far >= field("least")) & (far <= field("most")))
        rid = b.column("rid").to_numpy()[row[near]]
        block = (rid * 2654435761 >> 7) % field("blocks")[near]
        for at in range(0, len(near), 4000):
            i = near[at : at + 4000]
            out = b.select(keep).take(pa.array(row[i]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(field("group")[i].astype(np.int64)), pa.array(block[at : at + 4000].astype(np.int64))], names=[*keep, "group", "block"])


def _best_positives(anchors: pa.Table, rows: pa.Table, space: Space, k: int) -> pa.Table:
    """Each anchor's best rows of a block, itself left out."""
    rows = rows.sort_by([("vid", "ascending"), ("rid", "ascending")])
    q, x = matrix(anchors.column("v"), space.dtype, space.dim), matrix(rows.column("v"), space.dtype, space.dim)
    rid, vid, own = rows.column("rid").to_numpy(), rows.column("vid").to_numpy(), anchors.column("rid").to_numpy()
    out = []
    for at in range(0, len(q), AT_ONCE):
        for a, s in zip(own[at : at + AT_ONCE], space.scores(q[at : at + AT_ONCE], x)):
            best = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]) if len(s) > k + 1 else np.arange(len(s))
            best = best[np.argsort(-s[best], kind="stable")]
            best = best[rid[best] != a][:k]
            out += [(a, vid[j], s[j]) for j in best]
    cols = list(zip(*out)) if out else [[]] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("rid", "positive_id", "score"), cols)})


def _first_in_range(s: np.ndarray, low, high, k: int):
    """Places of the first ``k`` of falling scores from ``high`` down to ``low``."""
    at = np.searchsorted(-s, -high, "left")
    return at + np.flatnonzero(s[at : at + k] >= low)


def _ranges(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest integer n with ``low * p <= 100 * n <= high * p``, as integers of any size."""
    p = [int(x) for x in scores]
    return np.array([-(-low * x // 100) for x in p]), np.array([high * x // 100 for x in p])


def _limits(batches, space: Space, sample, k: int, low: int, high: int):
    """Each anchor's least and most distance of a row that it might need; anchors that can have no negative are left out."""
    x, labels = sample
    for b in batches:
        q = matrix(b.column("v"), space.dtype, space.dim)
        rows = []
        for i, (label, scores) in enumerate(zip(b.column("label").to_pylist(), b.column("scores").to_pylist())):
            lows, highs = _ranges(np.array(scores), low, high)
            s = -np.sort(-space.scores(q[i : i + 1], x)[0][labels != label])
            ends = []
            for least, most in zip(lows, highs):
                if least <= most:
                    known = _first_in_range(s, least, most, k)
                    ends.append((s[known[-1]] if len(known) == k else least, most))
            if ends:
                rows.append((i, min(e[0] for e in ends), max(e[1] for e in ends)))
        i = np.array([r[0] for r in rows], int)
        least, most = (np.array([r[c] for r in rows], float) for c in (1, 2))
        near, far = (space.distance_of(c, q[i]) for c in (most, least))
        some = b.take(pa.array(i))
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(near), pa.array(far)], names=[*b.schema.names, "near", "far"])


def _best_negatives(anchors: pa.Table, rows: pa.Table, space: Space, k: int, low: int, high: int) -> pa.Table:
    """For each anchor and positive the first rows of other labels within the range."""
    rows = rows.sort_by([("vid", "ascending"), ("rid", "ascending")])
    q, x = matrix(anchors.column("v"), space.dtype, space.dim), matrix(rows.column("v"), space.dtype, space.dim)
    vid, labels = rows.column("vid").to_numpy(), rows.column("label").to_numpy()
    out = []
    own = list(zip(anchors.column("rid").to_pylist(), anchors.column("label").to_pylist(), anchors.column("scores").to_pylist()))
    for at in range(0, len(q), AT_ONCE):
        for (a, label, scores), s in zip(own[at : at + AT_ONCE], space.scores(q[at : at + AT_ONCE], x)):
            lows, highs = _ranges(np.array(scores), low, high)
            other = np.flatnonzero((labels != label) & (s >= lows.min()) & (s <= highs.max()))
            other = other[np.argsort(-s[other], kind="stable")]
            for place, (least, most) in enumerate(zip(lows, highs)):
                if least <= most:
                    out += [(a, place, vid[j], s[j]) for j in other[_first_in_range(s[other], least, most, k)]]
    cols = list(zip(*out)) if out else [[]] * 4
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("rid", "place", "negative_id", "score"), cols)})


def mine_negatives(rows: DataFrame, anchor: Column, *, label: Column | str = "label", id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchors_a_pivot: int = ANCHORS_A_PIVOT, group_anchors: int = GROUP_ANCHORS, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor``: which rows are anchors. Scores are inner products of ``floor(scale * x)``; an anchor's positives are its
    ``positives`` best other rows of the same label, its negatives the ``negatives`` best rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    spark = session(rows.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    there = label.isNotNull() & F.col(vec_col).isNotNull() & ~bad
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * float(scale)))
    vid = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    taken = rows.where(there).select(whole.alias("x"), vid.alias("vid"), label.cast("long").alias("label"), F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("rid"))
    taken = materialise(taken.withColumn("n2", F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), "vectors")
    size = F.greatest(F.abs(F.array_max("x").cast("double")), F.abs(F.array_min("x").cast("double")))
    stats = taken.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("n2").alias("n2"), F.max(F.size("x")).alias("dim"), F.max(size).alias("size")).first()
    if not stats["anchors"]:
        return spark.createDataFrame([], schema)
    dim, largest = max(1, stats["dim"]), stats["size"] or 0.0
    if stats["n2"] >= 2**63 / 1.01:
        raise ArithmeticError(f"scores of vectors of norm {stats['n2'] ** 0.5:.3g} don't fit 64 bits")
    dtype = next(t for t, most in (("int8", 2**7), ("int16", 2**15), ("int32", 2**31), ("int64", np.inf)) if largest < most)
    packed = taken.select("x", "vid", "label", "anchor", "rid").mapInArrow(lambda it: _packed(it, dim, dtype), "vid long, label long, anchor boolean, rid long, v binary")
    n_pivots = int(np.clip(-(-stats["anchors"] // anchors_a_pivot), LEAST_PIVOTS, MOST_PIVOTS))
    drawn = packed.orderBy(F.xxhash64("rid"), "rid").limit(max(n_pivots, sample)).select("v", "label").toArrow()  # bounded by the two numbers
    pivots = matrix(drawn.column("v").combine_chunks(), dtype, dim)
    radius = float(np.sqrt(stats["n2"])) or 1.0
    space = Space(np.unique(pivots[:n_pivots], axis=0), radius, dim, dtype, stats["n2"] < 2**52)
    shared = spark.sparkContext.broadcast((space, (pivots[:sample], drawn.column("label").to_numpy()[:sample])))
    slack = SLACK * radius
    table = materialise(packed.mapInArrow(lambda it: _placed(it, shared.value[0]), "vid long, label long, anchor boolean, rid long, v binary, cell int, dist double, acell int, adist double"), "placed")
    columns = table.select("rid", "vid", "label", "v")
    anchors = table.where("anchor").select("rid", "vid", "label", "v", "acell", "adist")

    def grouped(of: DataFrame, keys: list[str]) -> DataFrame:
        """Groups of anchors: those of a pivot (and label) in chunks; ``group`` numbers them by hash."""
        n = of.groupBy(*keys).agg(F.ceil(F.count("*") / group_anchors).alias("chunks"))
        few = F.broadcast(n) if n.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else n
        chunk = F.pmod(F.xxhash64("rid"), F.col("chunks"))
        return of.join(few, keys).withColumn("chunk", chunk).withColumn("group", F.xxhash64(*keys, "chunk")).drop("chunks")

    def joined(of: DataFrame, sent: DataFrame, blocks: DataFrame, kernel, out: str) -> DataFrame:
        """Anchors copied to the blocks of their group, rows sent to one, joined block by block."""
        few = F.broadcast(blocks) if blocks.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else blocks
        copies = of.join(few, "group").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        return copies.groupBy("group", "block").cogroup(sent.groupBy("group", "block")).applyInArrow(kernel, out)

    # positives
    mine = materialise(grouped(anchors, ["acell", "label"]), "anchors")
    groups = mine.groupBy("group", "acell", "label").agg(F.max("adist").alias("reach"))
    nearest = Window.partitionBy("cell", "label").orderBy("dist", "rid")
    summary = table.select("cell", "label", "dist", "rid").withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= positives + 1)
    within = groups.groupBy("label").cogroup(summary.groupBy("label")).applyInArrow(_within(shared, positives + 1), "group long, label long, pivot int, least double, most double")
    sizes = table.groupBy("label").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    within = materialise(within.join(sizes, "label"), "within")
    limit = F.struct("group", "pivot", (F.col("least") - slack).alias("least"), (F.col("most") + slack).alias("most"), "blocks")
    by_label = within.groupBy("label").agg(F.collect_list(limit).alias("groups"))  # as many as the label's groups
    few = F.broadcast(by_label) if within.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else by_label
    sent_schema = "rid long, vid long, label long, v binary, group long, block long"
    sent = columns.join(few, "label").mapInArrow(lambda it: _sent(it, shared.value[0]), sent_schema)
    best = joined(mine.select("rid", "v", "group"), sent, within.select("group", "blocks"), lambda a, r: _best_positives(a, r, shared.value[0], positives), "rid long, positive_id long, score long")
    first = Window.partitionBy("rid").orderBy(F.desc("score"), "positive_id")
    best = best.withColumn("place", F.row_number().over(first) - 1).where(F.col("place") < positives)
    found = materialise(best.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives")), "positives")
    # negatives
    scored = anchors.join(found, "rid").select("rid", "vid", "label", "v", "acell", "adist", "positives", F.col("positives.score").alias("scores"))
    fields = "rid long, vid long, label long, v binary, acell int, adist double, positives array<struct<place int, positive_id long, score long>>, scores array<long>"
    ranged = scored.mapInArrow(lambda it: _limits(it, *shared.value, negatives, low, high), fields + ", near double, far double")
    mine = materialise(grouped(ranged, ["acell"]), "ranged")
    limits = mine.groupBy("group", F.col("acell").alias("pivot")).agg((F.min(F.col("near") - F.col("adist")) - slack).alias("least"), (F.max(F.col("far") + F.col("adist")) + slack).alias("most"))
    limits = materialise(limits.withColumn("blocks", F.lit(-(-stats["n"] // block_rows)).cast("long")), "limits")
    sent = columns.crossJoin(F.broadcast(limits.agg(F.collect_list(F.struct("group", "pivot", "least", "most", "blocks")).alias("groups")))).mapInArrow(lambda it: _sent(it, shared.value[0]), sent_schema)
    worst = joined(mine.select("rid", "label", "v", "scores", "group"), sent, limits.select("group", "blocks"), lambda a, r: _best_negatives(a, r, shared.value[0], negatives, low, high), "rid long, place long, negative_id long, score long")
    first = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "negative_id")
    worst = worst.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    out = worst.join(mine.select("rid", "vid", "positives"), "rid")
    positive = F.element_at("positives", (F.col("place") + 1).cast("int"))
    named = lambda c: F.when(c != NO_ID, c)
    return out.select(F.col("vid").alias("anchor_id"), named(positive["positive_id"]).alias("positive_id"), "rank", named(F.col("negative_id")).alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def _within(shared, k: int):
    def bound(groups: pa.Table, summary: pa.Table) -> pa.Table:
        """Of one label: the distance from its pivot within which all rows lie that a group of anchors might need."""
        pivots = shared.value[0].pivots
        cell, dist = summary.column("cell").to_numpy(), summary.column("dist").to_numpy()
        own, reach = groups.column("acell").to_numpy(), groups.column("reach").to_numpy()
        most = np.empty(len(own))
        for i, (p, u) in enumerate(zip(own, reach)):
            far = np.sort(np.linalg.norm(pivots[cell] - pivots[p], axis=1) + dist)
            most[i] = 2 * u + (far[k - 1] if len(far) >= k else np.inf)
        return pa.table({"group": groups.column("group"), "label": groups.column("label"), "pivot": groups.column("acell"), "least": pa.array(np.full(len(own), -np.inf)), "most": pa.array(most)})

    return bound


def oracle(positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> str:
    """The query's rows in SQL, by all scores of all anchors."""
    return f"""WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.rid AS arid, a.label AS own, e.vec_id, e.label, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.rid <> e.rid WHERE a.vec_id % 100 = 0),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS place FROM s WHERE label = own) WHERE place <= {positives}),
 n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.arid, p.place ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.arid = p.arid AND s.label <> p.own AND {low} * p.score <= 100 * s.score AND 100 * s.score <= {high} * p.score)
 SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
