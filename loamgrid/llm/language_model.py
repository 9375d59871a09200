"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of every n-gram order and a uniform one are mixed;
the weights of the mixture depend on the frequency bucket of the context and are
learned by expectation-maximisation on held-out counts: those of a tenth of the
training texts, against estimates from the other training texts (the "deleted"
part is put back for scoring).

The corpus is held as blocks of dictionary-coded texts. Each block's distinct
n-grams are dealt to shards by a 62-bit key (packed arrays, one row for a block
and a shard), summed there, and the totals go back to the blocks. No row moves
per token, no key is hot, and the number of shards follows the number of tokens.
A block deals to at most ``FAN_OUT`` ranges: where more shards are needed, the
pieces of some blocks in one range are merged to a run, which is dealt to parts of
the range, and the totals return the same way. So the rows grow with the number of
blocks times the logarithm of the number of shards. Two keys of a corpus of n
different n-grams collide with a chance of about n * n / 2**63.

Cases: a null or empty text holds the end token alone; repeated rows count and
score as rows of their own; a null doc_id stays null and falls in the fold of
the empty text; without training texts the estimates are uniform; further
columns are ignored; a very long text is a block of its own and held whole, as is
every text (about 100 bytes a token in a task); there are no ties, as nothing is
ranked; an empty table gives an empty table.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, session

ORDER = 2
#: Tokens of a block (the last document may exceed it) and distinct n-grams of a shard, about.
BLOCK_TOKENS = 2_000_000
SHARD_ENTRIES = 600_000
#: Ranges that a block deals to, at most.
FAN_OUT = 256
ROUNDS = 12
TOLERANCE = 1e-4
BUCKETS = 40

BLOCK_SCHEMA = "block long, n_tokens long, n_docs long, doc_ids array<long>, part binary, lens binary, ids binary, words binary"
EOT, BOS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
HELD, TRAIN, DELETED = 0, 1, 2


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _expand(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _pack(a: np.ndarray) -> bytes:
    """Counts in 4 bytes each where they fit, else in 8."""
    return _squeeze(a.astype(np.uint32 if a.max(initial=0) < 2**32 else np.uint64))


def _unpack(b: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.uint64)


class Vocabulary(dict):
    """Number of each word, in order of appearance."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _blocks(batches, block_tokens: int):
    base, made = TaskContext.get().partitionId() << 32, 0
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]

    def fresh():
        return Vocabulary({None: 0}), [], array("b"), array("I"), array("I")

    vocabulary, doc_ids, part, lens, ids = fresh()

    def row():
        keys = [EOT, *(np.uint64(xxhash.xxh3_64_intdigest(w)) for w in list(vocabulary)[1:])]
        # columns of low and high bytes, which compress apart from each other
        planes = np.frombuffer(ids, np.uint32).view(np.uint8).reshape(-1, 4).T
        cols = [[base + made], [len(ids)], [len(doc_ids)], [list(doc_ids)], [part.tobytes()], [_squeeze(np.frombuffer(lens, np.uint32))], [_squeeze(planes)], [np.array(keys, np.uint64).tobytes()]]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for b in batches:
        for key, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            words = t.as_py().encode("utf-8", "surrogatepass").lower().split()
            ids.extend(map(vocabulary.__getitem__, words))
            ids.append(0)
            doc_ids.append(key)
            part.append(HELD if r == 0 else DELETED if r == 1 else TRAIN)
            lens.append(len(words) + 1)
            if len(ids) >= block_tokens:
                yield row()
                made += 1
                vocabulary, doc_ids, part, lens, ids = fresh()
    if doc_ids:
        yield row()


class Block:
    """A block's tokens with, for each order, the distinct n-grams and every token's n-gram."""

    def __init__(self, r: dict, order: int):
        self.part = np.frombuffer(r["part"], np.int8)
        self.lens = _expand(r["lens"], np.uint32).astype(np.int64)
        planes = _expand(r["ids"], np.uint8).reshape(4, -1)
        ids = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        words = np.concatenate((np.frombuffer(r["words"], np.uint64), [BOS]))
        n, pad, docs = len(ids), order - 1, len(self.lens)
        first = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        # each text gets order - 1 start marks before it; ``at``: the tokens' places in the padded sequence
        self.at = np.arange(n) + pad * (np.repeat(np.arange(docs), self.lens) + 1)
        seq = np.full(n + pad * docs, len(words) - 1, np.int64)
        seq[self.at] = ids
        counted = np.zeros(len(seq), bool)
        counted[self.at] = True
        if pad:
            counted[first + pad * (np.arange(docs) + 1) - 1] = True  # the last start mark is a context
        kind = np.zeros(len(seq), np.int8)
        kind[self.at] = np.repeat(self.part, self.lens)
        if pad:
            kind[first + pad * (np.arange(docs) + 1) - 1] = self.part
        self.grams, keys, train, deleted = [], [], [], []
        gram, key, offset = seq, words, 0
        for level in range(order):
            if level:
                code = np.zeros(len(seq), np.int64)
                code[1:] = gram[:-1] * len(words) + seq[1:]
                distinct, gram_new = np.unique(code, return_inverse=True)
                key = _mix(key[distinct // len(words)] * np.uint64(3) + np.uint64(level), words[distinct % len(words)])
                gram = gram_new.astype(np.int64)
            self.grams.append(gram + offset)
            keys.append(key & ~np.uint64(3) | np.uint64(min(level, 3)))
            train.append(np.bincount(gram[counted & (kind != HELD)], minlength=len(key)))
            deleted.append(np.bincount(gram[counted & (kind == DELETED)], minlength=len(key)))
            offset += len(key)
        self.keys, self.train, self.deleted = np.concatenate(keys), np.concatenate(train), np.concatenate(deleted)
        self.sorted = np.argsort(self.keys, kind="stable")

    def shards(self, n: int):
        """(shard, places of its keys)."""
        return [(s, self.sorted[a:b]) for s, a, b in _ranges(self.keys[self.sorted], n)]


def _ranges(keys: np.ndarray, n: int):
    """(shard, start, end) of sorted keys in n shards by their upper bits; n times k shards are parts of n."""
    of = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(of, prepend=np.uint64(2**63)))
    return [(int(of[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(of)])]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _rows(batches):
    for b in batches:
        yield from b.to_pylist()


def _deal(batches, order: int, n_shards: int):
    for r in _rows(batches):
        block = Block(r, order)
        out = [(s, r["block"], block.keys[i].tobytes(), _pack(block.train[i]), _pack(block.deleted[i])) for s, i in block.shards(n_shards)]
        for k in range(0, len(out), 64):
            cols = [pa.array(list(c), t) for c, t in zip(zip(*out[k : k + 64]), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "block", "keys", "train", "deleted"])


def _sums(rows: pa.Table):
    """Distinct keys of some pieces with their counts, and each piece's places in them."""
    keys = [np.frombuffer(k.as_py(), np.uint64) for k in rows.column("keys")]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("train", "deleted"):
        each = np.concatenate([_unpack(x.as_py(), len(k)) for x, k in zip(rows.column(name), keys)])
        sums.append(np.bincount(where, weights=each, minlength=len(distinct)).astype(np.uint64))
    cuts = np.cumsum([0, *map(len, keys)])
    return distinct, sums, [where[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _back(rows: pa.Table, sums, places, n_tokens: int = 0, n_words: int = 0) -> pa.Table:
    """A row with the totals of each piece, and a row without block with the counts of words."""
    shard, blocks = rows.column("shard")[0].as_py(), rows.column("block").to_pylist()
    cols = [pa.array([*(_squeeze(s[p]) for p in places), None], pa.binary()) for s in sums]
    count = lambda x: pa.array([0] * len(blocks) + [x], pa.int64())
    return pa.table([pa.array([*blocks, None], pa.int64()), pa.array([shard] * (len(blocks) + 1), pa.int32()), *cols, count(n_tokens), count(n_words)], names=["block", "shard", "train", "deleted", "n_tokens", "n_words"])


def _total(rows: pa.Table) -> pa.Table:
    """Totals of a shard's keys, a row back for each piece, and a row without block that counts the training words."""
    distinct, sums, places = _sums(rows)
    word = (distinct & np.uint64(3) == 0) & (distinct != (BOS & ~np.uint64(3))) & (sums[0] > 0)
    return _back(rows, sums, places, int(sums[0][word].sum()), int(word.sum()))


def _merge(rows: pa.Table, n_shards: int) -> pa.Table:
    """The pieces of a run as one, dealt to the parts of its range."""
    distinct, sums, _ = _sums(rows)
    run = rows.column("run")[0].as_py()
    out = [(s, run, distinct[a:b].tobytes(), _pack(sums[0][a:b]), _pack(sums[1][a:b])) for s, a, b in _ranges(distinct, n_shards)]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=["shard", "block", "keys", "train", "deleted"])


def _hand_back(rows: pa.Table, totals: pa.Table) -> pa.Table:
    """The totals of a run's parts, handed to the pieces that it was merged from."""
    totals = totals.sort_by("part")
    sums = [np.concatenate([_expand(x.as_py(), np.uint64) for x in totals.column(name)]) for name in ("train", "deleted")]
    return _back(rows, sums, _sums(rows)[2])


PIECE = "shard int, block long, keys binary, train binary, deleted binary"
TOTALS = "block long, shard int, train binary, deleted binary, n_tokens long, n_words long"


def _shard_levels(n_shards: int, fan_out: int) -> list[int]:
    """Numbers of shards by level, each the same multiple of the one before."""
    levels, step = 1, 1
    while fan_out**levels < n_shards:
        levels += 1
    while step**levels < n_shards:
        step += 1
    return [step ** (k + 1) for k in range(levels)]


def _add_up(pieces: DataFrame, sizes: list[int], n_runs: int, group: int):
    """Totals for every piece, and the corpus' training tokens and words."""
    if len(sizes) == 1:
        totals = materialise(pieces.groupBy("shard").applyInArrow(_total, TOTALS), "totals")
        corpus = totals.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("v")).first()
    else:
        n_groups, n_next, step = -(-n_runs // group), sizes[1], sizes[1] // sizes[0]
        pieces = materialise(pieces.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(n_groups))), "pieces")
        merged = pieces.groupBy("shard", "run").applyInArrow(lambda t: _merge(t, n_next), PIECE)
        above, corpus = _add_up(merged, sizes[1:], n_groups, group)
        above = above.select(F.floor(F.col("shard") / step).cast("int").alias("shard"), F.col("block").alias("run"), F.col("shard").alias("part"), "train", "deleted")
        totals = materialise(pieces.groupBy("shard", "run").cogroup(above.groupBy("shard", "run")).applyInArrow(_hand_back, TOTALS), "totals")
    return totals.where("block is not null"), corpus


def _estimates(block: Block, counts: np.ndarray, n: float, v: int, order: int, keep: np.ndarray | slice):
    """Bucket of the context and the estimates of each order (the uniform one first) for the kept tokens."""
    at = block.at[keep]
    word = counts[block.grams[0][at]]
    parts = [np.full(len(at), 1.0 / (v + 1)), word / max(n, 1.0)]
    context = np.full(len(at), n)
    for level in range(1, order):
        context = counts[block.grams[level - 1][at - 1]].astype(float)
        parts.append(counts[block.grams[level][at]] / np.maximum(context, 1.0))
    return np.minimum(np.log2(1 + context).astype(np.int64), BUCKETS - 1), np.stack(parts, 1)


def _join(block_rows: pa.Table, total_rows: pa.Table, order: int, n: int, n_deleted: int, v: int) -> pa.Table:
    """A block with the totals of its n-grams, and the held-out estimates that the weights are learned from."""
    out = []
    for r in block_rows.to_pylist():
        block = Block(r, order)
        totals = total_rows.sort_by("shard")
        train, deleted = (np.empty(len(block.keys), np.int64) for _ in range(2))
        for a, name in ((train, "train"), (deleted, "deleted")):
            a[block.sorted] = np.concatenate([_expand(x.as_py(), np.uint64) for x in totals.column(name)]).astype(np.int64)
        held = np.repeat(block.part == DELETED, block.lens)
        bucket, parts = _estimates(block, train - deleted, n - n_deleted, v, order, np.flatnonzero(held))
        both = np.column_stack([bucket.astype(np.float32), parts[:, 1:].astype(np.float32)])
        kinds, many = np.unique(both, axis=0, return_counts=True) if len(both) else (both, np.zeros(0))
        out.append(r | {"totals": _squeeze(train.astype(np.uint32) if train.max(initial=0) < 2**32 else train.astype(np.uint64)), "wide": bool(train.max(initial=0) >= 2**32), "held": _squeeze(kinds.astype(np.float32)), "many": _squeeze(many.astype(np.uint32))})
    schema = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("part", "lens", "ids", "words", "totals")], ("wide", pa.bool_()), ("held", pa.binary()), ("many", pa.binary())])
    return pa.Table.from_pylist(out, schema)


def _expectations(batches, weights: np.ndarray, uniform: float):
    """Summed responsibilities by bucket and order, and the log-likelihood, of a task's held-out counts."""
    order = weights.shape[1] - 1
    sums, loss = np.zeros(weights.shape), 0.0
    for r in _rows(batches):
        x = _expand(r["held"], np.float32).reshape(-1, order + 1)
        many = _expand(r["many"], np.uint32)
        if not len(x):
            continue
        bucket = x[:, 0].astype(int)
        each = weights[bucket] * np.column_stack([np.full(len(x), uniform), x[:, 1:]])
        total = each.sum(1)
        for k in range(order + 1):
            sums[:, k] += np.bincount(bucket, weights=many * each[:, k] / total, minlength=len(sums))
        loss += float((many * np.log(total)).sum())
    yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64())), pa.array([loss], pa.float64())], names=["sums", "loss"])


def learn_weights(joined: DataFrame, order: int, v: int, *, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """EM: a row of mixture weights (uniform first) for each bucket of context frequencies."""
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    last, held = None, joined.select("held", "many")
    for _ in range(rounds):
        w = weights
        sums = held.mapInArrow(lambda it, w=w: _expectations(it, w, 1.0 / (v + 1)), "sums array<double>, loss double")
        cells = sums.select(F.posexplode("sums").alias("cell", "x"), "loss").groupBy("cell").agg(F.sum("x").alias("x"), F.sum("loss").alias("loss")).collect()
        got = np.zeros(weights.size)
        for r in cells:
            got[r["cell"]] = r["x"]
        got = got.reshape(weights.shape) + 0.1 / (order + 1)  # a bucket without held-out counts keeps even weights
        weights = got / got.sum(1, keepdims=True)
        loss = cells[0]["loss"] if cells else 0.0
        if last is not None and abs(loss - last) <= tolerance * abs(last):
            break
        last = loss
    return weights


def _score(batches, order: int, n: int, v: int, weights: np.ndarray):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for r in _rows(batches):
        block = Block(r, order)
        train = _expand(r["totals"], np.uint64 if r["wide"] else np.uint32).astype(np.int64)
        bucket, parts = _estimates(block, train, float(n), v, order, slice(None))
        score = np.log10((weights[bucket] * parts).sum(1))
        c = train[block.grams[0][block.at]]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        starts = np.concatenate(([0], np.cumsum(block.lens)[:-1]))
        cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(block.part == HELD), pa.array(block.lens), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), n)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts))]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def score_documents(docs: DataFrame, *, order: int = ORDER, folds: int = 10, block_tokens: int = BLOCK_TOKENS, shard_entries: int = SHARD_ENTRIES, fan_out: int = FAN_OUT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows outside fold 0 and score every row."""
    session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(id_col, folds).alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = materialise(rows.mapInArrow(lambda it: _blocks(it, block_tokens), BLOCK_SCHEMA), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.count("*").alias("blocks")).first()
    sizes = _shard_levels(max(1, -(-size["n"] * order // (2 * shard_entries))), fan_out)
    dealt = blocks.mapInArrow(lambda it: _deal(it, order, sizes[0]), PIECE)
    # blocks of a run: their pieces of one range are about a shard's entries
    group = max(2, 2 * shard_entries * sizes[0] // (block_tokens * order))
    totals, corpus = _add_up(dealt, sizes, size["blocks"], group)
    n, v = corpus["n"], corpus["v"]
    n_deleted = _deleted_tokens(blocks)
    joined = materialise(
        blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
            lambda a, b: _join(a, b, order, n, n_deleted, v), BLOCK_SCHEMA + ", totals binary, wide boolean, held binary, many binary"
        ),
        "joined",
    )
    weights = learn_weights(joined, order, v, rounds=rounds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.drop("held", "many").mapInArrow(lambda it: _score(it, order, n, v, weights), schema)


def _deleted_tokens(blocks: DataFrame) -> int:
    def count(batches):
        for b in batches:
            got = [int(_expand(r["lens"], np.uint32)[np.frombuffer(r["part"], np.int8) == DELETED].sum()) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["n"])

    return blocks.select("part", "lens").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
