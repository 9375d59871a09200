"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries are trained on labelled rows. The ordinary one comes from whole
ordinary texts. The toxic one comes from what recurs in toxic texts and not in
ordinary ones: spans of byte 5-grams that are found in many different surroundings
of toxic texts and ``RATIO`` times rarer elsewhere; a passage that is copied from
text to text has one surrounding and counts once. The toxic compressor holds the
ordinary dictionary and the toxic one behind it, so ordinary words cost the same in
both and a window's gain, ordinary less toxic length in bytes, tells toxic wording.

A text is cut into windows of ``WINDOW`` bytes at every ``STEP``. How many windows
reach each gain threshold, in all and as a share, is weighed by a logistic function.
The weights are learned from halves of the sample, each with dictionaries of the
other half, so no gain is that of texts the dictionaries were made of; scores use
the dictionaries of the whole sample. A run of zero bytes ends each window, so that
all are compressed and a single match of five bytes counts.

The sample takes whole texts in the order of a hash of their ids, about
``TOXIC_BYTES`` and ``ORDINARY_BYTES`` of them (documented bounds; one text more at
most, and none above a fourth of a bound if there are others). Scores cover all
rows and whole texts.

Cases: a null or empty text is one empty window and has a score; a very long text
is read whole, a thousand windows at a time; without labels of both classes, or
without wording of toxic texts, all scores are the share of toxic labels (0 without
labels); several labels of one doc_id are toxic if any is; repeated rows give a row
each and are one text of the sample, of several texts the least; a null doc_id
stays null, has no label and falls in the fold of the empty text; a score that
equals the threshold is predicted toxic; further columns are ignored, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import random
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import fold, materialise, session, unit_hash, whole_row, worker_memo

TOXIC_BYTES, ORDINARY_BYTES = 6_000_000, 14_000_000
#: Rows of labels that are looked at for the sample, of each class, about.
LABELS = 20_000
TOXIC_DICTIONARY, ORDINARY_DICTIONARY = 2048, 16384
WINDOW, STEP = 64, 48
FILL = b"\0" * 32
THRESHOLDS = (1, 2, 3, 4, 5, 6, 7)
THRESHOLD = 0.3
GRAM, SIDE = 5, 8
RATIO, DEVIATIONS = 12.0, 6.0
PIECE = 1000


def normal(text: str | None) -> bytes:
    """Lower-case A-Z, blanks for runs of white space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def grams_by_surroundings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte grams and the number of different surroundings (bytes before and after) that each is found in."""
    prime, zero = np.uint64(0x9E3779B97F4A7C15), b"\0" * SIDE
    codes, keys, at = [], [], 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and size < 2_000_000:
            some.append(texts[at])
            size += len(texts[at])
            at += 1
        a = np.frombuffer(zero + zero.join(some) + zero, np.uint8).astype(np.uint64)
        n = len(a) - 2 * SIDE - GRAM + 1
        if n <= 0:
            continue
        code, around = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(2 * SIDE + GRAM):
            if SIDE <= k < SIDE + GRAM:
                code = code << np.uint64(8) | a[k : k + n]
            else:
                around = (around ^ a[k : k + n]) * prime
                around ^= around >> np.uint64(29)
        ends = np.cumsum(np.concatenate([[0], a == 0]))
        inside = ends[SIDE + GRAM : SIDE + GRAM + n] == ends[SIDE : SIDE + n]
        code = code[inside]
        key, first = np.unique((code * prime) ^ around[inside], return_index=True)
        codes.append(code[first])
        keys.append(key)
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, first = np.unique(np.concatenate(keys), return_index=True)
    return np.unique(np.concatenate(codes)[first], return_counts=True)


def typical_grams(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, int]:
    """Grams of toxic texts that are rare in ordinary ones, with the number of their surroundings."""
    (gt, ct), (go, co) = grams_by_surroundings(toxic), grams_by_surroundings(ordinary)
    if not len(gt) or not len(go):
        return {}
    at = np.minimum(np.searchsorted(go, gt), len(go) - 1)
    other = np.where(go[at] == gt, co[at], 0)
    nt, no = ct.sum(), co.sum()
    z = (ct / nt - other / no) / np.sqrt((ct + other) / (nt + no) * (1 / nt + 1 / no))
    rate = ((ct + 0.5) / nt) / ((other + 0.5) / no)
    typical = (rate >= RATIO) & (z >= DEVIATIONS)
    return {int(g).to_bytes(GRAM, "big"): int(n) for g, n in zip(gt[typical], ct[typical])}


def typical_spans(texts: list[bytes], grams: dict[bytes, int]) -> list[bytes]:
    """The runs of texts that such grams cover, with at most two bytes between their starts, from the first to the last gram
    that is at least half as frequent as the run's most frequent: what else is there are words that happen to be near.
    """
    spans = []
    for b in texts:
        hits = [(i, n) for i in range(len(b) - GRAM + 1) if (n := grams.get(b[i : i + GRAM]))]
        i = 0
        while i < len(hits):
            j = i
            while j + 1 < len(hits) and hits[j + 1][0] <= hits[j][0] + 2:
                j += 1
            most = max(n for _, n in hits[i : j + 1])
            often = [at for at, n in hits[i : j + 1] if 2 * n >= most]
            spans.append(b[often[0] : often[-1] + GRAM])
            i = j + 1
    return spans


def train_dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train on, the samples themselves, the last ones first kept."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Frames without headers, so that lengths are those of the content."""
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=17, hash_log=15, chain_log=15, search_log=4, target_length=16,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=parameters)


class Distance:
    """Gains of windows and a text's features."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary).compress, compressor(toxic + ordinary).compress

    def reached(self, text: bytes) -> tuple[np.ndarray, int]:
        """Number of windows that reach each threshold, and of all windows."""
        n = max(1, -(-(len(text) - (WINDOW - STEP)) // STEP))
        total = np.zeros(len(THRESHOLDS))
        plain, toxic = self.ordinary, self.toxic
        for at in range(0, n, PIECE):
            windows = [text[i : i + WINDOW] + FILL for i in range(at * STEP, min(n, at + PIECE) * STEP, STEP)]
            gains = np.array([len(plain(w)) - len(toxic(w)) for w in windows])
            total += (gains[:, None] >= np.array(THRESHOLDS)).sum(0)
        return total, n

    def features(self, text: bytes) -> np.ndarray:
        total, n = self.reached(text)
        return np.concatenate([np.log1p(total), np.log1p(100 * total / n), [np.log(n)]])


def calibrate(x: np.ndarray, y: np.ndarray, prior: float, *, rounds: int = 100, ridge: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and constant of a logistic function of features, moved from the sample's share of toxic texts to ``prior``."""
    mean, scale = x.mean(0), 1 / np.maximum(x.std(0), 1e-6)
    a = np.c_[(x - mean) * scale, np.ones(len(x))]
    w, cost = np.zeros(a.shape[1]), np.r_[np.full(a.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(cost), a.T @ (p - y) + cost * w)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    odds = lambda q: np.log(q / (1 - q))
    return mean, scale, w[:-1], float(w[-1] + odds(prior) - odds(y.mean()))


def dictionaries(texts: dict[int, list[bytes]]) -> tuple[bytes, bytes] | None:
    """The ordinary and the toxic dictionary of some texts by label."""
    spans = typical_spans(texts[1], typical_grams(texts[1], texts[0]))
    if not spans:
        return None
    random.Random(1).shuffle(spans)
    ordinary = train_dictionary(ORDINARY_DICTIONARY, [b[i : i + 512] for b in texts[0] for i in range(0, len(b), 512)])
    return ordinary, train_dictionary(TOXIC_DICTIONARY, [b"".join(spans[i : i + 8]) for i in range(0, len(spans), 8)])


def _prepared(rows: list[tuple[str, int]], prior: float):
    """The model of a sample in a fixed order; None without wording. Weights are learned on halves, with dictionaries of the other half."""
    each = {y: [normal(t) for t, k in rows if k == y] for y in (1, 0)}
    halves = [{y: v[k::2] for y, v in each.items()} for k in (0, 1)]
    x, y = [], []
    for own, other in (halves, halves[::-1]):
        both = dictionaries(own)
        if both is None:
            continue
        distance = Distance(*both)
        for k in (1, 0):
            x += [distance.features(t) for t in other[k]]
            y += [float(k)] * len(other[k])
    both = dictionaries(each)
    if both is None or len(set(y)) < 2:
        return None
    return *both, calibrate(np.array(x), np.array(y), prior)


def fit(train: DataFrame, labels: DataFrame, *, toxic_bytes: int = TOXIC_BYTES, ordinary_bytes: int = ORDINARY_BYTES, sample: int = LABELS):
    """``train``: doc_id, text of the training rows; ``labels``: doc_id, toxic. The model (None without one) and the share of toxic labels."""
    session(train.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = materialise(known, "labelled")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    if not n.get(1) or not n.get(0):
        return None, float(prior)
    place = unit_hash(F.col("id"), F.lit(17))
    some = known.withColumn("place", place).where(F.col("place") < F.when(F.col("toxic") == 1, sample / n[1]).otherwise(sample / n[0]))
    # the texts are sized where they are read; ids and sizes of a bounded number of labels come to the driver
    texts = train.join(F.broadcast(some), F.col("doc_id") == F.col("id")).groupBy("id", "toxic", "place").agg(F.min("text").alias("text"))
    texts = materialise(texts.withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))), "sample")
    sizes = sorted((r["place"], r["id"], r["toxic"], r["size"]) for r in texts.select("place", "id", "toxic", "size").collect())
    chosen = []
    for y, bound in ((1, toxic_bytes), (0, ordinary_bytes)):
        own = [r for r in sizes if r[2] == y]
        room, taken = bound, [r for r in own if 4 * r[3] <= bound] or own[:1]
        for r in taken:
            if room <= 0:
                break
            chosen.append(r[1])
            room -= r[3]
    ids = train.sparkSession.createDataFrame([(i,) for i in chosen], "chosen long")

    def learn(key, rows):
        rows = rows.sort_by([("place", "ascending"), ("id", "ascending")])
        model = _prepared(list(zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())), prior)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # one task: the sample is bounded
    rows = texts.join(F.broadcast(ids), F.col("id") == F.col("chosen")).select(F.lit(1).alias("all"), "place", "id", "text", "toxic")
    learned = rows.groupBy("all").applyInArrow(learn, "model binary").first()
    return (pickle.loads(learned["model"]) if learned else None), float(prior)


def predict(docs: DataFrame, model, prior: float, *, threshold: float = THRESHOLD, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, toxicity, predicted`` of every row; the columns ``keep`` in a struct ``kept_row``."""
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries and some weights
    name = ("toxicity", uuid.uuid4().hex)
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).cast("long").alias("doc_id"), *([whole_row(keep)] if keep else []))
    schema = StructType([*rows.schema.fields[1:], StructField("toxicity", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        for b in batches:
            if shared.value is None:
                s = np.full(b.num_rows, prior)
            else:
                ordinary, toxic, (mean, scale, w, constant) = shared.value
                distance = worker_memo(name, lambda: Distance(ordinary, toxic))
                x = np.array([distance.features(normal(t.as_py())) for t in b.column(0)]).reshape(b.num_rows, len(w))
                s = 1 / (1 + np.exp(-np.clip((x - mean) * scale @ w + constant, -30, 30)))
            cols = [pa.array(s.astype(float), pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*b.schema.names[1:], "toxicity", "predicted"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Learn from the rows outside fold ``held`` and score all: ``doc_id, held_out, toxicity, predicted``."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(fold("doc_id", folds) != held)
    model, prior = fit(train, labels.select("doc_id", "toxic").where(fold("doc_id", folds) != held), **options)
    return predict(docs, model, prior, keep=keep).withColumn("held_out", fold("doc_id", folds) == held)
