"""Quality classifier by positive-unlabelled learning.

Trusted positives are the training rows labelled good; all training texts,
whatever their label, are the unlabelled side. A small network minimises the
non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

with the logistic loss; where the second part turns negative its gradient is
reversed. The class prior is estimated from the labelled training rows where
they hold both classes, else by the mean score of a first classifier of
positives against unlabelled (the Elkan-Noto ratio).

A text is described by rates of byte classes and of pairs of byte classes, and
by its word and line statistics, over the whole text.

The network is fitted on samples by hash of at most about ``positives`` and
``unlabelled`` documents (documented bounds); scores cover all rows.

Cases: a null or empty text has a score, that of a text without words; a very
long text is read whole; without a positive label all scores are the prior 0.5;
several labels of one doc_id count as good if any is; repeated rows give a row
each and are one document of the samples, of several texts the least; a null
doc_id stays null, has no label and falls in the fold of the empty text; equal
scores are predicted alike; further columns are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import fold, materialise, session, unit_hash, whole_row, worker_cache

#: Bounds of the training samples (rows, in expectation).
POSITIVES = 6000
UNLABELLED = 12000
THRESHOLD = 0.3
PAIRS = 256
PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Byte -> class: lower, upper, digit, blank, line end, other control, beyond ASCII, each mark its own."""
    cache = worker_cache()
    if "byte classes" not in cache:
        table = np.full(256, 5, np.uint16)
        table[ord("a") : ord("z") + 1] = 0
        table[ord("A") : ord("Z") + 1] = 1
        table[ord("0") : ord("9") + 1] = 2
        table[[9, 11, 12, 13, 32]] = 3
        table[10] = 4
        table[128:] = 6
        marks = [b for b in range(33, 127) if not chr(b).isalnum()]
        table[marks] = np.arange(7, 7 + len(marks))
        cache["byte classes"] = table
    return cache["byte classes"]


N_CLASSES = 39
DIM = N_CLASSES + PAIRS + 12


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    one, two = np.zeros(N_CLASSES), np.zeros(PAIRS)
    for at in range(0, len(raw), PIECE):
        c = _classes()[np.frombuffer(raw[at : at + PIECE + 1], np.uint8)]
        one += np.bincount(c[:PIECE], minlength=N_CLASSES)
        pair = c[:-1].astype(np.uint32) * np.uint32(N_CLASSES) + c[1:]
        two += np.bincount(pair * np.uint32(2654435761) >> np.uint32(24), minlength=PAIRS)
    n = max(1, len(raw))
    words = raw.split()
    k = max(1, len(words))
    freq = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    extra = [
        np.log1p(len(words)), lengths.mean() / 10, lengths.std() / 10, np.log1p(lengths.max()),
        len(freq) / k, max(freq.values(), default=0) / k, repeated / k, np.sqrt(repeated / k),
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(k / max(1, len(lines))), float(not words),
    ]
    return np.concatenate([np.sqrt(one / n), np.sqrt(two / n), extra]).astype(np.float32)


class Network:
    """One hidden layer; scores are probabilities of the good class."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(np.clip((x - self.mean) * self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_network(p: np.ndarray, u: np.ndarray, prior: float, *, hidden: int = 16, epochs: int = 100, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on mini-batches of the non-negative unbiased risk, with a step size that falls linearly."""
    rng = np.random.default_rng(seed)
    mean, std = u.mean(0), u.std(0)
    scale = np.where(std > 1e-6, 1 / np.maximum(std, 1e-6), 0).astype(np.float32)
    xp, xu = (np.clip((x - mean) * scale, -8, 8).astype(np.float32) for x in (p, u))
    d = p.shape[1]
    par = [rng.normal(0, d**-0.5, (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, hidden).astype(np.float32), np.float32(np.log(prior / (1 - prior)))]
    m, v, t = [0 * x for x in par], [0 * x for x in par], 0
    size = max(1, min(256, len(xp), len(xu)))
    steps = max(20, len(xu) // (2 * size))
    for _ in range(epochs):
        for _ in range(steps):
            bp, bu = xp[rng.integers(0, len(xp), size)], xu[rng.integers(0, len(xu), 2 * size)]
            x = np.vstack([bp, bu])
            h = np.tanh(x @ par[0] + par[1])
            z = h @ par[2] + par[3]
            s = _sigmoid(z)
            good, rest = np.arange(len(x)) < len(bp), np.arange(len(x)) >= len(bp)
            minus = np.logaddexp(0, z)
            negative = minus[rest].mean() - prior * minus[good].mean()
            g = np.zeros(len(x), np.float32)
            sign = 1.0 if negative >= 0 else -1.0
            g[rest] = sign * s[rest] / len(bu)
            g[good] = -sign * prior * s[good] / len(bp) + (prior * (s[good] - 1) / len(bp) if negative >= 0 else 0)
            gh = np.outer(g, par[2]) * (1 - h * h)
            grads = [x.T @ gh + decay * par[0], gh.sum(0), h.T @ g + decay * par[2], g.sum()]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                par[i] = par[i] - rate * (1.02 - t / (epochs * steps)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, *par)


def _sampled_features(batches):
    for b in batches:
        got = [features(t.as_py()).tobytes() for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(got, pa.binary())], names=["good", "part", "x"])


def fit(train: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network | None, float]:
    """``train``: doc_id, text of the training rows; ``labels``: doc_id, quality. The network and the class prior."""
    session(train.sparkSession)
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    # labels meet ids alone; the texts of the samples follow by a broadcast of the sampled ids
    ids = materialise(train.select("doc_id").distinct().join(known, F.col("doc_id") == F.col("id"), "left").select("doc_id", "quality"), "labelled")
    counts = ids.agg(F.count("*").alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("p"), F.count("quality").alias("k")).first()
    if not counts["p"]:
        return None, 0.5
    share = lambda seed: unit_hash(F.col("doc_id"), F.lit(seed))
    as_p = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (share(11) < positives / counts["p"])
    part = F.when(as_p, 1).otherwise(0) + F.when(share(13) < unlabelled / counts["n"], 2).otherwise(0)
    sample = F.broadcast(ids.select(F.col("doc_id").alias("id"), part.alias("part")).where("part > 0").distinct())
    chosen = train.join(sample, F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("id", "part").agg(F.min("text").alias("text")).select("text", F.lit(0).alias("good"), "part")
    rows = chosen.mapInArrow(_sampled_features, "good int, part int, x binary").collect()
    x = np.vstack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, DIM), np.float32)
    parts = np.array([r["part"] for r in rows], int)
    p, u = x[(parts & 1) > 0], x[(parts & 2) > 0]
    if not len(p) or not len(u):
        return None, 0.5
    order = lambda a: a[np.lexsort(a[:, ::40].T)]  # noqa: E731  the sample's order doesn't depend on tasks
    p, u = order(p), order(u)
    if counts["k"] > counts["p"]:
        prior = counts["p"] / counts["k"]
    else:
        g = train_network(p, np.vstack([u, p]), len(p) / (len(p) + len(u)))
        prior = float(g.score(u).mean() / max(1e-6, g.score(p).mean()))
    prior = float(np.clip(prior, 0.05, 0.95))
    return train_network(p, u, prior), prior


def predict(docs: DataFrame, network: Network | None, prior: float, *, threshold: float = THRESHOLD, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, quality_score, predicted`` of every row; the columns ``keep`` in a struct ``kept_row``."""
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(network)  # DIM * 16 numbers
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).cast("long").alias("doc_id"), *([whole_row(keep)] if keep else []))
    schema = StructType([*rows.schema.fields[1:], StructField("quality_score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        net = shared.value
        for b in batches:
            n = b.num_rows
            if net is None or not n:
                s = np.full(n, prior)
            else:
                s = np.concatenate([net.score(np.vstack([features(t.as_py()) for t in b.column(0).slice(i, 256)])) for i in range(0, n, 256)])
            cols = [pa.array(s.astype(float), pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*b.schema.names[1:], "quality_score", "predicted"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 5, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Learn from the rows outside fold 0 and score all: ``doc_id, held_out, quality_score, predicted``."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(fold("doc_id", folds) != 0)
    network, prior = fit(train, labels.select("doc_id", "quality").where(fold("doc_id", folds) != 0), **options)
    return predict(docs, network, prior, keep=keep).withColumn("held_out", fold("doc_id", folds) == 0)
