"""Language identification by nearest centroid.

A text is a vector of its character bigrams and trigrams (letters lower-cased,
every run of other characters one blank), hashed into ``dim`` places, weighted
by TF-IDF and normalised. Each language has several centroids, found by
spherical k-means on its training texts; a text takes the language of the
centroid with the greatest cosine. A text that is much farther from it than
training passages of its length are, and than any whole training text of its
length or longer, is marked ``rejected``.

Document frequencies cover all training texts. The centroids are fitted on a
sample by hash of at most about ``sample_per_language`` texts a language, whole
texts, copies of a row once; the sample is a documented bound, not a part of
prediction. A language takes 64 kB of the model that every worker holds.

Cases: a text that is null or has no letter is ``und`` with score 0 and is
rejected, having no language; without any training text all are ``und``; a very
long text is counted whole, piece by piece; of languages with equal cosines the
first by name is taken; repeated rows give a row each; a null doc_id stays null
and falls in the fold of the empty text; further columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import fold, session, unit_hash, whole_row, worker_cache

DIM = 4096
CLUSTERS = 4
#: Bound of the training sample, texts a language (in expectation).
SAMPLE_PER_LANGUAGE = 400
#: A text is rejected below this share of the median cosine of training passages of its length, or of the least cosine of a
#: whole training text of its length or longer, whichever is lower.
MEDIAN_SHARE, LEAST_SHARE = 0.4, 0.9
#: Passages of a length that are drawn from each text of the sample.
PASSAGES = 2
PIECE = 1 << 20
SHARPNESS = 20.0


def _letters() -> np.ndarray:
    """For each code point: itself lower-cased where it is a letter, else 0."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def ngram_counts(text: str, dim: int) -> np.ndarray | None:
    """Hashed counts of letter bigrams and trigrams; None without a letter."""
    letters, total = _letters(), None
    for at in range(0, len(text), PIECE):
        raw = text[at : at + PIECE + 2].lower().encode("utf-32-le", "surrogatepass")
        a = np.frombuffer(raw, np.uint32)
        is_letter = letters[np.minimum(a, 0x10FFFF)]
        if not is_letter.any():
            continue
        a = np.where(is_letter, a, np.uint32(0))
        a = np.concatenate(([np.uint32(0)], a[is_letter | np.concatenate(([True], is_letter[:-1]))], [np.uint32(0)]))
        two = a[:-1] * np.uint32(2654435761) ^ a[1:] * np.uint32(2246822519)
        three = two[:-1] * np.uint32(3266489917) ^ a[2:] * np.uint32(668265263)
        shift = np.uint32(32 - (dim.bit_length() - 1))
        h = np.concatenate((two, three)) * np.uint32(374761393) >> shift
        counts = np.bincount(h, minlength=dim)
        total = counts if total is None else total + counts
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def _document_frequencies(batches, dim: int):
    n, df = 0, np.zeros(dim, np.int64)
    for batch in batches:
        for t in batch.column(0):
            c = ngram_counts(t.as_py() or "", dim)
            if c is not None:
                n += 1
                df += c > 0
    if n:
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], names=["place", "n"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of the rows of x: the first is the mean's direction, the next the rows farthest from those chosen."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    centres = unit(x.mean(0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(1))]])
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        centres = unit(np.vstack([x[nearest == j].mean(0) if (nearest == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def _fit_language(rows: pd.DataFrame, idf: np.ndarray, clusters: int) -> pd.DataFrame:
    found = [(c, math.floor(math.log2(c.sum()))) for t in rows["text"] if (c := ngram_counts(t, len(idf))) is not None]
    if not found:
        return pd.DataFrame({"lang": [], "centroid": [], "least": []})
    x = np.vstack([vector(c, idf) for c, _ in found])
    centres = spherical_kmeans(x, clusters)
    cos, bins = (x @ centres.T).max(1), np.array([b for _, b in found])
    # how near passages of the language come by their length: a short one has few of a centroid's n-grams
    rng, near = np.random.default_rng(0), [[] for _ in range(40)]
    for t in sorted(rows["text"]):
        size = 4
        while size <= len(t):
            for at in rng.integers(0, len(t) - size + 1, PASSAGES):
                if (c := ngram_counts(t[at : at + size], len(idf))) is not None:
                    near[int(math.log2(c.sum()))].append(float((centres @ vector(c, idf)).max()))
            size *= 2
    for b, c in zip(bins, cos):
        near[b].append(float(c))
    least, last = [], 0.0
    for b in range(40):
        last = max(last, float(np.median(near[b]))) if near[b] else last
        whole = cos[bins >= b] if (bins >= b).any() else cos[bins == bins.max()]
        least.append(min(MEDIAN_SHARE * last, LEAST_SHARE * float(whole.min())))
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centres], "least": [least] * len(centres)})


class Model:
    """Centroids by language, IDF weights, the cosines by length below which a text is rejected."""

    def __init__(self, langs: list[str], owner: np.ndarray, centroids: np.ndarray, least: np.ndarray, idf: np.ndarray):
        self.langs, self.owner, self.centroids, self.least, self.idf = langs, owner, centroids, least, idf


def fit(train: DataFrame, *, dim: int = DIM, clusters: int = CLUSTERS, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """``train``: doc_id, text, lang, of the training rows alone."""
    train = train.where("text is not null and lang is not null")
    session(train.sparkSession)
    counted = train.select("text").mapInArrow(lambda it: _document_frequencies(it, dim), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    n = next((r["n"] for r in counted if r["place"] < 0), 0)
    df = np.zeros(dim)
    for r in counted:
        if r["place"] >= 0:
            df[r["place"]] = r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    mark = unit_hash(F.col("doc_id"), F.col("text"))
    sizes = train.select("lang", mark.alias("mark")).distinct().groupBy("lang").agg(F.count("*").alias("size"))
    chosen = train.withColumn("mark", mark).join(F.broadcast(sizes), "lang").where(F.col("mark") < F.lit(float(sample_per_language)) / F.col("size"))
    sample = chosen.dropDuplicates(["lang", "mark"]).select("lang", "text")
    fitted = sample.groupBy("lang").applyInPandas(lambda rows: _fit_language(rows, idf, clusters), "lang string, centroid binary, least array<double>")
    rows = fitted.collect()
    langs = sorted({r["lang"] for r in rows})
    rows.sort(key=lambda r: (r["lang"], r["centroid"]))
    owner = np.array([langs.index(r["lang"]) for r in rows], int)
    centroids = np.vstack([np.frombuffer(r["centroid"], np.float32) for r in rows]) if rows else np.zeros((0, dim), np.float32)
    least = np.array([next(r["least"] for r in rows if r["lang"] == x) for x in langs])
    return Model(langs, owner, centroids, least, idf)


def classify(text: str | None, m: Model, margin: float) -> tuple[str, float, bool]:
    counts = ngram_counts(text, len(m.idf)) if text else None
    if counts is None or not m.langs:
        return "und", 0.0, True
    cos = m.centroids @ vector(counts, m.idf)
    best = np.full(len(m.langs), -1.0)
    np.maximum.at(best, m.owner, cos)
    k = int(best.argmax())
    score = 1.0 / np.exp(SHARPNESS * (best - best[k])).sum()
    length = min(39, int(math.log2(counts.sum())))
    far = best[k] < margin * m.least[k][length]
    return m.langs[k], float(score), bool(far)


def predict(docs: DataFrame, model: Model, *, margin: float = 1.0, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row; the columns ``keep`` in a struct ``kept_row``."""
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # CLUSTERS centroids of DIM numbers a language
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).cast("long").alias("doc_id"), *([whole_row(keep)] if keep else []))
    schema = StructType([*rows.schema.fields[1:], StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches):
        m = shared.value
        for b in batches:
            got = [classify(t.as_py(), m, margin) for t in b.column(0)]
            cols = [pa.array(list(c), t) for c, t in zip(zip(*got), (pa.string(), pa.float64(), pa.bool_()))] if got else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*b.schema.names[1:], "lang_pred", "lang_score", "rejected"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, *, folds: int = 5, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Learn from the rows outside fold 0 and predict all: ``doc_id, held_out, lang_pred, lang_score, rejected``."""
    train = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(fold("doc_id", folds) != 0)
    out = predict(docs, fit(train, **options), keep=keep)
    return out.withColumn("held_out", fold("doc_id", folds) == 0)
