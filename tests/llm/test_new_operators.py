"""Hard negatives, collocations, toxicity and language rejection against slow versions and held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loamgrid.llm import hard_negatives, language_id, phrases, toxicity
from loamgrid.llm import queries as Q
from tests.llm.common import LOREM
from tests.oracle import connect, rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_collocations"])
def test_same_as_sql(spark, name):
    got = rows(Q.QUERIES[name](spark, SMALL).toPandas())
    assert got == rows(connect(SMALL).sql(Q.ORACLE_SQL[name]).arrow().read_all().to_pandas())


def slow_negatives(ids, x, labels, anchors, k=5, m=10, low=30, high=90):
    x = np.vectorize(int, otypes=[object])(np.floor(256 * x))
    out = []
    for a in anchors:
        s = [int(v) for v in x @ x[a]]
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))
        for p in [j for j in order if labels[j] == labels[a] and j != a][:k]:
            fits = [j for j in order if labels[j] != labels[a] and low * s[p] <= 100 * s[j] <= high * s[p]][:m]
            out += [(ids[a], ids[p], r + 1, ids[j], s[p], s[j]) for r, j in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("spread,scale", [(0.05, 1.0), (1.0, 1.0), (0.3, 1e5)])
def test_hard_negatives(spark, spread, scale):
    """Tight and wide clusters, many ties and copies, and products beyond 2**53; many small groups and blocks."""
    rng = np.random.default_rng(6)
    n, centres = 600, rng.normal(size=(6, 5))
    labels = rng.integers(0, 4, n)
    x = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, 5))
    x[:200] = np.round(x[:200])
    x[200:280] = x[200]
    x = x * scale
    ids = [int(i) * 5 for i in rng.permutation(n)]
    d = spark.createDataFrame([(i, [float(v) for v in r], int(y)) for i, r, y in zip(ids, x, labels)], "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine_negatives(d, F.col("vec_id") % 100 == 0, anchors_a_pivot=3, group_anchors=4, block_rows=90, sample=50)
    want = slow_negatives(ids, x, labels, [k for k, i in enumerate(ids) if i % 100 == 0])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_bounds_leave_rows_out(spark):
    """On tight clusters the bounds send a row to few of the groups."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, 50, axis=0) + 0.01 * rng.normal(size=(600, 8))
    space = hard_negatives.Space(np.floor(256 * centres), 300.0, 8, "int16", True)
    q = np.floor(256 * x).astype(np.int16)
    d = space.to_pivots(space.lifted(q))
    own = d[np.arange(600), np.repeat(np.arange(12), 50)]
    assert (d.argmin(1) == np.repeat(np.arange(12), 50)).all() and own.max() < 0.5 * np.sort(d, axis=1)[:, 1].min()
    s = space.scores(q[:5], q)
    assert np.allclose(space.distance_of(s[0], np.repeat(q[:1], 600, axis=0)), np.linalg.norm(space.stretched(q[:1]) - space.lifted(q), axis=1), atol=1e-6)


def slow_collocations(docs, minimum, longest, top, percent=100):
    n, f = Counter(), Counter()
    for lang, text in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else "\n" if c in ".,;:!?\n\x0b\x0c\r" else c for c in text or "")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= minimum}
    out = []
    for lang in {p[0] for p in f}:
        found = []
        for (of, w), a in f.items():
            if of != lang or len(w) < 2:
                continue
            inside = any(of == o and len(v) > len(w) and 100 * c >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), c in f.items())
            if not inside:
                cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("minimum,block,bits", [(3, 40, 12), (12, 10**6, 20), (300, 500, 12)])
def test_collocations(spark, minimum, block, bits):
    """Few buckets that nearly all are full, or many; small blocks or one."""
    rng = np.random.default_rng(2)
    words = LOREM[:9] + ["É", "été", "A", "a-b", "\x00", "\xa0"]
    docs = [(str(rng.choice(["en", "fr", "x"])) if i % 5 else None, "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "?", "\x0b", "\r\n"])) for _ in range(int(rng.integers(0, 60))))) for i in range(150)] + [("en", None), ("fr", "")]
    d = spark.createDataFrame(docs, "lang string, text string")
    got = phrases.collocations(d.repartition(3), minimum=minimum, top=40, block_words=block, least_bits=bits, most_bits=bits)
    want = slow_collocations(docs, minimum, 5, 40)
    assert sorted(map(tuple, got.collect())) == want and (want or minimum > 100)


def test_collocation_scores_beyond_64_bits(spark):
    """The query's arithmetic on counts of a large corpus."""
    a, n, left, right = 3 * 10**12 + 7, 10**15 + 3, 4 * 10**12 + 1, 5 * 10**12 + 9
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    got = row.select(F.expr("(1000BD * (cast(a AS decimal(19,0)) * cast(n AS decimal(19,0)))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))").alias("s")).first()["s"]
    assert got == 1000 * a * n // (left * right)


def test_equal_hashes_are_told_apart(spark):
    block = phrases._Block.__new__(phrases._Block)
    block.ids = np.array([1, 2, 0, 2, 1, 0, 1, 2], np.uint32)
    places = np.array([0, 3, 6])
    first, n = block.distinct(places, np.zeros(3, np.uint64), 2)
    assert sorted(zip(first.tolist(), n.tolist())) == [(0, 2), (3, 1)]


def toxic_corpus(spark, n=1600):
    """Texts of random syllables; a fifth hold words of a few stems with changing ends, which other texts never hold."""
    rng = np.random.default_rng(3)
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "e", "i", "o", "un", "est")]
    stems = ["grobz", "vilkor", "snarpe"]
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(40, 160)))]
        toxic = i % 5 == 0
        for _ in range(int(rng.integers(2, 6)) if toxic else 0):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(stems)) + str(rng.choice(syllables)))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_texts_are_found(spark):
    d, labels = toxic_corpus(spark)
    r = toxicity.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in r) and len(r) > 300
    found = [x["predicted"] for x in r if x["toxic"]]
    false = [x["predicted"] for x in r if not x["toxic"]]
    assert np.mean(found) > 0.9 and np.mean(false) < 0.05
    assert all((x["toxicity"] >= 0.3) == bool(x["predicted"]) and 0 <= x["toxicity"] <= 1 for x in r)


def test_held_out_labels_are_never_read(spark):
    """Turning the labels of the held-out fold changes no score."""
    d, labels = toxic_corpus(spark, 500)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({x["doc_id"]: x["toxicity"] for x in toxicity.classify(d, y).collect()} for y in (labels, turned))
    assert a == b and len(set(a.values())) > 10


def test_windows_and_grams_by_hand():
    """Windows cover every byte, long texts in pieces give the same counts, and grams count surroundings once."""
    text = b"x" * 10 + b"abcdefgh" * 400
    d = toxicity.Distance(b"ordinary words of all kinds " * 20, b"abcdefgh" * 10)
    total, n = d.reached(text)
    starts = range(0, len(text), toxicity.STEP)
    windows = [text[i : i + toxicity.WINDOW] for i in starts][:n]
    assert set(range(len(text))) == {k for i in list(starts)[:n] for k in range(i, min(len(text), i + toxicity.WINDOW))}
    gains = [len(d.ordinary(w + toxicity.FILL)) - len(d.toxic(w + toxicity.FILL)) for w in windows]
    assert total.tolist() == [sum(g >= t for g in gains) for t in toxicity.THRESHOLDS]
    texts = [b"12345678 hello 12345678", b"12345678 hello 12345678", b"abcdefgh hello 12345678", b"hi"]
    grams, counts = toxicity.grams_by_surroundings(texts)
    slow = {}
    for t in texts:
        padded = bytes(toxicity.SIDE) + t + bytes(toxicity.SIDE)
        for i in range(len(t) - toxicity.GRAM + 1):
            k = i + toxicity.SIDE
            slow.setdefault(t[i : i + toxicity.GRAM], set()).add((padded[k - toxicity.SIDE : k], padded[k + toxicity.GRAM : k + toxicity.GRAM + toxicity.SIDE]))
    assert {int(g).to_bytes(toxicity.GRAM, "big"): int(c) for g, c in zip(grams, counts)} == {g: len(s) for g, s in slow.items()}
    assert isinstance(toxicity.train_dictionary(100, [b"too few"]), bytes) and zstandard.__version__


ITALIAN = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura. Tant è amara che poco è più morte ma per trattar del ben ch io vi trovai dirò de l altre cose"
DUTCH = "Ik ben makelaar in koffi en woon op de Lauriergracht. Het is mijn gewoonte niet romans te schrijven of zulke dingen en het heeft dan ook lang geduurd voor ik er toe overging een paar riem papier extra te bestellen en het werk aan te vangen dat gij lieve lezer in de hand hebt genomen"


def test_related_languages_are_rejected(spark):
    """Passages of languages that weren't learned, at every length from 60 characters; learned texts of any length stay."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "text", "lang"))
    for text in (ITALIAN, DUTCH):
        for n in (60, 120, 240):
            assert language_id.classify(text[:n], model, 1.0)[2], text[:n]
    held = d.where("text is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("text", "lang").collect()
    got = [language_id.classify(r["text"], model, 1.0) for r in held]
    assert np.mean([g[2] for g in got]) < 0.002 and np.mean([g[0] == r["lang"] for g, r in zip(got, held)]) > 0.99


def slow_language(text, m):
    """The same by loops: letters lower-cased, other runs one mark; hashes of bigrams and trigrams; the nearest centroid."""
    marks, last = [0], True
    for c in text.lower():
        if c.isalpha():
            marks.append(ord(c))
            last = False
        elif not last:
            marks.append(0)
            last = True
    marks.append(0)
    mask, counts = 2**32 - 1, Counter()
    two = [(marks[i] * 2654435761 & mask) ^ (marks[i + 1] * 2246822519 & mask) for i in range(len(marks) - 1)]
    three = [(two[i] * 3266489917 & mask) ^ (marks[i + 2] * 668265263 & mask) for i in range(len(marks) - 2)]
    for h in two + three:
        counts[(h * 374761393 & mask) >> (32 - (len(m.idf).bit_length() - 1))] += 1
    v = {k: math.log1p(c) * float(m.idf[k]) for k, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    cos = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in m.centroids]
    best = [max(c for c, o in zip(cos, m.owner) if o == j) for j in range(len(m.langs))]
    j = max(range(len(best)), key=lambda j: (best[j], -j))
    return m.langs[j], 1 / sum(math.exp(language_id.SHARPNESS * (b - best[j])) for b in best)


def test_language_by_loops(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(d.select("doc_id", "text", "lang"), sample_per_language=30)
    for r in d.where("text is not null").orderBy("doc_id").limit(25).collect():
        got = language_id.classify(r["text"], model, 1.0)
        want = slow_language(r["text"], model)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-4)
