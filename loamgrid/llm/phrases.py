"""Collocations by hash-pruned counting of contiguous phrases (the PCY and DHP algorithms).

Texts are coded once in blocks: a vocabulary of (language, word) and the words'
numbers, with a mark between pieces. Then a pass for each length k

* counts those k-word phrases that can be frequent: their bucket reached the
  minimum in the pass before, and both their (k-1)-word parts are frequent;
* counts, by hash, the buckets of all (k+1)-word phrases both of whose parts are
  counted in this pass.

The first pass only counts the buckets of words. Two bitmaps steer a pass, the
frequent buckets and the hashes of the frequent phrases one word shorter. Both are
broadcast and bounded: a quarter of a bit for each word of the corpus, 2**28 bits
at most; where more words make all buckets full, the pruning gets weaker and the
counts stay the same. Bitmaps only leave out phrases that can't be frequent, what
is left is counted by its words, so all counts are exact.

Phrases and buckets are dealt to slices by hash. A block sends one row to a slice:
the different phrases it counted there and the buckets it saw there, whose counts
stop at the minimum. A slice adds its rows up one by one. So no row moves for a
word or a phrase, no phrase is hot, and the rows are blocks times slices; there are
2**16 slices at most.

Cases: a null text is empty, a null language is ``und``; a text without words has
no phrase; repeated rows count again; a very long text is spread over blocks by
pieces, a piece is held whole; equal scores go by count, then by the phrase's
bytes; a language with few phrases returns them all; further columns are ignored,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, session

LONGEST = 5
MINIMUM = 100
TOP = 2000
#: Words of a block, about.
BLOCK_WORDS = 5_000_000
#: Exponents of the number of buckets.
LEAST_BITS, MOST_BITS = 20, 28
#: Rows of counts, and of languages, that are broadcast at most.
BROADCAST_COUNTS, BROADCAST_LANGS = 300_000, 50_000
#: Parts of a language that are ranked by themselves before the language is.
PARTS = 32

#: Fixed by the definition of a piece: ``[.,;:!?\\x0A-\\x0D]`` ends one; words are what blanks and tabs part.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)

BLOCK_SCHEMA = "n_words long, langs array<string>, totals array<long>, word_langs binary, words binary, ids binary"
SLICE_SCHEMA = "slice int, phrases binary, counts binary, steps binary, many binary"
FOUND_SCHEMA = "slice int, bits binary, lang string, phrase string, f long, hash long"


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _squeeze_planes(a: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, which compress apart from each other."""
    return _squeeze(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _expand_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_expand(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _squeeze_bytes(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _expand(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


class _Coder:
    """Texts of a block as numbers: 0 ends a piece, words count from 1 in order of appearance, apart for each language."""

    def __init__(self):
        self.langs: dict[str, tuple[dict, int]] = {}
        self.words: list[bytes] = []
        self.word_langs, self.ids, self.n_words = array("I"), array("I"), 0
        self.totals: list[int] = []

    def numbers(self, lang: str):
        if lang not in self.langs:
            coder, k = self, len(self.langs)

            class Numbers(dict):
                def __missing__(self, word):
                    coder.words.append(word)
                    coder.word_langs.append(k)
                    n = self[word] = len(coder.words)
                    return n

            self.langs[lang] = Numbers(), k
            self.totals.append(0)
        return self.langs[lang]

    def row(self) -> pa.RecordBatch:
        joined = _squeeze_bytes(b"\n".join(self.words))
        cols = [[self.n_words], [list(self.langs)], [self.totals], [_squeeze(np.frombuffer(self.word_langs, np.uint32))], [joined], [_squeeze_planes(np.frombuffer(self.ids, np.uint32))]]
        types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])


def _code(batches, block_words: int):
    block = _Coder()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            numbers, k = block.numbers(lang)
            for piece in text.as_py().lower().translate(ENDS).split(b"\n"):
                words = piece.split()
                if not words:
                    continue
                block.ids.extend(map(numbers.__getitem__, words))
                block.ids.append(0)
                block.n_words += len(words)
                block.totals[k] += len(words)
                if block.n_words >= block_words:
                    yield block.row()
                    block = _Coder()
                    numbers, k = block.numbers(lang)
    if block.n_words:
        yield block.row()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ a >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _bits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; the number of bits is a power of two."""
    at = h & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Block:
    """A block's words and the hashes of its phrases of each length."""

    def __init__(self, r: dict):
        self.word_langs = _expand(r["word_langs"], np.uint32)
        self.words = zstandard.ZstdDecompressor().decompress(r["words"]).split(b"\n")
        self.ids = _expand_planes(r["ids"])
        self.names = [x.encode("utf-8", "surrogatepass").replace(b"%", b"%25").replace(b"\n", b"%0A") for x in r["langs"]]
        one = [0, *(xxhash.xxh3_64_intdigest(self.names[k] + b"\n" + w) for k, w in zip(self.word_langs, self.words))]
        self.one = np.array(one, np.uint64)[self.ids]

    def phrases(self, k: int):
        """(hash, whether all k words lie in one piece) at each place but the last k - 1; and the same for k + 1."""
        h, whole = self.one, self.ids > 0
        for j in range(1, k):
            h, whole = _mix(h[:-1], self.one[j:]), whole[:-1] & (self.ids[j:] > 0)
        longer = _mix(h[:-1], self.one[k:]), whole[:-1] & (self.ids[k:] > 0)
        return (h, whole), longer

    def distinct(self, places: np.ndarray, h: np.ndarray, k: int):
        """First place and number of each different phrase among those that start at ``places``; ``h``: their hashes."""
        _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        same = places[first][inverse]
        if any((self.ids[places + j] != self.ids[same + j]).any() for j in range(k)):  # two phrases share a hash
            rows = np.stack([self.ids[places + j] for j in range(k)], axis=1)
            _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
        return places[first], n

    def key(self, place: int, k: int) -> bytes:
        """Language, a tab, and the words of a phrase; a word holds neither blank, tab nor line end."""
        w = self.ids[place : place + k].tolist()
        return self.names[self.word_langs[w[0] - 1]] + b"\t" + b" ".join([self.words[x - 1] for x in w])


def _pass(batches, k: int, longest: int, minimum: int, n_buckets: int, n_slices: int, buckets, shorter):
    """A block's row for each slice; ``buckets``: bitmap of the frequent buckets of length k, ``shorter``: that of the frequent phrases of k - 1 words."""
    names = [x.split()[0] for x in SLICE_SCHEMA.split(", ")]
    types = [pa.int32(), *[pa.binary()] * 4]
    width = np.uint64(n_buckets // n_slices)
    cut = lambda places: np.searchsorted(places, np.arange(n_slices + 1, dtype=np.uint64) * width)
    for b in batches:
        for r in b.to_pylist():
            block = _Block(r)
            first, counts, at = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
            if k == 0:
                longer, next_ok = block.one, block.ids > 0
            else:
                (h, counted), (longer, next_ok) = block.phrases(k)
                if k > 1:
                    (before, whole), _ = block.phrases(k - 1)
                    known = whole & _bits(shorter, before)
                    counted = counted & known[:-1] & known[1:]
                counted = counted & _bits(buckets, h)
                places = np.flatnonzero(counted)
                first, counts = block.distinct(places, h[places], k)
                at = h[first] & np.uint64(n_buckets - 1)
                order = np.argsort(at, kind="stable")
                first, counts, at = first[order], counts[order], at[order]
                next_ok = next_ok & counted[:-1] & counted[1:]
            bucket, many = np.zeros(0, np.uint64), np.zeros(0, int)
            if k < longest:
                bucket, many = np.unique(longer[next_ok] & np.uint64(n_buckets - 1), return_counts=True)
                many = np.minimum(many, minimum).astype(_small(minimum))
            own, next_own = cut(at), cut(bucket)
            rows = []
            for x in np.flatnonzero(np.diff(own) + np.diff(next_own)):
                f, n = first[own[x] : own[x + 1]], counts[own[x] : own[x + 1]]
                phrases = sorted((block.key(p, k), c) for p, c in zip(f.tolist(), n.tolist()))
                steps = np.diff(bucket[next_own[x] : next_own[x + 1]], prepend=np.uint64(x) * width)
                packed = _squeeze_bytes(b"\n".join([p for p, _ in phrases])) if phrases else None
                rows.append((x, packed, _squeeze_planes(np.array([c for _, c in phrases])), _squeeze_planes(steps), _squeeze(many[next_own[x] : next_own[x + 1]])))
                if len(rows) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def _small(minimum: int):
    return np.uint32 if minimum > 255 else np.uint8


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Hashes of phrases, equal to those that blocks give them."""
    out, by_length = np.zeros(len(keys), np.uint64), {}
    for i, key in enumerate(keys):
        by_length.setdefault(key.count(b" "), []).append(i)
    for k, places in by_length.items():
        parts = [key.rsplit(b"\t", 1) for key in (keys[i] for i in places)]
        words = np.array([[xxhash.xxh3_64_intdigest(lang + b"\n" + w) for w in phrase.split(b" ")] for lang, phrase in parts], np.uint64)
        h = words[:, 0]
        for j in range(1, k + 1):
            h = _mix(h, words[:, j])
        out[places] = h
    return out


def _merged(minimum: int, width: int):
    from collections.abc import Iterator

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's frequent phrases, and the bitmap of its frequent buckets."""
        total, sums = np.zeros(width, np.int64), {}
        for b in batches:
            for phrases, counts, steps, many in zip(b.column("phrases"), b.column("counts"), b.column("steps"), b.column("many")):
                if phrases.is_valid:
                    keys = zstandard.ZstdDecompressor().decompress(phrases.as_py()).split(b"\n")
                    for p, n in zip(keys, _expand_planes(counts.as_py()).tolist()):
                        sums[p] = sums.get(p, 0) + n
                at = np.cumsum(_expand_planes(steps.as_py()).astype(np.int64))
                total[at] += _expand(many.as_py(), _small(minimum))  # a bucket is once in a row
        bits = np.packbits(total >= minimum, bitorder="little").tobytes()
        slice_ = key[0].as_py()
        schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64()), ("hash", pa.int64())])
        one = [[slice_], [bits], [None], [None], [None], [None]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, schema)], schema=schema)
        found = [p for p, n in sums.items() if n >= minimum]
        for i in range(0, len(found), 20_000):
            some = found[i : i + 20_000]
            langs, phrases = zip(*(p.rsplit(b"\t", 1) for p in some))
            text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
            none = [None] * len(some)
            cols = [pa.array(none, pa.int32()), pa.array(none, pa.binary()), text([x.replace(b"%0A", b"\n").replace(b"%25", b"%") for x in langs]), text(list(phrases)), pa.array([sums[p] for p in some], pa.int64()), pa.array(_hashes(some).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    merge.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return merge


def _power(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n)))))


def count_phrases(docs: DataFrame, *, minimum: int = MINIMUM, longest: int = LONGEST, block_words: int = BLOCK_WORDS, least_bits: int = LEAST_BITS, most_bits: int = MOST_BITS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, f`` of all phrases of 1 to ``longest`` words that occur ``minimum`` times or more; ``lang, n``: all words."""
    spark = session(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    blocks = materialise(docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(lambda it: _code(it, block_words), BLOCK_SCHEMA), "blocks", codec="none")
    each = blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    totals = materialise(each.where("n > 0"), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    n_bits = min(max(_power(words / 4), least_bits), most_bits)
    n_slices = 2 ** min(max(_power(words / 2**20), 4), 16, n_bits - 6)
    n_buckets, width = 2**n_bits, 2**n_bits // n_slices
    steer, found = spark.sparkContext.broadcast((None, None)), []
    for k in range(longest + 1):

        def step(it, k=k, steer=steer):
            return _pass(it, k, longest, minimum, n_buckets, n_slices, *steer.value)

        made = blocks.mapInArrow(step, SLICE_SCHEMA).groupBy("slice").applyInArrow(_merged(minimum, width), FOUND_SCHEMA)
        made = materialise(made, f"pass{k}")
        shorter = None
        if k:
            found.append(made.where("slice is null").select("lang", F.lit(k).alias("k"), "phrase", "f", "hash"))
            place = F.col("hash").bitwiseAND(n_buckets - 1) + 1  # such bitmaps count from 1
            bits = found[-1].groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
            shorter = np.zeros(max(n_buckets // 8, 4096), np.uint8)
            for r in bits.collect():  # 4,096 bytes for each 32,768 bits of a bounded bitmap
                shorter[4096 * (r["part"] - 1) : 4096 * r["part"]] = np.frombuffer(r["bits"], np.uint8)
            shorter = shorter[: n_buckets // 8]
        if k < longest:
            bitmap = np.zeros(n_buckets // 8, np.uint8)
            for r in made.where("slice is not null").select("slice", "bits").collect():  # bounded likewise
                bitmap[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
            steer = spark.sparkContext.broadcast((bitmap, shorter))
    counts = found[0]
    for x in found[1:]:
        counts = counts.union(x)
    return counts.drop("hash"), totals


def collocations(docs: DataFrame, *, minimum: int = MINIMUM, longest: int = LONGEST, top: int = TOP, percent: int = 100, broadcast_counts: int = BROADCAST_COUNTS, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases of the highest scores.

    A phrase of count ``a`` that is cut into parts of counts l and r has the score ``floor(1000 * a * n / (l * r))``; its
    lowest-scoring cut counts. Phrases inside a longer one of at least ``percent`` of their count are left out. Products
    are exact up to 38 digits.
    """
    counts, totals = count_phrases(docs, minimum=minimum, longest=longest, **options)
    small = counts.limit(broadcast_counts + 1).count() <= broadcast_counts
    near = F.broadcast if small else (lambda x: x)
    few = F.broadcast if totals.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else (lambda x: x)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    long = counts.where("k > 1").withColumn("w", words)
    cut = long.select("lang", "phrase", "k", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, out: near(counts.select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(out)))
    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(few(totals), "lang")
    score = "(1000BD * (cast(a AS decimal(19,0)) * cast(n AS decimal(19,0)))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    cut = cut.withColumn("score", F.expr(score))
    worst = F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut"))
    scored = cut.groupBy("lang", "phrase").agg(worst.alias("x")).select("lang", "phrase", "x.*")
    inner = long.where("k > 2").select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    covered = inner.groupBy("lang", part(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored.join(covered, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(percent)} * a").drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.hash("phrase"), F.lit(PARTS))
    best = left.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(minimum: int = MINIMUM, longest: int = LONGEST, top: int = TOP) -> str:
    """The same in SQL, by counting all phrases."""
    upper = "".join(map(chr, range(65, 91)))
    marks = r"'[.,;:!?\n\x0b\f\r]'"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, longest + 1))
    parts = " UNION ALL ".join(f"SELECT lang, phrase, f, string_split(phrase, ' ') AS w, {c} AS cut FROM f WHERE k > {c}" for c in range(1, longest))
    inside = " UNION ALL ".join(f"SELECT lang, f, array_to_string(string_split(phrase, ' ')[{at}:{at + m - 1}], ' ') AS phrase FROM f WHERE k = {k}" for k in range(3, longest + 1) for m in range(2, k) for at in range(1, k - m + 2))
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{upper.lower()}'), {marks})) AS piece FROM documents WHERE text IS NOT NULL),
 p AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \\t]+') IF x <> ''] AS w FROM d),
 n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
 f AS (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {minimum}),
 c AS (SELECT x.lang, x.phrase, x.f AS a, cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * x.f * n.n) // (l.f::HUGEINT * r.f) AS score FROM ({parts}) x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = x.lang),
 s AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS low FROM c),
 i AS (SELECT lang, phrase, max(f) AS longer FROM ({inside}) GROUP BY ALL)
 SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE low = 1 AND (longer IS NULL OR longer < a)) WHERE rank <= {top}"""
