"""What the text operators share: the shared folder, worker caches, folds."""

from __future__ import annotations

import re
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise, new_path, shared_dir  # noqa: F401

#: White space of the word definition ``[^\x20\x09-\x0D]+`` (fixed values).
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Bytes of an Arrow batch sent to a Python worker; bounds a worker's memory where texts are long.
BATCH_BYTES = 8 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000


def without(rows: DataFrame, ids: DataFrame, col: str = "doc_id") -> DataFrame:
    """The rows whose id is not listed; the list is broadcast where it is short, else joined."""
    gone = "gone"
    while gone in {c.lower() for c in rows.columns}:
        gone += "_"
    ids = materialise(ids.select(F.col(col).alias(gone)).where(F.col(gone).isNotNull()).distinct(), "ids")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col(col) == F.col(gone), "left_anti")


def whole_row(columns) -> Column:
    """The columns, of whatever names, as one struct ``kept_row``."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in columns)).alias("kept_row")


def unit_hash(*columns: Column) -> Column:
    """A number from 0 to 1 by hash, fine enough for any table; null counts as the empty text."""
    return F.shiftrightunsigned(F.xxhash64(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 1) / F.lit(2.0**63)


def fold(doc_id: Column | str, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    m = sys.modules.get("_loamgrid_worker")
    if m is None:
        m = sys.modules["_loamgrid_worker"] = types.ModuleType("_loamgrid_worker")
        m.cache = {}
    return m.cache


def worker_memo(name, make):
    """The worker's one lookup table: that of another operator is dropped, so tables don't add up in a pipeline."""
    cache = worker_cache()
    if cache.get("memo name") != name:
        cache["memo name"], cache["memo"] = name, None
        cache["memo"] = make()
    return cache["memo"]


def load_tokenizer(path: str):
    """The tokenizer of a .json file, loaded once in a worker, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache()
    if path not in cache:
        from tokenizers import Tokenizer

        cache[path] = Tokenizer.from_file(path)
    return cache[path]


#: A run that byte-level splitters cut in two at most: Latin letters (after a blank or not), then marks.
PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*()|-]*)")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
