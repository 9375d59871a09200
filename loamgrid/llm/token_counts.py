"""Token counts without token ids.

Pieces are counted once for each distinct pre-token of a worker's share of the
corpus; the counts are joined (a hash join inside the worker) to the
pre-token frequencies of each document and summed. Ids are never kept.

A pre-token here is a run that starts at a space followed by a visible
character. A byte-level tokenizer always cuts at such a place, so a run's count
doesn't depend on its neighbours.

Cases: a null or empty text has 0 tokens; a very long text is counted whole;
nothing is ranked, so there are no ties; repeated rows give a row each; a null
doc_id stays null; further columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, byte_alphabet, load_tokenizer, session, worker_memo

#: Distinct runs and pre-tokens whose counts a worker keeps; beyond it the table starts anew (results don't change).
MEMO_ENTRIES = 700_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounts(dict):
    """Number of tokens of a run; each distinct pre-token is counted once and shared by all runs that hold it.

    Plain pre-tokens go to the model directly; a run that needs the splitter, or
    may hold a special string, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.model, self.pieces = self.tokenizer.model, {}
        self.letters = byte_alphabet()

    def count(self, pretoken: str) -> int:
        n = self.pieces.get(pretoken)
        if n is None:
            n = self.pieces[pretoken] = len(self.model.tokenize("".join(map(self.letters.__getitem__, pretoken.encode()))))
        return n

    def __missing__(self, run: str) -> int:
        m = PLAIN.fullmatch(run)
        if m:
            n = self.count(m[1]) + (self.count(m[2]) if m[2] else 0)
        else:
            n = len(self.tokenizer.encode(run, add_special_tokens=False))
        self[run] = n
        return n

    def trim(self, entries: int) -> None:
        """Start anew where the tables have grown beyond so many entries."""
        if len(self) + len(self.pieces) > entries:
            self.clear()
            self.pieces.clear()


def _counts(batches, path: str, limit: int):
    cut = re.compile(r"(?= \S)").split
    memo = worker_memo(("pieces", path), lambda: PieceCounts(path))
    for batch in batches:
        counts = []
        for t in batch.column(1):
            frequency = Counter(cut(t.as_py()))
            counts.append(sum(map(mul, map(memo.__getitem__, frequency), frequency.values())))
        memo.trim(MEMO_ENTRIES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text, by the byte-level tokenizer file ``path``."""
    session(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(lambda it: _counts(it, path, limit), SCHEMA)
