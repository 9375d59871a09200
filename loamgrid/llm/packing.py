"""Packing documents into windows by best fit, longest pieces first.

A document longer than a window is first cut into full windows. The rest of each
document is a piece shorter than a window; pieces are placed longest first, each
into the open window whose remaining room is the tightest that holds it. Open
windows are found through a segment tree over the remaining room. Windows that
stay badly filled are emptied and their pieces cut to fill windows to the brim;
the last tail is laid out as sequences whose lengths are powers of two, which
need no padding.

Packing runs per block: the documents of one input partition, at most
``block_tokens`` tokens at a time. Memory is bounded by the block, no row is
shuffled, and a retried task gives the same blocks.

Cases: a null or empty text holds the end id alone; a very long text is coded
whole and ends its block; pieces of one length go in the order of the rows, and
of windows with equal room the one that got it last is taken; repeated rows are packed
once per row; a null doc_id stays null; further columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, byte_alphabet, load_tokenizer, session, worker_memo

#: Distinct words whose ids a worker keeps; beyond it the table starts anew (results don't change).
MEMO_ENTRIES = 700_000
#: A window whose padding is above this share of it is emptied and packed again by cutting.
MAX_PADDING = 1 / 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Segment tree over remaining room 1..window: which rooms have open windows."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        if room <= 0:
            return
        held = self.open.setdefault(room, [])
        held.append(window)
        if len(held) == 1:
            node = room + self.size
            while node and not self.tree[node]:
                self.tree[node] = 1
                node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take the open window with the least room of at least ``length``: (room, window)."""
        tree, node = self.tree, length + self.size
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node <<= 1
                if not tree[node]:
                    node += 1
        room = node - self.size
        held = self.open[room]
        window = held.pop()
        if not held:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of the lengths (1..window) in each window; equal lengths go in their given order."""
    tree, windows = RoomTree(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = tree.tightest(n)
        if found is None:
            windows.append([i])
            tree.add(window - n, len(windows) - 1)
        else:
            windows[found[1]].append(i)
            tree.add(found[0] - n, found[1])
    return windows


def lay_out(lengths: list[int], window: int, max_padding: float = MAX_PADDING) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents of these lengths once."""
    sequences, rest = [], []
    for d, n in enumerate(lengths):
        full = n // window
        sequences += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            rest.append((d, full * window, n % window))
    loose = []
    for held in best_fit_decreasing([n for _, _, n in rest], window):
        pieces = [rest[i] for i in held]
        if window - sum(n for _, _, n in pieces) > max_padding * window:
            loose += pieces
        else:
            sequences.append(pieces)
    left = sum(n for _, _, n in loose)
    sizes = [window] * (left // window)
    tail = left % window
    sizes += [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1]
    at = 0
    for size in sizes:
        pieces = []
        while size:
            d, start, n = loose[at]
            take = min(n, size)
            pieces.append((d, start, take))
            loose[at] = (d, start + take, n - take)
            at += take == n
            size -= take
        sequences.append(pieces)
    return sequences


class WordIds(dict):
    """Ids of a run without blanks, as little-endian 32-bit words; looked up once per distinct run.

    A plain word goes to the model directly, in pieces shared by all runs that
    hold it; any other run goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.model, self.pieces = self.tokenizer.model, {}
        self.letters = byte_alphabet()

    def piece(self, x: str) -> bytes:
        ids = self.pieces.get(x)
        if ids is None:
            spelt = x if x.isascii() else "".join(map(self.letters.__getitem__, x.encode()))
            ids = self.pieces[x] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return ids

    def __missing__(self, run: str) -> bytes:
        m = PLAIN.fullmatch(run)
        if m:
            word, marks = m.groups()
            ids = self.piece(word.lower())
            if marks:
                ids += self.piece(marks)
        elif run:
            ids = array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        else:
            ids = b""
        self[run] = ids
        return ids

    def trim(self, entries: int) -> None:
        """Start anew where the tables have grown beyond so many entries."""
        if len(self) + len(self.pieces) > entries:
            self.clear()
            self.pieces.clear()


def _pack(batches, path: str, window: int, end_id: int, block_tokens: int):
    memo = worker_memo(("ids", path), lambda: WordIds(path))
    blank = re.compile(r"[\t\r\n]")
    end = array("I", [end_id]).tobytes()
    base, n_sequences = TaskContext.get().partitionId() << 40, 0
    doc_ids: list = []
    ids: list[bytes] = []
    held = 0

    def flush():
        nonlocal n_sequences, held
        lengths = [len(x) // 4 for x in ids]
        cols: list[list] = [[] for _ in range(7)]
        for pieces in lay_out(lengths, window):
            offset = 0
            for d, start, n in pieces:
                row = (doc_ids[d], start, n, zlib.crc32(ids[d][4 * start : 4 * (start + n)]), lengths[d], base + n_sequences, offset)
                for c, v in zip(cols, row):
                    c.append(v)
                offset += n
            n_sequences += 1
        doc_ids.clear()
        ids.clear()
        held = 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    for batch in batches:
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            runs = blank.sub(" ", t.as_py()).split(" ")
            x = b"".join(map(memo.__getitem__, runs)) + end
            doc_ids.append(key)
            ids.append(x)
            held += len(x) // 4
            if held >= block_tokens:
                yield flush()
        memo.trim(MEMO_ENTRIES)
    if ids:
        yield flush()


def pack_documents(docs: DataFrame, path: str, *, window: int = 4096, end_id: int = 2, block_tokens: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document with their sequence and place there.

    ``path``: a tokenizers .json file that drops white space, so that words
    between blanks are encoded alike alone and in a text.
    """
    session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, path, window, end_id, block_tokens), SCHEMA)
