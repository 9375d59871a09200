"""WARC archives and their index.

``write_archives`` writes a WARC/1.1 record per page with Spark's text writer, so
the files (.gz) lie wherever Spark can write. Of pages with equal payloads the
least page_id is a response record, the others are revisits of it. Pages go to
archives by classes of size, so that an archive holds ``ARCHIVE_BYTES`` before
compression at most, or one record that is longer. A file is one gzip stream;
the index's ``at`` is a record's place in what it unpacks to.

``read_archives`` reads the files back and gives a locally sorted capture run for
each archive; ``merge_runs`` deals the runs' rows to key ranges and merges the
pieces of all runs in a range with a loser tree. Ranges follow each other by URL
key, time and page, so the result is globally ordered; a hot URL key is split by
time and page.

Cases: null html is an empty payload; a very long page is an archive of its own;
a null url is left out of the record and read back as null; pages that share
page_id and payload are all responses if that page_id is the least; a row without
page_id revisits the least page with its payload, and is a response where no page
with an id has it; equal URL keys and times are ordered by page, archive and
place; further columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, session

BROADCAST_REVISITS = 500_000
RECORDS_PER_FILE = 20_000
#: Bytes of an archive before compression, and the longest payloads of the classes that share archives.
ARCHIVE_BYTES = 64 << 20
CLASSES = (64 << 10, 1 << 20, 16 << 20)
RANGE_ROWS = 100_000
#: Capture time where the table has none.
CAPTURED = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "urlkey string, captured string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, at long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.col("__hex"), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _digested(pages: DataFrame, id_col: str, url_col: str, html_col: str, time_col: str | None) -> DataFrame:
    captured = F.date_format(F.col(time_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(CAPTURED)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), captured.alias("captured"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    return rows.withColumn("__hex", F.sha1("payload")).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload").cast("long")).drop("__hex")


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> None:
    """Write the pages as .gz WARC files into the folder ``path``."""
    rows = _digested(pages, id_col, url_col, html_col, time_col)
    ids = materialise(rows.select("page_id", "digest", "n"), "digests")
    sizes = ids.agg(*(F.count_if((F.col("n") > low) & (F.col("n") <= high)).alias(f"c{k}") for k, (low, high) in enumerate(_size_classes()))).first()
    ids = ids.where(F.col("n") >= min_bytes).select("page_id", "digest")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("unnamed"))
    firsts = firsts.where("first != last or unnamed > 0 and first is not null").select("digest", "first")
    again = materialise(ids.join(firsts, "digest").where("page_id is null or page_id != first").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), F.col("first").alias("refers_to")).distinct(), "revisits")
    if again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.withColumn("http", http)
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "")), F.lit("")),
        line("WARC-Date", F.coalesce(F.col("captured"), F.lit(CAPTURED))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n")), F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
        F.col("http"), F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n\r"),
    )
    # the writer ends each line with \n, which completes the record's last \r\n\r\n
    for k, (low, high) in enumerate(_size_classes()):
        if sizes[f"c{k}"]:
            most = min(records_per_file, max(1, ARCHIVE_BYTES // (high + 1)))
            some = rows.where((F.col("n") > low) & (F.col("n") <= high)).select(record.alias("value"))
            some.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _size_classes() -> list[tuple[int, int]]:
    return list(zip((-1, *CLASSES), (*CLASSES, 1 << 62)))


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels from the last to the first, then the path."""
    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?(.*)$", (url or "").lower(), re.S)
    return ",".join(reversed(m[1].split("."))) + (m[2] or "") + ")" + (m[3] or "/") if m else (url or "")


def parse_archive(data: bytes):
    """(offset, headers, HTTP headers, payload) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + 4, int(headers["Content-Length"])
        split = data.index(b"\r\n\r\n", start) + 4
        http = dict(x.split(": ", 1) for x in data[start : split - 4].decode("latin-1").split("\r\n")[1:])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield at, headers, http, data[split : start + size]
        at = start + size + 4


def _page(urn: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _entries(path: str, content: bytes) -> list[tuple]:
    """A sorted run: the captures of one archive."""
    out = []
    for at, h, http, payload in parse_archive(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(http["Content-Length"])
        if h["WARC-Type"] == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or len(payload) != size:
                raise ValueError(f"{path}: the record at byte {at} doesn't have its digest")
        url = h.get("WARC-Target-URI")
        out.append((url_key(url), h["WARC-Date"], _page(h["WARC-Record-ID"]), url, h["WARC-Type"], digest, size, _page(h.get("WARC-Refers-To")), path.rsplit("/", 1)[-1], at))
    out.sort(key=_order)
    return out


def _order(e: tuple) -> tuple:
    return (e[0], e[1], e[2] is not None, e[2] or 0, e[8], e[9])


_TYPES = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*entries), _TYPES)], names=_NAMES)


def read_archives(spark, path: str) -> DataFrame:
    """Index entries of all archives in a folder: a sorted run per archive."""
    def runs(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                entries = _entries(name.as_py(), content.as_py())
                for i in range(0, len(entries), 5000):
                    yield _batch(entries[i : i + 5000])

    files = session(spark).read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(runs, ENTRY)


def loser_tree_merge(runs: list[list], key):
    """Merge sorted runs: each inner node of the tree holds the loser of its match, the winner goes out."""
    k = len(runs)
    if not k:
        return
    place, done = [0] * k, object()
    heads = [key(r[0]) if r else done for r in runs]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return y is done or x is not done and (x < y or x == y and a < b)

    tree, winner = [0] * k, [0] * (2 * k)
    for leaf in range(k):
        winner[k + leaf] = leaf
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while heads[top] is not done:
        yield runs[top][place[top]]
        place[top] += 1
        heads[top] = key(runs[top][place[top]]) if place[top] < len(runs[top]) else done
        node = (top + k) >> 1
        while node:
            if beats(tree[node], top):
                tree[node], top = top, tree[node]
            node >>= 1


def merge_runs(entries: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures of all runs in the order of URL key, time and page; ranges of about ``range_rows``."""
    n = max(1, -(-entries.count() // range_rows))
    dealt = entries.repartitionByRange(n, "urlkey", "captured", "page_id").sortWithinPartitions("archive", "urlkey", "captured", "page_id", "at")

    def merge(batches):
        runs: dict[str, list] = {}
        for b in batches:
            for e in zip(*[c.to_pylist() for c in b.columns]):
                runs.setdefault(e[8], []).append(e)
        out = []
        for e in loser_tree_merge(list(runs.values()), _order):
            out.append(e)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return dealt.mapInArrow(merge, ENTRY)


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages as archives, read them back and merge their runs into the global index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **options)
    if not _exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return merge_runs(materialise(read_archives(spark, path), "runs"))


def oracle() -> str:
    """DuckDB SQL of the archived pages, straight from the table."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p),
b AS (SELECT page_id, n, f, list_transform(range(8), lambda k: ('0x' || substr(x, 5 * k::INT + 1, 5))::INT) AS v FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda y: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (y >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (y >> 10 & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (y >> 5 & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (y & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM b"""
