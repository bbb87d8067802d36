"""WARC archives of pages, and an index of their captures by external merge.

Pages are written as WARC records by Spark's text writer: a record ends with the blank lines that
separate lines here, so each gzipped part is an archive. Equal payloads of at least min_bytes are kept
once, in the record with the largest page_id; the others are revisits that name it.

An archive holds at most ARCHIVE_BYTES of records, or one record. Reading inflates it piece by piece and parses record after record by their
content lengths. Each archive yields a run of captures sorted by URL key and time; runs are dealt out by ranges of (key, time, page_id),
as many as bound what one holds, and each range merges its k runs with a loser tree. Nothing is kept in local files.

Null html: an empty payload. Null or odd url: kept as it is; its key is its text. Null page_id: takes part as a
copy, never as the one that others refer to if any has an id. Repeated rows: rows with the largest page_id are
all responses; equal captures are told apart by where they stand, so ranges split them too. Ties of key, time and page_id: any order. Very long html: a record
of its own archive. Extra columns, whatever their names, are not read. Empty table: no archives, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF = "\r\n"
#: Records of one archive at most, and bytes of their payloads.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 500, 64 << 20
#: Bytes of gzipped archives for each range of the index: a merging task holds their captures.
RANGE_BYTES = 32 << 20
#: Bytes that are inflated at once.
PIECE = 1 << 20
EPOCH = 1_704_067_200


def base32_sha1(binary: Column) -> Column:
    """The bare upper-case base32 form of a SHA-1 digest."""
    h = F.sha1(binary)
    digits = F.concat(*(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_targets(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, n (payload bytes), digest and refers_to (null for a response)."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "key": F.sha2(F.encode("html", "UTF-8"), 256), "digest": base32_sha1(F.encode("html", "UTF-8"))})
    copies = rows.where(F.col("n") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select("key", "last")
    # apart from the join, so that the join can split a hot payload
    rows = rows.join(common.checkpointed(copies), "key", "left").drop("key")
    return rows.withColumn("refers_to", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))).drop("last")


def records(rows: DataFrame) -> DataFrame:
    """One column, each record without its last two line ends."""
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n"), F.lit(CRLF * 2)
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    odd = F.col("url").rlike(r"[\x00-\x20\x7f]")  # what can't stand in a header field
    seconds = F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)) % (1 << 31)
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.when(odd, F.url_encode("url")).otherwise(F.col("url"))),
        F.when(odd, F.lit("X-URI: encoded")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("n"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return rows.select(F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF * 2), block).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes the archives, gzipped, to a folder that all executors share: ordinary pages by the hundred, longer ones in archives of fewer records."""
    rows = with_targets(pages, min_bytes)
    longest = rows.agg(F.max(F.when(F.col("refers_to").isNull(), F.col("n")))).first()[0] or 0
    usual = ARCHIVE_BYTES // ARCHIVE_RECORDS
    low, mode = -1, "overwrite"
    for records_of_one in (ARCHIVE_RECORDS, ARCHIVE_RECORDS // 25, 1):
        high = ARCHIVE_BYTES // records_of_one if records_of_one > 1 else max(longest, usual)
        part = rows.where(F.col("n").between(low + 1, high)) if longest > usual else rows
        records(part).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_of_one).mode(mode).text(path)
        low, mode = high, "append"
        if longest <= high:
            break


def inflated(archive: bytes) -> Iterator[bytes]:
    """The bytes of a gzipped archive, piece by piece."""
    while archive:
        d = zlib.decompressobj(31)
        data = d.decompress(archive, PIECE)
        while data:
            yield data
            data = d.decompress(d.unconsumed_tail, PIECE)
        archive = d.unused_data


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive that comes in pieces; one record is held at a time."""
    held, at = bytearray(), 0

    def more(n: int) -> bool:
        """Whether n bytes are there now."""
        while len(held) < n and (piece := next(pieces, None)):
            held.extend(piece)
        return len(held) >= n

    while more(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not more(looked + 1):
                raise ValueError(f"the record at byte {at} has no end of its header")
        lines = held[:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if not more(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield head, bytes(held[start:stop])
        del held[: stop + 4]
        at += stop + 4


def url_key(url: str) -> str:
    """A sortable key: the host's labels from the right, then path and query."""
    m = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/") if m else url


def captures(archive: bytes) -> list[tuple]:
    """Of each record of a gzipped archive: key, time, page_id, payload bytes, digest, type, page_id referred to; sorted."""
    from urllib.parse import unquote_plus

    out = []
    for head, block in parse(inflated(archive)):
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"digest of {head['WARC-Record-ID']}")
        ids = [None if x == "none" else int(x) for x in (head[k][10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To") if k in head)]
        url = head.get("WARC-Target-URI", "")
        url = unquote_plus(url) if "X-URI" in head else url
        out.append((url_key(url), head["WARC-Date"], -(1 << 63) if ids[0] is None else ids[0], len(payload) if kind == "response" else int(head["X-Payload-Length"]), digest, kind, ids[1] if len(ids) > 1 else None, ids[0] is None))
    return sorted(out, key=order)


def order(capture: tuple) -> tuple:
    return capture[:3]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step costs one path from leaf to root."""

    def __init__(self, runs: list[Iterator[tuple]], key=order):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.head: list = [next(r, None) for r in self.runs] or [None]
        self.tree = [0] * self.k
        self.tree[0] = self.play(1) if self.k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self.key(x), a) < (self.key(y), b)

    def play(self, node: int) -> int:
        """Fills the matches below a node and returns the winner."""
        if node >= self.k:
            return node - self.k
        a, b = self.play(2 * node), self.play(2 * node + 1)
        winner, self.tree[node] = (a, b) if self.before(a, b) else (b, a)
        return winner

    def __iter__(self) -> Iterator[tuple]:
        while (out := self.head[w := self.tree[0]]) is not None:
            yield out
            self.head[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self.before(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.tree[0] = w


def merged(batches: Iterator[pa.RecordBatch], width: int = 3, at_once: int = 500) -> Iterator[tuple]:
    """All rows in order, from batches whose rows come as sorted runs, one after another; the first width columns give the order.

    Runs are told by where the order breaks. They are held as Arrow batches, and of each run at_once rows are read at a time.
    """
    runs: list[list[pa.RecordBatch]] = []
    last = None
    for b in batches:
        keys = [*zip(*(c.to_pylist() for c in b.columns[:width]), strict=True)]
        cut = [k for k in range(len(keys)) if (keys[k - 1] if k else last) is None or keys[k] < (keys[k - 1] if k else last)]
        if keys:
            last = keys[-1]
        if keys and (not cut or cut[0] > 0):
            runs[-1].append(b.slice(0, cut[0] if cut else len(keys)))
        for k, to in pairwise([*cut, len(keys)]):
            runs.append([b.slice(k, to - k)])

    def read(run: list[pa.RecordBatch]) -> Iterator[tuple]:
        for b in run:
            for at in range(0, len(b), at_once):
                yield from zip(*(c.to_pylist() for c in b.slice(at, at_once).columns), strict=True)

    yield from LoserTree(list(map(read, runs)))


COLUMNS = [("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("no_id", pa.bool_())]
TYPES = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _batches(rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), COLUMNS, strict=True)], names=[n for n, _ in COLUMNS])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), COLUMNS, strict=True)], names=[n for n, _ in COLUMNS])


def index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of a folder's archives, in the order of URL key, time and page_id over all partitions."""
    common.small_batches(spark, 64)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    # the files' lengths are known without reading them
    ranges = max(common.partitions(spark), -(-(files.agg(F.sum("length")).first()[0] or 0) // RANGE_BYTES))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column(0):
                yield from _batches(captures(content.as_py()))

    runs = files.select("content").mapInArrow(read, TYPES + ", no_id boolean")
    # equal captures may lie in any range
    dealt = runs.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(ranges, "url_key", "captured_at", "page_id", "salt").drop("salt")

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(merged(it))

    out = dealt.mapInArrow(merge, TYPES + ", no_id boolean")
    return out.withColumn("page_id", F.when(~F.col("no_id"), F.col("page_id"))).drop("no_id")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives to the shared folder and reads their index back: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at."""
    spark = pages.sparkSession
    path = common.shared_path(spark, "warc")
    write(pages, path, min_bytes)
    if not spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path").take(1):
        return spark.createDataFrame([], TYPES).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")
    return index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")
