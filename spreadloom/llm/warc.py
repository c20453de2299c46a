"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a record's header and block are one string column, and the writer's line separator is the CRLF CRLF that ends
a record, so the archives go to any store Spark writes to. Equal payloads of MIN_REVISIT bytes or more are stored
once, with the largest page_id; the others are revisit records that refer to it.

Reading: archives are cut into ranges of SPLIT bytes. A task emits each place where the version line stands, as a
candidate, with the offset of its successor by Content-Length; inside the range it jumps pointers until the chain
leaves the range. A line inside a payload is a candidate too, but no record's successor. From offset 0 of each file,
pointer jumping over the ranges' exits (log2 of the ranges a file has, rounds of small joins) finds where the true
chain enters each range; the last pass walks from there and reads only records that the chain reaches.

Cases: a null html is an empty payload; a null url is empty, and CR or LF in a url are percent-encoded; a null page_id
reads back as null, and is a response unless an equal payload has an id; rows that repeat the largest page_id are all
responses; payloads are equal where their SHA-1 and length are; headers of any length are read to their blank line;
payloads of any length are digested in blocks; archives are read ahead READ bytes at a time; a broken or cut record ends its file's chain; empty tables
and empty archives give no records. Extra columns are not stored. Digests are SHA-1 in lower-case hex.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, checked_broadcast, materialised, new_folder, salted_join

MIN_REVISIT = 1000
#: Bytes of an archive that one task scans; bytes first read of a header; records in one archive; repeated payloads to broadcast.
SPLIT, MAX_HEADER, MAX_RECORDS, MAX_BROADCAST = 4 << 20, 1 << 16, 100_000, 200_000
#: Bytes that a walk reads at a time.
READ = 1 << 20
#: Bytes in which a walk looks for a blank line first.
HEADER = 4096

MAGIC = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame) -> DataFrame:
    """One column: the record of each row of (page_id, url, html) without its final CRLF CRLF."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    twice = rows.where(F.col("n") >= MIN_REVISIT).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").select("digest", "n", "keeper")
    twice = materialised(twice, "payloads")
    size = twice.count()
    rows = rows.join(checked_broadcast(twice, size, MAX_BROADCAST), ["digest", "n"], "left") if size <= MAX_BROADCAST else salted_join(rows, twice, ["digest", "n"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("n"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("keeper"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body"), F.lit("\r\n\r\n"), F.col("body"),
    )
    return rows.withColumn("body", body).select(head.alias("record"))


def write_archives(pages: DataFrame, folder: str | None = None) -> str:
    """Writes archives for pages and returns their folder."""
    folder = folder or f"{new_folder(pages.sparkSession, 'warc')}/archives"
    records(pages).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", MAX_RECORDS).text(folder)
    return folder


# ---------------------------------------------------------------- reading


def _open(path: str):
    """A file that can be read at offsets, of any store that pyarrow knows."""
    from pyarrow import fs

    if re.match("file:", path):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class Ahead:
    """Ranges of a file, from one read of READ bytes or more at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def read(self, n: int, at: int) -> bytes:
        """n bytes at an offset, fewer at the end of the file."""
        n = min(n, self.size - at)
        if at < self.start or at + n > self.start + len(self.data):
            self.data, self.start = self.file.read_at(min(max(n, READ), self.size - at), at), at
        return self.data[at - self.start : at - self.start + n]


def parse(header: bytes) -> tuple[int, int] | None:
    """(length of the header with its blank line, Content-Length) of what starts with a header, or None."""
    if not header.startswith(MAGIC):
        return None
    end = header.find(b"\r\n\r\n")
    m = _LENGTH.search(header, 0, end + 2) if end >= 0 else None
    return (end + 4, int(m[1])) if m else None


def candidates(file, size: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in [start, end) where a header stands, and those of their successors; what runs past the file is none."""
    data = file.read_at(min(end + MAX_HEADER, size) - start, start)
    found, after = [], []
    top = end - start + len(MAGIC) - 1
    at, blank, m = data.find(MAGIC, 0, top), -1, None
    while at >= 0:
        if blank < at:  # the next blank line ends the header of every place before it
            blank = data.find(b"\r\n\r\n", at)
            while blank < 0 and (more := min(len(data), size - start - len(data))) > 0:
                seen = len(data)
                data += file.read_at(more, start + seen)
                blank = data.find(b"\r\n\r\n", max(at, seen - 3))
            if blank < 0:
                break
            m = _LENGTH.search(data, at, blank + 2)
        elif m and m.start() < at:
            m = _LENGTH.search(data, at, blank + 2)
        if m and (succ := start + blank + 8 + int(m[1])) <= size:
            found.append(start + at)
            after.append(succ)
        at = data.find(MAGIC, at + 1, top)
    return np.array(found, np.int64), np.array(after, np.int64)


def jump(found: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """For each candidate, the first offset of its chain at `end` or beyond; -1 where the chain breaks before."""
    n = len(found)
    if not n:
        return after
    at = np.minimum(np.searchsorted(found, after), n - 1)
    stays = (after < end) & (found[at] == after)
    # node n is where a chain breaks
    nxt = np.append(np.where(after >= end, np.arange(n), np.where(stays, at, n)), n)
    for _ in range(max(1, n.bit_length())):
        nxt = nxt[nxt]
    return np.append(after, -1)[nxt[:n]]


SPLITS = "path string, size long, start long"


def splits_of(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size")).where("size > 0")
    return files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(SPLIT).cast("long"))))


def verified_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, node): where the chain from each file's start enters each range."""
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = splits_of(spark, folder)
    files = splits.where("start = 0").select("path", "size", F.lit(0).cast("long").alias("node"))
    longest = splits.agg(F.max("size")).first()[0] or 0
    edge = pa.schema([("path", pa.string()), ("size", pa.int64()), ("node", pa.int64()), ("to", pa.int64())])

    def scan(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(path) as file:
                    end = min(start + SPLIT, size)
                    found, after = candidates(file, size, start, end)
                to = jump(found, after, end)
                live = to >= 0
                yield batch_of(edge, [path] * int(live.sum()), [size] * int(live.sum()), found[live], to[live])

    edges = materialised(splits.repartition(spread, "path", "start").mapInArrow(scan, "path string, size long, node long, to long"), "edges")
    # the only nodes that a chain can come to are file starts and exits of ranges
    nodes = edges.select("path", F.col("to").alias("node")).union(files.select("path", "node")).distinct()
    hop = materialised(edges.join(nodes, ["path", "node"]).select("path", "node", "to"), "hops")
    reach = files.select("path", "node")
    rounds = int(np.ceil(np.log2(-(-longest // SPLIT) + 1)))
    for k in range(rounds):
        step = reach.join(hop, ["path", "node"]).select("path", F.col("to").alias("node"))
        reach = materialised(reach.union(step).distinct(), "reached")
        if k + 1 < rounds:
            second = hop.select("path", F.col("node").alias("to"), F.col("to").alias("then"))
            hop = materialised(hop.join(second, ["path", "to"], "left").select("path", "node", F.coalesce("then", "to").alias("to")), "hops")
    return reach.join(files.select("path", "size"), "path").where("node < size").select("path", "size", "node")


RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64())])


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"\r\n" + name + rb":[ \t]*([^\r]*)\r\n", head, re.I)
    return m[1] if m else None


def _id(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records that the chains reach; size and digest are of the payload as stored, for revisits as declared."""

    def walk(batches):
        for batch in batches:
            for path, size, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end, out = min((node // SPLIT + 1) * SPLIT, size), []
                with _open(path) as file:
                    ahead = Ahead(file, size)
                    while node < end:
                        head = ahead.read(HEADER, node)
                        while head.startswith(MAGIC) and b"\r\n\r\n" not in head and len(head) < size - node:
                            head = ahead.read(2 * len(head), node)
                        got = parse(head)
                        if not got or (succ := node + sum(got) + 4) > size:
                            break
                        h, length = got
                        kind = (_field(head[:h], b"WARC-Type") or b"").decode()
                        at, stop = node + h, node + h + length
                        gap = ahead.read(min(HEADER, length), at).find(b"\r\n\r\n")
                        if kind == "revisit":
                            n, digest = int(_field(head[:h], b"WARC-Payload-Length") or 0), (_field(head[:h], b"WARC-Payload-Digest") or b"").decode().removeprefix("sha1:")
                        else:
                            at += gap + 4 if gap >= 0 else 0
                            n, sha = stop - at, hashlib.sha1()
                            while at < stop:
                                sha.update(part := ahead.read(min(READ, stop - at), at))
                                at += len(part)
                            digest = sha.hexdigest()
                        out.append((_id(_field(head[:h], b"WARC-Record-ID")), n, digest, kind, _id(_field(head[:h], b"WARC-Refers-To")), path, node))
                        if len(out) == 2000:
                            yield batch_of(RECORD, *zip(*out, strict=True))
                            out = []
                        node = succ
                if out:
                    yield batch_of(RECORD, *zip(*out, strict=True))

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return verified_entries(spark, folder).select("path", "size", "node").repartition(spread, "path", "node").mapInArrow(walk, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long")


def op2(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(spark, write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
