"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes ends a chunk where it equals blocksize - 1 modulo the block size, so chunk ends
depend on the content near them only. Each chunk gives one character of a signature; a fingerprint is
`blocksize:signature:signature at twice the block size`. Two fingerprints are compared at equal block sizes, by the
edit distance of insertions and deletions, as 1 - distance / (sum of lengths); signatures without a common run of
RUN characters (a third of the shorter one, where that is less) count as unlike.

Cases: a null or empty text is `3::`, like to another such text with 1 and to anything else with 0; a text of any
length is read whole, its last chunk covering whatever follows the last character there is room for (as the format
has it); equal texts have equal fingerprints. The next document of a null doc_id comes after all others; rows that
share a doc_id are ordered by text. Extra columns are not read. A single document is its own next one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, random64

WINDOW, SIGNATURE, LEAST_BLOCK, RUN = 7, 64, 3, 7
#: Bytes that are hashed at a time.
PIECE = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_VALUES = (random64(8, 256) >> np.uint64(32)).astype(np.uint32)
_BASE = 0x2F0B4C47


def rolling(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, hashes) of pieces: hash i covers the WINDOW bytes that end at byte i (fewer at the start)."""
    for at in range(0, len(data), PIECE):
        back = min(at, WINDOW - 1)
        x = _VALUES[data[at - back : at + PIECE]]
        h = x.copy()
        factor = 1
        for k in range(1, WINDOW):
            factor = factor * _BASE & 0xFFFFFFFF
            h[k:] += x[:-k] * np.uint32(factor)
        h = h[back:]
        yield at, h ^ (h >> np.uint32(15))


def _ends(hashes: list[tuple[int, np.ndarray]], block: int) -> np.ndarray:
    return np.concatenate([np.flatnonzero(h % np.uint32(block) == block - 1) + at + 1 for at, h in hashes] or [np.zeros(0, np.int64)])


def _signature(raw: bytes, ends: np.ndarray, room: int) -> str:
    """One character a chunk; the last covers the rest."""
    cut = ends[: room - 1].tolist()
    view, out, at = memoryview(raw), [], 0
    for end in cut:
        out.append(ALPHABET[zlib.crc32(view[at:end]) >> 13 & 63])
        at = end
    if at < len(raw):
        out.append(ALPHABET[zlib.crc32(view[at:]) >> 13 & 63])
    return "".join(out)


def fingerprint(raw: bytes) -> str:
    block = LEAST_BLOCK
    while block * SIGNATURE < len(raw):
        block *= 2
    data = np.frombuffer(raw, np.uint8)
    # beyond a few pieces, the hashes are made again for each block size rather than kept
    hashes = list(rolling(data)) if len(raw) <= 8 * PIECE else None
    while True:
        ends = _ends(hashes if hashes is not None else rolling(data), block)
        if block == LEAST_BLOCK or len(ends) >= SIGNATURE // 2:
            break
        block //= 2
    # ends at twice the block size are a subset of these, as block sizes are LEAST_BLOCK times powers of two
    wide = _ends(hashes if hashes is not None else rolling(data), 2 * block)
    return f"{block}:{_signature(raw, ends, SIGNATURE)}:{_signature(raw, wide, SIGNATURE // 2)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, max(2, min(len(a), len(b)) // 3), len(a), len(b))
    if run == 0 or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    # insertions and deletions only: the distance is the sum of lengths less twice the common subsequence
    return 2 * _common(a, b) / (len(a) + len(b))


def similarity(x: str, y: str) -> float:
    """0 to 1; 0 where the block sizes are not equal or neighbours."""
    if x == y:
        return 1.0
    xb, x1, x2 = x.split(":")
    yb, y1, y2 = y.split(":")
    p, q = int(xb), int(yb)
    if p == q:
        return max(_alike(x1, y1), _alike(x2, y2))
    if p == 2 * q:
        return _alike(x1, y2)
    if q == 2 * p:
        return _alike(x2, y1)
    return 0.0


def edited(text: str, other: str) -> str:
    """The last half of text replaced by the first as many code points of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, doc_id, text) dealt so that each bucket holds a range of ids and one extra row: the next one.

    The driver gets the bounds of ids and the largest id of each bucket, no texts. Only one exchange moves texts.
    Bucket 0 holds the largest ids, and null ids have a bucket of their own after all others.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def bucket_of(ids: pa.Array) -> np.ndarray:
        place = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, place)

    def largest(batches):
        for batch in batches:
            ids = batch.column(0)
            bucket = bucket_of(ids)
            for b in np.unique(bucket):
                own = ids.filter(pa.array(bucket == b)).drop_null()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([max(own.to_pylist(), default=None)], pa.int64())], ["bucket", "head"])

    heads = dict(docs.select("doc_id").mapInArrow(largest, "bucket int, head long").groupBy("bucket").agg(F.max("head")).collect())
    # the first row of a bucket also ends the bucket before it; that of the first ends the last
    order = sorted(heads)
    owner = {order[i]: order[i - 1] for i in range(len(order))}
    schema = pa.schema([("bucket", pa.int32()), ("extra", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])

    def deal(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            bucket = bucket_of(ids)
            yield batch_of(schema, bucket, np.zeros(len(bucket), np.int32), ids, texts)
            first = np.array([heads[b] == i for b, i in zip(bucket.tolist(), ids.to_pylist(), strict=True)], bool)
            if first.any():
                keep = pa.array(first)
                yield batch_of(schema, [owner[b] for b in bucket[first].tolist()], np.ones(int(first.sum()), np.int32), ids.filter(keep), texts.filter(keep))

    rows = docs.select("doc_id", "text").mapInArrow(deal, "bucket int, extra int, doc_id long, text string")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text")


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see FIELDS."""
    schema = pa.schema(FIELDS)

    def work(batches):
        last = None  # (bucket, doc_id, text, fingerprint)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                bucket, extra, doc_id, text = (batch.column(k)[i].as_py() for k in range(4))
                if last is not None and last[0] != bucket:
                    last = None
                if extra and last is None:
                    continue  # further rows of the same id
                mark = fingerprint(text.encode())
                if last is not None:
                    _, own, body, own_mark = last
                    new = edited(body, text).encode()
                    new_mark = fingerprint(new)
                    out.append((own, len(body), hashlib.sha256(new).hexdigest(), own_mark, new_mark, similarity(own_mark, new_mark), similarity(own_mark, mark)))
                last = None if extra else (bucket, doc_id, text, mark)
            yield batch_of(schema, *(zip(*out, strict=True) if out else [[]] * len(FIELDS)))

    return with_next(docs).mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
