"""Near duplicates by SimHash, found by covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 places: whether more than half of a text's shingle hashes have it set.

Candidates: every place is given a vector of RADIUS + 1 bits, not zero, all vectors about equally often; a mask keeps
the places whose vector has an odd product with the mask's own, and there is a mask for every vector but zero. Of any
RADIUS places, some mask keeps none: their vectors leave a direction that is even with all of them. So two fingerprints
that differ in RADIUS places at most are equal under one of the 2 ** (RADIUS + 1) - 1 masks, with certainty. A mask
keeps 32 to 36 of the 64 places.

Distinct fingerprints are dealt by masked value, and those of one value are compared in tiles of bounded size
(`common.tiles`), a matrix of bit counts at a time. A tile sends the stars of its own components, at most one link a
member, never all pairs. The components of these links are found by alternating stars. Copies share a fingerprint and
are one node.

Cases: a null text, or one without words, has fingerprint zero, which links like any other; with fewer words than a
shingle, the whole sequence is the one shingle; long texts are hashed in blocks; rows go by their own fingerprint, also
where they share a doc_id; a null doc_id is never the smallest of a component, and a component without any id has null.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, by_tile, cut_at_space, materialised, salted_join, tiles, utf8, whole_groups
from .minhash import components

RADIUS, WIDTH, SEED = 3, 3, 42
#: Fingerprints of a block, and pairs that are compared at a time.
BLOCK, COMPARED = 4096, 1 << 20
#: Words that are hashed at a time.
WORDS = 1 << 16


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks of 64 bits, one for each vector of radius + 1 bits but zero."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << place for place in range(64) if ((1 + place % vectors) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """XXH64 of the runs of `width` words, joined by blanks."""
    import xxhash

    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, by the values of their bytes."""
    at = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    return (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def fingerprint(data: np.ndarray, width: int = WIDTH) -> int:
    """The fingerprint of UTF-8 bytes, read in blocks that end at white space."""
    counts, total, words = np.zeros(64, np.int64), 0, []
    for piece in cut_at_space(data):
        words += piece.tobytes().lower().split()
        if len(words) >= WORDS:
            got = shingle_hashes(words, width)
            counts, total, words = counts + bit_counts(got), total + len(got), words[len(words) - width + 1 :]
    if words and (not total or len(words) >= width):
        got = shingle_hashes(words, min(width, len(words)))
        counts, total = counts + bit_counts(got), total + len(got)
    return int(((2 * counts > total).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long, of each row of docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            got = np.array([fingerprint(data[s:e], width) for s, e in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield batch_of(schema, batch.column(0), got.view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fp long")


def united(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels, each the least member known to be connected, after the links of i and j."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (labels != (closer := labels[labels])).any():
            labels = closer


def stars(values: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within the radius: (members, least member of their component).

    side: whether a value is of the first block of two, which are compared with each other only; None for one block.
    """
    a, b = (np.arange(len(values)), np.arange(len(values))) if side is None else (np.flatnonzero(side), np.flatnonzero(~side))
    labels = np.arange(len(values))
    rows = max(1, COMPARED // max(1, len(b)))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(values[a[at : at + rows], None] ^ values[b]) <= radius)
        labels = united(labels, a[i + at], b[j])
    far = np.flatnonzero(labels != np.arange(len(values)))
    return values[far], values[labels[far]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of the distinct fingerprints in distinct(fp) that have the components of all within the radius."""
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))) for m in masks(radius)])
    keyed = distinct.select("fp", F.posexplode(masked).alias("mask", "kept")).select("kept", "mask", "fp")
    key = ["kept", "mask"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches):
        for batch, bounds in whole_groups(batches, 4):
            i, j, own = (batch.column(k).to_numpy() for k in (2, 3, 4))
            values, found = batch.column(5).to_numpy().view(np.uint64), []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found.append(stars(values[s:e], None if i[s] == j[s] else own[s:e] == i[s], radius))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield batch_of(schema, a.view(np.int64), b.view(np.int64))

    return by_tile(tiles(keyed, key, F.lit(BLOCK)), key).mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, fp and component_id of each row of docs(doc_id, text)."""
    with bounded_batches(docs.sparkSession, rows=10_000):
        base = materialised(fingerprints(docs, width), "fingerprints")
        classes = materialised(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        found = components(materialised(links(classes.select("fp"), radius), "links"))
        rooted = classes.join(found.withColumnRenamed("rep", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
        rooted = materialised(rooted, "rooted")
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        return salted_join(base, salted_join(rooted.select("fp", "root"), ids, ["root"]).drop("root"), ["fp"])


def op13(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
