"""Shared pieces: the folder that all machines see, materialised tables, and hashing of text in numpy."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: White space that separates words, and that line keys are stripped of.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that the numpy code handles at a time; longer texts are cut at white space.
CHUNK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    return shared_folder(spark)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, which is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def materialised(df: DataFrame, kind: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives the loss of executors."""
    path = f"{new_folder(df.sparkSession, kind)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cap_batches(spark: SparkSession, rows: int = 256, size: int = 2 << 20) -> dict[str, str]:
    """Caps the session's Arrow batches to and from Python, so that wide rows take little memory outside the heap.

    Returns the settings that held before.
    """
    before = {}
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        before[key] = spark.conf.get(key)
        now = before[key].lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return before


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = 256, size: int = 2 << 20) -> Iterator[None]:
    """cap_batches while it lasts; for operators that run their Python stages themselves."""
    before = cap_batches(spark, rows, size)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def checked_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the bound; otherwise the planner shuffles."""
    return F.broadcast(df) if rows <= most else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Equi-join in which a hot key of `left` goes to `salts` partitions; `right` must be small for a key.

    The salt is part of the key on both sides, so that adaptive execution may also split what is still uneven.
    """
    one = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c not in keys] or [F.rand(7)]), F.lit(salts)).cast("int"))
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return one.join(many, [*keys, "__salt"], how).drop("__salt")


def tiles(rows: DataFrame, key: list[str], block: Column) -> DataFrame:
    """rows with i, j and own: every two rows of a key meet in exactly one tile (i, j), i <= j, as rows of blocks i and j.

    A key's rows are dealt to blocks of about `block` rows by their hash, and each block to the tiles that hold it, so a
    tile is two blocks at most, however many rows the key has. Keys of a single row make none.
    """
    counts = materialised(rows.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1"), "tiles")
    found = salted_join(rows, counts, key).withColumn("__blocks", F.ceil(F.col("__n") / block).cast("int"))
    own = F.pmod(F.xxhash64(F.lit(1), *[c for c in rows.columns if c not in key]), F.col("__blocks")).cast("int")
    found = found.withColumn("own", own).withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return found.select(*key, F.least("own", "__with").alias("i"), F.greatest("own", "__with").alias("j"), "own", *[c for c in rows.columns if c not in key])


def by_tile(dealt: DataFrame, key: list[str]) -> DataFrame:
    """The rows of tiles(), with those of a tile one after the other in one task."""
    spread = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(spread, *key, "i", "j").sortWithinPartitions(*key, "i", "j")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, bounds) of batches that are in order of their first `keys` columns: no group is cut."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        bounds = _group_bounds(batch, keys)
        if last := int(bounds[-2]):
            yield batch.slice(0, last), bounds[:-1]
        held = batch.slice(last)
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _group_bounds(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in range(keys):
        values = batch.column(k).to_numpy()
        change |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def crc32_of_id(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


# ---------------------------------------------------------------- numpy


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of murmur3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def random64(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit values, the same with any numpy version."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x10001)) * np.uint64(0x9E3779B97F4A7C15))


class ByteHasher:
    """Polynomial hashes of byte ranges, from prefix sums modulo 2**64 over random values of the bytes."""

    BASE = 0x9E6C63D0876A9A47

    def __init__(self, seed: int = 11):
        self.values = random64(seed, 256)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                size = 1 << (n - 1).bit_length()
                inverse = pow(self.BASE, -1, 1 << 64)
                self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, self.BASE, np.uint64), dtype=np.uint64)])
                self.inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, inverse, np.uint64), dtype=np.uint64)])

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of data[s:e] for each range; equal bytes give equal hashes wherever they stand."""
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
            got = (sums[ends] - sums[starts]) * self.inverses[starts]
            return mix64(got + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class WordHasher:
    """64-bit hashes of the lower-cased words `[^\\x20\\x09-\\x0D]+` of UTF-8 texts."""

    def __init__(self, seed: int = 11):
        self.bytes = ByteHasher(seed)

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes, and where each text's words begin among them; no word crosses an offset."""
        low, space = _LOWER[data], _SPACE[data]
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            before[inner] = True
            after[inner - 1] = True
        starts = np.flatnonzero(before & ~space)
        ends = np.flatnonzero(after & ~space) + 1
        return self.bytes.ranges(low, starts, ends), np.searchsorted(starts, offsets)

    def pieces(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(first row, word hashes, bounds, whether the last row ends) of runs of rows: row first+i has hashes[bounds[i]:bounds[i+1]].

        A text of more than CHUNK_BYTES comes in pieces, each a run of its one row. Null is empty.
        """
        data, offsets = utf8(column)
        row, n = 0, len(offsets) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
            if offsets[end] - offsets[row] <= CHUNK_BYTES:
                yield row, *self._piece(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]), True
            else:  # one long text
                at = 0
                for x in cut_at_space(data[offsets[row] : offsets[end]]):
                    at += len(x)
                    hashes = self._piece(x, np.array([0, len(x)]))[0]
                    yield row, hashes, np.array([0, len(hashes)]), at == offsets[end] - offsets[row]
            row = end

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The runs of pieces(), with each text in one."""
        held: list[np.ndarray] = []
        for row, hashes, bounds, ends in self.pieces(column):
            if ends and not held:
                yield row, hashes, bounds
                continue
            held.append(hashes)
            if ends:
                hashes, held = np.concatenate(held), []
                yield row, hashes, np.array([0, len(hashes)])


def cut_at_space(data: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end += 4096
        end = min(end, len(data))
        yield data[at:end]
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without copying, and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def batch_of(schema: str | pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
