"""LM scoring with an Elias-Fano n-gram trie of two levels: words, and successors of a word.

Tokens are 64-bit hashes of lower-cased words, then one end for a text; a text's first token follows a start symbol.
Counting: tasks count the words of their texts, sorted, and hand them out by hash range as compressed blobs; each range
is merged and written as a file of level 1. A word's id is its rank. A second pass counts (context id, word id) the same
way; key ranges follow level 1's, and a context with more than a range's share is cut by word ids, so that no task
gathers a hot context whole. Every count of the training texts is kept.

A level file holds, for contexts c with n(c) children: monotone pointers to their first child and first low bit
(Elias-Fano), the children's high parts as one Elias-Fano bit vector (child w falls in bucket first(c) + w * n(c) / V,
each bucket ends with a 0), low parts of just the bits a bucket needs, and 8-bit codes of log10((count - D) / count(c)).
A lookup is relative to its context: select the bucket's zero, compare low bits. Interpolated absolute discounting:
p(w | c) = (count - D) / count(c) + D * n(c) / count(c) * p(w), where n(c) is the difference of two pointers and
p(w) = (count(w) + 0.5) / (N + 0.5 * (V + 1)); an unknown context gives p(w). Level 1 has exact counts, as the base score is defined by them.

Files are written to the shared folder and memory-mapped by the tasks; from a store without local paths they are read
into anonymous memory, OPEN_BYTES of them at a time in a worker. They are written under another name and moved, so a task can run again.

Cases: a null or empty text is the end token alone; no training texts: p is 1 for every token; more than 2**32 - 2
distinct words raise, as does a file of 2**32 bits; counts have 64 bits; long texts are hashed, counted and scored in blocks; equal texts have equal scores; a null doc_id isn't held out and
isn't trained on; rows that repeat count as often as they stand. Extra columns are not read.
"""

from __future__ import annotations

import json
import mmap
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, batch_of, bounded_batches, crc32_of_id, materialised, new_folder, random64

DISCOUNT = 0.75
#: Tokens that a task counts or scores at a time.
TOKENS = 1 << 18
#: Distinct words or pairs that a counting task holds before it hands them out.
HELD = 1 << 20
#: Bytes of text for each range of words at most, as long as there are no more than 2**MAX_BITS ranges.
RANGE_BYTES, MAX_BITS = 32 << 20, 20
#: Rows and bytes of an Arrow batch to and from a worker.
BATCH = {"rows": 1024, "size": 4 << 20}
#: Bytes of level files that a worker holds in memory where they can't be mapped.
OPEN_BYTES = 256 << 20
#: Word ids are halves of 64-bit keys; the last two values are for the start symbol and the end of its range.
MAX_WORDS = (1 << 32) - 2
END = np.uint64(random64(9, 1)[0])

U = np.uint64


# ---------------------------------------------------------------- bits


def pack(values: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words with each value's bits at its bit offset; offsets ascend and values don't overlap."""
    out = np.zeros(bits // 64 + 2, np.uint64)
    if len(values):
        word, shift = offsets >> 6, (offsets & 63).astype(np.uint64)
        for at, part in ((word, values << shift), (word + 1, np.where(shift > 0, values >> ((U(64) - shift) & U(63)), U(0)))):
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out[at[first]] |= np.bitwise_or.reduceat(part, first)
    return out


def unpack(words: np.ndarray, offsets: np.ndarray, widths: np.ndarray) -> np.ndarray:
    at, shift = offsets >> 6, (offsets & 63).astype(np.uint64)
    got = words[at] >> shift | np.where(shift > 0, words[at + 1] << ((U(64) - shift) & U(63)), U(0))
    return got & ((U(1) << widths.astype(np.uint64)) - U(1))


class Bits:
    """A bit vector that finds its k-th 0 or 1: cumulative counts for each 64-bit word, then halving inside the word."""

    def __init__(self, words: np.ndarray, before: np.ndarray, ones: bool):
        self.words, self.before, self.ones = words, before, ones

    @staticmethod
    def build(positions: np.ndarray, length: int, ones: bool) -> tuple[np.ndarray, np.ndarray]:
        if length >= 1 << 32:
            raise ValueError(f"{length} bits of a level file; its directory holds less than {1 << 32}")
        words = pack(np.ones(len(positions), np.uint64), positions.astype(np.int64), length)
        counts = np.bitwise_count(words if ones else ~words).astype(np.int64)
        return words, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)

    def select(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.before, k, "right") - 1
        x = self.words[at] if self.ones else ~self.words[at]
        left = (k - self.before[at]).astype(np.int64)
        pos = at.astype(np.int64) << 6
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(x & U((1 << step) - 1)).astype(np.int64)
            more = left >= low
            left -= np.where(more, low, 0)
            x = np.where(more, x >> U(step), x)
            pos += np.where(more, step, 0)
        return pos


class Monotone:
    """Elias-Fano of a sequence that doesn't fall."""

    def __init__(self, arrays: dict, name: str, meta: dict):
        self.low, self.width = arrays[f"{name}_low"], meta[f"{name}_width"]
        self.high = Bits(arrays[f"{name}_high"], arrays[f"{name}_before"], True)

    @staticmethod
    def build(values: np.ndarray, name: str, arrays: dict, meta: dict) -> None:
        n, top = len(values), int(values[-1]) + 1
        width = max(0, (top // n).bit_length() - 1)
        arrays[f"{name}_low"] = pack(values.astype(np.uint64) & U((1 << width) - 1), np.arange(n) * width, n * width) if width else np.zeros(2, np.uint64)
        arrays[f"{name}_high"], arrays[f"{name}_before"] = Bits.build((values >> width) + np.arange(n), (top >> width) + n + 1, True)
        meta[f"{name}_width"] = width

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self.high.select(i) - i
        return high << self.width | unpack(self.low, i * self.width, np.full(len(i), self.width)).astype(np.int64) if self.width else high


# ---------------------------------------------------------------- levels


def build_level(sizes: np.ndarray, places: np.ndarray, values: np.ndarray, widths: np.ndarray, arrays: dict, meta: dict) -> None:
    """The search structure of one file.

    sizes: children of each context; places: of each child, its value scaled to 32 bits; widths: low bits, by context.
    """
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    low = np.concatenate([[0], np.cumsum(sizes * widths)]).astype(np.int64)
    n = int(first[-1])
    context = np.repeat(np.arange(len(sizes)), sizes)
    bucket = first[context] + (places * sizes[context].astype(np.uint64) >> U(32)).astype(np.int64)
    arrays["high"], arrays["high_before"] = Bits.build(bucket + np.arange(n), 2 * n + 64, False)
    own = widths[context]
    arrays["low"] = pack(values & ((U(1) << own.astype(np.uint64)) - U(1)), low[context] + (np.arange(n) - first[context]) * own, int(low[-1]))
    Monotone.build(first, "first", arrays, meta)
    Monotone.build(low, "lows", arrays, meta)
    meta["n"] = n


class Level:
    """A memory-mapped file of a level."""

    def __init__(self, folder: str, name: str):
        raw = _mapped(f"{folder}/{name}")
        #: Bytes in memory; a mapped file has none of its own.
        self.held = 0 if isinstance(raw, np.memmap) else raw.nbytes
        size = int(raw[:8].view(np.uint64)[0])
        self.meta = json.loads(raw[8 : 8 + size].tobytes())
        self.arrays = {k: raw[at : at + n].view(kind) for k, (at, n, kind) in self.meta.pop("arrays").items()}
        self.high = Bits(self.arrays["high"], self.arrays["high_before"], False)
        self.first, self.lows = Monotone(self.arrays, "first", self.meta), Monotone(self.arrays, "lows", self.meta)

    def children(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first.get(context)
        return first, self.first.get(context + 1) - first

    def find(self, context: np.ndarray, places: np.ndarray, values: np.ndarray, width) -> np.ndarray:
        """The index of each child among all of the file, or -1. width(sizes) gives the low bits of contexts."""
        first, size = self.children(context)
        out = np.full(len(context), -1, np.int64)
        has = np.flatnonzero(size > 0)
        if not len(has):
            return out
        first, size, lows = first[has], size[has], self.lows.get(context[has])
        bucket = first + (places[has] * size.astype(np.uint64) >> U(32)).astype(np.int64)
        begin = np.where(bucket > 0, self.high.select(np.maximum(bucket - 1, 0)) - (bucket - 1), 0)
        end = self.high.select(bucket) - bucket
        own = width(size)
        wanted = values[has] & ((U(1) << own.astype(np.uint64)) - U(1))
        live = np.flatnonzero(begin < end)
        at = begin
        while len(live):
            got = unpack(self.arrays["low"], lows[live] + (at[live] - first[live]) * own[live], own[live])
            hit = got == wanted[live]
            out[has[live[hit]]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def _store(folder: str):
    from pyarrow import fs

    if re.match(r"file:|/", folder):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def write_level(folder: str, name: str, arrays: dict, meta: dict) -> None:
    """One file: length of the JSON head, head, arrays at multiples of 8 bytes."""
    arrays = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [at, v.nbytes, v.dtype.str]
        at += (v.nbytes + 7) // 8 * 8
    room = (len(json.dumps(meta | {"arrays": head})) + 40 * len(arrays) + 7) // 8 * 8
    head = {k: [x + 8 + room, n, kind] for k, (x, n, kind) in head.items()}
    text = json.dumps(meta | {"arrays": head}).encode().ljust(room)
    store, path = _store(folder)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(np.array([room], np.uint64).tobytes() + text)
        for v in arrays.values():
            out.write(v.tobytes() + b"\0" * (-v.nbytes % 8))
    store.move(own, f"{path}/{name}")


def _mapped(path: str) -> np.ndarray:
    store, inner = _store(path)
    if type(store).__name__ == "LocalFileSystem":
        return np.memmap(inner, np.uint8, "r")
    with store.open_input_file(inner) as src:
        got = np.frombuffer(mmap.mmap(-1, src.size()), np.uint8)
        at = 0
        while part := src.read(1 << 22):
            got[at : at + len(part)] = np.frombuffer(part, np.uint8)
            at += len(part)
    return got


# ---------------------------------------------------------------- tokens and counts


def token_blocks(hasher: WordHasher, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(tokens, rows, starts, seen): runs of tokens with the row of each run's texts and where they start, ends included.

    A run has whole texts, but for a text that is long: it comes in blocks, hashed one after the other; from the second
    on, a block's first token is the last one before it, and `seen` is 1.
    """
    tokens, rows, sizes, n, before = [], [], [], 0, None
    for first, words, bounds, ends in hasher.pieces(column):
        if not ends or before is not None or len(bounds) == 2 and len(words) > TOKENS:  # a long text, or a piece of it
            if n:
                yield *_run(tokens, rows, sizes), 0
                tokens, rows, sizes, n = [], [], [], 0
            own, before = np.append(words, END) if ends else words, words[:0] if before is None else before
            for at in range(0, len(own), TOKENS):
                block = np.concatenate([before, own[at : at + TOKENS]])
                yield block, np.array([first]), np.array([0]), len(before)
                before = block[-1:]
            before = None if ends else before
            continue
        count = np.diff(bounds)
        tokens.append(np.insert(words, bounds[1:], END))
        rows.append(np.arange(first, first + len(count)))
        sizes.append(count + 1)
        n += len(words) + len(count)
        if n >= TOKENS:
            yield *_run(tokens, rows, sizes), 0
            tokens, rows, sizes, n = [], [], [], 0
    if n:
        yield *_run(tokens, rows, sizes), 0


def _run(tokens, rows, sizes):
    sizes = np.concatenate(sizes)
    return np.concatenate(tokens), np.concatenate(rows), np.cumsum(sizes) - sizes


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


BLOB = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOB_SQL = "part int, n long, keys binary, counts binary"


def blobs(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Sorted keys cut at bounds; each part's differences with equal bytes together, compressed."""
    import zstandard as Z

    press = Z.ZstdCompressor(level=1).compress
    cut = np.append(np.searchsorted(keys, bounds), len(keys))
    rows = []
    for part in np.flatnonzero(np.diff(cut)):
        k = keys[cut[part] : cut[part + 1]]
        gaps = np.diff(k, prepend=U(0))
        c = counts[cut[part] : cut[part + 1]].astype("<u8")
        rows.append((part, len(k), *(press(x.view(np.uint8).reshape(-1, 8).T.tobytes()) for x in (gaps, c))))
    return batch_of(BLOB, *(zip(*rows, strict=True) if rows else [[]] * 4))


def unblob(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard as Z

    d = Z.ZstdDecompressor()
    gaps, c = (np.ascontiguousarray(np.frombuffer(d.decompress(x), np.uint8).reshape(8, n).T).view("<u8").ravel() for x in (keys, counts))
    return np.cumsum(gaps, dtype=np.uint64), c.astype(np.int64)


def gathered(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, counts) of rows that come in order of part; blobs are merged as they come, so memory follows the part."""
    part, keys, counts, extra = None, [], [], 0
    for batch in batches:
        for p, n, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if p != part:
                if part is not None:
                    yield part, *merged(keys, counts)
                part, keys, counts, extra = p, [], [], 0
            a, b = unblob(n, k, c)
            keys.append(a)
            counts.append(b)
            extra += len(a)
            if len(keys) > 1 and extra > max(TOKENS, 2 * len(keys[0])):
                a, b = merged(keys, counts)
                keys, counts, extra = [a], [b], 0
    if part is not None:
        yield part, *merged(keys, counts)


# ---------------------------------------------------------------- the model


def word_width(bits: int):
    return lambda size: bits - np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1


def child_width(words: int):
    return lambda size: np.floor(np.log2(np.maximum(words // np.maximum(size, 1) + 1, 1))).astype(np.int64) + 2


def child_places(ids: np.ndarray, words: int) -> np.ndarray:
    return (ids.astype(np.uint64) << U(32)) // U(max(1, words))


class Trie:
    """The files of both levels. Word ids are ranks of hashes; the id of the start symbol is the number of words."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.bits, self.words, self.total = spec["bits"], spec["words"], spec["total"]
        self.offsets = np.array(spec["offsets"], np.int64)
        self.bounds = np.array(spec.get("bounds", []), np.uint64)
        self.open: dict = {}

    def level(self, name: str) -> Level | None:
        if name not in self.spec["files"]:
            return None
        if name not in self.open:
            self.open[name] = Level(self.spec["folder"], name)
            held = [(k, x.held) for k, x in self.open.items() if x.held]
            while len(held) > 1 and sum(n for _, n in held) > OPEN_BYTES:
                del self.open[held.pop(0)[0]]  # the one that was opened first
        return self.open[name]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted hashes."""
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        parts = 1 << self.bits
        cut = np.append(np.searchsorted(hashes, np.arange(parts, dtype=np.uint64) << U(64 - self.bits)), len(hashes))
        for part in np.flatnonzero(np.diff(cut)):
            if (level := self.level(f"words-{part}")) is not None:
                own = hashes[cut[part] : cut[part + 1]] << U(self.bits) >> U(self.bits)
                at = level.find(np.zeros(len(own), np.int64), own >> U(32 - self.bits), own, word_width(64 - self.bits))
                hit = at >= 0
                s = slice(cut[part], cut[part + 1])
                out[s] = np.where(hit, at + self.offsets[part], -1)
                counts[s][hit] = level.arrays["counts"][at[hit]]
        return out, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted word ids; the start symbol's is the number of texts."""
        out = np.full(len(ids), self.spec["texts"], np.int64)
        cut = np.searchsorted(ids, np.append(self.offsets, self.words))
        for part in np.flatnonzero(np.diff(cut)):
            s = slice(cut[part], cut[part + 1])
            out[s] = self.level(f"words-{part}").arrays["counts"][ids[s] - self.offsets[part]]
        return out

    def _parts(self, keys: np.ndarray) -> Iterator[tuple[Level, slice]]:
        cut = np.append(np.searchsorted(keys, self.bounds), len(keys))
        for part in np.flatnonzero(np.diff(cut)):
            if (level := self.level(f"pairs-{part}")) is not None:
                yield level, slice(cut[part], cut[part + 1])

    def successors(self, ids: np.ndarray) -> np.ndarray:
        """Distinct successors of sorted context ids."""
        out = np.zeros(len(ids), np.int64)
        for level, s in self._parts(ids.astype(np.uint64) << U(32)):
            own = ids[s] - level.meta["context"]
            inside = own < level.meta["contexts"]
            out[s][inside] = level.children(own[inside])[1]
        for context, n in self.spec["cut"].items():  # contexts over several files
            out[ids == int(context)] = n
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Discounted probability of sorted keys (context id << 32 | word id); 0 where the pair is unknown."""
        out = np.zeros(len(keys))
        for level, s in self._parts(keys):
            context = (keys[s] >> U(32)).astype(np.int64) - level.meta["context"]
            inside = np.flatnonzero(context < level.meta["contexts"])
            word = keys[s][inside] & U(0xFFFFFFFF)
            at = level.find(context[inside], child_places(word, self.words), word, child_width(self.words))
            hit = at >= 0
            out[np.arange(s.start, s.stop)[inside[hit]]] = level.arrays["codebook"][level.arrays["codes"][at[hit]]]
        return out


def quantised(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes of values, and the mean of each code's values; codes hold about equally many distinct values."""
    if not len(logs):
        return np.zeros(0, np.uint8), np.zeros(256)
    levels = np.unique(np.round(logs, 4))
    at = np.unique(np.linspace(0, len(levels), 257).astype(np.int64)[1:-1])
    at = at[(at > 0) & (at < len(levels))]
    codes = np.searchsorted((levels[at - 1] + levels[at]) / 2, logs).astype(np.uint8)
    n = np.maximum(1, np.bincount(codes, minlength=256))
    return codes, np.bincount(codes, logs, 256) / n


def train(docs: DataFrame) -> dict:
    """Writes the trie of docs(text) to the shared folder; the driver gets sizes and the commonest words of each range."""
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select("text")
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # ranges follow the text, so that a range's level fits a task however large the corpus
    bits = max(1, min(MAX_BITS, (max(spread, -(-size // RANGE_BYTES)) - 1).bit_length()))
    folder = new_folder(spark, "ngrams")

    def count_words(batches):
        hasher, bounds = WordHasher(), np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)
        keys, counts, size = [], [], 0
        for batch in batches:
            for tokens, _, _, seen in token_blocks(hasher, batch.column(0)):
                k, c = np.unique(tokens[seen:], return_counts=True)
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size > HELD:
                    k, c = merged(keys, counts)
                    if len(k) > HELD // 2:
                        yield blobs(k, c, bounds)
                        keys, counts, size = [], [], 0
                    else:
                        keys, counts, size = [k], [c], len(k)
        if size:
            yield blobs(*merged(keys, counts), bounds)

    found = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("heavy", pa.list_(pa.int64())), ("heavy_counts", pa.list_(pa.int64())), ("ends", pa.int64())])

    def write_words(batches):
        for part, keys, counts in gathered(batches):
            own, arrays, meta = keys << U(bits) >> U(bits), {"counts": counts}, {}
            sizes = np.array([len(keys)], np.int64)
            build_level(sizes, own >> U(32 - bits), own, word_width(64 - bits)(sizes), arrays, meta)
            write_level(folder, f"words-{part}", arrays, meta)
            heavy = np.flatnonzero(counts > counts.sum() // 32)
            yield batch_of(found, [part], [len(keys)], [int(counts.sum())], [heavy.tolist()], [counts[heavy].tolist()], [int(counts[keys == END].sum())])

    rows = text.mapInArrow(count_words, BLOB_SQL).repartition(spread, "part").sortWithinPartitions("part")
    rows = rows.mapInArrow(write_words, "part int, n long, total long, heavy array<long>, heavy_counts array<long>, ends long").collect()
    got = {r["part"]: r for r in rows}
    sizes = [got[p]["n"] if p in got else 0 for p in range(1 << bits)]
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int).tolist()
    words, total, texts = sum(sizes), sum(r["total"] for r in rows), sum(r["ends"] for r in rows)
    spec = {"folder": folder, "bits": bits, "words": words, "total": total, "texts": texts, "offsets": offsets, "files": {f"words-{p}" for p in got}, "cut": {}}
    if not words:
        return spec
    if words > MAX_WORDS:
        raise ValueError(f"{words} distinct words, {MAX_WORDS} at most")
    # ranges of keys: level 1's, with contexts over a range's share on their own and cut by word ids
    share = max(1, total >> bits)
    heavy = {offsets[r["part"]] + i: c for r in rows for i, c in zip(r["heavy"], r["heavy_counts"], strict=True) if c > share}
    if texts > share:
        heavy[words] = texts
    bounds = {o << 32 for o in offsets} | {words << 32}
    for word, c in heavy.items():
        pieces = -(-c // share)
        bounds |= {(word << 32) + words * j // pieces for j in range(pieces)} | {(word + 1) << 32}
    spec["bounds"] = sorted(bounds)

    def count_pairs(batches):
        hasher, trie = WordHasher(), Trie(spec)
        keys, counts, size = [], [], 0
        for batch in batches:
            for tokens, _, starts, seen in token_blocks(hasher, batch.column(0)):
                own, back = np.unique(tokens, return_inverse=True)
                ids = trie.ids(own)[0][back]
                context = np.empty_like(ids)
                context[1:] = ids[:-1]
                context[starts] = words
                k, c = np.unique((context.astype(np.uint64) << U(32) | ids.astype(np.uint64))[seen:], return_counts=True)
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size > HELD:
                    yield blobs(*merged(keys, counts), trie.bounds)
                    keys, counts, size = [], [], 0
        if size:
            yield blobs(*merged(keys, counts), trie.bounds)

    wrote = pa.schema([("part", pa.int32()), ("cut", pa.list_(pa.int64())), ("cut_n", pa.list_(pa.int64()))])

    def write_pairs(batches):
        trie = Trie(spec)
        for part, keys, counts in gathered(batches):
            context = (keys >> U(32)).astype(np.int64)
            start = int(context[0])
            sizes = np.bincount(context - start)
            own = np.flatnonzero(sizes)
            of = np.repeat(trie.counts(own + start), sizes[own])
            arrays, meta = {}, {"context": start, "contexts": len(sizes)}
            arrays["codes"], log = quantised(np.log10((counts - DISCOUNT) / of))
            arrays["codebook"] = 10.0**log
            word = keys & U(0xFFFFFFFF)
            build_level(sizes, child_places(word, words), word, child_width(words)(sizes), arrays, meta)
            write_level(folder, f"pairs-{part}", arrays, meta)
            mine = [i for i in own.tolist() if i + start in heavy]
            yield batch_of(wrote, [part], [[i + start for i in mine]], [[int(sizes[i]) for i in mine]])

    rows = text.mapInArrow(count_pairs, BLOB_SQL).repartition(spread, "part").sortWithinPartitions("part")
    for r in rows.mapInArrow(write_pairs, "part int, cut array<long>, cut_n array<long>").collect():
        spec["files"].add(f"pairs-{r['part']}")
        for context, n in zip(r["cut"], r["cut_n"], strict=True):
            spec["cut"][context] = spec["cut"].get(context, 0) + n
    return spec


FIELDS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def score_tokens(trie: Trie, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether known, base score, score) of each token of texts that start at starts."""
    own, back = np.unique(tokens, return_inverse=True)
    ids, counts = trie.ids(own) if trie.words else (np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64))
    base = (counts + 0.5) / (trie.total + 0.5 * (trie.words + 1))
    known = (ids >= 0)[back]
    p = base[back]
    logs = np.log10(base)[back]
    if trie.words:
        order = np.flatnonzero(ids >= 0)
        # what each known word leaves to its backoff, as a context
        left = np.ones(len(own) + 1)
        left[order] = DISCOUNT * trie.successors(ids[order]) / np.maximum(1, counts[order])
        begin = np.array([trie.words], np.int64)
        left[-1] = DISCOUNT * trie.successors(begin)[0] / max(1, trie.spec["texts"])
        context, which = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
        token_ids = ids[back]
        context[1:], which[1:] = token_ids[:-1], back[:-1]
        context[starts], which[starts] = trie.words, len(own)
        p = p * np.where(context >= 0, left[which], 1.0)
        both = np.flatnonzero((context >= 0) & (token_ids >= 0))
        keys, again = np.unique(context[both].astype(np.uint64) << U(32) | token_ids[both].astype(np.uint64), return_inverse=True)
        p[both] += trie.pairs(keys)[again]
    return known.astype(np.int64), logs, np.log10(p)


def score_texts(docs: DataFrame, spec: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of docs(doc_id, text)."""
    schema = pa.schema(FIELDS)

    def work(batches):
        hasher, trie = WordHasher(), Trie(spec)
        for batch in batches:
            part = None  # sums of the blocks so far of a long text
            for tokens, rows, starts, seen in token_blocks(hasher, batch.column(1)):
                each = (np.ones(len(tokens), np.int64), *score_tokens(trie, tokens, starts))
                sums = [np.add.reduceat(x[seen:], starts) for x in each]
                if seen:
                    sums = [a + b for a, b in zip(part, sums, strict=True)]
                if tokens[-1] == END:
                    yield batch_of(schema, batch.column(0).slice(int(rows[0]), len(rows)), *sums)
                part = sums

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5))
    with bounded_batches(spark, **BATCH):
        spec = train(docs.where(fold != 1))
        out = materialised(score_texts(docs, spec), "scores")
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(spec["total"]).cast("long").alias("train_tokens"), "base_score", "score")
