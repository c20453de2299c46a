"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

A piece (one match of the splitting pattern) has a segment tree over its byte positions. The leaf of a live position
holds the rank of the pair that starts there, an inner node the least (rank, position) below it, so the root is the
leftmost pair of minimum rank. A merge changes two leaves at most and empties one; each change walks up one path.
Short pieces are handled as a forest: trees of equal size stacked in one array, one merge of every piece a step.
A piece that is itself a token gets its rank without merging, as in the tiktoken library.

Cases: a null text is empty and has no tokens; a text has any length (pieces are encoded in blocks; a long piece takes
n log n steps); repeated rows give equal results; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of

#: Pieces whose ids a worker keeps; beyond it the store starts anew.
CACHE_PIECES = 250_000
#: Longest piece in the forest; longer ones have a tree of their own.
FOREST_BYTES = 64
#: Texts of more characters are split as a stream.
LONG_TEXT = 1_000_000
NONE = np.int64(1 << 62)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteBPE:
    def __init__(self, path: str, pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        # the tiktoken library takes \s as Unicode's White_Space
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        size = max(self.rank.values()) + 1
        self.bytes_of = [b""] * size
        for token, r in self.rank.items():
            self.bytes_of[r] = token
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.shift = np.int64(size)
        # a pair of tokens -> the rank of their bytes together, for all pairs that can merge
        found = {}
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    found[a * size + b] = r
        self.pairs = found
        self.pair_keys = np.array(sorted(found), np.int64)
        self.pair_ranks = np.array([found[int(k)] for k in self.pair_keys], np.int64)
        self.cache: dict[str, bytes] = {}

    # ---- the forest

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.shift + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def forest(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of 1 to FOREST_BYTES bytes."""
        width = 1 << (max(map(len, pieces)) - 1).bit_length() if pieces else 1
        n, lens = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width + 1) < lens[:, None]
        ids[inside] = self.byte_id[flat]
        nxt = np.where(inside, np.arange(1, width + 2), 0)
        prv = np.arange(-1, width) * np.ones((n, 1), np.int64)
        tree = np.full((n, 2 * width), NONE, np.int64)
        both = inside[:, :-1] & inside[:, 1:]
        rows, cols = np.nonzero(both)
        ranks = self._pair(ids[rows, cols], ids[rows, cols + 1])
        tree[rows, width + cols] = np.where(ranks < NONE, ranks * width + cols, NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2

        def put(rows, at, value):
            node = width + at
            tree[rows, node] = value
            while width > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                if node[0] == 1:
                    return

        live = np.flatnonzero(tree[:, 1] < NONE) if width > 1 else np.zeros(0, np.int64)
        while len(live):
            top = tree[live, 1]
            at, rank = top % width, top // width
            gone = nxt[live, at]
            after = nxt[live, gone]
            ids[live, at] = rank
            ids[live, gone] = -1
            nxt[live, at] = after
            more = after < lens[live]
            prv[live[more], after[more]] = at[more]
            right = np.full(len(live), NONE, np.int64)
            got = self._pair(rank[more], ids[live[more], after[more]])
            right[more] = np.where(got < NONE, got * width + at[more], NONE)
            put(live, at, right)
            put(live, gone, NONE)
            before = prv[live, at]
            has = before >= 0
            if has.any():
                r, b = live[has], before[has]
                got = self._pair(ids[r, b], rank[has])
                put(r, b, np.where(got < NONE, got * width + b, NONE))
            live = live[tree[live, 1] < NONE]
        return [[x for x in row if x >= 0] for row in ids[:, :width].tolist()]

    def single(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length: one tree, in arrays of machine integers, about 60 bytes a byte."""
        n = len(piece)
        width = 1 << max(0, n - 1).bit_length()
        none, pairs, size = int(NONE), self.pairs, int(self.shift)
        ids = array("q", self.byte_id[np.frombuffer(piece, np.uint8)].astype(np.int64).tobytes())
        nxt, prv = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        tree = array("q", [none]) * (2 * width)
        for i in range(n - 1):
            r = pairs.get(ids[i] * size + ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at, value):
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        while width > 1 and tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = nxt[at]
            after = nxt[gone]
            ids[at], ids[gone], nxt[at] = rank, -1, after
            put(gone, none)
            if after < n:
                prv[after] = at
                r = pairs.get(rank * size + ids[after])
                put(at, none if r is None else r * width + at)
            else:
                put(at, none)
            before = prv[at]
            if before >= 0:
                r = pairs.get(ids[before] * size + rank)
                put(before, none if r is None else r * width + before)
        return [x for x in ids if x >= 0]

    # ---- texts

    def _learn(self, pieces: set[str]) -> None:
        """Makes sure that the store has the ids of these pieces; a full store starts anew with them."""
        missing = pieces.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_PIECES:
            self.cache.clear()
            missing = pieces
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in missing:
            raw = piece.encode()
            if (whole := self.rank.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > FOREST_BYTES:
                self.cache[piece] = np.array(self.single(raw), "<u4").tobytes()
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in by_width.values():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                for (piece, _), ids in zip(part, self.forest([x[1] for x in part]), strict=True):
                    self.cache[piece] = np.array(ids, "<u4").tobytes()

    def _blocks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.split.findall(text)
        else:
            found = self.split.finditer(text)
            while block := [m.group() for m in islice(found, 200_000)]:
                yield block

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and chars < LONG_TEXT:
                chars += len(texts[end])
                end += 1
            if end == at + 1:
                parts = []
                for block in self._blocks(texts[at]):
                    self._learn(set(block))
                    parts.append(b"".join(map(self.cache.__getitem__, block)))
                yield b"".join(parts)
            else:
                split = [[p for block in self._blocks(t) for p in block] for t in texts[at:end]]
                self._learn(set().union(*split))
                for pieces in split:
                    yield b"".join(map(self.cache.__getitem__, pieces))
            at = end

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_many([text])), "<u4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; they need not be whole characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_models: dict[str, ByteBPE] = {}


def model(path: str) -> ByteBPE:
    """One vocabulary for a worker process."""
    if path not in _models:
        _models[path] = ByteBPE(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and the decoded bytes of every text."""
    return _run(docs, path, False)


def _run(docs: DataFrame, path: str | None, digest: bool) -> DataFrame:
    path = path or default_path()
    kind = pa.string() if digest else pa.binary()
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), (names[0], kind), (names[1], kind)])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def work(batches):
        bpe = model(path)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                part = ["" if t is None else t for t in texts.slice(at, 256).to_pylist()]
                n, ids, decoded = [], [], []
                for blob in bpe.encode_many(part):
                    n.append(len(blob) // 4)
                    back = bpe.decode(np.frombuffer(blob, "<u4"))
                    ids.append(sha(blob) if digest else blob)
                    decoded.append(sha(back) if digest else back)
                yield batch_of(schema, batch.column(0).slice(at, 256), n, ids, decoded)

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id long, n_tokens long, {names[0]} {'string' if digest else 'binary'}, {names[1]} {'string' if digest else 'binary'}")


def op5(spark, sf_dir: str) -> DataFrame:
    """The digests of encode_texts, made where the ids are, so that no ids leave the worker."""
    return _run(spark.read.parquet(f"{sf_dir}/documents.parquet"), None, True)
