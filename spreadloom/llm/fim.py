"""Fill-in-middle: texts cut in three, with the middle moved to the end, for training on infilling.

A text is a run of units: a word with the white space before it, or white space that ends the text. It is seen as blocks
of BLOCK bytes; a Fenwick tree over the blocks holds how many units end in them and how many code points begin in them.
A cut after k units is found by descending the tree with binary lifting, which gives the block and the code points
before it; the boundary itself is then located among the bytes of that block. White space is ASCII, so bytes of UTF-8
tell units as code points do.

Which form a text takes, and where it is cut, follows from a digest of seed and id alone, so a lost task makes the same
rows again. A text that holds a marker stays plain; any other comes back exactly from output and form (`restored`), as
no marker can arise where pieces meet.

Cases: a null text is empty, and an empty text is plain with no units; a null doc_id counts as an empty id; rows that
repeat, or share an id, are transformed each on its own; a text of any length is read a megabyte at a time beside the
text itself; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, utf8

#: Bytes of a block of the tree, and bytes whose blocks are counted at a time.
BLOCK, PIECE = 1024, 1 << 20
#: Bytes of output that a task sends at a time, about.
SEND = 4 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those that are transformed, and of 100 of these, those with the suffix first.
FIM_PERCENT, SPM_PERCENT = 50, 80


class Blocks:
    """A Fenwick tree over the blocks of a text: units that end and code points that begin in each."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        self.n_blocks = -(-len(data) // block)
        counts = [self._counts(at, min(at + PIECE // block * block, len(data))) for at in range(0, len(data), PIECE // block * block)]
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.concatenate([np.zeros((0, 2), np.int64), *counts]), axis=0)])
        place = np.arange(self.n_blocks + 1)
        self.tree = sums - sums[place - (place & -place)]
        self.units, self.chars = sums[-1].tolist()

    def ends(self, at: int, to: int) -> np.ndarray:
        """Which bytes of data[at:to] end a unit: those of a word before white space, and the last of the text."""
        space = _SPACE[self.data[at : to + 1]]
        out = np.ones(to - at, bool)
        inner = len(space) - 1
        out[:inner] = ~space[:inner] & space[1:]
        return out

    def _counts(self, at: int, to: int) -> np.ndarray:
        first = np.arange(0, to - at, self.block)
        starts = (self.data[at:to] & 0xC0) != 0x80
        return np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (self.ends(at, to), starts)], axis=1)

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before the end of the text's first `units` units."""
        if not units:
            return 0, 0
        at, chars, step = 0, 0, 1 << self.n_blocks.bit_length() >> 1
        while step:
            if at + step <= self.n_blocks and self.tree[at + step, 0] < units:
                at += step
                units -= int(self.tree[at, 0])
                chars += int(self.tree[at, 1])
            step >>= 1
        begin = at * self.block
        own = self.ends(begin, min(begin + self.block, len(self.data)))
        end = begin + int(np.flatnonzero(own)[units - 1]) + 1
        return end, chars + int(((self.data[begin:end] & 0xC0) != 0x80).sum())


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers from the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(raw: bytes, data: np.ndarray, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """(units, form, code points of prefix and middle, output); raw and data hold the same bytes."""
    blocks, h = Blocks(data), draws(doc_id, seed)
    n = blocks.units
    if not raw or h[2] % 100 >= fim_percent or any(x in raw for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    (a, a_chars), (b, b_chars) = map(blocks.cut, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of docs(doc_id, text)."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]

    def work(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            rows, size = [], 0
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = data[at[i] : at[i + 1]]
                rows.append((doc_id, *transform(own.tobytes(), own, doc_id, seed, fim_percent, spm_percent)))
                size += len(rows[-1][-1])
                if size >= SEND or i == batch.num_rows - 1:
                    columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], [k for k, _ in fields])
                    rows, size = [], 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
