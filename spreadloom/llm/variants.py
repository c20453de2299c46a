"""Spelling variants: words a single edit apart, grouped under the commoner one.

Two words differ by one inserted, deleted or replaced code point exactly if they are different and the lengths of their
common prefix and common suffix add up to the longer length less one, or more. That test is made densely: words are rows
of padded code-point matrices, and a tile compares a block of words with another, all pairs at once.

Which blocks meet: of lengths p and s with p + s >= T (T is the longer length less one), either p or s is at least
k = ceil(T / 2), and of what is left at least k2 = ceil((T - k) / 2) is again on one side. So a pair agrees on a prefix
of k + k2, or a prefix of k and a suffix of k2, or the reverse, or a suffix of k + k2. Words are keyed by each of the
four, for their own length and for the next one, and only words of a key are tiled; a pair counts in the first of its
four keys alone. Nothing is lost, and some three quarters of a word must agree before it is compared. A key of many
words is cut into blocks, two of which make a tile (`common.tiles`). A tile sends one row a word, never pairs.

Counting words, and following forms to their roots, are DataFrame functions; counts are combined before they are
shuffled, so a word that is everywhere is one row a task. Roots are found by doubling: a form is at least twice as
common as its word, so a chain of forms is short.

Cases: a null text has no words; a null doc_id counts as an empty id; rows that repeat count as often as they stand;
ties go to the word that is first in code-point order; an empty table gives an empty result. A text's runs are an array
in its task. Words of any length are compared: blocks hold fewer words as these get longer. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, batch_of, bounded_batches, by_tile, materialised, salted_join, tiles, whole_groups

#: Letters that a run is made of, and shortest words and least counts that are grouped.
RUN, MIN_CHARS, MIN_COUNT = "[A-Za-zÀ-ÿ]+", 5, 3
#: One run in so many loses a code point (see word_counts).
DAMAGE = 97
#: A form is so many times as common as its word, at least.
TIMES = 2
#: Code points of a block, its most words, and code points that a tile compares at a time.
CELLS, WORDS, COMPARED = 1 << 19, 2048, 1 << 22


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n) of docs(doc_id, text): lower-cased runs of letters, counted.

    damage: where it divides the crc32 of `doc_id:run`, the run loses a code point; None leaves all runs as they are.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("word"))
    runs = runs.where(F.char_length("word") >= min_chars)
    if damage is not None:
        h, size = F.crc32(F.concat_ws(":", "id", "word").cast("binary")), F.char_length("word")
        at = (h % size).cast("int")
        runs = runs.select(F.when(h % damage == 0, F.concat(F.left("word", at), F.right("word", size - at - 1))).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.char_length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def keyed(words: DataFrame) -> DataFrame:
    """(key, m, c, word, n): the four keys of each word, for pairs whose longer word has m code points."""
    sized = words.select("word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("m"))
    k = F.floor(F.col("m") / 2).cast("int")
    k2 = F.floor((F.col("m") - k) / 2).cast("int")
    ends = [(k + k2, F.lit(0)), (k, k2), (k2, k), (F.lit(0), k + k2)]
    key = F.array(*[F.xxhash64(F.left("word", a), F.right("word", b)) for a, b in ends])
    return sized.select("m", "word", "n", F.posexplode(key).alias("c", "key")).select("key", "m", "c", "word", "n")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a with each row of b; of equal rows, 0."""
    return (a[:, None, :] != b[None, :, :]).argmax(axis=2)


class Block:
    """Words as matrices of code points, from the front and from the back, and their place by count and code points."""

    def __init__(self, words: list[str], counts: np.ndarray, m: int):
        self.words, self.counts = words, counts
        self.front, self.back = (np.array(w, f"<U{m}").view(np.uint32).reshape(len(w), m) for w in (words, [x[::-1] for x in words]))
        self.long = self.front[:, -1] > 0
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.rank, self.at = np.empty(len(words), np.int64), np.array(order, np.int64)
        self.rank[self.at] = np.arange(len(words))


def tile(a: Block, b: Block, m: int, c: int) -> np.ndarray:
    """(near words, best of them) of each word of a among b: a count, and a place in b, or -1. Only pairs that are in key c."""
    k, out = m // 2, np.empty((len(a.words), 2), np.int64)
    k2 = (m - k) // 2
    rows = max(1, COMPARED // (len(b.words) * m))
    for at in range(0, len(a.words), rows):
        p, s = common(a.front[at : at + rows], b.front), common(a.back[at : at + rows], b.back)
        near = (p + s >= m - 1) & (a.long[at : at + rows, None] | b.long)
        first = np.where(p >= k + k2, 0, np.where((p >= k) & (s >= k2), 1, np.where((s >= k) & (p >= k2), 2, 3)))
        near &= first == c
        best = np.where(near, b.rank, len(b.words)).min(axis=1)
        out[at : at + rows, 0] = near.sum(axis=1)
        out[at : at + rows, 1] = np.append(b.at, -1)[best]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are near, and of those the commonest as struct (less, word), less its count."""
    key = ["key", "m", "c"]
    dealt = by_tile(tiles(keyed(words), key, F.greatest(F.lit(1), F.least(F.lit(WORDS), F.floor(F.lit(CELLS) / F.col("m"))))), key)
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("best", pa.string())])

    def work(batches):
        for batch, bounds in whole_groups(batches, 5):
            _, m, c, i, j, own = (batch.column(k).to_numpy() for k in range(6))
            text, n, found = batch.column(6).to_pylist(), batch.column(7).to_numpy(), []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                size, which = int(m[s]), int(c[s])
                if i[s] == j[s]:
                    block = Block(text[s:e], n[s:e], size)
                    sides = [(block, block)]
                else:
                    at = [np.flatnonzero(own[s:e] == x) + s for x in (i[s], j[s])]
                    if not len(at[0]) or not len(at[1]):
                        continue
                    a, b = (Block([text[x] for x in y.tolist()], n[y], size) for y in at)
                    sides = [(a, b), (b, a)]
                for a, b in sides:
                    got = tile(a, b, size, which)
                    for x in np.flatnonzero(got[:, 0]).tolist():
                        y = got[x, 1]
                        found.append((a.words[x], got[x, 0], -b.counts[y], b.words[y]))
            yield batch_of(schema, *(zip(*found, strict=True) if found else [[]] * 4))

    rows = dealt.mapInArrow(work, "word string, n_near long, less long, best string")
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, root), which has a word's next form: the last form that is reached."""
    while True:
        step = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = salted_join(forms, step, ["root"], "left")
        new = materialised(new.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forms = new.select("word", "root")
        if not new.where("moved").head(1):
            return forms


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of each row of words(word, n), whose words are distinct."""
    with bounded_batches(words.sparkSession, rows=10_000):
        words = materialised(words, "words")
        found = words.join(near_words(words), "word", "left")
        ok = -F.col("best.less") >= times * F.col("n")
        found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best.word")).alias("form"), F.when(ok, -F.col("best.less")).alias("form_n"))
        found = materialised(found, "forms")
        last = roots(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
        return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
