"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

A window is one lower-cased word, repeated ECHO times so that a frame is never stored raw: its compressed length is
then the cost of the word under a dictionary. Both dictionaries are trained by zstandard, on one half of the labelled
texts: the ordinary one on runs of 20 words, the toxic one on the words of toxic texts that hold a run of GRAM
characters which many toxic and hardly any ordinary texts have (on whole toxic texts the trainer keeps what is common
in all text, and nothing tells the classes apart). Their contents are then used as raw dictionaries. The pair (length
under the toxic dictionary, gain over the ordinary one) of a word of some length makes a cell. On the other half of
the labelled texts, which trained no dictionary, each cell gets the log odds of occurring in a toxic text; a text's
evidence is the sum over its distinct cells, and a threshold on it, chosen there too, becomes score 0.5. The halves
are used so at every size.

The fit takes a bounded sample of the labelled rows: SAMPLE_TOXIC and SAMPLE_ORDINARY of them by the hash of the id,
whole texts, SAMPLE_BYTES characters a class at most; a text that doesn't fit is passed over. Every word of every text is scored.

Cases: a null or empty text has the score of no evidence; where a class has no text in either half, every score is the
toxic share; where the samples are too few to train on, they are the dictionary themselves; equal texts get equal scores; long texts are read in blocks. Labels, lang,
source and doc_id play no part in a score. Rows of labels that are repeated count once; labels of null are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checked_broadcast, crc32_of_id, materialised

SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 2000, 6000, 24_000_000
LEVEL, MIN_MATCH, ECHO, GRAM = 9, 3, 3, 5
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
#: Segment and run lengths of the toxic dictionary's training: long segments hold several words.
SEGMENT, RUN = 200, 6
#: A run counts as toxic from this share of the toxic texts on, this many texts, and this ratio to ordinary texts.
LEAST_SHARE, LEAST_TEXTS, LEAST_RATIO = 0.004, 3, 12
#: Words whose cell a worker keeps; beyond it the store starts anew.
CACHE_WORDS = 400_000

_WORD = re.compile(rb"[^\x00-\x20]+")
BLOCK = 1 << 20


def words(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw)


def _grams(own: list[bytes]) -> set[bytes]:
    out = set()
    for w in set(own):
        p = b" " + w + b" "
        out.update(p[i : i + GRAM] for i in range(len(p) - GRAM + 1))
    return out


def toxic_samples(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Each toxic text's words that hold a run of characters which marks toxic texts."""
    a, b = Counter(), Counter()
    for x in toxic:
        a.update(_grams(x))
    for x in ordinary:
        b.update(_grams(x))
    na, nb = len(toxic), len(ordinary)
    good = {k for k, v in a.items() if v >= max(LEAST_TEXTS, LEAST_SHARE * na) and v / na > LEAST_RATIO * (b[k] + 1) / (nb + 1)}
    return [b" " + w + b" " for x in toxic for w in sorted(set(x)) if not good.isdisjoint(_grams([w]))]


def trained(samples: list[bytes], size: int, **settings) -> bytes:
    """A dictionary's bytes; the samples themselves where they are too few to train on."""
    import zstandard as Z

    try:
        return Z.train_dictionary(size, samples, **settings).as_bytes()
    except (Z.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


class Distance:
    """Compressed lengths of words under two dictionaries, and the weights of their cells."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: dict | None = None, threshold: float = math.inf, scale: float = 1.0, share: float = 0.0):
        import zstandard as Z

        def length(content: bytes):
            dictionary = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
            params = Z.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), min_match=MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
            return Z.ZstdCompressor(compression_params=params, dict_data=dictionary).compress

        self.ordinary, self.toxic = length(ordinary or b" " * 16), length(toxic or b" " * 16)
        self.weights, self.threshold, self.scale, self.share = weights, threshold, scale, share
        self.cells: dict[bytes, tuple | None] = {}

    def cell(self, word: bytes) -> tuple | None:
        """(length, gain, toxic length), each clipped; None where the ordinary dictionary does better."""
        if word in self.cells:
            return self.cells[word]
        p = (b" " + word) * ECHO + b" "
        a, b = len(self.ordinary(p)), len(self.toxic(p))
        got = (min(len(word), 16), min(6, a - b), min(b, 24)) if a >= b else None
        if len(self.cells) >= CACHE_WORDS:
            self.cells.clear()
        if len(word) <= 64:
            self.cells[word] = got
        return got

    def cells_of(self, text: str | None) -> set:
        found: set = set()
        own = (text or "").lower().encode()
        at = 0
        while at < len(own):
            end = at + BLOCK
            if end < len(own):
                m = re.compile(rb"[\x00-\x20]").search(own, end)
                end = m.start() if m else len(own)
            found.update(map(self.cell, set(words(own[at:end]))))
            at = end
        found.discard(None)
        return found

    def evidence(self, text: str | None) -> float:
        return math.fsum(self.weights.get(c, 0.0) for c in self.cells_of(text))

    def score(self, text: str | None) -> float:
        if self.threshold == math.inf:
            return self.share
        x = (self.evidence(text) - self.threshold) / self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def train(rows: list[tuple[str, int]]) -> dict:
    """The arguments of Distance, from (text, toxic) rows; repeated texts count once.

    Every other text of a class trains the dictionaries, the rest calibrates the cells and the threshold.
    """
    texts = dict(rows)
    share = sum(texts.values()) / len(texts) if texts else 0.0
    parts = {(y, k): [words(t.lower().encode()) for t in [t for t, z in texts.items() if z == y][k::2]] for y in (0, 1) for k in (0, 1)}
    if not all(parts.values()):
        return {"ordinary": b"", "toxic": b"", "weights": {}, "share": share}
    plain = trained([b" ".join(x[i : i + 20]) for x in parts[0, 0] for i in range(0, len(x), 20)], ORDINARY_BYTES)
    body = trained(toxic_samples(parts[1, 0], parts[0, 0]), TOXIC_BYTES, k=SEGMENT, d=RUN)
    model = Distance(plain, body)
    sets = {y: [{model.cell(w) for w in set(x)} - {None} for x in parts[y, 1]] for y in (0, 1)}
    counts = {y: Counter(c for x in sets[y] for c in x) for y in (0, 1)}
    weights = {}
    for c, n in counts[1].items():
        w = math.log((n + 0.5) / (len(sets[1]) + 1)) - math.log((counts[0][c] + 0.5) / (len(sets[0]) + 1))
        if w > 1 and n >= 2:
            weights[c] = w
    value = {y: np.array([math.fsum(weights.get(c, 0.0) for c in x) for x in sets[y]]) for y in (0, 1)}
    # the threshold that errs least, in the middle of the gap below it; a text without evidence stays below
    levels = np.unique(np.concatenate([value[0], value[1], [0.0, 1.0]]))[1:]
    errors = [(value[1] < t).sum() + (value[0] >= t).sum() for t in levels]
    at = int(np.argmin(errors))
    threshold = float((levels[at] + (levels[at - 1] if at else 0.0)) / 2)
    return {"ordinary": plain, "toxic": body, "weights": weights, "threshold": threshold, "scale": max(0.5, threshold / 4), "share": share}


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The arguments of Distance, from docs (doc_id, text) and labels (doc_id, toxic).

    The ids of the sample are drawn from labels first and broadcast (their number is bounded), so texts aren't shuffled.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = dict(own.groupBy("toxic").count().collect())
    share = F.coalesce(*[F.when(F.col("toxic") == y, F.lit(min(1.0, most / sizes[y]))) for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)) if sizes.get(y)], F.lit(0.0))
    drawn = own.where(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    drawn = materialised(drawn, "labelled")
    found = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_BYTES).join(checked_broadcast(drawn, drawn.count(), 2 * (SAMPLE_TOXIC + SAMPLE_ORDINARY)), "doc_id")
    rows, used = [], Counter()
    for text, y in found.select("text", "toxic").orderBy(F.xxhash64(F.lit(10), "doc_id"), "text").toLocalIterator():
        if used[y] + len(text) <= SAMPLE_BYTES:
            used[y] += len(text)
            rows.append((text, y))
    return train(rows)


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def work(batches):
        distance = Distance(**shared.value)
        for batch in batches:
            scores = [distance.score(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
            yield batch_of(schema, batch.column(0), scores, [int(x >= 0.5) for x in scores])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double, predicted int")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5))
    model = fit(docs, labels.where(fold != 0))
    return score_texts(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
