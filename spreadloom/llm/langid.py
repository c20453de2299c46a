"""Language ID: multinomial naive Bayes over hashed character n-grams.

The fit counts n-grams of a bounded sample of the labelled rows (SAMPLE_PER_LANG a language, by the hash of the id);
the driver gets one matrix of languages x BUCKETS, which is broadcast. Texts are scored a batch at a time as a sparse
matrix (bucket, count) against the matrix of log probabilities, in numpy. Whole texts are read.

Cases: a null text or one without letters is `und` with score 0, as is every text when nothing is labelled; equal
texts get equal results; a tie of languages goes to the first name; long texts are counted in blocks, so memory
doesn't follow the length; sums are of 64 bits, so blocks don't change them; more than MAX_LANGS languages raise. A
score is the posterior by one order's share of the evidence (the log-likelihood divided by ORDERS), as the orders' n-grams
overlap and would count the same characters over and over. lang, source and doc_id play no part in a prediction. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, crc32_of_id

#: Buckets of the hashed n-grams, longest n-gram, and labelled texts a language that the fit takes (about).
BUCKETS, ORDERS, SAMPLE_PER_LANG = 1 << 15, 3, 4000
#: Languages at most: the matrix goes to the driver and is broadcast, 128 KB a language.
MAX_LANGS = 1000
#: Code points that are counted at a time.
BLOCK = 1 << 18

_NOT_WORD = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    import regex

    return regex.search(r"\p{L}", text) is not None


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of 1 to ORDERS characters of the lower-cased words, in blocks.

    What isn't a letter counts as one space; blocks overlap by what a longer n-gram needs.
    """
    points = np.frombuffer((" " + _NOT_WORD.sub(" ", text.lower()) + " ").encode("utf-32-le"), np.uint32)
    for at in range(0, len(points), BLOCK):
        part = points[max(0, at - ORDERS + 1) : at + BLOCK]
        new = min(at, ORDERS - 1)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, ORDERS + 1):  # h[i] is the hash of the n points that end at i
            h[n - 1 :] = (h[n - 2 : -1] if n > 1 else h) * np.uint32(0x9E3779B1) + part[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
            x = h[max(n - 1, new) :]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield (x ^ (x >> np.uint32(13))) % np.uint32(BUCKETS)


def counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for x in grams(text):
        total += np.bincount(x, minlength=BUCKETS)
    return total


def fit(docs: DataFrame, sample: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (languages x BUCKETS), from rows of (doc_id, text, lang).

    The share of a language's rows that is taken makes `sample` of them on average; a smaller language is whole.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(labelled.groupBy("lang").count().collect())
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32)
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"{len(sizes)} languages, {MAX_LANGS} at most")
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sorted(sizes.items())])
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if has_letter(text):
                    lang = batch.column(0)[i].as_py()
                    total[lang] = total.get(lang, 0) + counts(text)
        for lang, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], ["lang", "bucket", "n"])

    table = drawn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    matrix = np.full((len(langs), BUCKETS), 0.5)
    for k, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        matrix[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32)


def score_column(texts: pa.Array, names: list[str], table: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and posterior of each text: equal priors, and one n-gram order's worth of evidence.

    table: log probabilities, BUCKETS x languages. Rows of the sparse matrix are gathered until a block is full.
    """
    pred, sure = ["und"] * len(texts), [0.0] * len(texts)
    cols, data, ends, rows = [], [], [0], []
    for i in range(len(texts)):
        text = texts[i].as_py()
        if text and names and has_letter(text):
            if len(text) < 4000:
                at = np.concatenate(list(grams(text)))
                n = np.ones(len(at), np.float32)
            else:
                total = counts(text)
                at = np.flatnonzero(total)
                n = total[at].astype(np.float32)
            rows.append(i)
            cols.append(at)
            data.append(n)
            ends.append(ends[-1] + len(at))
        if rows and (ends[-1] > 1 << 18 or i == len(texts) - 1):
            product = table[np.concatenate(cols)] * np.concatenate(data)[:, None]
            sums = np.add.reduceat(product, np.array(ends[:-1]), axis=0, dtype=np.float64) / ORDERS
            best = sums.argmax(1)
            p = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            for j, r in enumerate(rows):
                pred[r], sure[r] = names[best[j]], float(p[j])
            cols, data, ends, rows = [], [], [0], []
    return pred, sure


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    names = list(langs)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches):
        for batch in batches:
            yield batch_of(schema, batch.column(0), *score_column(batch.column(1), names, shared.value))

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, langs: list[str], logs: np.ndarray, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    names, at = list(langs), docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            _, sure = score_column(batch.column(at), names, shared.value)
            yield batch.filter(pa.array([x > 0 and x >= least for x in sure], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4))
    langs, logs = fit(docs.where(fold != 2))
    return predict(docs, langs, logs).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
