"""The corpus pipeline: five of the operators in spreadloom.llm, one after the other over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadloom.llm import bpe, langid, linededup, minhash, mixing
from spreadloom.llm.common import cap_batches, checked_broadcast, materialised

#: Least score of a language for a document to stay.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without a likely language. Learns from docs whose lang isn't null."""
    cap_batches(spark)  # workers of all stages live side by side
    langs, logs = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.keep_known(docs, langs, logs, MIN_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents repeat; no document goes. n_chars follows the text."""
    out = linededup.dedup_lines(docs)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared: not so maps, variants, nor what holds them."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, similarity 0.8): the one of least id.

    By row, not by id: a text stays where only other texts of its id have an earlier copy. Of leading rows that share
    the id, that of the least hash of the text stays; of rows with the same text too, the least by all columns that have
    an order, then by a hash of the row as JSON. Rows without words, and those without an id whose text no row with an id has, are in no group and all stay.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text")).where("node IS NOT NULL")
    found = materialised(found.select("doc_id", "text_hash", "node", "kept"), "groups")
    led = found.where("kept").groupBy("node").agg(F.min("text_hash").alias("first"), F.count("*").alias("n")).where("n > 1")
    led = materialised(led, "leaders")
    gone = found.where("NOT kept").select("doc_id", "text_hash")
    name = lambda df: df.distinct().select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).withColumn("__h", minhash.text_hash(F.col("__row.text")))
    same = F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))
    kept = []
    if led.head(1):  # rows that share a leader's id
        lead = found.where("kept").join(led, "node")
        one = materialised(name(lead.where("text_hash = first").select("doc_id", "text_hash")), "gone")
        own = rows.join(checked_broadcast(one, one.count(), minhash.MAX_BROADCAST), same, "left_semi")
        order = [F.col("__row").getField(f.name) for f in docs.schema.fields if _ordered(f.dataType)]
        first = F.min_by("__row", F.struct(*order, F.xxhash64(F.to_json("__row"))))
        kept.append(own.groupBy(F.col("__row.doc_id").alias("__id"), "__h").agg(first.alias("__row")).select("__row"))
        gone = gone.union(lead.select("doc_id", "text_hash"))
    gone = materialised(name(gone), "gone")
    kept.insert(0, rows.join(checked_broadcast(gone, gone.count(), minhash.MAX_BROADCAST), same, "left_anti").select("__row"))
    out = kept[0] if len(kept) == 1 else kept[0].union(kept[1])
    return out.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lowers the shares of junk and toxic text to their targets; rates are at most 1, and the leading domain's stay 1."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mixed(docs, labels, mixing.TARGETS, most=1.0, headroom=0.05)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids as little-endian unsigned 32-bit integers, and the digest of the decoded bytes."""
    cap_batches(spark)
    out = bpe.encode_texts(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("byte_bpe", byte_bpe)]

#: Language ID, MinHash, the fit of rates and BPE can't be put as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return docs
