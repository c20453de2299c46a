"""Line dedup: lines that occur in many documents go, except in the largest document that holds them.

DataFrame functions only. Lines are exploded as 128-bit hashes of their normalised form, never with their text; an
aggregate counts distinct documents for a hash; the lines over the threshold come back as positions of a document,
and the text is put together from the positions that stay. Only that last join moves texts, and each text once.

Cases: a null or empty text is one empty line; a null doc_id holds lines but doesn't count as a document and is never
the largest; rows repeated under one doc_id count as one document; other columns are carried along and may have any
name. Ties can't occur: the largest doc_id is unique. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialised, salted_join

#: Shortest key, in code points, and least number of documents, for which lines are dropped.
MIN_CHARS, MIN_DOCS = 20, 3


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with `text` less the repeated lines, and n_lines and n_dropped in a struct column `line_dedup`.

    The row key is (doc_id, hash of the text): repeated rows share one key, and lose the same lines.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__row"), F.col(doc_id).alias("__id"), F.xxhash64(body).alias("__h"), body.alias("__text"))
    lines = keyed.select("__id", "__h", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", _key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = lines.select("__id", "__h", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(min_docs), "key").alias("k2"))
    # read twice, below: the texts are split and hashed once
    lines = materialised(lines, "lines")
    often = lines.groupBy("k1", "k2").agg(F.countDistinct("__id").alias("n"), F.max("__id").alias("largest")).where(F.col("n") >= min_docs).drop("n")
    drops = salted_join(lines, often, ["k1", "k2"]).where(~F.col("__id").eqNullSafe(F.col("largest")))
    drops = drops.groupBy("__id", "__h").agg(F.collect_set("pos").alias("drop"))
    drops = drops.select(F.col("__id").alias("__id2"), F.col("__h").alias("__h2"), "drop")
    both = keyed.join(drops, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__h") == F.col("__h2")), "left")
    # one element of an outer array binds the split lines once; the inner lambda then reads them by position
    bound = F.array(F.struct(F.split("__text", "\n", -1).alias("lines"), F.col("drop").alias("drop")))
    joined = F.element_at(F.transform(bound, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["drop"]), lambda p: F.get(s["lines"], p)), "\n")), 1)
    kept = F.when(F.col("drop").isNull(), F.col("__text")).otherwise(joined)
    n_lines = (F.length("__text") - F.length(F.translate("__text", "\n", "")) + 1).cast("long")
    info = F.struct(n_lines.alias("n_lines"), F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long").alias("n_dropped"))
    return both.select(*[(kept if c == text else F.col("__row").getField(c)).alias(c) for c in docs.columns], info.alias("line_dedup"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i AS pos, ls[i] AS line,
        translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS largest FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id IS DISTINCT FROM c.largest AS dropped FROM l LEFT JOIN c ON l.k = c.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid
"""
