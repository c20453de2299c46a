"""Mixing sources to target weights by soft membership. DataFrame functions only.

1. A multinomial naive Bayes classifier over hashed words is counted from a labelled table (doc_id, domain): distinct
   lower-cased words of a text, in BUCKETS buckets. It takes a bounded sample of the labelled rows, SAMPLE of them by
   the hash of the id; their ids are broadcast, so no texts move.
2. Every document gets its token count t and posteriors p over domains: its words are exploded, looked up in the
   broadcast table of log probabilities (BUCKETS rows), and summed again where they are, before the exchange.
3. Rates r >= 0 minimise the weighted least squares of expected domain totals, sum over d of (S_d - T_d)**2 / (2 w_d),
   with S_d = sum of r t p_d, by projected gradient in the metric that weighs a document by its tokens:
   r <- clip(r - step * sum of p_d (S_d - T_d) / (w_d N), 0, most). An iteration is one aggregate of D sums; the driver
   holds D numbers an iteration, and a document's rate is the nested expression of them, from the written table.
   The start is r = 1, so documents that can't be told apart keep equal rates.

Cases: a null or empty text has no tokens and its posteriors are the priors; rate 1 has one copy; no labelled rows or
one domain: all posteriors are 1 and rates scale alike; a target of a domain that no label has is left out and the
others are scaled up; a row that repeats (doc_id and text) is one row of the result with the evidence of one and `rows`
saying how many there are, which the fit weighs by, and `mixed` gives each of them its copies; a repeated label row
counts once (the largest domain). A fit that ITERATIONS end before it is within TOLERANCE or stands still gives a
warning; `residual` says how far the totals are from their targets. A tie can't occur. Extra columns are carried along under any name. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checked_broadcast, materialised

BUCKETS, SAMPLE = 1 << 15, 20_000
ITERATIONS, TOLERANCE = 60, 1e-4
#: Cells of the classifier's table, buckets times domains, that are broadcast at most.
MAX_CELLS = 1 << 22
#: Domains of the labels table and the share of tokens that each shall have.
TARGETS = {"good": 0.92, "junk": 0.06, "toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels(doc_id, quality, toxic)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "good")
    return labels.where(F.col("doc_id").isNotNull()).select("doc_id", domain.alias("domain")).where("domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _buckets(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row (keep, bucket) for each distinct word of __words."""
    return rows.select(*keep, F.explode(F.array_distinct("__words")).alias("__word")).select(*keep, F.pmod(F.xxhash64("__word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def classifier(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], dict[str, float], DataFrame]:
    """Domains, log priors, and the table (bucket, logs array) of BUCKETS rows, from docs(doc_id, text)."""
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}
    domains, n = sorted(sizes), sum(sizes.values())
    if not domains:
        return [], {}, spark.createDataFrame([], "bucket int, logs array<double>")
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20))
    drawn = materialised(drawn, "labelled")
    own = docs.select("doc_id", "text").join(checked_broadcast(drawn, drawn.count(), 4 * SAMPLE), "doc_id")
    counts = _buckets(own.withColumn("__words", _words(F.col("text"))), ["domain"]).groupBy("domain", "bucket").count()
    counts = materialised(counts, "classifier")
    totals = dict(counts.groupBy("domain").agg(F.sum("count")).collect())
    sums = [F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)) for d in domains]
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    logs = F.array(*[F.ln((F.coalesce(s, F.lit(0)) + 0.5) / (totals.get(d, 0) + 0.5 * BUCKETS)) for s, d in zip(sums, domains, strict=True)])
    return domains, {d: math.log(sizes[d] / n) for d in domains}, materialised(every.groupBy("bucket").agg(logs.alias("logs")), "logs")


def posteriors(docs: DataFrame, domains: list[str], priors: dict[str, float], table: DataFrame) -> DataFrame:
    """docs' doc_id and row key, rows, n_tokens, and p: the array of posteriors. One row a distinct (doc_id, text)."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), _words(F.col("text")).alias("__words"))
    if not domains:
        return rows.groupBy("doc_id", "key").agg(F.count("*").alias("rows"), F.max(F.size("__words")).cast("long").alias("n_tokens"), F.array(F.lit(1.0)).alias("p"))
    keyed = rows.select("doc_id", "key", F.size("__words").alias("size"), F.posexplode_outer(F.array_distinct("__words")).alias("__pos", "__word"))
    looked = keyed.withColumn("bucket", F.pmod(F.xxhash64("__word"), F.lit(BUCKETS)).cast("int")).join(checked_broadcast(table, BUCKETS * len(domains), MAX_CELLS), "bucket", "left")
    there = F.col("__word").isNotNull()
    sums = [F.sum(F.when(there, F.get("logs", F.lit(i))).otherwise(0.0)).alias(f"s{i}") for i in range(len(domains))]
    # each row has one first word, or none; a repeated row's evidence is that of one
    got = looked.groupBy("doc_id", "key").agg(F.count_if(F.coalesce("__pos", F.lit(0)) == 0).alias("rows"), F.max("size").cast("long").alias("n_tokens"), *sums)
    got = got.select("doc_id", "key", "rows", "n_tokens", *[(F.col(f"s{i}") / F.col("rows")).alias(f"s{i}") for i in range(len(domains))])
    value = [F.col(f"s{i}") + priors[d] for i, d in enumerate(domains)]
    top = F.greatest(*value) if len(value) > 1 else value[0]
    parts = [F.exp(v - top) for v in value]
    total = sum(parts[1:], parts[0])
    return got.select("doc_id", "key", "rows", "n_tokens", F.array(*[x / total for x in parts]).alias("p"))


def fit_rates(scored: DataFrame, targets: list[float], most: float | None, headroom: float = 0.0) -> tuple[Column, list[dict]]:
    """The rate as an expression of p, and the iterations. scored: rows, n_tokens, p. targets: shares in order of p.

    The tokens wanted are as many as keep the domain of the largest target at rate 1 + headroom.
    """
    d = len(targets)
    p = [F.get("p", F.lit(i)) for i in range(d)]
    t = F.col("n_tokens").cast("double") * F.col("rows")
    first = scored.agg(F.sum(t), *[F.sum(t * x) for x in p], *[F.sum(t * p[i] * p[j]) for i in range(d) for j in range(i, d)]).first()
    total = first[0] or 0.0
    rate: Column = F.lit(1.0)
    if not total:
        return rate, []
    have = [x or 0.0 for x in first[1 : 1 + d]]
    lead = max(range(d), key=lambda i: targets[i])
    wanted = have[lead] * (1 + headroom) / targets[lead]
    goal = [wanted * x for x in targets]
    weight = [max(have[i] / total, 1e-6) for i in range(d)]
    # the Gram matrix in the weighted metric; its largest row sum bounds the largest eigenvalue
    gram = [[0.0] * d for _ in range(d)]
    at = 1 + d
    for i in range(d):
        for j in range(i, d):
            gram[i][j] = gram[j][i] = (first[at] or 0.0) / total / math.sqrt(weight[i] * weight[j])
            at += 1
    step = 1 / max(sum(row) for row in gram)
    trace, now = [], have
    for k in range(ITERATIONS):
        miss = [(now[i] - goal[i]) / total for i in range(d)]
        trace.append({"iteration": k, "totals": now, "error": max(abs(m) * total / max(goal[i], 1.0) for i, m in enumerate(miss))})
        # at the targets, or, where a bound keeps them out of reach, when no domain's total moves any more
        if trace[-1]["error"] < TOLERANCE or k and max(abs(a - b) for a, b in zip(now, trace[-2]["totals"], strict=True)) < TOLERANCE * total:
            break
        move = sum((p[i] * (step * miss[i] / weight[i]) for i in range(1, d)), p[0] * (step * miss[0] / weight[0]))
        rate = F.greatest(rate - move, F.lit(0.0))
        if most is not None:
            rate = F.least(rate, F.lit(float(most)))
        now = [x or 0.0 for x in scored.agg(*[F.sum(rate * t * x) for x in p]).first()]
    else:
        warnings.warn(f"rates not settled after {ITERATIONS} iterations, error {trace[-1]['error']:.3g}", stacklevel=2)
    return rate, trace


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: float | None = None, headroom: float = 0.0) -> DataFrame:
    """doc_id, key, rows, n_tokens, rate, copies, residual, and p_<domain> of each distinct (doc_id, text) of docs.

    copies: floor(rate), one more for the share of ids that the fraction is, by the hash of the id.
    """
    domains, priors, table = classifier(docs, labelled)
    named = domains or ["all"]
    scored = materialised(posteriors(docs, domains, priors, table), "posteriors")
    known = [targets.get(d, 0.0) for d in named]
    goal = [x / sum(known) for x in known] if sum(known) else [1 / len(named)] * len(named)
    rate, trace = fit_rates(scored, goal, most, headroom)
    uniform = F.pmod(F.xxhash64(F.lit(66), "doc_id", "key"), F.lit(1 << 30)) / float(1 << 30)
    residual = F.lit(trace[-1]["error"] if trace else 0.0).alias("residual")
    return scored.withColumn("rate", rate).select("doc_id", "key", "rows", "n_tokens", "rate", F.floor(F.col("rate") + uniform).cast("int").alias("copies"), residual, *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(named)])


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: float | None = None, headroom: float = 0.0) -> DataFrame:
    """docs, each row as often as its copies say."""
    own = mix(docs, labelled, targets, most, headroom).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = rows.join(own, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("__row.text", F.lit(""))) == F.col("__key")))
    rows = rows.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(docs, labels, TARGETS).drop("key")
