"""Principal components of target returns by block power iteration: loadings as a small table, joined to all dates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ordered

#: Targets whose vectors are broadcast; beyond them they are joined by key.
BROADCAST = 100_000
#: Vectors beside those asked for, which speed up convergence; residual, relative to the largest value, that ends it.
EXTRA, TOLERANCE, MOST = 10, 1e-9, 200


def standardised_returns(targets: DataFrame, train_end: int, n: int) -> DataFrame:
    """(target, date_id, x): returns of complete train dates, which have all n targets, less their mean, by their deviation."""
    rows = targets.withColumn("ret", F.col("px") - F.lag("px").over(ordered())).where((F.col("date_id") <= train_end) & F.col("ret").isNotNull())
    complete = rows.groupBy("date_id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("date_id")
    own, rows = Window.partitionBy("target"), rows.join(complete, "date_id", "left_semi")
    sd = F.stddev_samp("ret").over(own)
    return rows.select("target", "date_id", F.when(sd > 0, (F.col("ret") - F.avg("ret").over(own)) / sd).otherwise(0.0).alias("x"))


def multiplied(x: DataFrame, names: list[str], v: np.ndarray) -> np.ndarray:
    """The product of x's covariance (up to its scale) with vectors, a row a target: two joins and two aggregates of x.

    Sums are combined in the tasks; what meets is a row of block numbers a date, then a target.
    """
    spark, block = x.sparkSession, v.shape[1]
    vectors = spark.createDataFrame(list(zip(names, v.tolist(), strict=True)), "target string, v array<double>")
    by_date = x.join(F.broadcast(vectors) if len(names) <= BROADCAST else vectors, "target")
    by_date = by_date.groupBy("date_id").agg(*[F.sum(F.col("x") * F.get("v", F.lit(j))).alias(f"y{j}") for j in range(block)])
    rows = x.join(by_date, "date_id").groupBy("target").agg(F.array(*[F.sum(F.col("x") * F.col(f"y{j}")) for j in range(block)]).alias("z"))
    got = {r.target: r.z for r in rows.toLocalIterator()}
    return np.array([got[t] for t in names])


def pca_loadings(targets: DataFrame, train_end: int, k: int = 5, extra: int = EXTRA) -> DataFrame:
    """(target, component, loading) of standardised returns on complete train dates; the largest entry is positive.

    A block of vectors is multiplied by the covariance, which is never made, until the wanted ones stand still; each
    time they are turned to the best within their span. The driver holds k + extra numbers a target, no matrix of
    targets by targets. Raises without complete train dates; no more components than targets.
    """
    spark = targets.sparkSession
    names = [r[0] for r in targets.select("target").distinct().orderBy("target").collect()]
    x = standardised_returns(targets, train_end, len(names)).persist()
    try:
        if not x.head(1):
            raise ValueError("no complete train dates")
        k = min(k, len(names))
        v = np.linalg.qr(np.random.default_rng(0).normal(size=(len(names), min(len(names), k + extra))))[0]
        for _ in range(MOST):
            z = multiplied(x, names, v)
            values, turn = np.linalg.eigh((v.T @ z + z.T @ v) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            v, z = v @ turn, z @ turn
            off = np.linalg.norm(z[:, :k] - v[:, :k] * values[:k], axis=0)
            if (off <= TOLERANCE * max(values[0], 1e-300)).all():
                break
            v = np.linalg.qr(z)[0]
    finally:
        x.unpersist()
    pc = v[:, :k]
    pc = pc * np.sign(pc[np.abs(pc).argmax(axis=0), range(k)])
    return spark.createDataFrame([(t, j, float(pc[i, j])) for i, t in enumerate(names) for j in range(k)], "target string, component int, loading double")


def with_loadings(features: DataFrame, loadings: DataFrame, k: int = 5) -> DataFrame:
    """features with pca_0 .. pca_{k-1} of their target."""
    wide = loadings.groupBy("target").agg(*[F.max(F.when(F.col("component") == j, F.col("loading"))).alias(f"pca_{j}") for j in range(k)])
    return features.join(wide, "target", "left")
