"""Summaries of a feature panel in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_summary(long: DataFrame, atol: float = 1e-12) -> DataFrame:
    """(feature, zero_ratio, mean, std, n): share of values within atol of 0, mean, population deviation."""
    return long.groupBy("feature").agg(F.avg(F.when(F.col("value").isNotNull(), (F.abs("value") <= atol).cast("double"))).alias("zero_ratio"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def panel_shape(long: DataFrame) -> DataFrame:
    return long.agg(F.countDistinct("date_id").alias("n_dates"), F.countDistinct("target").alias("n_targets"), F.countDistinct("feature").alias("n_features"))


def preview(features: DataFrame, targets: list[str], columns: list[str], rows: int) -> DataFrame:
    """The first dates with flat names `target::feature`."""
    wide = features.where(F.col("target").isin(targets)).groupBy("date_id").agg(*[F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{t}::{c}") for t in targets for c in columns])
    return wide.orderBy("date_id").limit(rows)
