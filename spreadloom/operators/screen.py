"""Feature screening, normalisation and imputation, over long features (target, date_id, feature, value) or wide ones.

The wide forms make all figures of a target in one aggregate and bring them back with one join, so a row of features is
moved by target at most, whatever the number of features; the long forms serve features that come long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c in features.columns if c not in ("target", "date_id")]
    return features.select("target", "date_id", *columns).unpivot(["target", "date_id"], columns, "feature", "value")


def to_wide(long: DataFrame, columns: list[str]) -> DataFrame:
    return long.groupBy("target", "date_id").pivot("feature", columns).agg(F.first("value"))


def variance_filter(long: DataFrame, train_end: int, threshold: float = 0.0) -> DataFrame:
    """(target, feature, variance) with a sample variance over the threshold on the train slice."""
    return long.where(F.col("date_id") <= train_end).groupBy("target", "feature").agg(F.var_samp("value").alias("variance")).where(F.col("variance") > threshold)


def kept_features(long: DataFrame, train_end: int, threshold: float = 0.0) -> DataFrame:
    """long with the features that variance_filter keeps; raises where that is none."""
    kept = variance_filter(long, train_end, threshold).select("target", "feature").persist()  # a row a feature
    if not kept.head(1):
        raise ValueError(f"no feature has a variance over {threshold}")
    return long.join(kept, ["target", "feature"], "left_semi")


def screened(long: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """(feature, variance): the mean over targets of the population variance over time, over the threshold."""
    own = long.groupBy("target", "feature").agg(F.var_pop("value").alias("v"))
    return own.groupBy("feature").agg(F.avg("v").alias("variance")).where(F.col("variance") > threshold)


def fit_normalizer(long: DataFrame, train_end: int) -> DataFrame:
    """(target, feature, mean, std) on train rows; deviations below 1e-6 count as 1."""
    own = long.where(F.col("date_id") <= train_end).groupBy("target", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return own.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def normalize(long: DataFrame, normalizer: DataFrame) -> DataFrame:
    return long.join(normalizer, ["target", "feature"]).withColumn("value", F.try_divide(F.col("value") - F.col("mean"), F.col("std"))).drop("mean", "std")


def fit_medians(long: DataFrame, train_end: int) -> DataFrame:
    """(target, feature, median): exact, interpolated, NULL left out."""
    return long.where(F.col("date_id") <= train_end).groupBy("target", "feature").agg(F.percentile("value", F.lit(0.5)).alias("median"))


def impute(long: DataFrame, medians: DataFrame) -> DataFrame:
    return long.join(medians, ["target", "feature"], "left").withColumn("value", F.coalesce("value", "median")).drop("median")


def fit_wide(features: DataFrame, columns: list[str], train_end: int) -> DataFrame:
    """(target, a struct for each of columns) of train rows: mean, std (1 below 1e-6), median (exact, interpolated), variance."""
    std = lambda c: F.stddev_pop(c)
    figures = [F.struct(F.avg(c).alias("mean"), F.when(std(c) < 1e-6, 1.0).otherwise(std(c)).alias("std"), F.percentile(c, F.lit(0.5)).alias("median"), F.var_samp(c).alias("variance")).alias(c) for c in columns]
    return features.where(F.col("date_id") <= train_end).groupBy("target").agg(*figures)


def _with_figures(features: DataFrame, fitted: DataFrame, columns: list[str], value, how: str) -> DataFrame:
    named = fitted.select("target", *[F.col(c).alias(f"__{c}") for c in columns])
    rest = [c for c in features.columns if c not in columns]
    return features.join(named, "target", how).select(*rest, *[value(F.col(c), F.col(f"__{c}")).alias(c) for c in columns])


def normalized_wide(features: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """features less their mean, by their deviation; targets that weren't fitted go."""
    return _with_figures(features, fitted, columns, lambda x, f: F.try_divide(x - f["mean"], f["std"]), "inner")


def imputed_wide(features: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """features with the target's median where they are missing."""
    return _with_figures(features, fitted, columns, lambda x, f: F.coalesce(x, f["median"]), "left")


def screened_wide(features: DataFrame, fitted: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """imputed_wide, and 0 where a target's feature has no variance over the threshold; raises where none has."""
    if not fitted.where(F.greatest(*[F.col(c)["variance"] for c in columns], F.lit(float("-inf"))) > threshold).head(1):
        raise ValueError(f"no feature has a variance over {threshold}")
    return _with_figures(features, fitted, columns, lambda x, f: F.when(f["variance"] > threshold, F.coalesce(x, f["median"], F.lit(0.0))).otherwise(0.0), "left")


def aligned(features: DataFrame, columns: list[str]) -> DataFrame:
    """features with just these columns, missing ones as NULL."""
    return features.select("target", "date_id", *[(F.col(c) if c in features.columns else F.lit(None).cast("double")).alias(c) for c in columns])


def require_complete(features: DataFrame, columns: list[str]) -> DataFrame:
    """(target, date_id, vec); a NULL raises when the rows are made."""
    any_null = F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1
    vec = F.array(*[F.col(c).cast("float") for c in columns])
    return features.select("target", "date_id", F.when(any_null, F.raise_error(F.concat(F.lit("missing value of "), F.col("target")))).otherwise(vec).alias("vec"))
