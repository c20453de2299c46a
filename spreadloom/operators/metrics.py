"""Evaluation of predictions (target, date_id, pred, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fewest pairs of a date that make a rank correlation.
LEAST = 3


def rmse(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.where("pred IS NOT NULL AND label IS NOT NULL").groupBy(*by).agg(F.sqrt(F.avg((F.col("label") - F.col("pred")) ** 2)).alias("rmse"))


def daily_ic(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, date_id, ic, n): correlation of ordinal ranks across targets; ties go by target; constant ranks give no row.

    by: columns that tell runs apart.
    """
    keys = [*(by or []), "date_id"]
    both = rows.where("pred IS NOT NULL AND label IS NOT NULL")
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, "target")).cast("double")
    ranked = both.select(*keys, rank("pred").alias("x"), rank("label").alias("y"))
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return got.where(F.col("n") >= LEAST).select(*keys, F.try_divide("c", F.col("sx") * F.col("sy")).alias("ic"), "n").where("ic IS NOT NULL")


def ic_summary(ic: DataFrame) -> DataFrame:
    """ic_mean, ic_std (population), ir and n_dates in one row."""
    return ic.agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.count("*").alias("n_dates")).select("ic_mean", "ic_std", F.when(F.col("ic_std") > 0, F.try_divide("ic_mean", "ic_std")).alias("ir"), "n_dates")


def shared_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("date_id").distinct().join(b.select("date_id").distinct(), "date_id", "left_semi")


def blended(predictions: DataFrame) -> DataFrame:
    """The mean over models of (lag, target, date_id, pred)."""
    return predictions.groupBy("target", "date_id").agg(F.avg("pred").alias("pred"))
