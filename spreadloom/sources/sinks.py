"""Writers: Parquet tables partitioned for pruning, run summaries, submissions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save_prices(prices: DataFrame, path: str) -> None:
    """Cleaned prices (split, date_id, asset, price), a folder a split."""
    prices.write.mode("overwrite").partitionBy("split").parquet(path)


def save_features(features: DataFrame, path: str) -> None:
    """A panel by target or asset with is_train, a folder for each side of the split."""
    features.repartition("is_train", "target" if "target" in features.columns else "asset").write.mode("overwrite").partitionBy("is_train").parquet(path)


def save_artifacts(folder: str, loadings: DataFrame, programs: list) -> None:
    """Component loadings, and programs as JSON in their order."""
    loadings.write.mode("overwrite").parquet(f"{folder}/loadings")
    rows = [(i, json.dumps(p)) for i, p in enumerate(programs)]
    loadings.sparkSession.createDataFrame(rows, "at int, program string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/programs")


def save_config(spark: SparkSession, path: str, config: dict) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_submission(predictions: DataFrame, path: str, row_id: str = "date_id", mode: str = "append") -> None:
    """Predictions with their row id first."""
    predictions.select(row_id, *[c for c in predictions.columns if c != row_id]).write.mode(mode).parquet(path)


def write_result(spark: SparkSession, path: str, error: BaseException | None = None, kind: str = "") -> None:
    """One JSON row: success, or the error's type, name and first 8000 characters."""
    row = (error is None, kind or None, type(error).__name__ if error else None, str(error)[:8000] if error else None)
    spark.createDataFrame([row], "Succeeded boolean, ErrorType string, ErrorName string, ErrorDetails string").coalesce(1).write.mode("overwrite").json(path)


def placeholder(spark: SparkSession, names: list[str], path: str) -> None:
    """Zeros of date 0, for a run that wrote nothing."""
    spark.createDataFrame([(0, n, 0.0) for n in names], "date_id int, target string, pred double").coalesce(1).write.mode("overwrite").parquet(path)
