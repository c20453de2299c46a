"""Boosted-tree regression, one pooled model for a set of targets, and grid search."""

from __future__ import annotations

import dataclasses
import itertools
import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest import Tables
from .labels import hash_sample, sample_weights, shifted
from .screen import fit_wide, screened_wide

#: Train rows of a partition. The learner runs some two jobs a level over all partitions, empty ones too.
PART = 32_768

#: Values of the default grid, by parameter. The published ones.
GRID = {
    "num_boost_round": [160, 200, 240, 280],
    "learning_rate": [0.03, 0.05, 0.07],
    "num_leaves": [16, 31, 48],
    "feature_fraction": [0.6, 0.7, 0.8],
    "bagging_fraction": [0.6, 0.7, 0.8],
    "min_data_in_leaf": [30, 50, 80],
    "lambda_l1": [0.0, 0.001, 0.01],
    "lambda_l2": [0.001, 0.01, 0.1],
    "early_stopping_rounds": [10, 20, 30],
}


@dataclasses.dataclass(frozen=True)
class TrainConfig:
    """Settings of a training run; those of Spark's learner that correspond to the grid's."""

    lag: int = 1
    horizon: int = 1
    train_end: int = 1800
    learning_rate: float = 0.05
    rounds: int = 20
    max_depth: int = 4
    min_data_in_leaf: int = 20
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    variance_threshold: float = 0.0
    weight_scheme: str = "recency_exp"
    weight_decay: float = 3.0
    weight_floor: float | None = 0.5
    weight_cap: float | None = 10.0
    seed: int = 2024


def training_rows(features: DataFrame, labels: DataFrame, columns: list[str], config: TrainConfig) -> DataFrame:
    """Rows (target, date_id, label, is_train, weight, columns): shifted labels, screened and imputed features.

    They and what they are made of are written to the shared folder, so that features are computed once.
    """
    store = Tables(features.sparkSession)
    rows = features.select("target", "date_id", *columns).join(shifted(labels.select("target", "date_id", "label"), config.lag, config.horizon), ["target", "date_id"]).where("label IS NOT NULL")
    rows = store.write("labelled", rows)
    fitted = store.write("figures", fit_wide(rows, columns, config.train_end))
    rows = screened_wide(rows, fitted, columns, config.variance_threshold).withColumn("is_train", F.col("date_id") <= config.train_end)
    train = sample_weights(rows.where("is_train"), config.weight_scheme, config.weight_decay, config.weight_floor, config.weight_cap).drop("distance")
    return store.write("rows", train.unionByName(rows.where("NOT is_train").withColumn("weight", F.lit(1.0))))


def fit(rows: DataFrame, columns: list[str], config: TrainConfig) -> GBTRegressionModel:
    """Train rows are dealt out by key, PART a partition and in order, so that bags don't depend on the cluster."""
    train, keys = rows.where("is_train"), ["target", "date_id"]
    train = train.repartition(max(1, math.ceil(train.count() / PART)), *keys).sortWithinPartitions(*keys)
    learner = GBTRegressor(
        featuresCol="vec", labelCol="label", weightCol="weight", maxIter=config.rounds, stepSize=config.learning_rate, maxDepth=config.max_depth,
        minInstancesPerNode=config.min_data_in_leaf, featureSubsetStrategy=str(config.feature_fraction), subsamplingRate=config.bagging_fraction, seed=config.seed,
    )
    return learner.fit(VectorAssembler(inputCols=columns, outputCol="vec").transform(train))


def predict(model: GBTRegressionModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    out = model.transform(VectorAssembler(inputCols=columns, outputCol="vec").transform(rows))
    return out.select("target", "date_id", "label", "is_train", F.col("prediction").alias("pred"))


def grid(spark: SparkSession, values: dict[str, list] | None = None) -> DataFrame:
    """One row a combination, with combo_id in order of the parameters."""
    values = values or GRID
    out = None
    for name, options in values.items():
        own = spark.createDataFrame([(float(v),) for v in options], f"{name} double")
        out = own if out is None else out.crossJoin(F.broadcast(own))  # the product is what is asked for; each side is a short list
    return out


def sampled_grid(spark: SparkSession, n: int, seed: int, values: dict[str, list] | None = None) -> DataFrame:
    """n combinations in the order of a seeded hash; all where n is 0 or at least as many."""
    rows = grid(spark, values)
    size = len(list(itertools.product(*(values or GRID).values())))
    return hash_sample(rows, rows.columns, n if 0 < n < size else size, seed)


def top_results(results: DataFrame, max_gap: float, n: int = 10) -> DataFrame:
    """The n best by val_ic of the runs that ended well, with a small gap between train and validation."""
    rows = results.withColumn("train_val_gap", F.col("train_ic").try_cast("double") - F.col("val_ic").try_cast("double"))
    return rows.where((F.col("status") == "ok") & (F.col("train_val_gap") <= max_gap)).orderBy(F.desc("val_ic"), "combo_id").limit(n)
