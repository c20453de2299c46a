"""Whole runs over folders of tables: cleaned splits, the feature store, training of all lags, search, serving."""

from __future__ import annotations

import dataclasses
import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, clean, forest, labels, metrics, models, panel, targets
from ..sources import sinks, tables

SPLITS = ("train", "test", "all")
LEARNERS = {"groups": boosting.fit_targets, "spark": forest.fit_targets}
#: What a run of a lag takes where its parameters say nothing. Fixed values.
RUN_DEFAULTS = {"num_boost_round": 200, "learning_rate": 0.03, "num_leaves": 31, "feature_fraction": 0.6, "bagging_fraction": 0.6, "min_data_in_leaf": 50, "lambda_l1": 0.0, "lambda_l2": 0.0}


def build_cleaned(spark: SparkSession, folder: str, out: str, window: int = clean.TREND_WINDOW) -> None:
    """The train, test and joint prices in a folder, filled and written by split."""
    filled = [clean.trend_fill(clean.to_long(tables.load_prices(spark, folder, s)), window).withColumn("split", F.lit(s)) for s in SPLITS]
    sinks.save_prices(functools.reduce(DataFrame.unionByName, filled), out)


def raw_prices(spark: SparkSession, folder: str) -> DataFrame:
    """(date_id, asset, price, arrival) of both splits; test rows arrive after train rows. Columns are those both have."""
    train, test = (tables.load_prices(spark, folder, s) for s in ("train", "test"))
    both = [c for c in train.columns if c in test.columns]
    part = lambda df, i: clean.to_long(df.select(*[f"`{c}`" for c in both])).withColumn("arrival", F.lit(i))
    return part(train, 0).unionByName(part(test, 1))


def build_store(prices: DataFrame, specs: DataFrame, own_labels: DataFrame, out: str, train_end: int, version: str = "v2", **settings) -> str:
    """Writes every block, the joint panel, targets, log prices and artifacts of a version; returns the store's folder.

    Panels are split by whether the date has labels. Each is written once and read back, so that none is computed
    twice. settings go to the evolution.
    """
    spark, folder = prices.sparkSession, f"{out}/{panel.store_name(version)}"
    px, lp = targets.price_targets(prices, specs)
    known = own_labels.where("label IS NOT NULL").select("date_id")

    def written(name: str, df: DataFrame) -> DataFrame:
        sinks.save_features(_with_side(df, known), f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}").drop("is_train")

    px, lp = written("target_prices", px), written("component_log_prices", lp)
    if version != "v1":
        written("target_nav", panel.curves(px, specs, version).withColumnRenamed("x", "nav"))
    parts = {name: written(name, df) for name, df in panel.blocks(px, lp, specs, version).items()}
    base = written("base", panel.joined(list(parts.values())))
    names = panel.columns_of(parts["technical"] if version != "v1" else base)
    artifacts = panel.fit_artifacts(base, names, px, own_labels, train_end, **settings)
    sinks.save_artifacts(f"{folder}/artifacts", artifacts.loadings, artifacts.programs)
    written("all", panel.with_artifacts(base, artifacts))
    return folder


def _with_side(df: DataFrame, known: DataFrame) -> DataFrame:
    mask = labels.train_mask(df.select("date_id").distinct(), known)
    return df.join(mask, "date_id")


def parse_lags(given: list[str] | None, available: list[int]) -> list[int]:
    """The lags asked for, without repeats and in order; all that there are if none is."""
    try:
        return sorted({int(v) for v in given} if given else set(available))
    except ValueError as e:
        raise ValueError(f"not a lag: {e}") from e


def lag_configs(text: str, lags: list[str] | None = None, train_end: int = 1960, **settings) -> dict[int, boosting.BoostConfig]:
    """Settings of full training runs by lag, from a JSON object keyed `lagN` or `N`.

    There is no early stopping; a weight cap of 0 or less is none; train_end here counts, not that of the parameters.
    """
    if (settings.get("weight_cap") or 1) <= 0:
        settings["weight_cap"] = None
    params = {int(str(k).removeprefix("lag")): v for k, v in json.loads(text).items()}
    out = {}
    for lag in parse_lags(lags, list(params)):
        if lag not in params:
            raise KeyError(f"no parameters of lag {lag}")
        values = {k: params[lag].get(k, v) for k, v in RUN_DEFAULTS.items()}
        base = dataclasses.replace(boosting.BoostConfig(), lag=lag, train_end=train_end, early_stopping_rounds=0, **settings)
        out[lag] = base.with_values(values)
    return out


def train_lags(features: DataFrame, own_labels: DataFrame, specs: DataFrame, configs: dict[int, boosting.BoostConfig], folder: str, learner: str = "groups") -> DataFrame:
    """Fits every target of each lag and writes models, predictions, daily correlations, settings and report.

    learner: groups, where a target's rows fit a task (see boosting), or spark, where they needn't (see forest).
    folder/lag_N has the parts of a lag; folder/summary one JSON row a lag, which is also what is returned. Lags are
    few; targets of a lag are fitted side by side.
    """
    spark, names, out, fit = features.sparkSession, panel.columns_of(features), None, LEARNERS[learner]
    for lag, config in sorted(configs.items()):
        at, own = f"{folder}/lag_{lag}", specs.where(F.col("lag") == lag).select("target")
        if not own.head(1):
            raise ValueError(f"no targets of lag {lag}")
        rows = boosting.training_rows(features.join(own, "target", "left_semi"), own_labels, names, config).persist()
        fit(rows, names, config).write.mode("overwrite").parquet(f"{at}/models")
        fitted = spark.read.schema(boosting.MODEL).parquet(f"{at}/models")
        predictions = boosting.predict_targets(fitted, rows.select(*panel.KEYS, *names), forest.DATES).join(rows.select(*panel.KEYS, "label"), panel.KEYS)
        predictions.write.mode("overwrite").parquet(f"{at}/predictions")
        predictions = spark.read.parquet(f"{at}/predictions")
        rows.unpersist()
        side = F.when(F.col("date_id") <= config.train_end, "train").otherwise("val").alias("side")
        sinks.save_csv(metrics.daily_ic(predictions).select(side, "date_id", "ic", "n"), f"{at}/daily_ic")
        sinks.save_config(spark, f"{at}/config", dataclasses.asdict(config))
        report = boosting.report(predictions, config.train_end).select(F.lit(lag).alias("lag"), "*")
        out = report if out is None else out.unionByName(report)
    sinks.save_json(out, f"{folder}/summary")
    return spark.read.schema(out.schema).json(f"{folder}/summary")


def search_grid(features: DataFrame, own_labels: DataFrame, specs: DataFrame, base: boosting.BoostConfig, n: int, seed: int, out: str) -> DataFrame:
    """The search over n sampled settings of the default grid (0: all) for the targets of base's lag, written as CSV."""
    names = panel.columns_of(features)
    own = features.join(specs.where(F.col("lag") == base.lag).select("target"), "target", "left_semi")
    rows = boosting.training_rows(own, own_labels, names, base)
    settings = [r.asDict() for r in models.sampled_grid(features.sparkSession, n, seed).collect()]  # at most the grid
    found = boosting.search(rows, names, base, settings)
    sinks.save_csv(found, out)
    return features.sparkSession.read.schema(found.schema).option("header", True).csv(out)
