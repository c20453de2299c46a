"""One query for each operator of the engine, over the stand-in panel. Floats are rounded for comparison."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import format_float, is_close_to_zero, rounded, to_number
from ..functions.windows import filled, last_rows, ordered
from ..operators import boosting, clean, datasets, decomp, eda, factors, forest, labels, metrics, models, scan, screen, stats, symbolic, targets, technical
from ..session import shared_folder
from ..sources import driver_tables as dt
from ..sources import tables
from ..streaming import daily, source, state

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed programs whose values SQL can check.
PROGRAMS = [("add", "ret_1", ("mul", "vol_20", 2.0)), ("div", "momentum_20", "vol_20"), ("log", ("abs", "zscore_20")), ("sqrt", ("sub", "ret_5", "ret_10")), ("sin", ("cos", "sharpe_20"))]
GRID_SMALL = {"learning_rate": [0.01, 0.05], "max_depth": [4.0, 6.0, 8.0], "lambda_l2": [0.0, 1.0]}
#: What a smaller test grid would look like as a parameter file.
PARAMS = '{"lag1": {"learning_rate": 0.02, "num_leaves": 63}, "2": {"learning_rate": 0.05, "max_depth": 6}}'


#: The published run's weighting; all else is the default.
BOOST = boosting.BoostConfig(train_end=dt.TRAIN_END, weight_scheme="recency_exp", weight_decay_rate=3.0, weight_floor=0.5, weight_cap=10.0)
#: Settings that the search query samples from the grid.
N_SETTINGS = 12
#: Dates of a block of a series: a target of the driver's tables has about five.
SERIES_BLOCK = 512


def _round(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[rounded(F.col(c), digits).alias(c) for c in df.columns if c not in keys])


KEYS = ["target", "date_id"]
CORE = ["ret_1", "vol_20", "sharpe_20", "momentum_20"]


def _core(s: SparkSession, d: str) -> DataFrame:
    return factors.factor_features(dt.targets(s, d), CORE)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return dt.labels(s, d).where("label IS NOT NULL")


def _predictions(s: SparkSession, d: str, days: int = 5) -> DataFrame:
    """A stand-in forecast: the mean of the last labels, one day late. Rounded, so that ranks don't follow noise."""
    lab = dt.labels(s, d).withColumn("pred", F.avg("label").over(ordered().rowsBetween(-days, -1)))
    return _round(lab, KEYS, 9)


def _factor(names: list[str]) -> Query:
    return lambda s, d: _round(factors.factor_features(dt.targets(s, d), names), KEYS)


def _curve(s: SparkSession, d: str) -> DataFrame:
    return dt.targets(s, d).select(*KEYS, F.col("px").alias("x"))


def _framed(names: list[str], digits: int = 6) -> Query:
    return lambda s, d: _round(technical.framed_features(_curve(s, d), names), KEYS, digits)


def _recursive(names: list[str], digits: int = 4) -> Query:
    return lambda s, d: _round(scan.recursive_features(_curve(s, d), SERIES_BLOCK).select(*KEYS, *names), KEYS, digits)


def _fourier(w: int) -> Query:
    def run(s, d):
        out = stats.fourier_features(dt.targets(s, d), (w,))
        amp, phase = F.col(f"fourier_amp_{w}"), F.col(f"fourier_phase_{w}")
        # the phase of next to nothing isn't defined
        return out.select(*KEYS, rounded(amp).alias(f"fourier_amp_{w}"), rounded(F.when(amp > 1e-4, F.cos(phase)).otherwise(0.0), 4).alias("phase_cos"), rounded(F.when(amp > 1e-4, F.sin(phase)).otherwise(0.0), 4).alias("phase_sin"))

    return run


def _long(s: SparkSession, d: str) -> DataFrame:
    return screen.to_long(_core(s, d))


def _coint(s: SparkSession, d: str) -> DataFrame:
    specs = dt.specs(s)
    lp = targets.log_prices(dt.filled_prices(s, d), specs)
    return stats.cointegration_inputs(dt.targets(s, d), targets.exploded_terms(specs), lp, stats.market_index(lp))


def _nav(single: bool) -> Query:
    return lambda s, d: targets.nav(dt.targets(s, d), dt.specs(s)).where(F.col("single") == single).select(*KEYS, rounded(F.col("nav"), 5).alias("nav"))


def _weights(scheme: str, decay: float, floor: float | None, cap: float | None) -> Query:
    return lambda s, d: labels.sample_weights(dt.targets(s, d).where(F.col("date_id") <= dt.TRAIN_END), scheme, decay, floor, cap).select(*KEYS, rounded(F.col("weight")).alias("weight"))


def _overlap(s: SparkSession, d: str) -> DataFrame:
    """Two slices of the observed prices that overlap; the later one has other prices."""
    seen = dt.observed(s, d)
    a = seen.where("date_id <= 1200").withColumn("src", F.lit(0))
    b = seen.where("date_id > 1100").select("date_id", "asset", (F.col("price") * 2).alias("price")).withColumn("src", F.lit(1))
    return tables.union_common(a, b.withColumn("is_scored", F.lit(True)))


def _grid_results(s: SparkSession) -> DataFrame:
    """A made-up result for each combination: numbers as text, some of them broken."""
    g = models.grid(s, GRID_SMALL)
    w = Window.orderBy("learning_rate", "max_depth", "lambda_l2")
    g = g.withColumn("combo_id", F.row_number().over(w))
    i = F.col("combo_id")
    return g.withColumn("train_ic", F.when(i % 5 == 0, "broken").otherwise((i * 0.01).cast("decimal(10,4)").cast("string"))).withColumn("val_ic", ((13 - i) * 0.005).cast("decimal(10,4)").cast("string")).withColumn("status", F.when(i % 4 == 0, "error").otherwise("ok"))


def _stream_prices(s: SparkSession, d: str) -> DataFrame:
    return dt.events(s, d)


def _events_features(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("change", F.col("price") - F.lag("price").over(ordered("asset")))
    return rows.select(F.col("asset").alias("target"), "date_id", "price", F.avg("price").over(last_rows(5, "asset")).alias("mean_5"), F.stddev_samp("change").over(last_rows(10, "asset")).alias("vol_10"))


def _events_labels(s: SparkSession, d: str) -> DataFrame:
    """What each date of events brings: changes of price, known by an asset's own lag, which its name gives."""
    rows = _stream_prices(s, d).withColumnRenamed("asset", "target")
    change = rows.select(*KEYS, (F.col("price") - F.lag("price").over(ordered())).alias("label"))
    return labels.lagged_labels(change, rows.select("target").distinct().withColumn("lag", 1 + F.length("target") % 4))


def _events_days(s: SparkSession, d: str) -> str:
    """A fresh folder, and in it the days of events with their labels."""
    work = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    source.write_panel(_stream_prices(s, d), _events_labels(s, d), f"{work}/days")
    return work


def stream_latest(s: SparkSession, d: str) -> DataFrame:
    """The stream's answers over all days: each day's prediction is the mean of the last five days, from the tail of the history."""
    class Mean(daily.Server):
        def features(self, history):
            return _events_features(history)

        def predict(self, rows):
            return rows.select("target", "date_id", F.col("mean_5").alias("pred"))

    work = _events_days(s, d)
    return _round(daily.serve(s, f"{work}/days", work, Mean(), panel=True), KEYS)


def stream_label_batches(s: SparkSession, d: str) -> DataFrame:
    """What the stream of days has brought by date: how many prices, and labels of each lag, and their sums."""
    work = _events_days(s, d)
    state.run_to_end(s, source.stream_days(s, f"{work}/days", f"{work}/checkpoint", 7), f"{work}/rows", f"{work}/checkpoint")
    rows = s.read.schema(source.SCHEMA).parquet(f"{work}/rows")
    return rows.groupBy("date_id", "part", "lag").agg(F.count("*").alias("n"), rounded(F.sum("value"), 9).alias("total"))


def _tail_features(rows: pd.DataFrame) -> pd.DataFrame:
    price = rows["price"]
    return pd.DataFrame({"price": price, "mean_5": price.rolling(5, min_periods=1).mean(), "vol_10": price.diff().rolling(10, min_periods=2).std()})


def stream_state_features(s: SparkSession, d: str) -> DataFrame:
    """Features of every day of events from keyed state, seven days a batch; an asset keeps its last eleven rows."""
    work = _events_days(s, d)
    days = source.stream_days(s, f"{work}/days", f"{work}/checkpoint", 7).where("part = 'prices'")
    rows = state.keyed_features(days.select("date_id", F.col("name").alias("asset"), F.col("value").alias("price")), 11, _tail_features, ["price", "mean_5", "vol_10"])
    state.run_to_end(s, rows, f"{work}/features", f"{work}/checkpoint")
    out = s.read.schema("asset string, date_id int, price double, mean_5 double, vol_10 double").parquet(f"{work}/features")
    return _round(out.withColumnRenamed("asset", "target").withColumn("vol_10", F.nanvl("vol_10", F.lit(None).cast("double"))), KEYS)


def _factors(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    return factors.factor_features(dt.targets(s, d)), list(factors.factor_columns())


def _gbt(s: SparkSession, d: str) -> DataFrame:
    config = models.TrainConfig()
    rows, names = _factors(s, d)
    rows = models.training_rows(rows, dt.labels(s, d), names, config)
    return models.predict(models.fit(rows, names, config), rows, names)


def _boost_rows(s: SparkSession, d: str, config: boosting.BoostConfig) -> tuple[DataFrame, list[str]]:
    """Rows of the targets of the setting's lag."""
    rows, names = _factors(s, d)
    rows = rows.join(dt.specs(s).where(F.col("lag") == config.lag).select("target"), "target", "left_semi")
    return boosting.training_rows(rows, dt.labels(s, d), names, config), names


#: The same weighting with trees that Spark grows, which are fewer: FOREST's rounds and leaves are its size.
FOREST = dataclasses.replace(BOOST, num_boost_round=6, num_leaves=4, learning_rate=0.2, early_stopping_rounds=3, max_bin=32)


def _forest_rows(s: SparkSession, d: str, names: list[str], config: boosting.BoostConfig = FOREST) -> DataFrame:
    """Rows of every target at its own lag."""
    return forest.training_rows_of_lags(factors.factor_features(dt.targets(s, d), names), dt.labels(s, d), dt.specs(s), names, config)


_fitted: dict = {}


def _fit_rows(s: SparkSession, d: str) -> DataFrame:
    """_forest_rows of all factors, made once in an application; they lie in the shared folder."""
    key = (s.sparkContext.applicationId, d, "rows")
    if key not in _fitted:
        _fitted[key] = forest.Tables(s).write("rows", _forest_rows(s, d, list(factors.factor_columns())))
    return _fitted[key]


def _models(s: SparkSession, d: str) -> DataFrame:
    """The models of all four lags, fitted once in an application; they lie in the shared folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _fitted:
        _fitted[key] = forest.fit_targets(_fit_rows(s, d), list(factors.factor_columns()), FOREST)
    return _fitted[key]


def _boosted(s: SparkSession, d: str) -> DataFrame:
    """(lag, target, date_id, pred, label) of all four lags, by each target's own model."""
    names = list(factors.factor_columns())
    rows = _fit_rows(s, d)
    return boosting.predict_targets(_models(s, d), rows.select(*KEYS, *names), forest.DATES).join(rows.select(*KEYS, "label"), KEYS)


def _root_splits(s: SparkSession, d: str, names: tuple[str, ...] = tuple(CORE)) -> DataFrame:
    """The first split of every target's first tree, over all rows: bins, gradients, histogram and the best gain."""
    config = dataclasses.replace(FOREST, max_bin=16)
    rows = _forest_rows(s, d, list(names), config).where("is_train")
    coded = forest.coded(rows, forest.bin_tables(rows, list(names), config), list(names))
    whole = Window.partitionBy("lag", "target")
    start = F.sum(F.col("label") * F.col("weight")).over(whole) / F.sum("weight").over(whole)
    own = coded.select("lag", "target", F.lit(0).alias("node"), ((start - F.col("label")) * F.col("weight")).alias("g"), F.col("weight").alias("h"), "codes")
    best = forest.best_splits(forest.histograms(own, list(range(len(names)))), config)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("feature") + 1).alias("feature")
    return best.select("lag", "target", name, rounded(F.col("gain"), 8).alias("gain"), F.col("nl").alias("n_left"), F.col("nr").alias("n_right"))


def _searched(s: SparkSession, d: str) -> DataFrame:
    """The search over a seeded sample of the default grid, as long a sample as N_SETTINGS says."""
    rows, names = _boost_rows(s, d, BOOST)
    own = [r.asDict() for r in models.sampled_grid(s, N_SETTINGS, 2025).collect()]
    return boosting.search(rows, names, BOOST, own)


def _gp(s: SparkSession, d: str) -> DataFrame:
    rows, names = _factors(s, d)
    rows = rows.join(dt.labels(s, d), KEYS)
    return symbolic.evaluated(rows, symbolic.evolve(rows, names))


def _windows(features: DataFrame, columns: list[str], length: int) -> DataFrame:
    out = labels.sequences(features, columns, length)
    return out.select(*KEYS, F.size("sequence").alias("n"), rounded(F.aggregate("sequence", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0)).cast("double")), 4).alias("sum_first"), rounded(F.get(F.get("sequence", F.lit(0)), F.lit(1)).cast("double"), 5).alias("oldest"))


def dataset_windows(s: SparkSession, d: str) -> DataFrame:
    """Every sample of a stored dataset of lag 1, cut from its chunks: its split, labels and the sum of its window."""
    own = dt.specs(s).where("lag = 1").select("target")
    pick = lambda df: df.join(own, "target", "left_semi")
    folder = f"{shared_folder(s)}/dataset-{uuid.uuid4().hex}"
    made = datasets.create_datasets(pick(_core(s, d)), pick(dt.labels(s, d)), CORE, 1, dt.TRAIN_END, folder)
    batches = [made.batches(x, 2024, 0) for x in datasets.SPLITS]
    rows = made.windows(batches[0].unionByName(batches[1])).join(made.table("samples").select("date_id", "split", "n_valid"), "date_id")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rows.select("date_id", "split", "n_valid", F.size("features").alias("n"), rounded(total(F.col("features")), 3).alias("total"), rounded(total(F.col("labels"))).alias("labels"))


def _label_batches(s: SparkSession, d: str) -> DataFrame:
    """How many prices and labels of each lag a date's batch has, and their sums."""
    out = labels.day_batches(dt.filled_prices(s, d), labels.lagged_labels(dt.labels(s, d), dt.specs(s)))
    total = lambda c: rounded(F.aggregate(F.filter(c, lambda x: x["label"].isNotNull()), F.lit(0.0), lambda a, x: a + x["label"]))
    return out.select("date_id", F.size("prices").alias("n_prices"), *[F.size(f"labels_lag_{k}").alias(f"n_lag_{k}") for k in labels.LAGS], *[total(f"labels_lag_{k}").alias(f"sum_lag_{k}") for k in labels.LAGS])


def _sequence_data(s: SparkSession, d: str) -> DataFrame:
    """Of the targets of lag 1: the number and sum of the kept features, label and mask."""
    own = dt.specs(s).where("lag = 1").select("target")
    rows, _ = labels.sequence_data(_core(s, d).join(own, "target", "left_semi"), dt.labels(s, d).join(own, "target", "left_semi"), CORE, 1)
    return rows.select(*KEYS, F.size("vec").alias("n"), rounded(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"), rounded(F.col("label")).alias("label"), "mask")


def queries() -> dict[str, Query]:
    px = dt.targets
    q: dict[str, Query] = {
        # sources, projection, cleaning
        "price_panel": lambda s, d: _round(dt.prices(s, d), ["date_id", "asset"]),
        "pair_parse": lambda s, d: targets.exploded_terms(dt.specs(s)),
        "specs_by_lag": lambda s, d: targets.targets_by_lag(dt.specs(s)).select("lag", F.array_join("targets", ",").alias("targets")),
        "lag_filter": lambda s, d: px(s, d).join(dt.specs(s).where("lag = 2").select("target"), "target", "left_semi").groupBy("target").agg(F.count("*").alias("n")),
        "required_assets": lambda s, d: targets.exploded_terms(dt.specs(s)).select("asset").distinct(),
        "missing_assets": lambda s, d: targets.missing_assets(dt.specs(s), dt.observed(s, d).where("asset <> 'MACHINERY'")),
        "union_common": lambda s, d: _overlap(s, d).groupBy("asset", "src").agg(F.count("*").alias("n"), rounded(F.sum("price"), 2).alias("total")),
        "dedup_last": lambda s, d: clean.last_arrival(_overlap(s, d), ["date_id", "asset"], "src").select("date_id", "asset", rounded(F.col("price"), 5).alias("price"), "src"),
        "trend_fill": lambda s, d: _round(clean.trend_fill(dt.prices(s, d), block=SERIES_BLOCK), ["date_id", "asset"], 5),
        "ffill_bfill": lambda s, d: dt.prices(s, d).select("date_id", "asset", rounded(filled(F.col("price"), "asset"), 5).alias("price")),
        "zscore_normalize": lambda s, d: _round(clean.normalized(dt.filled_prices(s, d)), ["date_id", "asset"], 5),
        "numeric_columns": lambda s, d: s.createDataFrame([(c,) for c in clean.numeric_columns(s.read.parquet(f"{d}/orders.parquet"), ("o_orderkey",))], "name string"),
        # targets
        "target_spread": lambda s, d: _round(px(s, d), KEYS),
        # of z-scores: averages of cents often end in a 5, which engines round apart
        "target_level": lambda s, d: _round(targets.target_frame(clean.normalized(dt.filled_prices(s, d)), dt.specs(s), log_scale=False), KEYS, 5),
        "target_returns": lambda s, d: targets.target_returns(px(s, d)).select(*KEYS, rounded(F.col("ret")).alias("ret")),
        "log_prices": lambda s, d: _round(targets.log_prices(dt.filled_prices(s, d), dt.specs(s)), ["date_id", "asset"]),
        "nav_additive": _nav(True),
        "nav_multiplicative": _nav(False),
        # factors
        "factor_core": lambda s, d: _round(_core(s, d), KEYS),
        "factor_returns": _factor(["ret_1", "ret_5", "ret_10", "ret_20"]),
        "factor_vol": _factor(["vol_5", "vol_20", "vol_60"]),
        "factor_sharpe": _factor(["sharpe_20", "sharpe_60"]),
        "factor_zscore": _factor(["zscore_20", "zscore_60"]),
        "factor_momentum": _factor(["momentum_20", "momentum_60"]),
        "factor_reversal": _factor(["reversal_5"]),
        "factor_rolling_min": _factor(["rolling_min_20"]),
        # technical indicators
        "sma": _framed([f"sma_{n}" for n in technical.SMA]),
        "mom": _framed([f"mom_{n}" for n in technical.MOM]),
        "roc": _framed([f"roc_{n}" for n in technical.ROC], 2),
        "apo": _framed(["apo"]),
        "ppo": _framed(["ppo"], 2),
        "bbands": _framed(["bb_upper_20", "bb_middle_20", "bb_lower_20"]),
        "linreg": _framed(["linreg_14", "linreg_slope_14"]),
        "ema": _recursive([f"ema_{n}" for n in technical.EMA]),
        "rsi": _recursive([f"rsi_{n}" for n in technical.RSI], 3),
        "macd": _recursive(["macd", "macd_signal", "macd_hist"]),
        "trix": _recursive(["trix_15"], 3),
        "tema": _recursive(["tema_10"]),
        "dema": _recursive(["dema_20"]),
        "kama": _recursive(["kama_10"]),
        "technical_nav": lambda s, d: _round(technical.framed_features(targets.nav(px(s, d), dt.specs(s)).select(*KEYS, F.col("nav").alias("x")), ["sma_20", "mom_10", "bb_upper_20"]), KEYS, 5),
        "technical_nav_recursive": lambda s, d: _round(scan.recursive_features(targets.nav(px(s, d), dt.specs(s)).select(*KEYS, F.col("nav").alias("x")), SERIES_BLOCK).select(*KEYS, "ema_10", "rsi_14"), KEYS, 2),
        # statistics
        "market_return": lambda s, d: stats.with_returns(px(s, d)).groupBy("date_id").agg(rounded(F.max("mkt")).alias("mkt")),
        "corr_market": lambda s, d: _round(stats.market_features(px(s, d)).select(*KEYS, *[f"corr_market_{w}" for w in stats.CORR]), KEYS, 5),
        "beta_market": lambda s, d: _round(stats.market_features(px(s, d)).select(*KEYS, *[f"beta_{w}" for w in stats.BETA]), KEYS, 5),
        "rolling_skew": lambda s, d: _round(stats.moment_features(px(s, d)).select(*KEYS, *[f"skew_{w}" for w in stats.MOMENTS]), KEYS, 4),
        "rolling_kurt": lambda s, d: _round(stats.moment_features(px(s, d)).select(*KEYS, *[f"kurt_{w}" for w in stats.MOMENTS]), KEYS, 3),
        "var_quantile": lambda s, d: _round(stats.risk_features(px(s, d)).select(*KEYS, "var_1", "var_5"), KEYS),
        "hill_alpha": lambda s, d: _round(stats.risk_features(px(s, d)).select(*KEYS, "hill_alpha"), KEYS, 4),
        "fourier_7": _fourier(7),
        "fourier_30": _fourier(30),
        "fourier_90": _fourier(90),
        "fourier_360": _fourier(360),
        "hurst": lambda s, d: _round(stats.reversion_features(px(s, d)).select(*KEYS, "hurst_30", "hurst_90"), KEYS, 5),
        "ou_params": lambda s, d: _round(stats.reversion_features(px(s, d)).select(*KEYS, "ou_speed_30", "ou_speed_90", "ou_mean_30", "ou_mean_90"), KEYS, 3),
        "coint_resid": lambda s, d: _round(stats.cointegration_features(_coint(s, d)), KEYS, 5),
        "market_index": lambda s, d: _round(stats.market_index(targets.log_prices(dt.filled_prices(s, d), dt.specs(s))), ["date_id"]),
        # reshaping, joins, set operations
        "panel_unpivot": lambda s, d: _round(_long(s, d), ["target", "date_id", "feature"]),
        "panel_pivot": lambda s, d: clean.to_wide(dt.filled_prices(s, d), list(dt.SEGMENTS)).select("date_id", *[rounded(F.col(a), 5).alias(a) for a in dt.SEGMENTS]),
        "wide_fill": lambda s, d: _round(clean.fill_wide(clean.to_wide(dt.prices(s, d), list(dt.SEGMENTS))), ["date_id"], 5),
        "lag_label_pivot": lambda s, d: dt.labels(s, d).join(dt.specs(s).select("target", "lag"), "target").groupBy("date_id").pivot("lag", [1, 2, 3, 4]).agg(rounded(F.sum("label")).alias("x")).toDF("date_id", "lag_1", "lag_2", "lag_3", "lag_4"),
        "train_mask": lambda s, d: labels.train_mask(px(s, d).select("date_id").distinct(), dt.labels(s, d).where(F.col("date_id") <= dt.TRAIN_END)),
        "train_test_split": lambda s, d: px(s, d).withColumn("is_train", F.col("date_id") <= dt.TRAIN_END).groupBy("target", "is_train").agg(F.count("*").alias("n"), F.min("date_id").alias("first"), F.max("date_id").alias("last")),
        # the sides of joins and set operations differ by train range and missing labels
        "feature_label_join": lambda s, d: _round(_core(s, d).join(_labelled(s, d), KEYS).select(*KEYS, "ret_1", "label"), KEYS),
        "mask_left_join": lambda s, d: labels.train_mask(px(s, d).select("date_id").distinct(), dt.labels(s, d).where(F.col("date_id") <= dt.TRAIN_END)).groupBy("is_train").agg(F.count("*").alias("n")),
        "full_join_blocks": lambda s, d: _round(_core(s, d).select(*KEYS, "ret_1").where(F.col("date_id") <= dt.TRAIN_END).join(_core(s, d).select(*KEYS, "vol_20").join(_labelled(s, d), KEYS, "left_semi"), KEYS, "full"), KEYS),
        "shared_dates": lambda s, d: metrics.shared_dates(px(s, d), _labelled(s, d)),
        "intersect_keys": lambda s, d: px(s, d).select(*KEYS).intersect(_labelled(s, d).select(*KEYS)),
        "aligned_columns": lambda s, d: _round(screen.aligned(_core(s, d), ["ret_1", "absent"]), KEYS),
        "latest_row": lambda s, d: _round(daily.latest(_core(s, d)), KEYS),
        "panel_preview": lambda s, d: _round(eda.preview(_core(s, d), ["target_0", "target_7"], ["ret_1", "vol_20"], 50), ["date_id"]),
        # labels, weights, screening
        "label_shift": lambda s, d: labels.shifted(dt.labels(s, d), 2).select(*KEYS, rounded(F.col("label")).alias("label")),
        "label_shift_by_lag": lambda s, d: labels.shifted(dt.labels(s, d).join(dt.specs(s).select("target", "lag"), "target"), F.col("lag")).select(*KEYS, rounded(F.col("label")).alias("label")),
        "label_batches": _label_batches,
        "sequence_data": _sequence_data,
        "dataset_windows": dataset_windows,
        "label_mask": lambda s, d: labels.labels_and_mask(dt.labels(s, d)).select(*KEYS, rounded(F.col("label")).alias("label"), "mask"),
        "valid_counts": lambda s, d: labels.valid_positions(dt.labels(s, d), 192, dt.TRAIN_END, 10),
        "sequence_windows": lambda s, d: _windows(_factors(s, d)[0], list(factors.factor_columns()), labels.SEQUENCE),
        "batch_numbers": lambda s, d: labels.batches(px(s, d).select(*KEYS), seed=2024),
        "recency_weights_exp": _weights("recency_exp", 3.0, 0.5, 10.0),
        "recency_weights_linear": _weights("recency_linear", 2.0, None, None),
        "recency_weights_falling": _weights("linear", -0.6, 0.5, None),
        "recency_weights_off": _weights("off", 3.0, 0.5, 10.0),
        "weight_summary": lambda s, d: labels.sample_weights(px(s, d), "recency_exp", 3.0, 0.5, 10.0).groupBy("target").agg(rounded(F.avg("weight")).alias("mean"), rounded(F.min("weight")).alias("low"), rounded(F.max("weight")).alias("high"), F.count("*").alias("n")),
        "variance_filter": lambda s, d: _round(screen.variance_filter(_long(s, d), dt.TRAIN_END, 1e-4), ["target", "feature"]),
        "screen_features": lambda s, d: _round(screen.screened(_long(s, d), 1e-6), ["feature"]),
        "normalizer": lambda s, d: _round(screen.to_long(screen.normalized_wide(_core(s, d), screen.fit_wide(_core(s, d), CORE, dt.TRAIN_END), CORE)), ["target", "date_id", "feature"], 4),
        "median_impute": lambda s, d: _round(screen.to_long(screen.imputed_wide(_gappy(s, d), screen.fit_wide(_gappy(s, d), CORE, dt.TRAIN_END), CORE)), ["target", "date_id", "feature"]),
        # metrics, EDA, grid
        "daily_ic": lambda s, d: _round(metrics.daily_ic(_predictions(s, d)), ["date_id", "n"]),
        "ic_summary": lambda s, d: _round(metrics.ic_summary(metrics.daily_ic(_predictions(s, d))), ["n_dates"]),
        "rmse": lambda s, d: _round(metrics.rmse(_predictions(s, d), ["target"]), ["target"], 8),
        "blended_mean": lambda s, d: _round(metrics.blended(_predictions(s, d).select(*KEYS, "pred").unionByName(_predictions(s, d, 10).select(*KEYS, "pred"))), KEYS, 10),
        "eda_summary": lambda s, d: _round(eda.feature_summary(_long(s, d)), ["feature", "n"]),
        "panel_shape": lambda s, d: eda.panel_shape(_long(s, d)),
        "grid_product": lambda s, d: models.grid(s),
        "grid_topk": lambda s, d: models.top_results(_grid_results(s), 0.05, 5).select("combo_id", "learning_rate", "max_depth", "lambda_l2", rounded(F.col("train_val_gap")).alias("train_val_gap")),
        "param_json": lambda s, d: tables.param_snapshot(s, PARAMS),
        "format_float": lambda s, d: metrics.rmse(_predictions(s, d), ["target"]).select("target", format_float(F.col("rmse") * 1000).alias("text")),
        "numeric_coerce": lambda s, d: _grid_results(s).select("combo_id", to_number(F.col("train_ic")).alias("train_ic")),
        "isclose_ratio": lambda s, d: dt.labels(s, d).groupBy("target").agg(F.sum(is_close_to_zero(F.col("label"), 1e-4).cast("long")).alias("n_zero"), F.count("label").alias("n")),
        # models and serving
        "gp_program_eval": lambda s, d: _round(symbolic.evaluated(factors.factor_features(px(s, d)), PROGRAMS), KEYS, 4),
        "gp_sample": lambda s, d: labels.hash_sample(px(s, d).select(*KEYS), KEYS, 1000, symbolic.SEED),
        "gp_evolved": _gp,
        "grid_sample": lambda s, d: models.sampled_grid(s, 50, 2025),
        "pca_loadings": lambda s, d: _round(decomp.pca_loadings(px(s, d), dt.TRAIN_END), ["target", "component"]),
        "pca_first": lambda s, d: decomp.pca_loadings(px(s, d), dt.TRAIN_END).where("component = 0").select("target", rounded(F.col("loading"), 4).alias("loading")),
        "pca_norms": lambda s, d: decomp.pca_loadings(px(s, d), dt.TRAIN_END).groupBy("component").agg(rounded(F.sum(F.col("loading") ** 2)).alias("norm"), F.count("*").alias("n")),
        "pca_features": lambda s, d: decomp.with_loadings(_core(s, d), decomp.pca_loadings(px(s, d), dt.TRAIN_END)),
        "gbt_train_predict": _gbt,
        "boost_by_target": lambda s, d: _models(s, d).drop("model"),
        "boost_root_splits": _root_splits,
        "boost_samples": lambda s, d: _boost_rows(s, d, BOOST)[0].groupBy("target").agg(F.count_if("is_train").alias("train_samples"), F.count_if(~F.col("is_train")).alias("val_samples"), *[rounded(f(F.when(F.col("is_train"), F.col("weight")))).alias(f"train_weight_{n}") for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))]),
        "boost_predictions": lambda s, d: _boosted(s, d),
        "boost_report": lambda s, d: boosting.report(_boosted(s, d), dt.TRAIN_END, ["lag"]),
        "ic_report": lambda s, d: _round(boosting.report(_predictions(s, d), dt.TRAIN_END), ["n_train_dates", "n_val_dates"]),
        "grid_search": _searched,
        "stream_daily_panel": lambda s, d: _round(_stream_prices(s, d), ["date_id", "asset"]),
        "stream_history_features": lambda s, d: _round(_events_features(_stream_prices(s, d)), KEYS),
        "stream_latest": stream_latest,
        "stream_label_batches": stream_label_batches,
        "stream_state_features": stream_state_features,
    }
    return q


def _gappy(s: SparkSession, d: str) -> DataFrame:
    """Features with every seventh date missing."""
    return _core(s, d).withColumns({c: F.when(F.col("date_id") % 7 != 0, F.col(c)) for c in CORE})
