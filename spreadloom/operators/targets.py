"""Target specifications and spread targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_price
from ..functions.windows import filled, ordered, up_to_now
from .clean import TREND_WINDOW, last_arrival, trend_fill

#: A pair is split at " + " and " - "; the spaces belong to the operator.
_OPERATOR = r" [+-] "


def parse_pairs(pairs: DataFrame) -> DataFrame:
    """(target, lag, pair) -> with terms: array of (asset, weight). The sign of a term is the operator before it."""
    tokens, signs = F.split("pair", _OPERATOR, -1), F.regexp_extract_all("pair", F.lit(r" ([+-]) "), 1)
    terms = F.transform(tokens, lambda x, i: F.struct(F.trim(x).alias("asset"), F.when((i > 0) & (F.get(signs, i - 1) == "-"), -1.0).otherwise(1.0).alias("weight")))
    return pairs.withColumn("terms", F.filter(terms, lambda t: t["asset"] != ""))


def is_single(terms="terms"):
    return (F.size(terms) == 1) & (F.get(terms, F.lit(0))["weight"] == 1.0)


def exploded_terms(specs: DataFrame) -> DataFrame:
    """(target, lag, pos, asset, weight)"""
    return specs.select("target", "lag", F.posexplode("terms").alias("pos", "term")).select("target", "lag", "pos", "term.asset", "term.weight")


def targets_by_lag(specs: DataFrame) -> DataFrame:
    return specs.groupBy("lag").agg(F.sort_array(F.collect_list("target")).alias("targets"))


def missing_assets(specs: DataFrame, prices: DataFrame) -> DataFrame:
    """Assets that specs need and prices lack."""
    return exploded_terms(specs).select("asset").distinct().join(prices.select("asset").distinct(), "asset", "left_anti")


def target_frame(prices: DataFrame, specs: DataFrame, log_scale: bool = True) -> DataFrame:
    """(target, date_id, px): the weighted sum of (log) prices of a target's terms, on dates that have all of them.

    The terms are as many as the specs say; the planner broadcasts them by their measured size.
    """
    value = log_price(F.col("price")) if log_scale else F.col("price")
    terms = exploded_terms(specs).withColumn("terms", F.count("*").over(_by_target()))
    rows = prices.join(terms, "asset")
    out = rows.groupBy("target", "date_id").agg(F.sum(F.col("weight") * value).alias("px"), F.count("*").alias("n"), F.max("terms").alias("terms"))
    return out.where("n = terms").select("target", "date_id", "px")


def _by_target():
    from pyspark.sql import Window

    return Window.partitionBy("target")


def price_targets(prices: DataFrame, specs: DataFrame, window: int = TREND_WINDOW) -> tuple[DataFrame, DataFrame]:
    """Targets and log prices of raw prices (date_id, asset, price, arrival) of all splits.

    The assets that specs need are filled over all splits in order of arrival and date; then the last arrival of a date
    counts and what is still missing is filled forward and backward. Raises on assets that prices lack.
    """
    if lacking := sorted(r[0] for r in missing_assets(specs, prices).collect()):
        raise KeyError(f"no prices of {lacking}")
    needed = prices.join(exploded_terms(specs).select("asset").distinct(), "asset", "left_semi")
    rows = last_arrival(trend_fill(needed, window, "arrival"), ["date_id", "asset"], "arrival")
    rows = rows.select("date_id", "asset", filled(F.col("price"), "asset").alias("price"))
    return target_frame(rows, specs), log_prices(rows)


def target_returns(targets: DataFrame, periods: int = 1) -> DataFrame:
    return targets.withColumn("ret", F.col("px") - F.lag("px", periods).over(ordered()))


def log_prices(prices: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(date_id, asset, lp) of the assets that specs need, or of all."""
    if specs is not None:
        prices = prices.join(exploded_terms(specs).select("asset").distinct(), "asset", "left_semi")
    return prices.select("date_id", "asset", log_price(F.col("price")).alias("lp"))


def nav(targets: DataFrame, specs: DataFrame) -> DataFrame:
    """Value curves: singles add returns from 0, spreads compound them from 1. The first return counts as 0."""
    ret = F.coalesce(F.col("px") - F.lag("px").over(ordered()), F.lit(0.0))
    rows = targets.join(specs.select("target", is_single().alias("single")), "target").withColumn("r", ret)
    return rows.withColumn("nav", F.when(F.col("single"), F.sum("r").over(up_to_now())).otherwise(F.product(1 + F.col("r")).over(up_to_now())))
