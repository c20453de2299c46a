"""The panel that stands in for price files: running average order values of customer segments.

prices: an asset is a market segment, a date the days since 1995-01-01, the price the average order value up to that
date; on dates without orders of the segment it is missing. Specs are the single segments and their pairs.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import trend_fill
from ..operators.targets import parse_pairs, target_frame

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: (target, lag, pair)
SPECS = [(f"target_{i}", 1 + i % 4, pair) for i, pair in enumerate([*SEGMENTS, *(f"{a} - {b}" for a, b in itertools.combinations(SEGMENTS, 2))])]
TRAIN_END = 1800


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date_id, asset, price) on dates with orders of the asset. Customers join by their measured size."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice", "o_orderdate")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("asset"))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    daily = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("asset", day.alias("date_id")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    run = Window.partitionBy("asset").orderBy("date_id").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("date_id", "asset", (F.sum("s").over(run) / F.sum("n").over(run)).alias("price"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date_id, asset, price) of every date and asset, NULL where there is no order: dates x a handful of assets."""
    seen = observed(spark, sf_dir)
    dates, assets = seen.select("date_id").distinct(), seen.select("asset").distinct()
    return dates.crossJoin(assets).join(seen, ["date_id", "asset"], "left")


def specs(spark: SparkSession) -> DataFrame:
    return parse_pairs(spark.createDataFrame(SPECS, "target string, lag int, pair string"))


_kept: dict = {}


def _once(spark: SparkSession, name: str, sf_dir: str, make) -> DataFrame:
    """A cached intermediate of this application; Spark spills it and makes lost blocks again."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _kept:
        _kept[key] = make().persist()
    return _kept[key]


def filled_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, "filled", sf_dir, lambda: trend_fill(prices(spark, sf_dir)))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, date_id, px), hash-partitioned by target, so that window features need no further exchange."""
    return _once(spark, "targets", sf_dir, lambda: target_frame(filled_prices(spark, sf_dir), specs(spark)).repartition("target"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, date_id, label): the change of px."""
    return targets(spark, sf_dir).select("target", "date_id", (F.col("px") - F.lag("px").over(Window.partitionBy("target").orderBy("date_id"))).alias("label"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date_id, asset, price): mean value of an event type on a day."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return rows.groupBy(day.alias("date_id"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("price"))
