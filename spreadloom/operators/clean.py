"""Cleaning of price panels (date_id, asset, price)."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import filled
from . import scan

TREND_WINDOW = 5


def trend_filled(values: np.ndarray, window: int = TREND_WINDOW) -> np.ndarray:
    """Gaps continue the mean of the last `window` observed steps from the last value, itself perhaps a filled one.

    A step is taken at each observed value from the value before it, filled or not; filling adds no step. A leading
    gap takes the first value; a series without values is 0.
    """
    out = np.asarray(values, float).copy()
    last, steps = None, deque(maxlen=window)
    for i, x in enumerate(out):
        if np.isnan(x):
            if last is not None:
                last = out[i] = last + (sum(steps) / len(steps) if steps else 0.0)
        else:
            if last is not None:
                steps.append(x - last)
            last = x
    seen = np.flatnonzero(~np.isnan(out))
    if not len(seen):
        return np.zeros(len(out))
    out[: seen[0]] = out[seen[0]]
    return out


def trend_fill(prices: DataFrame, window: int = TREND_WINDOW, arrival: str | None = None, block: int = scan.BLOCK) -> DataFrame:
    """trend_filled of each asset's series in order of date, composed by blocks of dates: no task holds a series.

    arrival: a column of whole numbers that goes before the date in this order and stays, for rows of several splits
    whose dates may repeat.
    """
    return scan.trend_fill(prices, window, arrival, block)


def normalized(prices: DataFrame) -> DataFrame:
    """z-score of each asset by its mean and sample deviation; unchanged where that is 0 or unknown."""
    own = Window.partitionBy("asset")
    sd = F.stddev_samp("price").over(own)
    return prices.withColumn("price", F.when(sd > 0, (F.col("price") - F.avg("price").over(own)) / sd).otherwise(F.col("price")))


def forward_backward_fill(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.withColumns({c: filled(F.col(c), key) for c in columns})


def last_arrival(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Of rows with equal keys, the one that arrived last."""
    w = Window.partitionBy(*keys).orderBy(F.col(arrival).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def unique_columns(df: DataFrame) -> DataFrame:
    """The first of columns that share a name."""
    seen, at = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            at.append(i)
    names = [f"__{i}" for i in range(len(df.columns))]
    return df.toDF(*names).select(*[F.col(names[i]).alias(df.columns[i]) for i in at])


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ("date_id", "is_scored")) -> list[str]:
    """Columns that cleaning touches."""
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def to_long(df: DataFrame, columns: list[str] | None = None, name: str = "asset", value: str = "price") -> DataFrame:
    """A wide table (date_id, one column an asset) as (date_id, asset, price); NaN becomes NULL."""
    columns = columns or numeric_columns(df)
    long = df.select("date_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot("date_id", columns, name, value)
    return long.withColumn(value, F.nanvl(value, F.lit(None).cast("double")))


def to_wide(df: DataFrame, names: list[str], name: str = "asset", value: str = "price") -> DataFrame:
    """(date_id, asset, price) with one column for each of names. For few names only."""
    return df.groupBy("date_id").pivot(name, names).agg(F.first(value))


def fill_wide(df: DataFrame, window: int = TREND_WINDOW, skip: tuple[str, ...] = ("date_id", "is_scored")) -> DataFrame:
    """trend_fill of every numeric column of a wide table; the skipped and other columns stay."""
    columns = numeric_columns(df, skip)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest).join(to_wide(trend_fill(to_long(df, columns), window), columns), "date_id", "left")

