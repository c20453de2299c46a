"""Thirty technical indicators of a curve (target, date_id, x). Warm-up rows are NULL until the final fill.

Window frames give what depends on a bounded number of rows; recursions (exponential averages and what builds on them)
are composed by block in `scan`. The functions of arrays here define them row by row, with their seeds and first rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..functions.windows import filled, full, last_rows, ordered
from .scan import BLOCK, recursive_features

SMA, EMA, RSI, MOM, ROC = (5, 10, 20, 60), (5, 10, 20, 60), (14, 28), (5, 10, 20), (5, 10, 20)


def framed_columns(x: Column | None = None) -> dict[str, Column]:
    """The fifteen or so indicators that are frames of rows. Rows need `pos`, the position from 1."""
    x = F.col("x") if x is None else x
    avg = lambda n: full(n, x, F.avg(x).over(last_rows(n)))
    out = {f"sma_{n}": avg(n) for n in SMA}
    out |= {f"mom_{n}": x - F.lag(x, n).over(ordered()) for n in MOM}
    for n in ROC:
        before = F.lag(x, n).over(ordered())
        out[f"roc_{n}"] = F.when(before == 0, 0.0).otherwise(100 * (div(x, before) - 1))
    # both averages from row 26 on
    fast, slow = F.when(avg(26).isNotNull(), F.avg(x).over(last_rows(12))), avg(26)
    out["apo"] = fast - slow
    out["ppo"] = F.when(slow == 0, 0.0).otherwise(100 * div(fast - slow, slow))
    sd = full(20, x, F.stddev_pop(x).over(last_rows(20)))
    out |= {"bb_upper_20": avg(20) + 2 * sd, "bb_middle_20": avg(20), "bb_lower_20": avg(20) - 2 * sd}
    pos = F.col("pos").cast("double")
    slope = full(14, x, F.regr_slope(x, pos).over(last_rows(14)))
    out["linreg_14"] = full(14, x, F.avg(x).over(last_rows(14))) + slope * 6.5
    out["linreg_slope_14"] = slope
    return out


def ema(x: np.ndarray, n: int, seed_at: int | None = None) -> np.ndarray:
    """Seeded at row n - 1 (or seed_at) with the mean of the n rows that end there; then e += 2 / (n + 1) * (x - e)."""
    out = np.full(len(x), np.nan)
    start = int(np.argmax(~np.isnan(x))) if len(x) and not np.isnan(x).all() else len(x)
    at = (n - 1 if seed_at is None else seed_at) + start
    if at >= len(x):
        return out
    e = x[at - n + 1 : at + 1].mean()
    out[at] = e
    k = 2.0 / (n + 1)
    for i in range(at + 1, len(x)):
        e += k * (x[i] - e)
        out[i] = e
    return out


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    """100 * gain / (gain + loss), 0 if both are 0: means of the first n changes, then (before * (n - 1) + now) / n."""
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    d = np.diff(x)
    gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
    g, s = gain[:n].mean(), loss[:n].mean()
    for i in range(n, len(x)):
        if i > n:
            g, s = (g * (n - 1) + gain[i - 1]) / n, (s * (n - 1) + loss[i - 1]) / n
        out[i] = 100 * g / (g + s) if g + s else 0.0
    return out


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, signal, difference) from row slow + signal - 2 on. Both averages are seeded at row slow - 1."""
    line = ema(x, fast, slow - 1) - ema(x, slow)
    sig = ema(line, signal)
    first = slow + signal - 2
    line[:first] = np.nan
    return line, sig, line - sig


def trix(x: np.ndarray, n: int = 15) -> np.ndarray:
    """Change in percent of the triple exponential average."""
    e = ema(ema(ema(x, n), n), n)
    out = np.full(len(x), np.nan)
    out[1:] = [100 * (b / a - 1) if a == a and a != 0 else (0.0 if a == 0 else np.nan) for a, b in zip(e[:-1], e[1:], strict=True)]
    return out


def tema(x: np.ndarray, n: int = 10) -> np.ndarray:
    a = ema(x, n)
    b = ema(a, n)
    return 3 * a - 3 * b + ema(b, n)


def dema(x: np.ndarray, n: int = 20) -> np.ndarray:
    a = ema(x, n)
    return 2 * a - ema(a, n)


def kama(x: np.ndarray, n: int = 10) -> np.ndarray:
    """Adaptive average from row n on, seeded with x[n - 1]; smoothing between 2/31 and 2/3 by the efficiency ratio."""
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    k = x[n - 1]
    step = np.abs(np.diff(x))
    for i in range(n, len(x)):
        change, path = x[i] - x[i - n], step[i - n : i].sum()
        ratio = 1.0 if path <= change or path == 0 else abs(change / path)
        k += (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[i] - k)
        out[i] = k
    return out


def recursive(x: np.ndarray) -> dict[str, np.ndarray]:
    out = {f"ema_{n}": ema(x, n) for n in EMA} | {f"rsi_{n}": rsi(x, n) for n in RSI}
    out["macd"], out["macd_signal"], out["macd_hist"] = macd(x)
    return out | {"trix_15": trix(x), "tema_10": tema(x), "kama_10": kama(x), "dema_20": dema(x)}


RECURSIVE = [*(f"ema_{n}" for n in EMA), *(f"rsi_{n}" for n in RSI), "macd", "macd_signal", "macd_hist", "trix_15", "tema_10", "kama_10", "dema_20"]


def framed_features(curves: DataFrame, names: list[str] | None = None) -> DataFrame:
    columns = {k: v for k, v in framed_columns().items() if names is None or k in names}
    rows = curves.select("target", "date_id", "x").withColumn("pos", F.row_number().over(ordered()))
    rows = rows.select("target", "date_id", *[v.alias(k) for k, v in columns.items()])
    return rows.select("target", "date_id", *[filled(F.col(k)).alias(k) for k in columns])


def technical_features(curves: DataFrame, block: int = BLOCK) -> DataFrame:
    """All thirty: recursions by blocks of dates, frames by target, joined by target and date."""
    return recursive_features(curves, block).drop("x").join(framed_features(curves), ["target", "date_id"])
