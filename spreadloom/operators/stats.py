"""Thirty statistical features of a target: market correlation and beta, moments, tails, spectrum, mean reversion.

All are window frames but regressions on several columns. Warm-up and undefined values are 0 (Hurst: 0.5).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..functions.windows import full, last_rows, ordered

CORR, BETA, MOMENTS, FOURIER, REVERSION, TAIL = (30, 60, 90), (22, 66), (30, 60, 90), (7, 30, 90, 360), (30, 90), 90


def with_returns(targets: DataFrame) -> DataFrame:
    """Adds ret and the market's return: the mean of a date over all targets (two exchanges: by target, by date)."""
    rows = targets.select("target", "date_id", "px").withColumn("ret", F.col("px") - F.lag("px").over(ordered()))
    return rows.withColumn("mkt", F.avg("ret").over(Window.partitionBy("date_id")))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def corr_column(w: int) -> Column:
    r, m = F.col("ret"), F.col("mkt")
    f = last_rows(w)
    return _zero(full(w, r, div(F.covar_samp(r, m).over(f), F.stddev_samp(r).over(f) * F.stddev_samp(m).over(f))))


def beta_column(w: int) -> Column:
    r, m = F.col("ret"), F.col("mkt")
    return _zero(full(w, r, div(F.covar_samp(r, m).over(last_rows(w)), F.var_samp(m).over(last_rows(w)))))


def skew_column(w: int) -> Column:
    """Bias-corrected skew."""
    return _zero(full(w, F.col("ret"), F.skewness("ret").over(last_rows(w)) * (math.sqrt(w * (w - 1)) / (w - 2))))


def kurt_column(w: int) -> Column:
    """Bias-corrected excess kurtosis; a window of equal values has 0."""
    return _zero(full(w, F.col("ret"), ((w + 1) * F.kurtosis("ret").over(last_rows(w)) + 6) * ((w - 1) / ((w - 2) * (w - 3)))))


def var_column(level: float, w: int = TAIL) -> Column:
    """The loss at a quantile, interpolated."""
    return _zero(full(w, F.col("ret"), -F.percentile("ret", F.lit(level)).over(last_rows(w))))


def hill_column(w: int = TAIL) -> Column:
    """Tail index of the largest tenth of losses, at least 5; 0 unless all of them are positive."""
    k = max(5, int(w * 0.1))
    losses = F.transform(F.collect_list("ret").over(last_rows(w)), lambda r: F.greatest(-r, F.lit(0.0)))
    tail = F.slice(F.sort_array(losses, asc=False), 1, k)
    low = F.array_min(tail)
    total = F.aggregate(tail, F.lit(0.0), lambda a, x: a + F.ln(F.greatest(x, F.lit(1e-300))))
    return _zero(full(w, F.col("ret"), F.when(low > 0, div(F.lit(float(k)), total - k * F.ln(F.greatest(low, F.lit(1e-300)))))))


def fourier_columns(w: int) -> tuple[Column, Column]:
    """Amplitude and phase of a window's first harmonic after its mean is taken off; (0, 0) for a flat window.

    Rows need `pos` from 0. The sums over the frame turn with the position of the frame's start.
    """
    x, pos, f = F.col("px"), F.col("pos"), last_rows(w)
    angle = 2 * math.pi * F.pmod(pos, F.lit(w)) / w
    c, s = F.sum(x * F.cos(angle)).over(f), F.sum(x * F.sin(angle)).over(f)
    start = 2 * math.pi * F.pmod(pos + 1, F.lit(w)) / w
    # e^(i start) * (c - i s)
    re, im = c * F.cos(start) + s * F.sin(start), c * F.sin(start) - s * F.cos(start)
    mean = F.avg(x).over(f)
    flat = F.greatest(F.max(x).over(f) - mean, mean - F.min(x).over(f)) <= 1e-8
    amp = F.when(flat, 0.0).otherwise(F.sqrt(re * re + im * im) / w)
    phase = F.when(flat, 0.0).otherwise(F.atan2(im, re))
    return _zero(full(w, x, amp)), _zero(full(w, x, phase))


def hurst_column(w: int) -> Column:
    """ln(range of cumulative deviations / population deviation) / ln w; 0.5 in warm-up and for flat windows."""
    x, f = F.col("px"), last_rows(w)
    values, mean, sd = F.collect_list(x).over(f), F.avg(x).over(f), F.stddev_pop(x).over(f)
    start = F.struct(F.lit(0.0).alias("c"), F.lit(-1e300).alias("hi"), F.lit(1e300).alias("lo"))

    def step(a, v):
        c = a["c"] + v - mean
        return F.struct(c.alias("c"), F.greatest(a["hi"], c).alias("hi"), F.least(a["lo"], c).alias("lo"))

    span = F.aggregate(values, start, step, lambda a: a["hi"] - a["lo"])
    return F.coalesce(full(w, x, F.when((sd > 1e-8) & (span > 1e-8), F.ln(div(span, sd)) / math.log(w))), F.lit(0.5))


def ou_columns(w: int) -> tuple[Column, Column]:
    """Speed and mean of an autoregression of order 1 on the w - 1 pairs of a window."""
    x = F.col("px")
    before = F.lag(x).over(ordered())
    f = ordered().rowsBetween(-(w - 2), 0)
    var = F.var_pop(before).over(f)
    b = F.when(var <= 1e-8, 0.0).otherwise(div(F.covar_pop(before, x).over(f), var))
    a = F.avg(x).over(f) - b * F.avg(before).over(f)
    speed = F.when((b > 0) & (b < 1), -F.ln(F.when(b > 0, b))).otherwise(0.0)
    mean = F.when(F.abs(1 - b) > 1e-8, div(a, 1 - b)).otherwise(0.0)
    return _zero(full(w, x, speed)), _zero(full(w, x, mean))


def coint_column(w: int) -> Column:
    """Residual of y on x: slope through the origin, intercept from the means. Rows need y and x."""
    y, x, f = F.col("y"), F.col("x"), last_rows(w)
    slope = F.coalesce(div(F.sum(x * y).over(f), F.sum(x * x).over(f)), F.lit(0.0))
    return _zero(full(w, y, y - slope * x - (F.avg(y).over(f) - slope * F.avg(x).over(f))))


def market_index(log_prices: DataFrame) -> DataFrame:
    """(date_id, idx): running sum of the mean change of log prices (date_id, asset, lp).

    The sum over all dates has a frame without partitions, over one row a date.
    """
    change = log_prices.withColumn("d", F.col("lp") - F.lag("lp").over(ordered("asset")))
    daily = change.groupBy("date_id").agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("d"))
    return daily.select("date_id", F.sum("d").over(Window.orderBy("date_id").rowsBetween(Window.unboundedPreceding, 0)).alias("idx"))


def cointegration_inputs(targets: DataFrame, terms: DataFrame, log_prices: DataFrame, index: DataFrame) -> DataFrame:
    """(target, date_id, y, x): first term against the second, or against the market index for single assets.

    terms: (target, pos, asset). Weights play no part; an asset without prices falls back to target and index.
    """
    first = terms.where("pos = 0").select("target", F.col("asset").alias("a"))
    second = terms.where("pos = 1").select("target", F.col("asset").alias("b"))
    rows = targets.select("target", "date_id", "px").join(first, "target").join(second, "target", "left")
    rows = rows.join(log_prices.select("date_id", F.col("asset").alias("a"), F.col("lp").alias("ya")), ["date_id", "a"], "left")
    rows = rows.join(log_prices.select("date_id", F.col("asset").alias("b"), F.col("lp").alias("xb")), ["date_id", "b"], "left")
    rows = rows.join(index, "date_id")
    both = F.col("ya").isNotNull() & (F.col("b").isNull() | F.col("xb").isNotNull())
    return rows.select("target", "date_id", F.when(both, F.col("ya")).otherwise(F.col("px")).alias("y"), F.when(both, F.coalesce("xb", "idx")).otherwise(F.col("idx")).alias("x"))


def moment_features(targets: DataFrame) -> DataFrame:
    rows = targets.withColumn("ret", F.col("px") - F.lag("px").over(ordered()))
    return rows.select("target", "date_id", *[skew_column(w).alias(f"skew_{w}") for w in MOMENTS], *[kurt_column(w).alias(f"kurt_{w}") for w in MOMENTS])


def market_features(targets: DataFrame) -> DataFrame:
    return with_returns(targets).select("target", "date_id", *[corr_column(w).alias(f"corr_market_{w}") for w in CORR], *[beta_column(w).alias(f"beta_{w}") for w in BETA])


def risk_features(targets: DataFrame) -> DataFrame:
    rows = targets.withColumn("ret", F.col("px") - F.lag("px").over(ordered()))
    return rows.select("target", "date_id", var_column(0.01).alias("var_1"), var_column(0.05).alias("var_5"), hill_column().alias("hill_alpha"))


def fourier_features(targets: DataFrame, windows: tuple[int, ...] = FOURIER) -> DataFrame:
    rows = targets.withColumn("pos", F.row_number().over(ordered()) - 1)
    out = []
    for w in windows:
        amp, phase = fourier_columns(w)
        out += [amp.alias(f"fourier_amp_{w}"), phase.alias(f"fourier_phase_{w}")]
    return rows.select("target", "date_id", *out)


def reversion_features(targets: DataFrame) -> DataFrame:
    out = []
    for w in REVERSION:
        speed, mean = ou_columns(w)
        out += [hurst_column(w).alias(f"hurst_{w}"), speed.alias(f"ou_speed_{w}"), mean.alias(f"ou_mean_{w}")]
    return targets.select("target", "date_id", *out)


def statistical_features(targets: DataFrame) -> DataFrame:
    """All of the above as frames of one projection: one exchange by date for the market, one by target for the rest."""
    rows = with_returns(targets).withColumn("pos", F.row_number().over(ordered()) - 1)
    out = {f"corr_market_{w}": corr_column(w) for w in CORR} | {f"beta_{w}": beta_column(w) for w in BETA}
    out |= {f"skew_{w}": skew_column(w) for w in MOMENTS} | {f"kurt_{w}": kurt_column(w) for w in MOMENTS}
    out |= {"var_1": var_column(0.01), "var_5": var_column(0.05), "hill_alpha": hill_column()}
    for w in FOURIER:
        out[f"fourier_amp_{w}"], out[f"fourier_phase_{w}"] = fourier_columns(w)
    for w in REVERSION:
        out[f"hurst_{w}"] = hurst_column(w)
        out[f"ou_speed_{w}"], out[f"ou_mean_{w}"] = ou_columns(w)
    return rows.select("target", "date_id", *[c.alias(k) for k, c in out.items()])


def regression_residuals(y: np.ndarray, x: np.ndarray, w: int) -> np.ndarray:
    """Residual at the end of each window of w rows of y on the columns of x; 0 before.

    Slopes solve the normal equations without a constant; where these are singular, they are those of least norm. The
    constant follows from the means.
    """
    out = np.zeros(len(y))
    if len(y) < w:
        return out
    xs = np.lib.stride_tricks.sliding_window_view(x, w, axis=0)  # window, column, row
    ys = np.lib.stride_tricks.sliding_window_view(y, w)
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        try:
            slope = np.linalg.solve(a @ a.T, a @ b)
        except np.linalg.LinAlgError:
            slope = np.linalg.lstsq(a.T, b, rcond=None)[0]
        out[i + w - 1] = y[i + w - 1] - x[i + w - 1] @ slope - (b.mean() - a.mean(axis=1) @ slope)
    return np.where(np.isfinite(out), out, 0.0)


def several_term_residuals(targets: DataFrame, terms: DataFrame, log_prices: DataFrame, index: DataFrame) -> DataFrame:
    """(target, date_id, coint_resid_*) of targets of three or more terms: the first on all others.

    Weights play no part; a date without a price of some term takes the target and the market index. A group is one
    target's series.
    """
    many = terms.join(terms.groupBy("target").agg(F.count("*").alias("n")).where("n > 2"), "target")
    lp = many.join(log_prices, "asset").groupBy("target", "date_id", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "lp"))).alias("lps"))
    rows = targets.join(many.select("target", "n").distinct(), "target").join(lp, ["target", "date_id", "n"], "left").join(index, "date_id")
    rows = rows.select("target", "date_id", "px", "idx", F.when(F.size("lps") == F.col("n"), F.transform("lps", lambda t: t["lp"])).alias("lps"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date_id", kind="stable")
        width = max((len(v) for v in group["lps"] if v is not None), default=2)
        table = np.zeros((len(group), width))
        for i, (v, px, idx) in enumerate(zip(group["lps"], group["px"], group["idx"], strict=True)):
            if v is None:
                table[i, :2] = px, idx
            else:
                table[i] = v
        own = {f"coint_resid_{w}": regression_residuals(table[:, 0], table[:, 1:], w) for w in REVERSION}
        return group[["target", "date_id"]].assign(**own)

    return rows.groupBy("target").applyInPandas(work, "target string, date_id int, " + ", ".join(f"coint_resid_{w} double" for w in REVERSION))


def cointegration_residuals(targets: DataFrame, terms: DataFrame, log_prices: DataFrame, index: DataFrame) -> DataFrame:
    """Residuals of every target: frames for one or two terms, a grouped map for more."""
    few = terms.groupBy("target").agg(F.count("*").alias("n")).where("n <= 2").select("target")
    out = cointegration_features(cointegration_inputs(targets.join(few, "target", "left_semi"), terms, log_prices, index))
    if terms.where("pos >= 2").head(1):  # terms are the specs' own small table
        out = out.unionByName(several_term_residuals(targets, terms, log_prices, index))
    return out


def cointegration_features(inputs: DataFrame) -> DataFrame:
    return inputs.select("target", "date_id", *[coint_column(w).alias(f"coint_resid_{w}") for w in REVERSION])


