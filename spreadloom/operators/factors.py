"""Fifteen factors of a target: returns, volatility, Sharpe ratio, z-score, momentum, reversal, rolling minimum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..functions.windows import filled, last_rows, ordered

RETURNS, VOLS, SHARPES, ZSCORES, MOMENTA = (1, 5, 10, 20), (5, 20, 60), (20, 60), (20, 60), (20, 60)


def factor_columns() -> dict[str, Column]:
    """Of rows (target, date_id, px, ret)."""
    px, ret = F.col("px"), F.col("ret")
    out = {f"ret_{k}": px - F.lag(px, k).over(ordered()) for k in RETURNS}
    out |= {f"vol_{w}": F.stddev_samp(ret).over(last_rows(w)) for w in VOLS}
    for w in SHARPES:
        sd = F.stddev_samp(ret).over(last_rows(w))
        out[f"sharpe_{w}"] = F.when(sd == 0, 0.0).otherwise(div(F.avg(ret).over(last_rows(w)), sd))
    out |= {f"zscore_{w}": div(px - F.avg(px).over(last_rows(w)), F.stddev_samp(px).over(last_rows(w))) for w in ZSCORES}
    out |= {f"momentum_{w}": F.sum(ret).over(last_rows(w)) for w in MOMENTA}
    out["reversal_5"] = -F.avg(ret).over(ordered().rowsBetween(-5, -1))
    out["rolling_min_20"] = F.min(px).over(last_rows(20))
    return out


def factor_features(targets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(target, date_id, factors), each filled forward, then backward."""
    columns = {k: v for k, v in factor_columns().items() if names is None or k in names}
    rows = targets.withColumn("ret", F.col("px") - F.lag("px").over(ordered())).select("target", "date_id", "px", "ret")
    rows = rows.select("target", "date_id", *[v.alias(k) for k, v in columns.items()])
    return rows.select("target", "date_id", *[filled(F.col(k)).alias(k) for k in columns])
