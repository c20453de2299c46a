"""Labels, train masks, sequences, sampling and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import last_rows, ordered
from .screen import require_complete

SEQUENCE, BATCH = 192, 8
LAGS = (1, 2, 3, 4)


def shifted(labels: DataFrame, lag: Column | int, horizon: int = 1) -> DataFrame:
    """Each row's label becomes that of lag + horizon rows later. lag: an int, or a column of lags from LAGS.

    A lag outside LAGS raises when the rows are made; a NULL lag gives a NULL label.
    """
    if isinstance(lag, int):
        return labels.withColumn("label", F.lead("label", lag + horizon).over(ordered()))
    label = F.when(lag.isNotNull() & ~lag.isin(*LAGS), F.raise_error(F.concat(F.lit("no such lag: "), lag.cast("string"))))
    for k in LAGS:
        label = label.when(lag == k, F.lead("label", k + horizon).over(ordered()))
    return labels.withColumn("label", label.cast("double"))


def train_mask(dates: DataFrame, labels: DataFrame) -> DataFrame:
    """dates with is_train: whether the date has labels."""
    known = labels.select("date_id").distinct().withColumn("is_train", F.lit(True))
    return dates.join(known, "date_id", "left").withColumn("is_train", F.coalesce("is_train", F.lit(False)))


def valid_positions(labels: DataFrame, length: int, train_end: int, least: int) -> DataFrame:
    """(date_id, n_valid, split) of dates with `length` - 1 dates before them and `least` labels."""
    daily = labels.groupBy("date_id").agg(F.count("label").alias("n_valid"))
    rows = daily.withColumn("pos", F.row_number().over(Window.orderBy("date_id")) - 1)
    rows = rows.where((F.col("pos") >= length - 1) & (F.col("n_valid") >= least))
    return rows.select("date_id", "n_valid", F.when(F.col("date_id") <= train_end, "train").otherwise("valid").alias("split"))


def sequences(features: DataFrame, columns: list[str], length: int = SEQUENCE) -> DataFrame:
    """(target, date_id, sequence): the feature vectors of the last `length` rows, where there are so many."""
    rows = features.select("target", "date_id", F.array(*[F.col(c).cast("float") for c in columns]).alias("vec"))
    rows = rows.withColumn("sequence", F.collect_list("vec").over(last_rows(length)))
    return rows.where(F.size("sequence") == length).select("target", "date_id", "sequence")


def lagged_labels(labels: DataFrame, specs: DataFrame, horizon: int = 1) -> DataFrame:
    """(lag, date_id, label_date_id, target, label): what is known on a date, lag + horizon of the target's rows later."""
    rows = labels.join(specs.select("target", "lag"), "target")
    known = F.lit(None).cast("int")
    for k in LAGS:
        known = F.when(F.col("lag") == k, F.lead("date_id", k + horizon).over(ordered())).otherwise(known)
    return rows.select("lag", known.alias("known"), F.col("date_id").alias("label_date_id"), "target", "label").where("known IS NOT NULL").withColumnRenamed("known", "date_id")


def day_batches(prices: DataFrame, lagged: DataFrame) -> DataFrame:
    """(date_id, prices, labels_lag_1 .. labels_lag_4): what a server gets on each date that has prices.

    Arrays are as long as there are assets and targets; a lag without labels on the date has an empty one.
    """
    days = prices.groupBy("date_id").agg(F.sort_array(F.collect_list(F.struct("asset", "price"))).alias("prices"))
    row = F.struct("target", "label", "label_date_id")
    own = lagged.groupBy("date_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("lag") == k, row))).alias(f"labels_lag_{k}") for k in LAGS])
    return days.join(own, "date_id", "left").select("date_id", "prices", *[F.coalesce(f"labels_lag_{k}", F.array().cast(own.schema[f"labels_lag_{k}"].dataType)).alias(f"labels_lag_{k}") for k in LAGS])


def sequence_data(features: DataFrame, labels: DataFrame, columns: list[str], lag: int, horizon: int = 1, threshold: float = 1e-6) -> tuple[DataFrame, list[str]]:
    """(target, date_id, vec, label, mask) for sequence models, and the names of vec's entries.

    Labels are those of lag + horizon rows later, 0 with mask false where there is none; dates without any label go.
    Features stay whose population variance over time, averaged over targets, is over the threshold; raises without
    any. A missing value of a feature raises when the rows are made. Features and labels meet by key.
    """
    own = shifted(labels.select("target", "date_id", "label"), lag, horizon)
    dates = own.where("label IS NOT NULL").select("date_id").distinct()
    rows = features.select("target", "date_id", *columns).join(dates, "date_id", "left_semi")
    spread = rows.groupBy("target").agg(*[F.var_pop(c).alias(c) for c in columns]).agg(*[F.avg(c).alias(c) for c in columns]).first()
    kept = [c for c in columns if spread[c] is not None and spread[c] > threshold]
    if not kept:
        raise ValueError(f"no feature has a variance over {threshold}")
    return require_complete(rows, kept).join(labels_and_mask(own), ["target", "date_id"]), kept


def labels_and_mask(labels: DataFrame) -> DataFrame:
    return labels.select("target", "date_id", F.coalesce("label", F.lit(0.0)).alias("label"), F.col("label").isNotNull().alias("mask"))


def batches(rows: DataFrame, seed: int, size: int = BATCH, buckets: int = 64) -> DataFrame:
    """rows in the order of a seeded hash, with bucket and batch numbers; each bucket's batches hold `size` rows."""
    order = F.xxhash64(F.lit(seed), *rows.columns)
    rows = rows.withColumn("bucket", F.pmod(order, F.lit(buckets)).cast("int"))
    w = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), *[c for c in rows.columns if c != "bucket"]), *[c for c in rows.columns if c != "bucket"])
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def hash_sample(rows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for a seed: the least of a hash of keys. A top-k, not a full sort."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def time_distance(df: DataFrame, key: str | list[str] = "target") -> DataFrame:
    return df.withColumn("distance", (F.col("date_id") - F.min("date_id").over(Window.partitionBy(*([key] if isinstance(key, str) else key)))).cast("double"))


#: What a weighting scheme may be called. Fixed values.
SCHEMES = {"none": "none", "off": "none", "recency_exp": "exp", "exp": "exp", "recency_linear": "linear", "linear": "linear"}


def sample_weights(df: DataFrame, scheme: str | None, decay: float, floor: float | None = None, cap: float | None = None, key: str | list[str] = "target") -> DataFrame:
    """weight by recency, capped, floored, then divided by its mean of a key where that is positive.

    Schemes: none, recency_exp, recency_linear, and their short names in any case; another one raises. An exponential
    scheme without a positive decay weighs all rows alike; a linear one may fall.
    """
    if (kind := SCHEMES.get((scheme or "none").lower())) is None:
        raise ValueError(f"unknown weighting scheme {scheme!r}")
    own = Window.partitionBy(*([key] if isinstance(key, str) else key))
    rows = time_distance(df, key)
    if kind == "none" or kind == "exp" and decay <= 0:
        return rows.withColumn("weight", F.lit(1.0))
    span = F.max("distance").over(own)
    rel = F.when(span > 0, F.try_divide("distance", span)).otherwise(F.col("distance"))
    w = F.exp(rel * decay) if kind == "exp" else 1 + rel * decay
    if cap is not None:
        w = F.least(w, F.lit(float(cap)))
    if floor is not None:
        w = F.greatest(w, F.lit(float(floor)))
    rows, mean = rows.withColumn("weight", w), F.avg("weight").over(own)
    return rows.withColumn("weight", F.when(mean > 0, F.try_divide("weight", mean)).otherwise(F.col("weight")))
