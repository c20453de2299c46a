"""Readers of the panel's inputs. Schemas are given where they are known, so no reader infers over the data twice."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "target string, lag int, pair string"


def csv_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A CSV with a header; `columns` is the projection."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_prices(spark: SparkSession, folder: str, split: str, columns: list[str] | None = None) -> DataFrame:
    """The wide price table of split train, test or all; `all` is the union of rows over the columns that both have."""
    if split not in ("train", "test", "all"):
        raise ValueError(f"split is train, test or all, not {split!r}")
    if split != "all":
        return csv_table(spark, f"{folder}/{split}.csv", columns)
    return union_common(csv_table(spark, f"{folder}/train.csv", columns), csv_table(spark, f"{folder}/test.csv"))


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, with the columns that both have, in the order of the first."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


def load_labels(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A wide label table as (date_id, target, label), with label_date_id where the table has it."""
    wide = csv_table(spark, path, columns)
    ids = [c for c in wide.columns if c in ("date_id", "label_date_id")]
    names = [c for c in wide.columns if c not in ids]
    return wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(ids, names, "target", "label")


def load_lagged_labels(spark: SparkSession, folder: str, lags: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(lag, date_id, label_date_id, target, label) of the files test_labels_lag_<lag>.csv."""
    out = None
    for lag in lags:
        one = load_labels(spark, f"{folder}/test_labels_lag_{lag}.csv").withColumn("lag", F.lit(lag))
        out = one if out is None else out.unionByName(one)
    return out.select("lag", "date_id", "label_date_id", "target", "label")


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, schema=PAIRS)


def load_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A feature panel in Parquet; raises without its keys."""
    df = spark.read.parquet(path)
    if missing := {"target", "date_id"} - set(df.columns):
        raise ValueError(f"not a feature panel: no {sorted(missing)}")
    if "is_train" in df.columns:  # a folder's name
        df = df.withColumn("is_train", F.col("is_train").cast("boolean"))
    return df.select("target", "date_id", *columns) if columns else df


def first_panel(spark: SparkSession, paths: list[str], from_date: int) -> DataFrame:
    """The first of paths that exists and has rows from a date on; the filter is pushed to the scan."""
    for path in paths:
        if exists(spark, path):
            df = load_features(spark, path).where(F.col("date_id") >= from_date)
            if df.head(1):
                return df
    raise FileNotFoundError(f"no panel in {paths}")


def param_snapshot(spark: SparkSession, text: str) -> DataFrame:
    """(lag, name, value) of a JSON object keyed `lagN` or `N`."""
    rows = spark.createDataFrame([(text,)], "j string").select(F.explode(F.from_json("j", "map<string, map<string, string>>")).alias("k", "v"))
    lag = F.regexp_replace("k", "^lag", "").cast("int")
    return rows.select(lag.alias("lag"), F.explode("v").alias("name", "value")).withColumn("value", F.col("value").try_cast("double"))


def newest_run(spark: SparkSession, folder: str) -> str:
    """The folder in a folder of runs that changed last; of equal times, the last by name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
    if not runs:
        raise FileNotFoundError(f"no run in {folder}")
    return max(runs)[1]


def load_models(spark: SparkSession, run: str, schema: str) -> DataFrame:
    """The models of all lags of a run, each with its own feature names and medians."""
    return spark.read.schema(schema).parquet(f"{run}/lag_*/models")


def load_artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame, list]:
    """Component loadings and symbolic programs, as save_artifacts wrote them."""
    as_program = lambda v: tuple(map(as_program, v)) if isinstance(v, list) else v
    rows = spark.read.schema("at int, program string").parquet(f"{folder}/programs").orderBy("at").collect()
    return spark.read.schema("target string, component int, loading double").parquet(f"{folder}/loadings"), [as_program(json.loads(r.program)) for r in rows]


def union_widened(parts: list[DataFrame]) -> DataFrame:
    """All rows of parts; a column takes the widest of its types, and is NULL where a part lacks it."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
