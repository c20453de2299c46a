"""Datasets for sequence models: normalised, split and stored once, cut into windows when a batch is read.

A sample is a date: the last `length` rows of every target's features, and the date's labels and mask. A panel is
stored as chunks of positions, each with the length - 1 rows before it, so a row is stored once or twice, not once a
window; a window is cut from one chunk. An epoch deals dates to batches by a seeded hash within each chunk, so that a
batch needs one chunk and any epoch can be made again, anywhere, from its number and seed.

Cases: a date is a sample if it has `length` - 1 dates before it and `least` labels; without train samples it raises, as
do missing features (see labels.sequence_data); deviations below 1e-6 count as 1; targets come in order of their names.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import ordered
from . import labels as L

#: Positions of a chunk.
CHUNK = 512
SPLITS = ("train", "valid")


@dataclasses.dataclass(frozen=True)
class Datasets:
    """What create_datasets has stored in a folder: chunks, samples (date_id, chunk, split, n_valid), normalizer."""

    spark: SparkSession
    folder: str
    columns: list[str]
    length: int
    chunk: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def batches(self, split: str, seed: int, epoch: int, size: int = L.BATCH) -> DataFrame:
        """(chunk, batch, place, date_id) of the samples of a split, in the order of an epoch."""
        order = F.xxhash64(F.lit(seed), F.lit(epoch), "date_id")
        at = F.row_number().over(Window.partitionBy("chunk").orderBy(order, "date_id")) - 1
        own = self.table("samples").where(F.col("split") == split)
        return own.select("chunk", F.floor(at / size).cast("int").alias("batch"), (at % size).cast("int").alias("place"), "date_id")

    def windows(self, wanted: DataFrame) -> DataFrame:
        """wanted (chunk, batch, place, date_id) with its features (a list by row, target, feature), labels and mask.

        A task holds one chunk of the panel and gives a sample at a time.
        """
        length, schema = self.length, "chunk int, batch int, place int, date_id int, features array<float>, labels array<double>, mask array<boolean>"

        def cut(own: pd.DataFrame, part: pd.DataFrame):
            own, part = own.sort_values(["batch", "place"]), part.sort_values("target")
            if not len(own):
                return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
            dates = np.asarray(part["dates"].iloc[0])
            cube = np.stack([np.stack(v) for v in part["vecs"]], axis=1)  # row, target, feature
            y, mask = (np.stack(part[c].tolist(), axis=1) for c in ("labels", "masks"))
            at = np.searchsorted(dates, own["date_id"].to_numpy())
            return own.assign(features=[cube[i - length + 1 : i + 1].ravel() for i in at], labels=list(y[at]), mask=list(mask[at]))

        return wanted.groupBy("chunk").cogroup(self.table("chunks").groupBy("chunk")).applyInPandas(cut, schema)


def split_samples(rows: DataFrame, length: int, train_end: int, least: int, chunk: int) -> DataFrame:
    """(date_id, chunk, split, n_valid) of rows (target, date_id, pos, mask)."""
    daily = rows.groupBy("date_id").agg(F.count_if("mask").alias("n_valid"), F.max("pos").alias("pos"))
    daily = daily.where((F.col("pos") >= length - 1) & (F.col("n_valid") >= least))
    split = F.when(F.col("date_id") <= train_end, SPLITS[0]).otherwise(SPLITS[1])
    return daily.select("date_id", F.floor(F.col("pos") / chunk).cast("int").alias("chunk"), split.alias("split"), "n_valid")


def fit_normalizer(rows: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """(target, means, stds) of rows (target, date_id, vec) on the dates of train samples."""
    own = rows.join(samples.where(F.col("split") == SPLITS[0]).select("date_id"), "date_id", "left_semi")
    value = lambda j: F.get("vec", F.lit(j)).cast("double")
    out = own.groupBy("target").agg(F.array(*[F.avg(value(j)) for j in range(n)]).alias("means"), F.array(*[F.stddev_pop(value(j)) for j in range(n)]).alias("stds"))
    return out.withColumn("stds", F.transform("stds", lambda s: F.when(s < 1e-6, 1.0).otherwise(s)))


def create_datasets(features: DataFrame, labels: DataFrame, columns: list[str], lag: int, train_end: int, folder: str, length: int = L.SEQUENCE, least: int = 1, horizon: int = 1, chunk: int = CHUNK, normalizer: DataFrame | None = None) -> Datasets:
    """Screens, aligns, splits, normalises and stores a lag's panel. normalizer: that of another run, else fitted here."""
    spark = features.sparkSession
    rows, kept = L.sequence_data(features, labels, columns, lag, horizon)
    rows = rows.withColumn("pos", F.row_number().over(ordered()) - 1).persist()
    try:
        split_samples(rows, length, train_end, least, chunk).write.mode("overwrite").parquet(f"{folder}/samples")
        samples = spark.read.parquet(f"{folder}/samples")
        if not samples.where(F.col("split") == SPLITS[0]).head(1):
            raise ValueError("no train samples; adjust train_end or length")
        (fit_normalizer(rows, samples, len(kept)) if normalizer is None else normalizer).write.mode("overwrite").parquet(f"{folder}/normalizer")
        scaled = rows.join(spark.read.parquet(f"{folder}/normalizer"), "target")
        vec = F.transform(F.arrays_zip("vec", "means", "stds"), lambda x: ((x["vec"] - x["means"]) / x["stds"]).cast("float"))
        # the rows before a chunk are stored with it, too
        chunk_of = lambda pos: F.floor(pos / chunk).cast("int")
        into = F.sequence(chunk_of(F.col("pos")), chunk_of(F.col("pos") + length - 1))
        parts = scaled.select("target", F.explode(into).alias("chunk"), F.struct("pos", "date_id", vec.alias("vec"), "label", "mask").alias("r"))
        lists = parts.groupBy("chunk", "target").agg(F.sort_array(F.collect_list("r")).alias("r"))
        lists.select("chunk", "target", *[F.col(f"r.{c}").alias(n) for c, n in (("date_id", "dates"), ("vec", "vecs"), ("label", "labels"), ("mask", "masks"))]).write.mode("overwrite").parquet(f"{folder}/chunks")
    finally:
        rows.unpersist()
    return Datasets(spark, folder, kept, length, chunk)
