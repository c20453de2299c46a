"""The pooled trees: rows that are written once, and partitions by their number."""

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from spreadloom.operators import models

CONFIG = models.TrainConfig(train_end=59, rounds=2, max_depth=2, min_data_in_leaf=2)


@pytest.fixture
def rows(spark):
    base = spark.range(240).select(F.concat(F.lit("t"), F.col("id") % 3).alias("target"), (F.col("id") / 3).cast("int").alias("date_id"))
    features = base.select("*", (F.col("date_id") % 7 + F.length("target")).cast("double").alias("a"), F.sin("date_id").alias("b"))
    return models.training_rows(features, base.withColumn("label", F.col("date_id") % 5 + F.lit(0.5)), ["a", "b"], CONFIG)


def test_training_rows_are_written_once(rows):
    assert rows.inputFiles()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert rows.count() == 3 * 78
    assert {(r.is_train, r.n) for r in rows.groupBy("is_train").agg(F.count("*").alias("n")).collect()} == {(True, 180), (False, 54)}
    assert rows.where("NOT is_train AND weight <> 1.0").count() == 0


@pytest.mark.parametrize("shuffled", [3, 40])
def test_partitions_follow_the_rows(spark, rows, monkeypatch, shuffled):
    """The learner's levels run over PART rows a partition, however many partitions shuffles have."""
    found, real = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: found.append([len(p) for p in df.rdd.glom().collect()]) or real(self, df))
    monkeypatch.setattr(models, "PART", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
    try:
        one, two = (models.fit(x, ["a", "b"], CONFIG).toDebugString for x in (rows, rows.repartition(7)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one.split("\n", 1)[1] == two.split("\n", 1)[1]
    assert found[0] == found[1] and len(found[0]) == 2 and sum(found[0]) == 180 and min(found[0]) > 0
