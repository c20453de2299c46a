"""Trees grown by Spark against the learner in numpy, which grows one target's trees in memory."""

import dataclasses
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import boosting, forest

CONFIG = boosting.BoostConfig(train_end=149, num_boost_round=2, num_leaves=4, max_depth=2, min_data_in_leaf=5, early_stopping_rounds=0, feature_fraction=1.0, bagging_fraction=1.0, learning_rate=0.3)
NAMES = ["f0", "f1", "f2", "flat"]


def table(n_targets=3, n=180, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n_targets):
        x = rng.normal(size=(n, 3)).round(2)
        y = np.where(x[:, t % 3] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] * (t + 1) + 0.05 * rng.normal(size=n)
        rows += [(1 + t % 2, f"t{t}", d, float(y[d]), float(rng.uniform(0.5, 2)), d <= 149, *map(float, x[d]), 1.0) for d in range(n)]
    return rows


SCHEMA = "lag int, target string, date_id int, label double, weight double, is_train boolean, f0 double, f1 double, f2 double, flat double"


def by_numpy(rows, config):
    """{(lag, target): predictions of all rows} by boosting.boosted."""
    out = {}
    for key in sorted({r[:2] for r in rows}):
        own = [r for r in rows if r[:2] == key]
        x, y, w = (np.array([r[s] for r in own], float) for s in (slice(6, 9), 3, 4))
        train = np.array([r[5] for r in own])
        model = boosting.boosted(x[train], y[train], w[train], x[~train], y[~train], config)
        out[key] = (boosting.predicted(model, x), model)
    return out


def by_spark(spark, rows, config):
    df = spark.createDataFrame(rows, SCHEMA)
    models = forest.fit_targets(df, NAMES, config)
    preds = boosting.predict_targets(models, df.select("target", "date_id", *NAMES), 50)
    got = {(r.lag, r.target, r.date_id): r.pred for r in preds.collect()}
    return {(m.lag, m.target): (np.array([got[r[:3]] for r in rows if r[:2] == (m.lag, m.target)]), m) for m in models.collect()}


@pytest.mark.parametrize("values", [{}, {"lambda_l1": 4.0, "lambda_l2": 3.0}, {"num_leaves": 3}, {"num_leaves": 8, "max_depth": 3, "min_data_in_leaf": 20}])
def test_same_trees_as_in_memory(spark, values):
    """All levels: the same splits and leaf values, so the same predictions of train rows and later ones."""
    config = CONFIG.with_values(values)
    rows = table()
    ours, theirs = by_spark(spark, rows, config), by_numpy(rows, config)
    assert ours.keys() == theirs.keys()
    for key, (pred, model) in ours.items():
        assert pred == pytest.approx(theirs[key][0], abs=1e-9)
        assert model.feature_names == NAMES[:3]
        own = json.loads(model.model)
        assert len(own["trees"]) == model.best_iteration == config.num_boost_round
        for a, b in zip(own["trees"], theirs[key][1]["trees"], strict=True):
            assert a["feature"][0] == b["feature"][0]
            assert sum(f < 0 for f in a["feature"]) == sum(f < 0 for f in b["feature"]) <= config.num_leaves


def test_figures_and_early_stopping(spark):
    rows = table(2, 240)
    noise = np.random.default_rng(3).normal(size=240)
    rows = [r if r[5] or r[1] == "t0" else (*r[:3], float(noise[r[2]]), *r[4:]) for r in rows]
    config = dataclasses.replace(CONFIG, num_boost_round=8, early_stopping_rounds=2)
    ours, theirs = by_spark(spark, rows, config), by_numpy(rows, config)
    for key, (pred, m) in ours.items():
        own = [r for r in rows if r[:2] == key]
        y, w, train = (np.array([r[k] for r in own]) for k in (3, 4, 5))
        assert m.best_iteration == len(theirs[key][1]["trees"])
        assert (m.train_samples, m.val_samples) == (150, 90)
        assert m.train_rmse == pytest.approx(np.sqrt(np.mean((pred - y)[train] ** 2)))
        assert m.val_rmse == pytest.approx(np.sqrt(np.mean((pred - y)[~train] ** 2)))
        assert (m.train_weight_min, m.train_weight_max) == (w[train].min(), w[train].max())
    assert ours[2, "t1"][1].best_iteration < 8


def test_bags_and_draws_are_seeded(spark):
    rows = table(2)
    config = dataclasses.replace(CONFIG, bagging_fraction=0.7, bagging_freq=1, feature_fraction=0.5, num_boost_round=4)
    a, b = by_spark(spark, rows, config), by_spark(spark, rows, config)
    other = by_spark(spark, rows, dataclasses.replace(config, seed=7))
    for key, (pred, m) in a.items():
        assert m.model == b[key][1].model
        assert (pred != other[key][0]).any()
        y, train = (np.array([r[k] for r in rows if r[:2] == key]) for k in (3, 5))
        assert np.mean((pred - y)[train] ** 2) < np.var(y[train])
    df = spark.createDataFrame(rows, SCHEMA)
    kept = df.where(forest.bag(config, 0)).count() / len(rows)
    assert 0.6 < kept < 0.8


def test_odd_tables(spark):
    rows = table(1)
    gaps = [(*r[:6], None if r[2] % 7 == 0 else r[6], None, *r[8:]) for r in rows]
    (pred, m), = by_spark(spark, gaps, CONFIG).values()
    assert m.feature_names == ["f0", "f2"]
    assert np.isfinite(pred).all()
    # values that are all alike but one, no room for a split: the root is the only leaf
    df = spark.createDataFrame(table(1, 20), SCHEMA)
    alone = forest.fit_targets(df, NAMES, dataclasses.replace(CONFIG, min_data_in_leaf=15)).first()
    assert all(t["feature"] == [-1] for t in json.loads(alone.model)["trees"])
    assert alone.val_samples == 0 and alone.val_rmse is None
    assert forest.fit_targets(df.limit(0), NAMES, CONFIG).count() == 0
    none = forest.fit_targets(df, NAMES, dataclasses.replace(CONFIG, num_boost_round=0)).first()
    assert none.best_iteration == 0 and json.loads(none.model)["trees"] == []
    with pytest.raises(Exception, match="no feature of t0 varies"):
        forest.fit_targets(df, ["flat"], CONFIG)
    with pytest.raises(ValueError, match="no train rows of t0"):
        forest.fit_targets(df.withColumn("is_train", F.lit(False)), NAMES, CONFIG)


def test_other_sides_are_made_by_subtraction(spark):
    rows = spark.createDataFrame([("a", 1, k, float(k % 5), 1.0 + k % 3, [k % 4, k % 7]) for k in range(200)], "target string, lag int, at int, g double, h double, codes array<int>")
    base = rows.withColumn("node", F.lit(0))
    cells = forest.histograms(base, [0, 1]).cache()
    splits = forest.Small(forest.best_splits(cells, CONFIG).cache(), 1)
    sent = forest.sent_on(base, splits)
    side = splits.df.select(*forest.KEY, forest.smaller().alias("node"))
    made = forest.histograms(sent.join(side, forest.NODE, "left_semi"), [0, 1], cells, splits).collect()
    whole = forest.histograms(sent, [0, 1]).collect()
    key = lambda r: (r.node, r.feature, r.bin)
    assert sorted(map(key, made)) == sorted(map(key, whole))
    for a, b in zip(sorted(made, key=key), sorted(whole, key=key), strict=True):
        assert (a.g, a.h, a.n) == pytest.approx((b.g, b.h, b.n))


def test_levels_run_over_as_many_partitions_as_they_have_rows_for(spark, monkeypatch):
    """A level's histograms are a written table: once persisted, each kept all partitions of its shuffles."""
    found, real = [], forest.best_splits
    monkeypatch.setattr(forest, "best_splits", lambda cells, config: found.append(cells.rdd.getNumPartitions()) or real(cells, config))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        forest.fit_targets(spark.createDataFrame(table(), SCHEMA), NAMES, dataclasses.replace(CONFIG, num_boost_round=1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 2 and max(found) <= 16


def test_predictions_take_the_rows_that_the_fit_had(spark, monkeypatch):
    from spreadloom.plans import queries

    made, given = [], []
    rows = spark.createDataFrame([(1, "t0", 0, 0.5)], "lag int, target string, date_id int, label double").select("*", *[F.lit(1.0).alias(c) for c in queries.factors.factor_columns()])
    monkeypatch.setattr(queries, "_fitted", {})
    monkeypatch.setattr(queries, "_forest_rows", lambda *a: made.append(a) or rows)
    monkeypatch.setattr(queries.forest, "fit_targets", lambda df, *a: given.append(df) or df)
    monkeypatch.setattr(queries.boosting, "predict_targets", lambda models, df, *a: df.select("target", "date_id", F.lit(2.0).alias("pred")))
    for _ in range(2):
        assert [tuple(r) for r in queries._boosted(spark, "nowhere").collect()] == [("t0", 0, 2.0, 0.5)]
    assert len(made) == len(given) == 1
