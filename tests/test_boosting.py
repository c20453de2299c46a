import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import boosting, labels

CONFIG = boosting.BoostConfig(train_end=149, num_boost_round=60, num_leaves=8, min_data_in_leaf=5, early_stopping_rounds=10)


def data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    return x, np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + 0.05 * rng.normal(size=n)


def stump(x, y, w, least):
    """The best split of all columns and places, by hand."""
    best = (-np.inf, None, None)
    g = (np.average(y, weights=w) - y) * w
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                gain = sum(g[s].sum() ** 2 / w[s].sum() for s in (left, ~left))
                best = max(best, (gain, j, cut), key=lambda t: t[0])
    return best[1:]


def test_first_split_against_brute_force():
    for seed in range(5):
        x, y = data(80, seed)
        w = np.random.default_rng(seed).uniform(0.5, 2, 80)
        config = boosting.BoostConfig(num_boost_round=1, num_leaves=2, feature_fraction=1.0, bagging_fraction=1.0, min_data_in_leaf=7, learning_rate=1.0)
        model = boosting.boosted(x, y, w, x[:0], y[:0], config)
        j, cut = stump(x, y, w, 7)
        tree = model["trees"][0]
        assert tree["feature"][0] == j
        left = x[:, j] <= cut
        expected = np.where(left, np.average(y[left], weights=w[left]), np.average(y[~left], weights=w[~left]))
        assert boosting.predicted(model, x) == pytest.approx(expected)


def test_terms_and_limits():
    x, y = data()
    w = np.ones(len(y))
    small = boosting.boosted(x, y, w, x[:0], y[:0], CONFIG)
    assert len(small["trees"]) == 60
    assert all(sum(f < 0 for f in t["feature"]) <= 8 for t in small["trees"])
    assert np.mean((boosting.predicted(small, x) - y) ** 2) < 0.2 * np.var(y)
    nothing = boosting.boosted(x, y, w, x[:0], y[:0], CONFIG.with_values({"lambda_l1": 1e9}))
    assert boosting.predicted(nothing, x) == pytest.approx(np.full(len(y), y.mean()))
    shallow = boosting.boosted(x, y, w, x[:0], y[:0], CONFIG.with_values({"max_depth": 1}))
    assert all(len(t["feature"]) <= 3 for t in shallow["trees"])


def test_early_stopping_keeps_the_best_round():
    x, y = data()
    noise = np.random.default_rng(1).normal(size=100)
    model = boosting.boosted(x[:200], y[:200], np.ones(200), x[200:], noise, CONFIG)
    assert len(model["trees"]) < 60
    path = [np.mean((boosting.predicted(model | {"trees": model["trees"][:k]}, x[200:]) - noise) ** 2) for k in range(len(model["trees"]) + 1)]
    assert len(model["trees"]) <= 1 or int(np.argmin(path[1:])) + 1 == len(model["trees"])


def test_without_stopping_rounds_all_rounds_count():
    import dataclasses

    x, y = data()
    model = boosting.boosted(x[:200], y[:200], np.ones(200), x[200:], np.zeros(100), dataclasses.replace(CONFIG, early_stopping_rounds=0, num_boost_round=7))
    assert len(model["trees"]) == 7


@pytest.fixture
def panel(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], []
    for t in ("a", "b", "c", "d"):
        x = rng.normal(size=(200, 3))
        for d in range(200):
            rows.append((t, d, *(None if rng.random() < 0.05 else float(v) for v in x[d]), 1.0))
            # the label of two dates on follows the first feature
            truth.append((t, d, float(x[d - 2, 0] * 2 + rng.normal() * 0.2) if d >= 2 else 0.0))
    return spark.createDataFrame(rows, "target string, date_id int, f0 double, f1 double, f2 double, flat double"), spark.createDataFrame(truth, "target string, date_id int, label double")


def test_models_by_target(spark, panel):
    features, truth = panel
    names = ["f0", "f1", "f2", "flat"]
    rows = boosting.training_rows(features, truth, names, CONFIG)
    models = boosting.fit_targets(rows, names, CONFIG).persist()
    got = models.collect()
    assert sorted(r.target for r in got) == list("abcd")
    for r in got:
        assert r.feature_names == ["f0", "f1", "f2"]
        assert (r.train_samples, r.val_samples) == (150, 48)
        assert r.val_rmse < 1.2
        assert len(json.loads(r.model)["trees"]) == r.best_iteration <= 60
        own = [x.f1 for x in features.where(F.col("target") == r.target).where("date_id <= 149 AND f1 IS NOT NULL").collect()]
        assert r.medians[1] == pytest.approx(np.median(own))
    # a served row lacks a column, and has one that no model knows
    served = boosting.predict_targets(models, features.where("date_id >= 198").drop("f2").withColumn("new", F.lit(1)))
    assert served.count() == 8
    assert served.where("pred IS NULL").count() == 0
    preds = boosting.predict_targets(models, rows.select("target", "date_id", *names)).join(rows.select("target", "date_id", "label"), ["target", "date_id"])
    out = boosting.report(preds, CONFIG.train_end).first()
    assert (out.n_train_dates, out.n_val_dates) == (150, 48)
    assert out.train_ic_mean > out.val_ic_mean > 0.7
    assert out.val_ir == pytest.approx(out.val_ic_mean / out.val_ic_std)


def test_a_target_without_features_or_train_rows_raises(spark, panel):
    features, truth = panel
    with pytest.raises(Exception, match="no feature of"):
        boosting.fit_targets(boosting.training_rows(features, truth, ["flat"], CONFIG), ["flat"], CONFIG).collect()
    late = CONFIG.with_values({"train_end": -1})
    with pytest.raises(Exception, match="no train rows"):
        boosting.fit_targets(boosting.training_rows(features, truth, ["f0"], late), ["f0"], late).collect()


def test_search(spark, panel):
    features, truth = panel
    names = ["f0", "f1", "f2"]
    settings = [{"num_boost_round": 5.0, "learning_rate": 0.1}, {"num_boost_round": 40.0, "learning_rate": 0.1}, {"learning_rate": 0.1, "no_such": 1.0}]
    rows = boosting.training_rows(features, truth, names, CONFIG)
    out = {r["index"]: r for r in boosting.search(rows, names, CONFIG, settings, chunks=2).collect()}
    assert [out[k].status for k in range(3)] == ["ok", "ok", "error"]
    assert out[2].error == "unknown settings: ['no_such']"
    assert out[2].val_ic is None
    assert out[0].param_num_boost_round == 5
    assert out[1].train_val_gap == pytest.approx(out[1].train_ic - out[1].val_ic)
    config = CONFIG.with_values(settings[1])
    preds = boosting.predict_targets(boosting.fit_targets(rows, names, config), rows.select("target", "date_id", *names)).join(rows.select("target", "date_id", "label"), ["target", "date_id"])
    alone = boosting.report(preds, config.train_end).first()
    assert out[1].val_ic == pytest.approx(alone.val_ic_mean)
    assert out[1].n_train_dates == 150


def test_a_search_goes_on_where_it_was_stopped(spark, panel, tmp_path):
    features, truth = panel
    names = ["f0", "f1", "f2"]
    settings = [{"num_boost_round": float(n), "learning_rate": 0.1} for n in (2, 4, 6, 8, 10)]
    rows = boosting.training_rows(features, truth, names, CONFIG)
    whole = sorted(map(tuple, boosting.search(rows, names, CONFIG, settings, wave=2).collect()))
    again = lambda: sorted(map(tuple, boosting.search(rows, names, CONFIG, settings, wave=2, folder=str(tmp_path)).collect()))
    assert again() == whole
    waves = sorted(x.name for x in (tmp_path / "rung=0").iterdir())
    assert waves == ["wave=0", "wave=1", "wave=2"]
    # the second wave is lost half-way; the others aren't fitted again
    (tmp_path / "rung=0" / "wave=1" / "_SUCCESS").unlink()
    stamp = {w: (tmp_path / "rung=0" / w / "_SUCCESS").stat().st_mtime_ns for w in ("wave=0", "wave=2")}
    assert again() == whole
    assert stamp == {w: (tmp_path / "rung=0" / w / "_SUCCESS").stat().st_mtime_ns for w in stamp}
    # correlations are kept, predictions aren't
    assert spark.read.parquet(f"{tmp_path}/rung=0/wave=0").columns == ["index", "date_id", "ic", "error"]


def test_halving_keeps_the_better_half(spark, panel):
    features, truth = panel
    names = ["f0", "f1", "f2"]
    settings = [{"num_boost_round": float(n), "learning_rate": 0.05} for n in (2, 40, 4, 60)]
    rows = boosting.training_rows(features, truth, names, CONFIG)
    out = {r["index"]: r for r in boosting.search(rows, names, CONFIG, settings, rungs=2).collect()}
    full = {r["index"]: r for r in boosting.search(rows, names, CONFIG, settings).collect()}
    half = {r["index"]: r for r in boosting.search(rows, names, CONFIG, [s | {"num_boost_round": s["num_boost_round"] / 2} for s in settings]).collect()}
    best = sorted(half, key=lambda i: (-half[i].val_ic, i))[:2]
    for i in range(4):
        assert out[i].status == ("ok" if i in best else "stopped")
        assert out[i].val_ic == pytest.approx((full if i in best else half)[i].val_ic)
        assert out[i].param_num_boost_round == settings[i]["num_boost_round"]


def test_one_exchange_by_target(spark, panel):
    """Joining aside, weights and fits use the partitioning by target that the rows have."""
    features, truth = panel
    rows = boosting.training_rows(features.repartition(4, "target"), truth.repartition(4, "target"), ["f0"], CONFIG)
    plan = boosting.fit_targets(rows, ["f0"], CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(target") + plan.count("Exchange hashpartitioning(date_id") <= 4


def test_a_lag_outside_the_range_raises(spark):
    df = spark.createDataFrame([("a", d, float(d), 9) for d in range(3)], "target string, date_id int, label double, lag int")
    with pytest.raises(Exception, match="no such lag"):
        labels.shifted(df, F.col("lag")).collect()
