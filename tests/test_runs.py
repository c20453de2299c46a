"""Whole runs over small CSV tables: clean, store, train, search, serve."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.__main__ import main
from spreadloom.operators import boosting, clean, labels, panel, screen, stats, symbolic, targets
from spreadloom.plans import runs
from spreadloom.sources import sinks, tables
from spreadloom.streaming import online

ASSETS, TRAIN, TEST = "ABC", 110, 2
PAIRS = [("t0", 1, "A"), ("t1", 1, "A - B"), ("t2", 2, "B - C"), ("t3", 1, "A - C"), ("t4", 1, "A - B - C")]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """Prices with gaps; the test table repeats the last train date with other prices."""
    folder, rng = tmp_path_factory.mktemp("data"), np.random.default_rng(5)
    walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (TRAIN + TEST, 3)), axis=0))

    def line(d, row, scored):
        return ",".join([str(d), *("" if rng.random() < 0.05 and 5 < d < TRAIN else f"{v:.4f}" for v in row), *scored])

    (folder / "train.csv").write_text("\n".join(["date_id,A,B,C", *(line(d, walk[d], []) for d in range(TRAIN))]) + "\n")
    (folder / "test.csv").write_text("\n".join(["date_id,A,B,C,is_scored", *(line(d, walk[d] * (1.01 if d < TRAIN else 1), ["True"]) for d in range(TRAIN - 1, TRAIN + TEST))]) + "\n")
    names = [p[0] for p in PAIRS]
    (folder / "train_labels.csv").write_text("\n".join(["date_id," + ",".join(names), *(",".join([str(d), *(f"{v:.6f}" for v in rng.normal(0, 0.02, len(names)))]) for d in range(TRAIN))]) + "\n")
    (folder / "target_pairs.csv").write_text("\n".join(["target,lag,pair", *(f"{t},{k},{p}" for t, k, p in PAIRS)]) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def specs(spark, data):
    return targets.parse_pairs(tables.load_pairs(spark, f"{data}/target_pairs.csv"))


@pytest.fixture(scope="module")
def store(spark, data, specs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    own = tables.load_labels(spark, f"{data}/train_labels.csv")
    folder = runs.build_store(runs.raw_prices(spark, data), specs, own, out, 90, population=20, generations=2)
    return out, folder


def test_cleaned_splits(spark, data, tmp_path):
    main(["clean", "--data", data, "--out", str(tmp_path)], spark)
    got = {r["split"]: r.n for r in spark.read.parquet(f"{tmp_path}/cleaned").where("price IS NOT NULL").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 3 * TRAIN, "test": 3 * (TEST + 1), "all": 3 * (TRAIN + TEST + 1)}


def test_last_arrival_of_a_date_makes_the_targets(spark, data, specs):
    raw = runs.raw_prices(spark, data)
    px, lp = targets.price_targets(raw, specs)
    ours = {(r.target, r.date_id): r.px for r in px.collect()}
    assert len(ours) == len(PAIRS) * (TRAIN + TEST)
    wide = {a: [(r.arrival, r.date_id, r.price) for r in raw.where(F.col("asset") == a).orderBy("arrival", "date_id").collect()] for a in ASSETS}
    price = {}
    for a, rows in wide.items():
        filled = clean.trend_filled(np.array([np.nan if p is None else p for _, _, p in rows]))
        price |= {(a, d): v for (_, d, _), v in zip(rows, filled, strict=True)}  # later arrivals overwrite
    for t, _, pair in PAIRS:
        a, *rest = pair.split(" - ")
        for d in (0, TRAIN - 1, TRAIN + 1):
            assert ours[t, d] == pytest.approx(np.log(price[a, d]) - sum(np.log(price[b, d]) for b in rest))
    assert lp.count() == 3 * (TRAIN + TEST)
    with pytest.raises(KeyError, match="B"):
        targets.price_targets(raw.where("asset <> 'B'"), specs)


def test_store_has_all_blocks_and_its_artifacts_come_back(spark, store, specs):
    _, folder = store
    everything = tables.load_features(spark, f"{folder}/all")
    names = panel.columns_of(everything)
    assert len(names) == len(set(names)) == 95
    assert everything.count() == len(PAIRS) * (TRAIN + TEST)
    assert {(r.is_train, r.n) for r in everything.groupBy("is_train").agg(F.countDistinct("date_id").alias("n")).collect()} == {(True, TRAIN), (False, TEST)}
    loadings, programs = tables.load_artifacts(spark, f"{folder}/artifacts")
    assert loadings.count() == 25
    assert len(programs) == 15
    row = symbolic.with_programs(everything.drop(*[f"gp_{i}" for i in range(15)]), programs).where("date_id = 50").orderBy("target").first()
    kept = everything.where("date_id = 50").orderBy("target").first()
    assert [row[f"gp_{i}"] for i in range(15)] == pytest.approx([kept[f"gp_{i}"] for i in range(15)])
    assert panel.store_name(None) == panel.store_name("V1") == "features"
    assert panel.store_name("mine") == "mine"


def test_served_features_are_those_of_the_store(spark, data, store, specs):
    _, folder = store
    context = online.load_context(spark, specs, folder)
    raw = runs.raw_prices(spark, data)
    history = clean.last_arrival(clean.trend_fill(raw, arrival="arrival"), ["date_id", "asset"], "arrival").select("date_id", "asset", "price")
    ours = {r.target: r for r in context.latest(history).collect()}
    theirs = {r.target: r for r in tables.load_features(spark, f"{folder}/all").where(F.col("date_id") == TRAIN + TEST - 1).collect()}
    assert set(ours) == set(theirs) == {p[0] for p in PAIRS}
    for t, row in theirs.items():
        for c in panel.columns_of(tables.load_features(spark, f"{folder}/all")):
            assert ours[t][c] == pytest.approx(row[c], rel=1e-6, abs=1e-8), (t, c)


def test_trained_lags_are_served(spark, data, store, specs, tmp_path):
    out, folder = store
    params = tmp_path / "params.json"
    params.write_text(json.dumps({"lag1": {"num_boost_round": 3, "min_data_in_leaf": 5}, "2": {"num_boost_round": 2, "min_data_in_leaf": 5}}))
    main(["train", "--data", data, "--out", out, "--params", str(params), "--train-end", "90", "--run", "first"], spark)
    run = tables.newest_run(spark, f"{out}/runs")
    assert run.endswith("first")
    fitted = tables.load_models(spark, run, boosting.MODEL)
    assert {(r.target, r.lag, r.best_iteration) for r in fitted.collect()} == {("t0", 1, 3), ("t1", 1, 3), ("t2", 2, 2), ("t3", 1, 3), ("t4", 1, 3)}
    summary = {r.lag: r for r in spark.read.json(f"{run}/summary").collect()}
    assert set(summary) == {1, 2}
    assert summary[1].n_train_dates == 91
    ic = spark.read.option("header", True).csv(f"{run}/lag_1/daily_ic")
    assert {r.side for r in ic.collect()} == {"train", "val"}
    assert json.loads(spark.read.text(f"{run}/lag_2/config").first()[0])["early_stopping_rounds"] == 0
    main(["serve", "--data", data, "--out", out], spark)
    served = spark.read.parquet(f"{out}/served/predictions")
    assert {(r.date_id, r.n) for r in served.groupBy("date_id").agg(F.count("pred").alias("n")).collect()} == {(d, len(PAIRS)) for d in range(TRAIN - 1, TRAIN + TEST)}


def test_lags_by_trees_that_spark_grows(spark, data, store, specs, tmp_path):
    """The same tables as from the other learner."""
    out, folder = store
    params = tmp_path / "params.json"
    params.write_text(json.dumps({"lag2": {"num_boost_round": 2, "num_leaves": 3, "min_data_in_leaf": 5}}))
    own = tables.load_features(spark, f"{folder}/factors")
    configs = runs.lag_configs(params.read_text(), None, 90)
    report = runs.train_lags(own, tables.load_labels(spark, f"{data}/train_labels.csv"), specs, configs, f"{tmp_path}/run", "spark").collect()
    assert [r.lag for r in report] == [2]
    fitted = tables.load_models(spark, f"{tmp_path}/run", boosting.MODEL).collect()
    assert [(r.target, r.lag, r.best_iteration) for r in fitted] == [("t2", 2, 2)]
    assert spark.read.parquet(f"{tmp_path}/run/lag_2/predictions").where("pred IS NULL").count() == 0
    with pytest.raises(KeyError):
        runs.train_lags(own, own, specs, configs, f"{tmp_path}/x", "other")


def test_a_stored_panel_is_read_until_a_date_is_missing(spark, data, store, specs):
    _, folder = store
    stored = tables.first_panel(spark, [f"{folder}/absent", f"{folder}/all"], TRAIN - 2)
    server = online.ModelServer(online.load_context(spark, specs, folder), spark.createDataFrame([], boosting.MODEL), stored)
    history = spark.createDataFrame([(TRAIN, "A", 1.0)], "date_id int, asset string, price double")
    assert {r.date_id for r in server.features(history).collect()} == {TRAIN}
    server.context = type("Context", (), {"features": staticmethod(lambda h: "computed")})
    assert server.features(history.withColumn("date_id", F.lit(999))) == "computed"
    assert server.features(history) == "computed"
    with pytest.raises(FileNotFoundError):
        tables.first_panel(spark, [f"{folder}/absent"], 0)


def test_grid_and_eda_write_tables(spark, data, store, specs, tmp_path):
    out, folder = store
    own = tables.load_features(spark, f"{folder}/factors")
    found = runs.search_grid(own, tables.load_labels(spark, f"{data}/train_labels.csv"), specs, boosting.BoostConfig(train_end=90), 2, 1, f"{tmp_path}/grid")
    rows = found.collect()
    assert len(rows) == 2
    assert {r.status for r in rows} == {"ok"}
    assert all(r.param_num_boost_round in (160, 200, 240, 280) for r in rows)
    main(["eda", "--data", data, "--out", out], spark)
    assert spark.read.option("header", True).csv(f"{out}/eda").count() == 95


def test_settings_by_lag():
    got = runs.lag_configs('{"lag2": {"num_leaves": 9}, "1": {}}', weight_cap=-1.0, weight_scheme="recency_exp")
    assert sorted(got) == [1, 2]
    assert (got[1].num_leaves, got[2].num_leaves, got[2].weight_cap, got[2].early_stopping_rounds) == (31, 9, None, 0)
    assert runs.lag_configs('{"1": {}}', weight_cap=10.0)[1].weight_cap == 10.0
    assert runs.parse_lags(["3", "1", "3"], [9]) == [1, 3]
    with pytest.raises(ValueError, match="lag"):
        runs.parse_lags(["x"], [1])
    with pytest.raises(KeyError, match="7"):
        runs.lag_configs('{"1": {}}', ["7"])


def test_regression_on_several_columns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(0, 0.1, 60)
    got = stats.regression_residuals(y, x, 30)
    assert not got[:29].any()
    for t in (29, 45, 59):
        a, b = x[t - 29 : t + 1], y[t - 29 : t + 1]
        slope = np.linalg.lstsq(a, b, rcond=None)[0]
        assert got[t] == pytest.approx(y[t] - x[t] @ slope - (b.mean() - a.mean(axis=0) @ slope))
    flat = np.column_stack([np.ones(40), np.ones(40)])  # singular: the constant takes it all
    assert stats.regression_residuals(np.arange(40.0), flat, 30)[-1] == pytest.approx(14.5)
    assert not stats.regression_residuals(np.arange(5.0), flat[:5], 30).any()


def test_label_batches(spark):
    days = spark.createDataFrame([("t", d, float(d) if d != 1 else None) for d in range(6)] + [("u", d, 1.0) for d in range(6)], "target string, date_id int, label double")
    specs = spark.createDataFrame([("t", 1), ("u", 3)], "target string, lag int")
    prices = spark.createDataFrame([(d, "a", 1.0) for d in range(7)], "date_id int, asset string, price double")
    got = {r.date_id: r for r in labels.day_batches(prices, labels.lagged_labels(days, specs)).collect()}
    assert sorted(got) == list(range(7))
    assert [(x.target, x.label, x.label_date_id) for x in got[5].labels_lag_1] == [("t", 3.0, 3)]
    assert [(x.target, x.label_date_id) for x in got[5].labels_lag_3] == [("u", 1)]
    assert got[3].labels_lag_1[0].label is None
    assert got[6].labels_lag_1 == got[5].labels_lag_2 == got[0].labels_lag_1 == []


def test_lagged_label_files(spark, tmp_path):
    for k in range(1, 5):
        (tmp_path / f"test_labels_lag_{k}.csv").write_text(f"date_id,label_date_id,t{k}\n9,{9 - k},0.{k}\n")
    rows = tables.load_lagged_labels(spark, str(tmp_path))
    assert {(r.lag, r.date_id, r.label_date_id, r.target, r.label) for r in rows.collect()} == {(k, 9, 9 - k, f"t{k}", k / 10) for k in range(1, 5)}
    prices = spark.createDataFrame([(9, "a", 1.0)], "date_id int, asset string, price double")
    assert [len(labels.day_batches(prices, rows).first()[f"labels_lag_{k}"]) for k in range(1, 5)] == [1, 1, 1, 1]


def test_sequence_data(spark):
    rows = spark.createDataFrame([(t, d, float(d), 1.0) for t in "xy" for d in range(5)], "target string, date_id int, f double, flat double")
    own = spark.createDataFrame([(t, d, None if (t, d) == ("y", 2) else float(d)) for t in "xy" for d in range(5)], "target string, date_id int, label double")
    got, kept = labels.sequence_data(rows, own, ["f", "flat"], 1)
    assert kept == ["f"]
    assert {(r.target, r.date_id): (list(r.vec), r.label, r.mask) for r in got.collect()} == {
        **{("x", d): ([float(d)], d + 2.0, True) for d in range(3)}, ("y", 0): ([0.0], 0.0, False), ("y", 1): ([1.0], 3.0, True), ("y", 2): ([2.0], 4.0, True),
    }
    with pytest.raises(ValueError, match="variance"):
        labels.sequence_data(rows, own, ["flat"], 1)
    with pytest.raises(ValueError, match="variance"):
        screen.kept_features(screen.to_long(rows, ["flat"]), 9)


def test_parts_of_unlike_types_are_united(spark):
    a = spark.createDataFrame([(1, 2)], "date_id int, pred int")
    b = spark.createDataFrame([(2, 0.5, "x")], "date_id long, pred double, note string")
    got = tables.union_widened([a, b])
    assert dict(got.dtypes) == {"date_id": "bigint", "pred": "double", "note": "string"}
    assert sorted(map(tuple, got.collect())) == [(1, 2.0, None), (2, 0.5, "x")]


def test_every_change_of_a_program_is_made():
    import random

    rng, base = random.Random(1), ("add", ("mul", "a", "b"), ("sin", "c"))
    seen = {symbolic.changed(rng, base, ["a", "b", "c"], lambda: ("abs", "a")) for _ in range(3000)}
    assert base in seen
    assert any(symbolic.length(p) == symbolic.length(base) - 1 for p in seen)  # hoisted or crossed
    assert all(set(x for _, x in symbolic.parts(p) if isinstance(x, str)) <= {"a", "b", "c"} for p in seen)
    flipped = symbolic.pointwise(random.Random(3), base, ["a", "b", "c"], 1.0)
    assert [len(x) if isinstance(x, tuple) else 0 for _, x in symbolic.parts(flipped)] == [3, 3, 0, 0, 2, 0]


def test_sinks_of_a_run(spark, tmp_path):
    sinks.save_config(spark, f"{tmp_path}/c", {"b": 1, "a": None})
    assert spark.read.text(f"{tmp_path}/c").first()[0] == '{"a": null, "b": 1}'
    with pytest.raises(FileNotFoundError):
        tables.newest_run(spark, f"{tmp_path}/absent")
