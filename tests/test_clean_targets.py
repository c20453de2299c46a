import numpy as np
import pytest

from spreadloom.operators import clean, targets
from spreadloom.sources import tables

N = None


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([N, 10, 12, N, N, 20], [10, 10, 12, 14, 16, 20]),
        ([N, 10, 12, N, N, 20, N], [10, 10, 12, 14, 16, 20, 23]),
        ([5, N, N], [5, 5, 5]),
        ([N, N], [0, 0]),
        ([], []),
    ],
)
def test_trend_fill(values, expected):
    assert clean.trend_filled(np.array([np.nan if v is N else v for v in values], float)).tolist() == expected


def test_trend_fill_by_asset(spark):
    rows = [(i, a, v) for a, vs in {"a": [N, 10.0, 12.0, N], "b": [N, N, N, 1.0]}.items() for i, v in enumerate(vs)]
    out = clean.trend_fill(spark.createDataFrame(rows, "date_id int, asset string, price double"))
    got = {(r.asset, r.date_id): r.price for r in out.collect()}
    assert [got["a", i] for i in range(4)] == [10, 10, 12, 14]
    assert [got["b", i] for i in range(4)] == [1, 1, 1, 1]
    assert clean.trend_fill(spark.createDataFrame([], "date_id int, asset string, price double")).count() == 0


def test_fill_forward_then_backward(spark):
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate([N, 1.0, N, 3.0])], "target string, date_id int, x double")
    out = clean.forward_backward_fill(df, ["x"], "target").orderBy("date_id")
    assert [r.x for r in out.collect()] == [1, 1, 1, 3]


def test_last_arrival(spark):
    df = spark.createDataFrame([(d, i) for i, d in enumerate([1, 2, 3, 2, 3, 4])], "date_id int, pos int")
    assert sorted(r.pos for r in clean.last_arrival(df, ["date_id"], "pos").collect()) == [0, 3, 4, 5]


def test_first_of_columns_with_a_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    assert clean.unique_columns(df).collect() == [(1, 2)]


@pytest.mark.parametrize(("pair", "terms"), [("A - B", [("A", 1.0), ("B", -1.0)]), ("A", [("A", 1.0)]), ("A-B", [("A-B", 1.0)]), ("A + B - C", [("A", 1.0), ("B", 1.0), ("C", -1.0)])])
def test_pairs(spark, pair, terms):
    out = targets.parse_pairs(spark.createDataFrame([("t", 1, pair)], "target string, lag int, pair string")).first()
    assert [(t.asset, t.weight) for t in out.terms] == terms


def test_targets_need_all_terms(spark):
    specs = targets.parse_pairs(spark.createDataFrame([("t", 1, "A - B"), ("u", 2, "A"), ("v", 2, "A - Z")], "target string, lag int, pair string"))
    prices = spark.createDataFrame([(0, "A", 2.0), (0, "B", 1.0), (1, "A", 4.0)], "date_id int, asset string, price double")
    got = {(r.target, r.date_id): r.px for r in targets.target_frame(prices, specs).collect()}
    assert got == {("t", 0): pytest.approx(np.log(2)), ("u", 0): pytest.approx(np.log(2)), ("u", 1): pytest.approx(np.log(4))}
    assert [r.asset for r in targets.missing_assets(specs, prices).collect()] == ["Z"]


def test_nav(spark):
    specs = targets.parse_pairs(spark.createDataFrame([("s", 1, "A"), ("m", 1, "A - B")], "target string, lag int, pair string"))
    rows = spark.createDataFrame([(t, i, 0.1 * i) for t in ("s", "m") for i in range(3)], "target string, date_id int, px double")
    got = {(r.target, r.date_id): r.nav for r in targets.nav(rows, specs).collect()}
    assert [round(got["s", i], 9) for i in range(3)] == [0, 0.1, 0.2]
    assert [round(got["m", i], 9) for i in range(3)] == [1, 1.1, 1.21]


def test_sources(spark, tmp_path):
    (tmp_path / "train.csv").write_text("date_id,A,B\n1,1.5,\n2,2.5,3.5\n")
    (tmp_path / "test.csv").write_text("date_id,A,B,is_scored\n3,1.0,2.0,True\n")
    both = tables.load_prices(spark, str(tmp_path), "all")
    assert both.columns == ["date_id", "A", "B"]
    assert both.count() == 3
    with pytest.raises(ValueError, match="split"):
        tables.load_prices(spark, str(tmp_path), "other")
    long = clean.to_long(both)
    assert long.where("price IS NULL").count() == 1
    (tmp_path / "labels.csv").write_text("date_id,target_0\n1,0.5\n2,\n")
    assert tables.load_labels(spark, str(tmp_path / "labels.csv")).where("label IS NOT NULL").count() == 1
    got = tables.param_snapshot(spark, '{"lag1": {"a": 0.5}, "2": {"b": 3}}').collect()
    assert sorted((r.lag, r.name, r.value) for r in got) == [(1, "a", 0.5), (2, "b", 3.0)]
    with pytest.raises(ValueError, match="panel"):
        spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "x"))
        tables.load_features(spark, str(tmp_path / "x"))
