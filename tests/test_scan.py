import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import clean, scan, technical


def expected(x):
    """Row by row from the first value on, filled forward, then backward."""
    seen = ~np.isnan(x)
    start = int(np.argmax(seen)) if seen.any() else len(x)
    out = {}
    with np.errstate(all="ignore"):
        for k, v in technical.recursive(x[start:]).items():
            out[k] = pd.Series(np.concatenate([np.full(start, np.nan), v])).ffill().bfill().to_numpy()
    return out


def walk(n, seed=0):
    return np.cumsum(np.random.default_rng(seed).normal(size=n)) + 3


def gap(x, at):
    x = x.copy()
    x[at] = np.nan
    return x


CASES = {
    "long": walk(700),
    "short": walk(40, 1),
    "two": walk(2, 2),
    "flat": np.full(150, 2.0),
    "late": gap(walk(300, 3), slice(0, 130)),
    "gap": gap(walk(300, 4), slice(155, 160)),
    "early gap": gap(walk(300, 5), 30),
    "none": np.full(120, np.nan),
    "zeros": np.zeros(90),
    "sparse": walk(90, 6),
}


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_recursions_by_block_equal_those_row_by_row(spark, block):
    rows = []
    for name, x in CASES.items():
        step = 41 if name == "sparse" else 1  # blocks of few rows, and blocks without any
        rows += [(name, i * step - 50, None if np.isnan(v) else float(v), "extra") for i, v in enumerate(x)]
    np.random.default_rng(0).shuffle(rows)
    df = spark.createDataFrame([(t, int(d), None if v is None else float(v), e) for t, d, v, e in rows], "target string, date_id int, x double, block string")
    got = scan.recursive_features(df, block).toPandas()
    assert list(got.columns) == ["target", "date_id", "x", *scan.NAMES]
    assert len(got) == len(rows)
    for name, x in CASES.items():
        own, want = got[got.target == name].sort_values("date_id"), expected(x)
        for k in technical.RECURSIVE:
            assert np.allclose(own[k].to_numpy(float), want[k], rtol=1e-9, atol=1e-9, equal_nan=True), (name, k)


def test_no_rows(spark):
    assert scan.recursive_features(spark.createDataFrame([], "target string, date_id int, x double")).count() == 0


def test_missing_keys_are_a_series_of_their_own(spark):
    rows = [(None, i, float(v)) for i, v in enumerate(walk(80))]
    got = scan.recursive_features(spark.createDataFrame(rows, "target string, date_id int, x double"), 16).toPandas().sort_values("date_id")
    assert np.allclose(got["ema_20"].to_numpy(float), expected(walk(80))["ema_20"])


def test_no_task_holds_a_series(spark):
    """A series of 400,000 rows: 50 blocks over all tasks, equal to the row-by-row definition."""
    n, block = 400_000, 8_000
    x = np.cumsum(np.random.default_rng(9).normal(size=n))
    values = spark.createDataFrame(pd.DataFrame({"target": "a", "date_id": np.arange(n, dtype="int32"), "x": x}))
    got = scan.recursive_features(values, block)
    counts = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in counts) < n
    got, want = got.toPandas().sort_values("date_id"), expected(x)
    for k in ("ema_60", "rsi_28", "macd_hist", "tema_10", "dema_20", "kama_10"):
        assert np.allclose(got[k].to_numpy(), want[k], rtol=1e-8, atol=1e-7), k


def series_with_gaps(n, seed, share):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=n)) + 50
    x[rng.random(n) < share] = np.nan
    return x


FILLS = {
    "few": series_with_gaps(300, 1, 0.2),
    "most": series_with_gaps(300, 2, 0.9),
    "late": gap(series_with_gaps(200, 3, 0.3), slice(0, 90)),
    "ends": gap(series_with_gaps(200, 4, 0.3), slice(100, 200)),
    "one": np.where(np.arange(60) == 25, 7.0, np.nan),
    "none": np.full(50, np.nan),
}


@pytest.mark.parametrize(("block", "window"), [(6, 5), (50, 5), (1000, 5), (9, 1)])
def test_trend_fill_by_block_equals_that_row_by_row(spark, block, window):
    rows = [(a, i - 20, None if np.isnan(v) else float(v)) for a, x in FILLS.items() for i, v in enumerate(x)]
    np.random.default_rng(0).shuffle(rows)
    df = spark.createDataFrame([(a, int(d), None if v is None else float(v)) for a, d, v in rows], "asset string, date_id int, price double")
    got = clean.trend_fill(df, window, block=block).toPandas()
    assert len(got) == len(rows)
    for a, x in FILLS.items():
        assert np.allclose(got[got.asset == a].sort_values("date_id")["price"].to_numpy(float), clean.trend_filled(x, window), rtol=1e-10), a


def test_trend_fill_by_block_goes_by_arrival_first(spark):
    x, y = FILLS["few"], FILLS["most"]
    rows = [("a", i, None if np.isnan(v) else float(v), k) for k, z in enumerate((x, y)) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "asset string, date_id int, price double, k int")
    got = clean.trend_fill(df, 5, "k", 40)
    assert got.columns == ["date_id", "asset", "price", "k"]
    got = got.toPandas().sort_values(["k", "date_id"])["price"].to_numpy(float)
    assert np.allclose(got, clean.trend_filled(np.concatenate([x, y])), rtol=1e-10)
