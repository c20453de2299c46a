import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadloom.functions.windows import last_rows
from spreadloom.plans import queries
from spreadloom.streaming import daily, source, state


class Mean(daily.Server):
    def features(self, history):
        return history.select(F.col("asset").alias("target"), "date_id", F.avg("price").over(last_rows(3, "asset")).alias("m"))

    def predict(self, rows):
        return rows.select("target", "date_id", F.col("m").alias("pred"))


@pytest.fixture
def prices(spark):
    return spark.createDataFrame([(d, a, float(d * 10 + k)) for d in range(5) for k, a in enumerate("xy")], "date_id int, asset string, price double")


def test_stream_equals_batch(spark, prices, tmp_path):
    days = daily.write_days(prices, f"{tmp_path}/days")
    assert days == [0, 1, 2, 3, 4]
    seen = []
    out = daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Mean(), tail=3, on_batch=seen.append)
    assert seen == days
    batch = Mean().predict(Mean().features(prices))
    assert sorted(out.collect()) == sorted(batch.collect())
    assert spark.read.json(f"{tmp_path}/result").first()["Succeeded"]


def test_a_failure_is_reported(spark, prices, tmp_path):
    class Bad(Mean):
        def predict(self, rows):
            return super().predict(rows).withColumn("pred", F.lit(None).cast("double"))

    daily.write_days(prices.where("date_id = 0"), f"{tmp_path}/days")
    with pytest.raises(Exception, match="nulls"):
        daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Bad())
    assert not spark.read.json(f"{tmp_path}/result").first()["Succeeded"]


@pytest.mark.parametrize(("kind", "server"), [("INVALID_SUBMISSION", "nulls"), ("SERVER_RAISED_EXCEPTION", "raises"), ("GATEWAY_RAISED_EXCEPTION", "two dates"), ("GRPC_DEADLINE_EXCEEDED", "slow")])
def test_the_kind_of_a_failure_is_kept(spark, prices, tmp_path, kind, server):
    class Bad(Mean):
        def predict(self, rows):
            if server == "raises":
                raise RuntimeError("no model")
            return super().predict(rows).withColumn("pred", F.lit(None).cast("double")) if server == "nulls" else super().predict(rows)

    if server == "two dates":
        prices.coalesce(1).write.parquet(f"{tmp_path}/days")
    else:
        daily.write_days(prices.where("date_id = 0"), f"{tmp_path}/days")
    with pytest.raises((daily.ValidationError, RuntimeError)):
        daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Bad(), batch_timeout=0.001 if server == "slow" else 300)
    assert spark.read.json(f"{tmp_path}/result").first()["ErrorType"] == kind


def test_a_batch_that_runs_again_changes_nothing(spark, prices, tmp_path):
    import shutil

    daily.write_days(prices, f"{tmp_path}/days")
    first = sorted(daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Mean()).collect())
    # the commit of the last batch is lost, as when the driver dies before it is written
    for name in ("4", ".4.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    seen = []
    again = daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Mean(), on_batch=seen.append)
    assert seen == [4]
    assert sorted(again.collect()) == first
    # the order of dates is known after a restart, too
    daily.write_days(prices.where("date_id = 0"), f"{tmp_path}/days")
    with pytest.raises(daily.ValidationError, match="after 4"):
        daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Mean())
    shutil.rmtree(tmp_path / "days")


def test_primed_history_is_looked_back_on(spark, prices, tmp_path):
    daily.write_days(prices.where("date_id >= 3"), f"{tmp_path}/days")
    got = sorted(daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Mean(), primed=prices.where("date_id < 3")).collect())
    whole = Mean().predict(Mean().features(prices)).where("date_id >= 3")
    assert got == sorted(whole.select("target", "date_id", "pred").collect())


def test_the_tail_reads_its_dates_only(spark, prices, tmp_path):
    h = daily.History(spark, f"{tmp_path}/h")
    h.append(prices, 0)
    plan = h.tail(4, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert "date_id" in plan.split("PartitionFilters")[1].split("]")[0]


def test_last_arrival_of_a_date_counts(spark, prices, tmp_path):
    h = daily.History(spark, f"{tmp_path}/h")
    h.append(prices, 0)
    h.append(prices.where("date_id = 4").withColumn("price", F.lit(0.0)), 1)
    assert {r.price for r in daily.latest(h.combined()).collect()} == {0.0}
    assert h.tail(4, 2).select("date_id").distinct().count() == 2


def test_targets_of_a_batch(spark, prices, tmp_path):
    row = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "target string, date_id int, pred double")
    daily.check_targets(row, ["b", "a"])
    for bad in (["a"], ["a", "b", "c"], ["a", "x"]):
        with pytest.raises(daily.ValidationError):
            daily.check_targets(row, bad)
    with pytest.raises(daily.ValidationError, match="2 dates"):
        daily.check_targets(row.withColumn("date_id", F.when(F.col("target") == "a", 1).otherwise(2)), ["a", "b"])
    daily.write_days(prices, f"{tmp_path}/days")
    with pytest.raises(daily.ValidationError, match="2 rows for 3"):
        daily.serve(spark, f"{tmp_path}/days", f"{tmp_path}/w", Mean(), targets=["x", "y", "z"])
    assert spark.read.json(f"{tmp_path}/w/result").first()["ErrorType"] == "INVALID_SUBMISSION"


def test_a_run_without_days_has_a_placeholder(spark, prices, tmp_path):
    prices.limit(0).write.parquet(f"{tmp_path}/days")
    out = daily.serve(spark, f"{tmp_path}/days", f"{tmp_path}/w", Mean(), targets=["x", "y"])
    assert sorted(tuple(r) for r in out.collect()) == [("x", 0, 0.0), ("y", 0, 0.0)]


def test_named_functions_serve(spark, prices):
    def features(history):
        return history.withColumnRenamed("asset", "target")

    def predict(rows):
        return rows.select("target", "date_id", F.lit(1).alias("pred"))

    s = daily.FunctionServer(predict, features)
    assert {r.pred for r in s.predict(s.features(prices)).collect()} == {1}
    with pytest.raises(ValueError, match="name"):
        daily.FunctionServer(lambda x: x, features)
    with pytest.raises(ValueError, match="predict"):
        daily.FunctionServer(features)


def test_constant_server(spark, prices):
    s = daily.ConstantServer()
    got = s.predict(daily.latest(s.features(prices))).orderBy("target").collect()
    assert [r.pred for r in got] == [0.0, 0.001]


def test_all_days_of_events_are_streamed(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, 12)
    rows = [(start + datetime.timedelta(days=d), a, float(d * d + 10 * k)) for d in range(14) for k, a in enumerate("xy") if (d + k) % 5]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    expected = {}
    for a in "xy":
        own = [(t, v) for t, b, v in rows if b == a]
        for i, (t, _) in enumerate(own):
            last = [v for _, v in own[max(0, i - 4) : i + 1]]
            expected[a, (t.date() - datetime.date(1970, 1, 1)).days] = round(sum(last) / len(last), 6)
    got = {(r.target, r.date_id): r.pred for r in queries.queries()["stream_latest"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(expected)


# ---------------------------------------------------------------- days as a source


@pytest.fixture
def lagged(spark):
    return spark.createDataFrame([(k, d, d - k - 1, a, float(100 * k + d)) for d in range(2, 5) for k in (1, 2, 3, 4) for a in "xy" if d > k], "lag int, date_id int, label_date_id int, target string, label double")


def test_days_as_a_table(spark, prices, lagged, tmp_path):
    source.write_panel(prices, lagged, f"{tmp_path}/days")
    got = source.read_days(spark, f"{tmp_path}/days", 2)
    assert got.rdd.getNumPartitions() == 6
    p = got.where("part = 'prices'").select("date_id", "name", "value").collect()
    assert sorted(map(tuple, p)) == sorted(map(tuple, prices.select("date_id", "asset", "price").collect()))
    own = got.where("part = 'labels'").select("lag", "date_id", "label_date_id", "name", "value").collect()
    assert sorted(map(tuple, own)) == sorted(map(tuple, lagged.collect()))
    assert source.listed_dates(f"file://{tmp_path}/days") == [0, 1, 2, 3, 4]
    assert source.listed_dates(f"{tmp_path}/none") == []


class Learns(Mean):
    def __init__(self):
        self.seen = []

    def learn(self, labels):
        self.seen.append(sorted((r.lag, r.date_id, r.target) for r in labels.collect()))


def test_a_date_brings_its_labels(spark, prices, lagged, tmp_path):
    """Files are written out of order and at once; dates come in order, each with the labels of its own."""
    source.write_panel(prices, lagged, f"{tmp_path}/days")
    server, seen = Learns(), []
    out = daily.serve(spark, f"{tmp_path}/days", str(tmp_path), server, tail=3, on_batch=seen.append, panel=True)
    assert seen == [0, 1, 2, 3, 4]
    assert server.seen == [sorted((r.lag, r.date_id, r.target) for r in lagged.where(F.col("date_id") == d).collect()) for d in range(5)]
    batch = Mean().predict(Mean().features(prices))
    assert sorted(out.collect()) == sorted(batch.collect())
    # more days later: the stream goes on after the last one
    more = prices.unionByName(prices.withColumn("date_id", F.col("date_id") + 5))
    source.write_panel(more, lagged, f"{tmp_path}/days")
    seen.clear()
    out = daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Learns(), tail=3, on_batch=seen.append, panel=True)
    assert seen == [5, 6, 7, 8, 9]
    assert sorted(out.collect()) == sorted(Mean().predict(Mean().features(more)).collect())


def test_a_day_that_runs_again_changes_nothing(spark, prices, lagged, tmp_path):
    source.write_panel(prices, lagged, f"{tmp_path}/days")
    first = sorted(daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Mean(), panel=True).collect())
    for name in ("4", ".4.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    seen = []
    again = daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Mean(), on_batch=seen.append, panel=True)
    assert seen == [4]
    assert sorted(again.collect()) == first


# ---------------------------------------------------------------- deadlines and kinds


def test_a_late_batch_is_cut_and_leaves_nothing(spark, prices, tmp_path):
    import time

    class Slow(Mean):
        def predict(self, rows):
            wait = F.udf(lambda x: time.sleep(60) or x, "double")
            return super().predict(rows).withColumn("pred", wait("pred"))

    source.write_panel(prices, None, f"{tmp_path}/days")
    began = time.monotonic()
    with pytest.raises(daily.ValidationError, match="more than 4"):
        daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Slow(), batch_timeout=4, panel=True)
    assert time.monotonic() - began < 40
    assert spark.read.json(f"{tmp_path}/result").first()["ErrorType"] == "GRPC_DEADLINE_EXCEEDED"
    assert not (tmp_path / "predictions").exists()
    # its jobs are gone
    tracker = spark.sparkContext.statusTracker()
    for _ in range(50):
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds()


def test_work_within_a_limit(spark):
    assert daily.within(spark, 20, lambda: spark.range(5).count(), "UNSPECIFIED", "late") == 5
    with pytest.raises(KeyError):
        daily.within(spark, 20, lambda: {}["x"], "UNSPECIFIED", "late")


@pytest.mark.parametrize(("kind", "make"), [("SERVER_NEVER_STARTED", "raises"), ("SERVER_NEVER_STARTED", "late"), ("SERVER_MISSING_ENDPOINT", "no predict"), ("SERVER_CONNECTION_FAILED", "lost"), ("INVALID_SUBMISSION", "type"), ("INVALID_SUBMISSION", "nothing"), ("INVALID_SUBMISSION", "dates")])
def test_every_failure_has_its_kind(spark, prices, tmp_path, kind, make):
    import time

    class Bad(Mean):
        def predict(self, rows):
            if make == "lost":
                raise ConnectionResetError("gone")
            out = super().predict(rows)
            return {"nothing": None, "dates": out.withColumn("pred", F.current_date()), "type": 0.5}[make]

    def features(history):
        return history

    started = {"raises": lambda: 1 / 0, "late": lambda: time.sleep(30), "no predict": lambda: daily.FunctionServer(features)}
    source.write_panel(prices.where("date_id = 0"), None, f"{tmp_path}/days")
    with pytest.raises((daily.ValidationError, ConnectionError)):
        daily.serve(spark, f"{tmp_path}/days", str(tmp_path), started.get(make) or Bad(), panel=True, startup_timeout=1)
    assert spark.read.json(f"{tmp_path}/result").first()["ErrorType"] == kind
    assert kind in daily.KINDS


def test_a_whole_number_or_text_is_a_prediction(spark, prices, tmp_path):
    class Text(Mean):
        def predict(self, rows):
            return super().predict(rows).withColumn("pred", F.lit("1.5") if rows.first().date_id else F.lit(2))

    source.write_panel(prices.where("date_id < 2"), None, f"{tmp_path}/days")
    out = daily.serve(spark, f"{tmp_path}/days", str(tmp_path), Text(), panel=True)
    assert {(r.date_id, r.pred) for r in out.collect()} == {(0, 2.0), (1, 1.5)}


def test_a_history_reads_its_tail_only(spark, prices, tmp_path):
    h = daily.History(spark, f"{tmp_path}/h")
    for d in range(5):
        h.append(prices.where(F.col("date_id") == d), d, [d])
    files = {f.rsplit("arrival=", 1)[1].split("/")[0] for f in h.tail(4, 2).inputFiles()}
    assert files == {"3", "4"}
    assert daily.History(spark, f"{tmp_path}/h").arrivals == h.arrivals
    assert h.last_before(3) == 2


# ---------------------------------------------------------------- keyed state


def mean_3():
    """A function of its own, so that it is sent to the workers as it is."""
    return lambda rows: pd.DataFrame({"m": rows["price"].rolling(3, min_periods=1).mean(), "n": rows["price"].notna().cumsum().astype(float)})


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    rows = [(d, a, None if (d + k) % 4 == 0 else float(d * d + k)) for d in range(12) for k, a in enumerate("xyz") if not (a == "z" and d < 5)]
    table = spark.createDataFrame(rows, "date_id int, asset string, price double")

    def run(step):
        days = source.stream_days(spark, f"{tmp_path}/days", f"{tmp_path}/cp", step).where("part = 'prices'")
        own = days.select("date_id", F.col("name").alias("asset"), F.col("value").alias("price"))
        state.run_to_end(spark, state.keyed_features(own, 3, mean_3(), ["m", "n"]), f"{tmp_path}/out", f"{tmp_path}/cp")

    for last, step in ((5, 2), (12, 4)):
        source.write_panel(table.where(F.col("date_id") < last), None, f"{tmp_path}/days")
        run(step)
    got = {(r.asset, r.date_id): r.m for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    frame = pd.DataFrame(rows, columns=["date_id", "asset", "price"]).sort_values("date_id")
    frame["price"] = frame.groupby("asset")["price"].ffill()
    frame["m"] = frame.groupby("asset")["price"].transform(lambda x: x.rolling(3, min_periods=1).mean())
    expected = {(r.asset, r.date_id): r.m for r in frame.itertuples()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) or (pd.isna(v) and pd.isna(got[k])) for k, v in expected.items())


def test_a_date_that_arrives_again(spark, tmp_path):
    class Kept:
        rows: list = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    tail = state.Tail(3, mean_3(), ["m", "n"])
    tail.kept = Kept()
    give = lambda *rows: [tuple(r) for x in tail.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["date_id", "price"])]), None) for r in x.itertuples(index=False)]
    assert [r[2] for r in give((1, 1.0), (2, 2.0), (2, 5.0), (3, 3.0))] == [1.0, 3.0, 3.0]
    assert tail.kept.rows == [(1, 1.0), (2, 5.0), (3, 3.0)]
    assert [r[1:3] for r in give((2, 8.0))] == [(2, 4.5)]
    assert [r[1:3] for r in give((5, None))] == [(5, 14 / 3)]
    assert tail.kept.rows == [(2, 8.0), (3, 3.0), (5, 3.0)]
