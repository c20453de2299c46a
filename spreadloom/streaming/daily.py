"""Date-by-date serving: one micro-batch a date, a history, features of the tail, checks and a sink.

A batch's features equal those of the whole history up to its date: frame features need the rows of the longest frame
only; a leading fill needs the first valid value, which the tail has when the history is that long.
"""

from __future__ import annotations

import abc
import threading
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JNetworkError
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import last_arrival
from ..sources import sinks
from .source import stream_days

#: Rows of history that the longest frame reads, with one for the difference.
TAIL = 361


#: What a failure may be called. Fixed values.
KINDS = ("UNSPECIFIED", "SERVER_NEVER_STARTED", "SERVER_CONNECTION_FAILED", "SERVER_RAISED_EXCEPTION", "SERVER_MISSING_ENDPOINT", "GATEWAY_RAISED_EXCEPTION", "INVALID_SUBMISSION", "GRPC_DEADLINE_EXCEEDED")
#: Types that a prediction may have.
ALLOWED = (T.NumericType, T.BooleanType, T.StringType)


class ValidationError(ValueError):
    """A batch's predictions break the contract, or a run fails in a way that has a name; `kind` is one of KINDS."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def write_days(prices: DataFrame, folder: str) -> list[int]:
    """One Parquet folder a date, in order of date: what the stream reads. Returns the dates."""
    days = [r[0] for r in prices.select("date_id").distinct().orderBy("date_id").collect()]
    for day in days:
        prices.where(F.col("date_id") == day).coalesce(1).write.mode("append").parquet(folder)
    return days


def kind_of(error: BaseException) -> str:
    """What a failure is called: its own kind, a lost connection, or whatever the server raised."""
    if isinstance(error, (ConnectionError, Py4JNetworkError)):
        return "SERVER_CONNECTION_FAILED"
    return getattr(error, "kind", "SERVER_RAISED_EXCEPTION")


def within(spark: SparkSession, seconds: float, work: Callable[[], Any], kind: str, text: str) -> Any:
    """work's result, if it is there in time; else its Spark jobs are interrupted by their tag and ValidationError is raised.

    What work does outside of Spark can't be interrupted: it is left alone, and its result is dropped.
    """
    # tags of the context: a batch's tables belong to a session of their own
    context, tag, got = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", {}

    def run() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            got["value"] = work()
        except BaseException as e:
            got["error"] = e

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(max(0.0, seconds))
    if thread.is_alive():
        context.cancelJobsWithTag(tag)
        raise ValidationError(kind, text)
    if "error" in got:
        raise got["error"]
    return got["value"]


def check_type(predictions: Any) -> None:
    """A table with a column `pred` of an allowed type."""
    if predictions is None:
        raise ValidationError("INVALID_SUBMISSION", "no predictions")
    if not isinstance(predictions, DataFrame):
        raise ValidationError("INVALID_SUBMISSION", f"predictions are of type {type(predictions).__name__}")
    if lacking := {"target", "date_id", "pred"} - set(predictions.columns):
        raise ValidationError("INVALID_SUBMISSION", f"predictions without {sorted(lacking)}")
    if not isinstance(predictions.schema["pred"].dataType, ALLOWED):
        raise ValidationError("INVALID_SUBMISSION", f"predictions of type {predictions.schema['pred'].dataType.simpleString()}")


def check_rows(predictions: DataFrame, rows: int) -> None:
    """As many rows as the batch, at least one, none of them null."""
    n, nulls = predictions.agg(F.count("*"), F.count_if(F.col("pred").isNull())).first()
    if n == 0:
        raise ValidationError("INVALID_SUBMISSION", "no rows")
    if n != rows:
        raise ValidationError("INVALID_SUBMISSION", f"{n} rows for {rows}")
    if nulls:
        raise ValidationError("INVALID_SUBMISSION", f"{nulls} nulls")


def check_targets(predictions: DataFrame, targets: list[str]) -> None:
    """One prediction of each target, no other, and one date. The driver gets the names of one date."""
    names, dates = [r[0] for r in predictions.select("target").collect()], predictions.select("date_id").distinct().count()
    if sorted(names) != sorted(targets):
        raise ValidationError("INVALID_SUBMISSION", f"{len(names)} predictions for {len(targets)} targets, or of others")
    if dates != 1:
        raise ValidationError("INVALID_SUBMISSION", f"{dates} dates")


class History:
    """A Parquet table of (date_id, asset, price, arrival), a folder an arrival and date; the last arrival of a date and asset counts.

    An arrival's folder is overwritten, so a batch that runs again changes nothing. Which dates there are is listed once
    and then kept, an entry a date, so a batch reads the folders of its tail and nothing else.
    """

    SCHEMA = "asset string, price double, arrival long, date_id int"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        #: arrival -> its dates
        self.arrivals: dict[int, set[int]] = {}
        for arrival in self._listed(folder, "arrival"):
            self.arrivals[arrival] = set(self._listed(f"{folder}/arrival={arrival}", "date_id"))

    def _listed(self, folder: str, name: str) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return [int(x.split("=")[1]) for x in names if x.startswith(f"{name}=")]

    def append(self, batch: DataFrame, arrival: int, dates: list[int] | None = None) -> None:
        """dates: those of the batch, where they are known."""
        batch.select("date_id", "asset", "price").write.mode("overwrite").partitionBy("date_id").parquet(f"{self.folder}/arrival={arrival}")
        self.arrivals[arrival] = set(dates if dates is not None else self._listed(f"{self.folder}/arrival={arrival}", "date_id"))

    def rows(self, dates: set[int] | None = None) -> DataFrame:
        """All rows, or those of some dates, whose folders alone are read."""
        paths = [f"{self.folder}/arrival={a}/date_id={d}" for a, own in self.arrivals.items() for d in own if dates is None or d in dates]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.folder).parquet(*(paths if dates is not None else [self.folder]))

    def last_before(self, arrival: int) -> int | None:
        """The last date of earlier arrivals."""
        return max((d for a, own in self.arrivals.items() if a < arrival for d in own), default=None)

    def combined(self) -> DataFrame:
        return last_arrival(self.rows(), ["date_id", "asset"], "arrival").select("date_id", "asset", "price")

    def tail(self, date: int, rows: int = TAIL) -> DataFrame:
        """The last `rows` dates up to a date."""
        dates = sorted({d for own in self.arrivals.values() for d in own if d <= date})[-rows:]
        own = self.rows(set(dates)).where((F.col("date_id") >= (dates or [date])[0]) & (F.col("date_id") <= date))
        return last_arrival(own, ["date_id", "asset"], "arrival").select("date_id", "asset", "price")


def latest(features: DataFrame) -> DataFrame:
    """The rows of the last date."""
    last = features.agg(F.max("date_id").alias("date_id"))
    return features.join(F.broadcast(last), "date_id", "left_semi")


class Server(abc.ABC):
    """What answers a batch: predictions (target, pred) of a date from the features of that date."""

    @abc.abstractmethod
    def features(self, history: DataFrame) -> DataFrame: ...

    @abc.abstractmethod
    def predict(self, rows: DataFrame) -> DataFrame: ...

    def learn(self, labels: DataFrame) -> None:
        """Gets the labels (lag, date_id, label_date_id, target, label) that a date brings, before its features are asked for."""


class FunctionServer(Server):
    """A server of two named functions, `features` and `predict`. Functions without a name of their own are refused."""

    def __init__(self, *functions: Callable[[DataFrame], DataFrame]):
        own = {f.__name__: f for f in functions}
        if "<lambda>" in own:
            raise ValidationError("SERVER_MISSING_ENDPOINT", "name the functions")
        if lacking := {"features", "predict"} - set(own):
            raise ValidationError("SERVER_MISSING_ENDPOINT", f"no function {sorted(lacking)}")
        self.own = own

    def features(self, history: DataFrame) -> DataFrame:
        return self.own["features"](history)

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.own["predict"](rows)


class ConstantServer(Server):
    """i / 1000 for the i-th asset of the last date; a smoke test."""

    def features(self, history: DataFrame) -> DataFrame:
        return history.select(F.col("asset").alias("target"), "date_id", "price")

    def predict(self, rows: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        return rows.withColumn("pred", (F.row_number().over(Window.partitionBy("date_id").orderBy("target")) - 1) / F.lit(1000.0)).select("target", "date_id", "pred")


def serve(spark: SparkSession, source: str, work: str, server: Server | Callable[[], Server], tail: int | None = TAIL, timeout: int = 900, on_batch: Callable[[int], None] | None = None, primed: DataFrame | None = None, batch_timeout: float = 300, targets: list[str] | None = None, panel: bool = False, startup_timeout: float = 900) -> DataFrame:
    """Runs the stream over the days in a folder until it is dry; returns the predictions (target, date_id, pred).

    source: a folder of files (date_id, asset, price), one a trigger in order of modification; with panel, one that
    source.write_panel wrote, whose dates come in order, each with its prices and the label tables of all lags, which
    the server learns from. Each batch is recorded, recomputed from the tail, checked and written to a folder of its
    number, which a batch that runs again overwrites. server: or a function that makes it, within startup_timeout.
    primed: earlier (date_id, asset, price), such as filled train prices, that the first batches' features look back on.
    A batch may take batch_timeout seconds: beyond them its jobs are interrupted and nothing of it is written. The run
    may take timeout. tail: as many dates of the history, None for all of them. targets: those that each batch must
    predict; a run without days writes a row of zeros for them. A failure is written to work/result as its kind and
    text, then raised as what it was.
    """
    history, failed = History(spark, f"{work}/history"), []

    def answered(server: Server, batch: DataFrame, number: int, days: list[int]) -> DataFrame:
        """The checked predictions of a date, in memory."""
        history.append(batch, number, days)
        seen = history.combined().where(F.col("date_id") <= days[0]) if tail is None else history.tail(days[0], tail)
        rows = latest(server.features(seen)).persist()
        try:
            out = server.predict(rows)
            check_type(out)
            out = out.withColumn("pred", F.col("pred").cast("double")).persist()
            if targets is None:
                check_rows(out, rows.count())
            else:
                check_rows(out, len(targets))
                check_targets(out, targets)
            return out
        finally:
            rows.unpersist()

    def answer(batch: DataFrame, number: int) -> None:
        if panel:
            own = batch.where("part = 'labels'").select("lag", "date_id", "label_date_id", F.col("name").alias("target"), F.col("value").alias("label"))
            batch = batch.where("part = 'prices'").select("date_id", F.col("name").alias("asset"), F.col("value").alias("price"))
        days = [r[0] for r in batch.select("date_id").distinct().collect()]
        if not days:
            return
        last = history.last_before(number)
        if len(days) > 1 or last is not None and days[0] < last:
            raise ValidationError("GATEWAY_RAISED_EXCEPTION", f"batch {number} has dates {days} after {last}")

        def work_of_batch() -> DataFrame:
            if panel:
                server.learn(own)
            return answered(server, batch, number, days)

        out = within(spark, batch_timeout, work_of_batch, "GRPC_DEADLINE_EXCEEDED", f"batch {number} took more than {batch_timeout} s")
        try:
            sinks.write_submission(out, f"{work}/predictions/batch={number}", mode="overwrite")
        finally:
            out.unpersist()
        if on_batch:
            on_batch(days[0])

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            answer(batch, number)
        except Exception as e:  # comes back as a StreamingQueryException without its kind
            failed.append(e)
            raise
        finally:
            batch.unpersist()

    try:
        if not isinstance(server, Server):
            make = server
            try:
                server = within(spark, startup_timeout, make, "SERVER_NEVER_STARTED", f"no server in {startup_timeout} s")
            except Exception as e:
                raise e if isinstance(e, ValidationError) else ValidationError("SERVER_NEVER_STARTED", str(e)) from e
        if primed is not None:
            history.append(primed, -1)
        checkpoint = f"{work}/checkpoint"
        if panel:
            writer = stream_days(spark, source, checkpoint).writeStream
        else:
            writer = spark.readStream.schema("date_id int, asset string, price double").option("maxFilesPerTrigger", 1).parquet(source).writeStream.trigger(availableNow=True)
        query = writer.foreachBatch(step).option("checkpointLocation", checkpoint).start()
        ended = threading.Timer(timeout, query.stop)
        ended.daemon = True
        ended.start()
        try:
            if panel:
                query.processAllAvailable()
                in_time = query.isActive
                query.stop()
            else:
                in_time = query.awaitTermination(timeout)
        finally:
            ended.cancel()
            query.stop()
        if not in_time:
            raise ValidationError("GATEWAY_RAISED_EXCEPTION", f"not done in {timeout} s")
    except Exception as e:
        cause = failed[0] if failed else e
        sinks.write_result(spark, f"{work}/result", cause, kind_of(cause))
        raise cause from e
    sinks.write_result(spark, f"{work}/result")
    if targets and history.last_before(2**62) is None:
        sinks.placeholder(spark, targets, f"{work}/predictions/batch=-1")
    return spark.read.schema("date_id int, target string, pred double").parquet(f"{work}/predictions").select("target", "date_id", "pred")
