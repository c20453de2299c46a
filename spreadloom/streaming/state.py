"""Features of a stream from keyed state: each asset keeps its last rows, so a day costs the same however long the run.

The state of an asset is a list of its last `rows` dates. New rows are put in order of date; of rows of one date, the
one that arrived last counts; a missing price continues the last one. Each date of a batch gets the features of the
rows up to it. The state lies in Spark's state store under the stream's checkpoint, so a restarted stream goes on with
the same answers, and a batch that runs again starts from the state before it.

Cases: a date that arrives again, or late, replaces its row in the state and is answered anew, while later dates keep
the answers they got; a date older than all that is kept is answered from itself alone; leading missing prices have
missing features; an asset without new rows costs nothing.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tail(StatefulProcessor):
    """The last rows of an asset. features: of rows (date_id, price) in order, a frame of as many rows with columns `names`."""

    def __init__(self, rows: int, features: Callable[[pd.DataFrame], pd.DataFrame], names: list[str]):
        self.rows, self.features, self.names = rows, features, names

    def init(self, handle) -> None:
        self.kept = handle.getListState("tail", "date_id int, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))[["date_id", "price"]]
        held = pd.DataFrame(self.kept.get() if self.kept.exists() else [], columns=["date_id", "price"])
        own = pd.concat([held, new]) if len(held) else new
        own = own.drop_duplicates("date_id", keep="last").sort_values("date_id", kind="stable").reset_index(drop=True)
        own = own.assign(date_id=own["date_id"].astype("int32"), price=own["price"].astype(float).ffill())
        self.kept.put([(int(d), None if pd.isna(p) else float(p)) for d, p in own.tail(self.rows).itertuples(index=False)])
        out = pd.concat([own[["date_id"]], self.features(own)[self.names]], axis=1)
        yield out[out["date_id"].isin(new["date_id"])].assign(asset=key[0])[["asset", "date_id", *self.names]]

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def keyed_features(stream: DataFrame, rows: int, features: Callable[[pd.DataFrame], pd.DataFrame], names: list[str]) -> DataFrame:
    """(asset, date_id, names) of a stream (date_id, asset, price); start its query inside rocks()."""
    schema = "asset string, date_id int, " + ", ".join(f"{n} double" for n in names)
    own = stream.select("asset", "date_id", "price").groupBy("asset")
    return own.transformWithStateInPandas(Tail(rows, features, names), schema, "Append", "None")


def run_to_end(spark: SparkSession, rows: DataFrame, out: str, checkpoint: str, timeout: int = 900) -> None:
    """Runs a stream until all that there is has been answered; answers are added to the Parquet folder `out`."""
    with rocks(spark):
        query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
            query.awaitTermination(timeout)
