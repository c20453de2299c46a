"""A Spark data source of days: offsets are dates, and a date brings its prices and the label tables of all lags together.

The tables lie in a folder, split by date: prices/date_id=N and labels/date_id=N. A reader lists the dates, so an order
of files or of times plays no part, and a date is a partition a table, read by the executors. As a stream, a trigger
takes the next `dates` dates (1 unless set); what has been taken follows from Spark's own offsets, so a batch that runs
again reads the same rows. As a batch, it is the whole table, `dates` dates a task.

Options: folder; dates; checkpoint, the stream's checkpoint folder, from which a restarted stream learns where it is.

Cases: a date without labels, or without prices, brings what there is; dates that are added later, beyond the last one
taken, are found by the next trigger; earlier ones are not; a folder without dates is an empty stream.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "part string, lag int, date_id int, label_date_id int, name string, value double"
PARTS = ("prices", "labels")


def write_panel(prices: DataFrame, labels: DataFrame | None, folder: str) -> None:
    """The tables of a folder, a job each: prices (date_id, asset, price), labels (lag, date_id, label_date_id, target, label)."""
    parts = [("prices", prices.select(F.lit(None).cast("int").alias("lag"), "date_id", F.lit(None).cast("int").alias("label_date_id"), F.col("asset").alias("name"), F.col("price").alias("value")))]
    if labels is not None:
        parts.append(("labels", labels.select("lag", "date_id", "label_date_id", F.col("target").alias("name"), F.col("label").alias("value"))))
    for name, df in parts:
        df.repartition("date_id").write.mode("overwrite").partitionBy("date_id").parquet(f"{folder}/{name}")


def _store(folder: str):
    from pyarrow import fs

    if re.match(r"file:|/", folder):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def listed_dates(folder: str) -> list[int]:
    """The dates that any table of a folder has."""
    from pyarrow import fs

    store, path = _store(folder)
    out = set()
    for part in PARTS:
        for found in store.get_file_info(fs.FileSelector(f"{path}/{part}", allow_not_found=True)):
            if m := re.fullmatch(r"date_id=(-?\d+)", found.base_name):
                out.add(int(m[1]))
    return sorted(out)


def last_offset(checkpoint: str) -> int | None:
    """The date of the last offset that a stream has recorded."""
    from pyarrow import fs

    store, path = _store(checkpoint)
    found = [x for x in store.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True)) if x.base_name.isdigit()]
    if not found:
        return None
    with store.open_input_stream(max(found, key=lambda x: int(x.base_name)).path) as src:
        return json.loads(src.read().decode().splitlines()[-1])["date"]


def day_rows(folder: str, part: str, date: int) -> Iterator[pa.RecordBatch]:
    """The rows of a date of a table, as SCHEMA has them."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = _store(folder)
    for found in store.get_file_info(fs.FileSelector(f"{path}/{part}/date_id={date}", allow_not_found=True)):
        if found.base_name.endswith(".parquet") and not found.base_name.startswith((".", "_")):
            with store.open_input_file(found.path) as src:
                for rows in pq.ParquetFile(src).iter_batches():
                    n, own = rows.num_rows, {c: rows.column(c) for c in rows.schema.names}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.string()), own["lag"].cast(pa.int32()), pa.array([date] * n, pa.int32()), own["label_date_id"].cast(pa.int32()), own["name"].cast(pa.string()), own["value"].cast(pa.float64())],
                        ["part", "lag", "date_id", "label_date_id", "name", "value"],
                    )


class Days(InputPartition):
    """Dates of a table, which one task reads."""

    def __init__(self, part: str, dates: list[int]):
        super().__init__((part, dates))


class _Reader:
    def __init__(self, options: dict):
        self.folder, self.step, self.checkpoint = options["folder"], max(1, int(options.get("dates", 1))), options.get("checkpoint")
        #: The last date that has been taken, once known.
        self.at: int | None = None

    def read(self, partition: Days):
        part, dates = partition.value
        for date in dates:
            yield from day_rows(self.folder, part, date)


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Days]:
        dates = listed_dates(self.folder)
        return [Days(part, dates[at : at + self.step]) for at in range(0, len(dates), self.step) for part in PARTS]


class StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        dates = listed_dates(self.folder)
        self.at = min(dates, default=0) - 1
        return {"date": self.at}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.at is None:  # a restarted stream whose last batch ended
            self.at = last_offset(self.checkpoint) if self.checkpoint else None
        ahead = [d for d in listed_dates(self.folder) if self.at is None or d > self.at]
        return {"date": ahead[: self.step][-1] if ahead else self.at if self.at is not None else -1}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        self.at = end["date"]
        return [Days(part, [d]) for d in listed_dates(self.folder) if start["date"] < d <= end["date"] for part in PARTS]

    def commit(self, end: dict) -> None:
        """Nothing is kept beside Spark's own offsets."""


class PanelDays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "panel_days"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def read_days(spark: SparkSession, folder: str, dates: int = 64) -> DataFrame:
    """All days of a folder, as a table of SCHEMA."""
    spark.dataSource.register(PanelDays)
    return spark.read.format("panel_days").options(folder=folder, dates=str(dates)).load()


def stream_days(spark: SparkSession, folder: str, checkpoint: str, dates: int = 1) -> DataFrame:
    """The days of a folder as a stream, `dates` of them a trigger."""
    spark.dataSource.register(PanelDays)
    return spark.readStream.format("panel_days").options(folder=folder, checkpoint=checkpoint, dates=str(dates)).load()
