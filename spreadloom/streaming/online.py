"""A server of fitted models: features of the history by the same code as the batch, predictions of every lag."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import filled
from ..operators import boosting, metrics, panel, targets
from ..sources import tables
from .daily import Server, latest


@dataclasses.dataclass(frozen=True)
class OnlineContext:
    """What a server needs beside the history."""

    specs: DataFrame
    artifacts: panel.Artifacts
    version: str = "v2"

    def features(self, history: DataFrame) -> DataFrame:
        """The panel of (date_id, asset, price), one row a date and asset: those that specs need, filled both ways."""
        rows = history.select("date_id", "asset", filled(F.col("price"), "asset").alias("price"))
        lp = targets.log_prices(rows, self.specs)
        parts = panel.blocks(targets.target_frame(rows, self.specs), lp, self.specs, self.version)
        return panel.with_artifacts(panel.joined(list(parts.values())), self.artifacts)

    def latest(self, history: DataFrame) -> DataFrame:
        """The panel's last date."""
        return latest(self.features(history))


def load_context(spark: SparkSession, specs: DataFrame, store: str, version: str = "v2") -> OnlineContext:
    """The context over a store that runs.build_store wrote."""
    return OnlineContext(specs, panel.Artifacts(*tables.load_artifacts(spark, f"{store}/artifacts")), version)


class ModelServer(Server):
    """Predictions of the models of all lags, averaged where a target has several.

    precomputed: a stored panel, read instead of the history until a date is not in it; from then on features are
    computed. Serve it with tail=None: running sums and exponential averages look back on the whole history.
    """

    def __init__(self, context: OnlineContext, models: DataFrame, precomputed: DataFrame | None = None):
        self.context, self.models, self.precomputed = context, models, precomputed

    def features(self, history: DataFrame) -> DataFrame:
        if self.precomputed is not None:
            last = history.agg(F.max("date_id")).first()[0]
            rows = self.precomputed.where(F.col("date_id") == last)
            if rows.head(1):
                return rows
            self.precomputed = None
        return self.context.features(history)

    def predict(self, rows: DataFrame) -> DataFrame:
        served = rows.join(self.models.select("target").distinct(), "target", "left_semi")
        return metrics.blended(boosting.predict_targets(self.models, served.drop("is_train")))
