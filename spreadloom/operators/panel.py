"""The wide panel that is stored, trained on and served: one row a target and date, one column a feature.

Version v1 takes the indicators of the log spreads, v2 those of the value curves. Components and symbolic programs are
fitted once and kept as Artifacts, a small table and a list.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame

from . import decomp, factors, stats, symbolic, technical
from .targets import exploded_terms, nav

KEYS = ["target", "date_id"]
#: Folder of a version's store. Fixed values.
STORES = {"v1": "features", "v2": "features_v2"}


@dataclasses.dataclass(frozen=True)
class Artifacts:
    """loadings: (target, component, loading); programs: those of symbolic.evolve."""

    loadings: DataFrame
    programs: list


def store_name(version: str | None) -> str:
    """The store of v1 (also if nothing is given) or v2; any other name is its own store."""
    return STORES.get((version or "v1").lower(), version or "v1")


def curves(targets: DataFrame, specs: DataFrame, version: str) -> DataFrame:
    """(target, date_id, x): what the indicators are taken of."""
    if version == "v1":
        return targets.select(*KEYS, targets.px.alias("x"))
    own = nav(targets, specs)
    return own.select(*KEYS, own.nav.alias("x"))


def blocks(targets: DataFrame, log_prices: DataFrame, specs: DataFrame, version: str = "v1") -> dict[str, DataFrame]:
    """technical (30), factors (15) and stats (30), each by target and date."""
    residuals = stats.cointegration_residuals(targets, exploded_terms(specs), log_prices, stats.market_index(log_prices))
    return {
        "technical": technical.technical_features(curves(targets, specs, version)),
        "factors": factors.factor_features(targets),
        "stats": stats.statistical_features(targets).join(residuals, KEYS),
    }


def joined(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.join(b, KEYS), parts)


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*KEYS, "is_train")]


def fit_artifacts(base: DataFrame, names: list[str], targets: DataFrame, labels: DataFrame, train_end: int, components: int = 5, programs: int = 15, **settings) -> Artifacts:
    """Components of returns and programs on the features `names` of base, both on train dates. Labels aren't shifted.

    settings go to symbolic.evolve.
    """
    rows = base.where(base.date_id <= train_end).join(labels.select(*KEYS, "label"), KEYS)
    return Artifacts(decomp.pca_loadings(targets, train_end, components), symbolic.evolve(rows, names, outputs=programs, **settings))


def with_artifacts(base: DataFrame, artifacts: Artifacts, components: int = 5) -> DataFrame:
    """base with gp_* and pca_*; raises on inputs that base lacks."""
    return decomp.with_loadings(symbolic.with_programs(base, artifacts.programs), artifacts.loadings, components)
