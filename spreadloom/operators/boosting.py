"""Boosted trees by target: one small model a target, fitted where the target's rows are.

A target has one row a date, so its rows fit one task; targets and settings are what grows, and what Spark deals out.
`fit_targets` gives a model a row, `predict_targets` brings models and rows together by target, `search` fits many
settings in groups of a target. The learner grows trees by the best leaf over binned features, with weights, bagging,
a share of features a tree, L1 and L2 terms, and early stopping on the rows after the train range.

Cases: a row without a label is left out; features of train variance at or below the threshold are dropped and a
target without any left raises; missing values take the target's train median; without later rows, or with 0 stopping rounds, all rounds count;
without later rows validation figures are NULL; a target without train rows raises. A feature that rows of a model lack is
its median.
"""

from __future__ import annotations

import dataclasses
import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .labels import sample_weights, shifted
from .metrics import daily_ic

#: Settings of a wave of a search, and of a group of one target.
WAVE, PER = 64, 4


@dataclasses.dataclass(frozen=True)
class BoostConfig:
    """Settings of the runs of one lag."""

    # fixed values: the published defaults
    lag: int = 1
    horizon: int = 1
    train_end: int = 1800
    num_boost_round: int = 500
    learning_rate: float = 0.05
    num_leaves: int = 64
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    bagging_freq: int = 5
    min_data_in_leaf: int = 20
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    early_stopping_rounds: int = 50
    max_depth: int = -1
    seed: int = 2024
    min_variance: float = 1e-9
    max_bin: int = 255
    weight_scheme: str = "none"
    weight_decay_rate: float = 0.0
    weight_floor: float | None = 0.1
    weight_cap: float | None = None

    def with_values(self, values: dict) -> BoostConfig:
        """These settings with others in place, each in the type it has here."""
        own = {f.name: f for f in dataclasses.fields(self)}
        if unknown := sorted(set(values) - set(own)):
            raise ValueError(f"unknown settings: {unknown}")
        return dataclasses.replace(self, **{k: type(getattr(self, k))(v) if isinstance(getattr(self, k), (int, float)) else v for k, v in values.items()})


# ---------------------------------------------------------------- the learner


def bin_edges(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Upper edges of each column's bins: midpoints of its values where they are few, else of its quantiles."""
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > most:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int64)


def _score(g, h, config: BoostConfig):
    g = np.maximum(np.abs(g) - config.lambda_l1, 0.0)
    return g * g / (h + config.lambda_l2)


class Leaf:
    """Rows of a leaf, their sums by column and bin, and its best split."""

    def __init__(self, rows, sums, depth):
        self.rows, self.sums, self.depth, self.split, self.gain = rows, sums, depth, None, -np.inf


def grown_tree(codes: np.ndarray, bins: int, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, columns: np.ndarray, config: BoostConfig) -> dict:
    """(feature, bin, left, right, value) by node; leaves have feature -1. Rows with a code up to `bin` go left."""
    flat = codes[:, columns] + np.arange(len(columns)) * bins
    shape = (len(columns), bins)

    def sums_of(own):
        at = flat[own].ravel()
        return [np.bincount(at, w, bins * len(columns)).reshape(shape) for w in (np.repeat(grad[own], len(columns)), np.repeat(hess[own], len(columns)))] + [np.bincount(at, minlength=bins * len(columns)).reshape(shape)]

    def find(leaf):
        g, h, n = (np.cumsum(s, axis=1) for s in leaf.sums)
        top_g, top_h, top_n = g[:, -1:], h[:, -1:], n[:, -1:]
        ok = (n >= config.min_data_in_leaf) & (top_n - n >= config.min_data_in_leaf) & (h > 1e-3) & (top_h - h > 1e-3)
        with np.errstate(all="ignore"):
            gain = np.where(ok, _score(g, h, config) + _score(top_g - g, top_h - h, config) - _score(top_g, top_h, config), -np.inf)
        best = int(np.argmax(gain))
        leaf.split, leaf.gain = divmod(best, bins), float(gain.flat[best])

    nodes = {"feature": [-1], "bin": [0], "left": [0], "right": [0], "value": [0.0]}
    root = Leaf(rows, sums_of(rows), 0)
    find(root)
    queue, leaves = [(-root.gain, 0, root)], {0: root}
    while queue and len(leaves) < config.num_leaves:
        gain, at, leaf = heapq.heappop(queue)
        if -gain <= 1e-12 or 0 < config.max_depth <= leaf.depth:
            continue
        column, cut = leaf.split
        right = codes[leaf.rows, columns[column]] > cut
        parts = leaf.rows[~right], leaf.rows[right]
        small = 0 if len(parts[0]) <= len(parts[1]) else 1
        sums = [None, None]
        sums[small] = sums_of(parts[small])
        sums[1 - small] = [a - b for a, b in zip(leaf.sums, sums[small], strict=True)]
        nodes["feature"][at], nodes["bin"][at] = int(columns[column]), int(cut)
        del leaves[at]
        for side, name in enumerate(("left", "right")):
            new = len(nodes["feature"])
            nodes[name][at] = new
            for k, v in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0), ("value", 0.0)):
                nodes[k].append(v)
            leaves[new] = child = Leaf(parts[side], sums[side], leaf.depth + 1)
            find(child)
            heapq.heappush(queue, (-child.gain, new, child))
    for at, leaf in leaves.items():
        g, h = leaf.sums[0][0].sum(), leaf.sums[1][0].sum()
        nodes["value"][at] = float(-np.sign(g) * max(abs(g) - config.lambda_l1, 0.0) / (h + config.lambda_l2) * config.learning_rate)
    return nodes


def tree_values(tree: dict, codes: np.ndarray) -> np.ndarray:
    feature, cut, left, right, value = (np.asarray(tree[k]) for k in ("feature", "bin", "left", "right", "value"))
    at = np.zeros(len(codes), np.int64)
    while (live := np.flatnonzero(feature[at] >= 0)).size:
        own = at[live]
        at[live] = np.where(codes[live, feature[own]] > cut[own], right[own], left[own])
    return value[at]


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, later_x: np.ndarray, later_y: np.ndarray, config: BoostConfig) -> dict:
    """start, edges and trees: all rounds, or with early stopping those up to the best round of the later rows."""
    edges = bin_edges(x, config.max_bin)
    codes, later = binned(x, edges), binned(later_x, edges) if len(later_y) and config.early_stopping_rounds > 0 else None
    bins = max(len(e) for e in edges) + 1
    rng = np.random.default_rng(config.seed)
    start = float(np.average(y, weights=w))
    out, out_later = np.full(len(y), start), np.full(len(later_y), start)
    trees, best, best_round, rows = [], np.inf, 0, np.arange(len(y))
    n_columns = max(1, round(config.feature_fraction * x.shape[1]))
    for k in range(config.num_boost_round):
        if config.bagging_freq > 0 and config.bagging_fraction < 1 and k % config.bagging_freq == 0:
            rows = np.sort(rng.choice(len(y), max(1, round(config.bagging_fraction * len(y))), replace=False))
        columns = np.sort(rng.choice(x.shape[1], n_columns, replace=False))
        tree = grown_tree(codes, bins, (out - y) * w, w, rows, columns, config)
        trees.append(tree)
        out += tree_values(tree, codes)
        if later is not None:
            out_later += tree_values(tree, later)
            miss = float(np.mean((out_later - later_y) ** 2))
            if miss < best:
                best, best_round = miss, k + 1
            elif k + 1 - best_round >= config.early_stopping_rounds:
                break
    return {"start": start, "edges": [e.tolist() for e in edges], "trees": trees[: best_round if later is not None else len(trees)]}


def predicted(model: dict, x: np.ndarray) -> np.ndarray:
    codes = binned(x, [np.asarray(e) for e in model["edges"]])
    return model["start"] + sum((tree_values(t, codes) for t in model["trees"]), np.zeros(len(x)))


# ---------------------------------------------------------------- by target


def training_rows(features: DataFrame, labels: DataFrame, columns: list[str], config: BoostConfig) -> DataFrame:
    """(target, date_id, label, is_train, weight, columns): wide, so that one exchange by target serves everything after.

    labels are shifted by lag and horizon among their own dates. Weights are of each target's train rows.
    """
    own = shifted(labels.select("target", "date_id", "label"), config.lag, config.horizon).where("label IS NOT NULL")
    rows = features.select("target", "date_id", *columns).join(own, ["target", "date_id"]).withColumn("is_train", F.col("date_id") <= config.train_end)
    return sample_weights(rows, config.weight_scheme, config.weight_decay_rate, config.weight_floor, config.weight_cap, key=["target", "is_train"]).drop("distance")


def _prepared(rows: pd.DataFrame, columns: list[str], config: BoostConfig):
    rows = rows.sort_values("date_id")
    train, later = rows[rows["is_train"]], rows[~rows["is_train"]]
    target = rows["target"].iloc[0]
    if train.empty:
        raise ValueError(f"no train rows of {target}")
    spread = train[columns].astype(float).var(ddof=1)
    kept = [c for c in columns if spread[c] > config.min_variance]
    if not kept:
        raise ValueError(f"no feature of {target} varies")
    medians = train[kept].astype(float).median().fillna(0.0)
    matrix = lambda part: part[kept].astype(float).fillna(medians).to_numpy()
    return train, later, kept, medians, matrix


def _rmse(a, b):
    return float(np.sqrt(np.mean((a - b) ** 2))) if len(a) else None


MODEL = "lag int, target string, feature_names array<string>, medians array<double>, model string, best_iteration int, train_samples long, val_samples long, train_rmse double, val_rmse double, train_weight_mean double, train_weight_min double, train_weight_max double"


def fit_targets(rows: DataFrame, columns: list[str], config: BoostConfig) -> DataFrame:
    """A model a target, with what it needs to serve and its figures; rows as training_rows gives them. See MODEL."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        train, later, kept, medians, matrix = _prepared(group, columns, config)
        x, later_x = matrix(train), matrix(later)
        y, later_y, w = (part.to_numpy(float) for part in (train["label"], later["label"], train["weight"]))
        model = boosted(x, y, w, later_x, later_y, config)
        figures = len(model["trees"]), len(y), len(later_y), _rmse(predicted(model, x), y), _rmse(predicted(model, later_x), later_y) if len(later_y) else None
        return pd.DataFrame([(config.lag, train["target"].iloc[0], kept, medians.tolist(), json.dumps(model), *figures, w.mean(), w.min(), w.max())], columns=[f.split()[0] for f in MODEL.split(", ")])

    return rows.groupBy("target").applyInPandas(fit, MODEL)


def predict_targets(models: DataFrame, rows: DataFrame, dates: int | None = None) -> DataFrame:
    """(lag, target, date_id, pred) of rows (target, date_id, features), by each model of the row's target.

    Rows are brought into the model's own columns; what is missing takes the target's own medians. dates: a group has so
    many dates of a target at most, to which its models are sent; else all of a target's rows.
    """

    def predict(own: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m in own.itertuples() if len(group) else ():
            names, medians = list(m.feature_names), np.asarray(m.medians, float)
            x = group.reindex(columns=names).astype(float).fillna(dict(zip(names, medians, strict=True))).to_numpy()
            out.append(pd.DataFrame({"lag": m.lag, "target": group["target"], "date_id": group["date_id"], "pred": predicted(json.loads(m.model), x)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["lag", "target", "date_id", "pred"])

    models, keys = models.select("lag", "target", "feature_names", "medians", "model"), ["target"]
    if dates:
        rows, keys = rows.withColumn("__block", F.floor(F.col("date_id") / dates)), ["target", "__block"]
        models = models.join(rows.select(*keys).distinct(), "target")
        models = models.toDF(*models.columns)  # columns of its own beside those of rows
    return models.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(predict, "lag int, target string, date_id int, pred double")


def report(predictions: DataFrame, train_end: int, by: list[str] | None = None) -> DataFrame:
    """train_ic_mean, train_ic_std, train_ir, n_train_dates and the same for val, of (target, date_id, pred, label).

    by: further columns that tell runs apart. Means are NULL and counts 0 where there are no dates.
    """
    by = by or []
    return summary(daily_ic(predictions, by), train_end, by)


def summary(ic: DataFrame, train_end: int, by: list[str]) -> DataFrame:
    """The figures of report, of daily correlations (by, date_id, ic)."""
    sides = [("train", F.col("date_id") <= train_end), ("val", F.col("date_id") > train_end)]
    figures = []
    for name, side in sides:
        own = F.when(side, F.col("ic"))
        figures += [F.avg(own).alias(f"{name}_ic_mean"), F.stddev_pop(own).alias(f"{name}_ic_std"), F.count(own).alias(f"n_{name}_dates")]
    out = ic.groupBy(*by).agg(*figures)
    for name, _ in sides:
        out = out.withColumn(f"{name}_ir", F.when(F.col(f"{name}_ic_std") > 0, F.try_divide(f"{name}_ic_mean", f"{name}_ic_std")))
    return out


# ---------------------------------------------------------------- many settings


def search(rows: DataFrame, columns: list[str], base: BoostConfig, settings: list[dict], chunks: int | None = None, wave: int = WAVE, folder: str | None = None, rungs: int = 1) -> DataFrame:
    """(index, status, train_end, param_*, train_ic, train_ir, val_ic, val_ir, n_train_dates, n_val_dates, error, train_val_gap).

    Settings run in waves. A group is a target and a chunk of a wave's settings (PER of them unless `chunks` says how
    many chunks); of a wave, daily rank correlations are written and predictions are not, so what is held doesn't grow
    with the settings. folder: where waves are written; one that is there already is read instead, so that a search that
    was stopped goes on. rungs: with more than one, all settings first run with a share of their rounds, half of the
    rounds of the next rung, and only the better half by val_ic goes on; the others keep the figures they have and have
    status stopped. A setting that fails for a target has status error and a target's message; its figures are NULL.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    alive, figures = list(range(len(settings))), None
    for rung in range(rungs):
        share = 2.0 ** (rung + 1 - rungs)
        own = [(i, settings[i] | {"num_boost_round": max(1, round(float(settings[i].get("num_boost_round", base.num_boost_round)) * share))}) if share < 1 else (i, settings[i]) for i in alive]
        found = _figures_of(rows, columns, base, own, chunks, wave, f"{folder}/rung={rung}")
        figures = found if figures is None else figures.join(found.select("index"), "index", "left_anti").unionByName(found)
        if rung < rungs - 1:  # a row a setting
            order = found.where("error IS NULL").orderBy(F.desc_nulls_last("val_ic_mean"), "index").select("index").limit(max(1, len(own) // 2))
            alive = sorted(r[0] for r in order.collect())
    out = settings_table(spark, settings).join(figures, "index", "left")
    ok = F.col("error").isNull()
    status = F.when(~ok, "error").when(F.col("index").isin(alive), "ok").otherwise("stopped") if rungs > 1 else F.when(ok, "ok").otherwise("error")
    params = [c for c in out.columns if c.startswith("param_")]
    value = lambda c, n: F.when(ok, F.col(c)).alias(n)
    out = out.select(
        "index", status.alias("status"), F.lit(base.train_end).alias("train_end"), *params,
        value("train_ic_mean", "train_ic"), value("train_ir", "train_ir"), value("val_ic_mean", "val_ic"), value("val_ir", "val_ir"), value("n_train_dates", "n_train_dates"), value("n_val_dates", "n_val_dates"), "error",
    )
    return out.withColumn("train_val_gap", F.col("train_ic") - F.col("val_ic"))


def _figures_of(rows: DataFrame, columns: list[str], base: BoostConfig, settings: list[tuple[int, dict]], chunks: int | None, wave: int, folder: str) -> DataFrame:
    """Report figures and error by index; a wave of settings is a table of daily correlations and errors in the folder."""
    spark = rows.sparkSession
    names = ["index", "target", "date_id", "label", "pred", "error"]
    kept = "index int, date_id int, ic double, error string"

    def fit_chunk(group: pd.DataFrame, own: list[tuple[int, dict]]) -> Iterator[pd.DataFrame]:
        for i, values in own:
            try:
                config = base.with_values(values)
                train, later, _, _, matrix = _prepared(group, columns, config)
                x, later_x = matrix(train), matrix(later)
                y, later_y, w = (part.to_numpy(float) for part in (train["label"], later["label"], train["weight"]))
                model = boosted(x, y, w, later_x, later_y, config)
                for part, side in ((train, x), (later, later_x)):
                    if len(part):
                        yield pd.DataFrame({"index": i, "target": part["target"], "date_id": part["date_id"], "label": part["label"], "pred": predicted(model, side), "error": None})
            except (ValueError, TypeError, FloatingPointError) as e:
                yield pd.DataFrame([(i, group["target"].iloc[0], None, None, None, str(e) or type(e).__name__)], columns=names)

    def fit_of(own: list[tuple[int, dict]], n: int):
        def fit(group: pd.DataFrame) -> pd.DataFrame:
            out = list(fit_chunk(group, own[int(group["chunk"].iloc[0]) :: n]))
            return pd.concat(out) if out else pd.DataFrame(columns=names)

        return fit

    for k in range(0, len(settings), wave):
        path = f"{folder}/wave={k // wave}"
        if _written(spark, path):
            continue
        own = settings[k : k + wave]
        n = min(chunks or -(-len(own) // PER), len(own))

        spread = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        got = spread.groupBy("target", "chunk").applyInPandas(fit_of(own, n), "index int, target string, date_id int, label double, pred double, error string").persist()
        ic = daily_ic(got.where("error IS NULL"), ["index"]).select("index", "date_id", "ic", F.lit(None).cast("string").alias("error"))
        failed = got.where("error IS NOT NULL").groupBy("index").agg(F.min("error").alias("error"))
        ic.unionByName(failed.select("index", F.lit(None).cast("int").alias("date_id"), F.lit(None).cast("double").alias("ic"), "error")).write.mode("overwrite").parquet(path)
        got.unpersist()
    if not settings:
        found = spark.createDataFrame([], kept)
    else:
        found = spark.read.schema(kept).parquet(*[f"{folder}/wave={k}" for k in range(-(-len(settings) // wave))])
    return summary(found.where("error IS NULL"), base.train_end, ["index"]).join(found.where("error IS NOT NULL").select("index", "error"), "index", "full")


def _written(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def settings_table(spark: SparkSession, settings: list[dict]) -> DataFrame:
    """(index, param_<name>) of a list of settings; a name that a setting lacks is NULL."""
    names = sorted({k for s in settings for k in s})
    rows = [(i, *[float(s[k]) if k in s else None for k in names]) for i, s in enumerate(settings)]
    return spark.createDataFrame(rows, ", ".join(["index int", *[f"param_{k} double" for k in names]]))
