"""Boosted trees grown by Spark: histograms as aggregates, all targets of all lags in one pass a level.

Rows carry their features as an array of bins. A level of a tree, for every target at once, is an aggregate by (run,
target, node, feature, bin) to sums of gradients and weights, and a maximum of structs that picks each node's split.
After the first level only rows of a split's smaller side are aggregated; the other side is its parent less that. The
splits are a small table, joined to the rows to send them on. No task ever holds a target: its rows may lie anywhere.

A tree is grown level by level to `max_depth` (or to the depth that num_leaves fits in); where a level would exceed
num_leaves, the splits of most gain stay. Bins are quantiles of the train rows, at most max_bin of them, from a sketch
that tasks merge. Bagging keeps the rows whose seeded hash falls below the fraction, drawn anew every bagging_freq
rounds; a tree's features are a seeded draw for all targets. L1 and L2 terms, row weights and early stopping on the
later rows are those of `boosting`, whose models these are: the same table, and `boosting.predict_targets` serves both.

Tables of a round are written to the shared folder and those of the round before removed, so a lost executor costs what
it was doing. Splits and leaf values of a level are broadcast while they are few (BROADCAST), and joined by key beyond.

Cases: rows without a label are left out; a feature of train variance at or below the threshold has no bins and is never
split on; missing values take the target's train median (of the sketch); a target without train rows or without any
feature that varies raises; without later rows, or with 0 stopping rounds, all rounds count. Ties of gain go to the
first feature, then the lowest bin. An empty table gives no models.
"""

from __future__ import annotations

import functools
import json
import random
import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .boosting import MODEL, BoostConfig, predict_targets
from .labels import sample_weights, shifted

#: Rows of a small table that is broadcast at most.
BROADCAST = 100_000
#: Dates of a target that are binned in one group.
DATES = 4096
#: Precision of the quantile sketch.
ACCURACY = 10_000

KEY = ["lag", "target"]
NODE = [*KEY, "node"]


class Small(NamedTuple):
    """A written table of targets' nodes, and its counted rows."""

    df: DataFrame
    n: int


class Tables:
    """Tables in the shared folder under names; one that is written again replaces the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}", {}
        self._fs().deleteOnExit(self._path(self.folder))

    def _path(self, text: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if old := self.paths.get(name):
            self._fs().delete(self._path(old), True)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, name: str, df: DataFrame) -> Small:
        out = self.write(name, df)
        return Small(out, out.count())

    def append(self, name: str, k: int, df: DataFrame) -> DataFrame:
        """df as the k-th part of a table, which `whole` reads."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/round={k}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}/round={k}")

    def whole(self, name: str, part: DataFrame) -> DataFrame:
        """All parts of a table like `part`, with `round`."""
        return self.spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in part.dtypes)}, round int").parquet(f"{self.folder}/{name}")


# ---------------------------------------------------------------- bins


def bin_tables(rows: DataFrame, columns: list[str], config: BoostConfig) -> DataFrame:
    """(lag, target, kept, medians, edges) of the train rows: which features vary, and their bins' upper edges, by position.

    edges: a matrix as an array of arrays; the last bin has none. One aggregate, over values that aren't missing.
    """
    parts = [0.5, *[i / (config.max_bin - 1) for i in range(config.max_bin)]]
    figures = F.array(*[F.struct(F.coalesce(F.var_samp(c), F.lit(0.0)).alias("spread"), F.percentile_approx(F.col(c).cast("double"), parts, ACCURACY).alias("q")) for c in columns])
    out = rows.where("is_train").groupBy(*KEY).agg(figures.alias("f"))
    varies = lambda x: x["spread"] > config.min_variance

    def edges(x):
        """Midpoints of the distinct quantiles, which are all values where these are few."""
        values = F.array_distinct(F.slice(x["q"], 2, config.max_bin))
        middle = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: (a + b) / 2)
        return F.when(varies(x), middle).otherwise(F.array().cast("array<double>"))

    kept = F.when(F.exists("f", varies), F.transform("f", varies)).otherwise(F.raise_error(F.concat(F.lit("no feature of "), "target", F.lit(" varies"))))
    return out.select(*KEY, kept.alias("kept"), F.transform("f", lambda x: F.coalesce(F.get(x["q"], F.lit(0)), F.lit(0.0))).alias("medians"), F.transform("f", edges).alias("edges"))


def coded(rows: DataFrame, bins: DataFrame, columns: list[str]) -> DataFrame:
    """(lag, target, date_id, label, weight, is_train, codes): the bin of each feature; binned in groups of DATES dates."""
    block = F.floor(F.col("date_id") / DATES).alias("block")
    rows = rows.select(*KEY, "date_id", "label", "weight", "is_train", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), block)
    sent = bins.join(rows.select(*KEY, "block").distinct(), KEY)
    schema = "lag int, target string, date_id int, label double, weight double, is_train boolean, codes array<int>"

    def work(own: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(own):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        x = np.array(group["x"].tolist(), float).reshape(len(group), len(columns))
        medians, edges = np.array(own["medians"].iloc[0], float), own["edges"].iloc[0]
        x = np.where(np.isnan(x), medians, x)
        codes = np.stack([np.searchsorted(np.asarray(e, float), x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        return group.drop(columns=["x", "block"]).assign(codes=list(codes))

    keys = [*KEY, "block"]
    # columns of its own beside those of rows, which bins may come from
    return sent.toDF(*sent.columns).groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(work, schema)


# ---------------------------------------------------------------- levels


def score(g: Column, h: Column, config: BoostConfig) -> Column:
    g = F.greatest(F.abs(g) - config.lambda_l1, F.lit(0.0))
    return F.coalesce(F.try_divide(g * g, h + config.lambda_l2), F.lit(0.0))


def leaf_value(g: Column, h: Column, config: BoostConfig) -> Column:
    size = F.greatest(F.abs(g) - config.lambda_l1, F.lit(0.0))
    return F.coalesce(-F.signum(g) * F.try_divide(size, h + config.lambda_l2) * config.learning_rate, F.lit(0.0))


def histograms(rows: DataFrame, features: list[int], parents: DataFrame | None = None, splits: Small | None = None) -> DataFrame:
    """(lag, target, node, feature, bin, g, h, n) of rows (lag, target, node, g, h, codes).

    With the parents' histograms and splits, rows hold nodes of the smaller sides only; the others are made by subtraction.
    """
    wanted = F.array(*[F.struct(F.lit(j).alias("feature"), F.get("codes", F.lit(j)).alias("bin")) for j in features])
    cells = rows.select(*NODE, "g", "h", F.inline(wanted))
    own = cells.groupBy(*NODE, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    if parents is None:
        return own
    # the parent's cells, less those of its smaller side
    sides = splits.df.select(*KEY, F.col("node").alias("parent"), larger().alias("rest"))
    above = small_join(parents.withColumnRenamed("node", "parent"), Small(sides, splits.n), [*KEY, "parent"])
    less = own.select(*KEY, F.floor((F.col("node") - 1) / 2).cast("int").alias("parent"), "feature", "bin", F.col("g").alias("g0"), F.col("h").alias("h0"), F.col("n").alias("n0"))
    rest = above.join(less, [*KEY, "parent", "feature", "bin"], "left")
    left = lambda a, b, zero: (F.col(a) - F.coalesce(b, F.lit(zero))).alias(a)
    rest = rest.select(*KEY, F.col("rest").alias("node"), "feature", "bin", left("g", "g0", 0.0), left("h", "h0", 0.0), left("n", "n0", 0)).where("n > 0")
    return own.unionByName(rest)


def smaller() -> Column:
    """The child node of fewer rows of a split."""
    return F.when(F.col("nl") <= F.col("nr"), 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)


def larger() -> Column:
    return F.when(F.col("nl") <= F.col("nr"), 2 * F.col("node") + 2).otherwise(2 * F.col("node") + 1)


def best_splits(cells: DataFrame, config: BoostConfig) -> DataFrame:
    """(lag, target, node, gain, feature, bin, gl, hl, nl, gr, hr, nr) of the nodes that a split improves.

    Rows with a bin up to `bin` go left. A node's best is a maximum of structs, so it is combined before the shuffle.
    """
    feature = [*NODE, "feature"]
    upto, whole = Window.partitionBy(*feature).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*feature)
    sums = cells.select(*feature, "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(f"{c}t") for c in "ghn"])
    sums = sums.select("*", *[(F.col(f"{c}t") - F.col(f"{c}l")).alias(f"{c}r") for c in "ghn"])
    gain = score(F.col("gl"), F.col("hl"), config) + score(F.col("gr"), F.col("hr"), config) - score(F.col("gt"), F.col("ht"), config)
    ok = sums.where((F.col("nl") >= config.min_data_in_leaf) & (F.col("nr") >= config.min_data_in_leaf) & (F.col("hl") > 1e-3) & (F.col("hr") > 1e-3))
    best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "nl", "gr", "hr", "nr")).alias("s")
    out = ok.groupBy(*NODE).agg(best).where(F.col("s.gain") > 1e-12)
    return out.select(*NODE, "s.gain", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), *[f"s.{c}{x}" for x in "lr" for c in "ghn"])


def small_join(rows: DataFrame, small: Small, keys: list[str], how: str = "inner") -> DataFrame:
    """A join with a small table: broadcast while its rows are few."""
    return rows.join(F.broadcast(small.df) if small.n <= BROADCAST else small.df, keys, how)


def sent_on(rows: DataFrame, splits: Small) -> DataFrame:
    """rows with the node that the splits of their nodes send them to."""
    there = small_join(rows, Small(splits.df.select(*NODE, "feature", "bin"), splits.n), NODE, "left")
    child = F.when(F.col("feature").isNull(), F.col("node")).when(F.get("codes", F.col("feature")) > F.col("bin"), 2 * F.col("node") + 2).otherwise(2 * F.col("node") + 1)
    return there.withColumn("node", child).drop("feature", "bin")


def depth_of(config: BoostConfig) -> int:
    fits = max(1, (config.num_leaves - 1).bit_length())
    return min(config.max_depth, fits) if config.max_depth > 0 else fits


def within_leaves(splits: DataFrame, levels: list[Small], config: BoostConfig) -> DataFrame:
    """The splits of most gain that a tree has room for, beside those that it has."""
    rows = splits.withColumn("at", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("gain"), "node")))
    if not levels:
        return rows.where(F.col("at") < config.num_leaves).drop("at")
    made = functools.reduce(DataFrame.unionByName, [x.df for x in levels]).groupBy(*KEY).agg(F.count("*").alias("so_far"))
    return rows.join(made, KEY).where(F.col("at") + F.col("so_far") < config.num_leaves).drop("at", "so_far")


def grown(store: Tables, rows: DataFrame, features: list[int], config: BoostConfig) -> tuple[list[Small], DataFrame]:
    """The splits of each level of one tree for each lag and target, and (lag, target, node, feature, bin, value) of all nodes.

    rows: (lag, target, g, h, codes). A node that isn't split has no feature; a node's value is what it gives as a leaf.
    """
    live, levels, cells = rows.withColumn("node", F.lit(0)), [], None
    for level in range(depth_of(config)):
        if level:
            live = sent_on(live, levels[-1])
            sides = Small(levels[-1].df.select(*KEY, smaller().alias("node")), levels[-1].n)
            new = histograms(small_join(live, sides, NODE, "left_semi"), features, cells, levels[-1])
        else:
            new = histograms(live, features)
        # read for the splits and by the next level, which ends before the one after it replaces them
        cells = store.write(f"cells-{level % 2}", new)
        found = best_splits(cells, config)
        if 2 ** (level + 1) > config.num_leaves:
            found = within_leaves(found, levels, config)
        found = store.small(f"splits-{level}", found)
        if not found.n:
            break
        levels.append(found)
    root = rows.groupBy(*KEY).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).withColumn("node", F.lit(0))
    nodes = root.select(*NODE, leaf_value(F.col("g"), F.col("h"), config).alias("value"))
    if not levels:
        return [], nodes.select(*NODE, F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("bin"), "value")
    splits = functools.reduce(DataFrame.unionByName, [x.df for x in levels])
    side = lambda k, c: F.struct((2 * F.col("node") + k).alias("node"), leaf_value(F.col(f"g{c}"), F.col(f"h{c}"), config).alias("value"))
    nodes = nodes.unionByName(splits.select(*KEY, F.inline(F.array(side(1, "l"), side(2, "r")))))
    return levels, nodes.join(splits.select(*NODE, "feature", "bin"), NODE, "left").select(*NODE, "feature", "bin", "value")


# ---------------------------------------------------------------- rounds


def draw(config: BoostConfig, k: int, n: int) -> list[int]:
    """The features of round k, the same for all targets."""
    return sorted(random.Random(config.seed * 1_000_003 + k).sample(range(n), max(1, round(config.feature_fraction * n))))


def bag(config: BoostConfig, k: int) -> Column:
    """Whether a row is in the bag of round k."""
    if config.bagging_freq <= 0 or config.bagging_fraction >= 1:
        return F.lit(True)
    h = F.xxhash64(F.lit(config.seed), F.lit(k // config.bagging_freq), "target", "date_id")
    return F.pmod(h, F.lit(1 << 20)) < int(config.bagging_fraction * (1 << 20))


def fit_targets(rows: DataFrame, columns: list[str], config: BoostConfig) -> DataFrame:
    """A model for each lag and target of rows, as boosting.fit_targets gives; see boosting.MODEL.

    rows: as boosting.training_rows gives them, with a column `lag`, or all of the setting's lag.
    """
    spark = rows.sparkSession
    store = Tables(spark)
    if "lag" not in rows.columns:
        rows = rows.withColumn("lag", F.lit(config.lag))
    rows = store.write("rows", rows.where("label IS NOT NULL").select(F.col("lag").cast("int"), "target", "date_id", "label", "weight", "is_train", *columns))
    if lacking := rows.groupBy(*KEY).agg(F.max("is_train").alias("any")).where("NOT any").select("target").head(1):
        raise ValueError(f"no train rows of {lacking[0][0]}")
    bins = store.write("bins", bin_tables(rows, columns, config))
    train = lambda c: F.sum(F.when(F.col("is_train"), c))
    starts = store.small("starts", rows.groupBy(*KEY).agg(F.try_divide(train(F.col("label") * F.col("weight")), train(F.col("weight"))).alias("start")))
    state = small_join(coded(rows, bins, columns), starts, KEY).withColumnRenamed("start", "pred")
    live, kept, nodes, misses = store.write("state", state), starts.df.select(*KEY, F.lit(0).alias("rounds")), None, None
    for k in range(config.num_boost_round):
        own = live.where(F.col("is_train") & bag(config, k)).select(*KEY, ((F.col("pred") - F.col("label")) * F.col("weight")).alias("g"), F.col("weight").alias("h"), "codes")
        levels, tree = grown(store, own, draw(config, k, len(columns)), config)
        nodes = store.append("nodes", k, tree)
        moved = live.withColumn("node", F.lit(0))
        for level in levels:
            moved = sent_on(moved, level)
        # a target has as many nodes as leaves and splits
        values = Small(nodes.select(*NODE, "value"), 2 * sum(x.n for x in levels) + starts.n)
        moved = small_join(moved, values, NODE, "left")
        live = store.write("state", moved.withColumn("pred", F.col("pred") + F.coalesce("value", F.lit(0.0))).drop("node", "value"))
        if config.early_stopping_rounds > 0:
            miss = F.avg(F.when(~F.col("is_train"), (F.col("pred") - F.col("label")) ** 2))
            misses = store.append("misses", k, live.groupBy(*KEY).agg(miss.alias("miss")))
            best = store.whole("misses", misses).where("miss IS NOT NULL").groupBy(*KEY).agg(F.min_by("round", F.struct("miss", "round")).alias("best"), F.max("round").alias("last"))
            done = store.small("done", best.where((F.col("last") == k) & (k - F.col("best") >= config.early_stopping_rounds)).select(*KEY))
            if done.n:  # their rows take no part from here on
                live = store.write("state", small_join(live, done, KEY, "left_anti"))
                if not live.head(1):
                    break
    if nodes is not None:
        kept = store.whole("nodes", nodes).groupBy(*KEY).agg((F.max("round") + 1).alias("rounds"))
    if misses is not None:
        best = store.whole("misses", misses).where("miss IS NOT NULL").groupBy(*KEY).agg((F.min_by("round", F.struct("miss", "round")) + 1).alias("best"))
        kept = kept.join(best, KEY, "left").select(*KEY, F.coalesce("best", "rounds").alias("rounds"))
    return _models(store, rows, columns, starts.df.join(bins, KEY).join(kept, KEY), None if nodes is None else store.whole("nodes", nodes))


def _models(store: Tables, rows: DataFrame, columns: list[str], own: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """The models' table: of each lag and target, its trees up to the best round, and figures of their predictions."""
    if nodes is None:
        own = own.withColumn("nodes", F.lit(None).cast("array<struct<round:int,node:int,feature:int,bin:int,value:double>>"))
    else:
        nodes = nodes.join(own.select(*KEY, "rounds"), KEY).where(F.col("round") < F.col("rounds"))
        own = own.join(nodes.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("round", "node", "feature", "bin", "value"))).alias("nodes")), KEY, "left")

    def pack(batches):
        for part in batches:
            out = []
            for r in part.itertuples():
                place = {j: i for i, j in enumerate(np.flatnonzero(r.kept).tolist())}
                names, medians = [columns[j] for j in place], [float(r.medians[j]) for j in place]
                model = {"start": r.start, "edges": [[float(e) for e in r.edges[j]] for j in place], "trees": packed_trees(r.nodes if r.nodes is not None else [], place)}
                out.append((r.lag, r.target, names, medians, json.dumps(model), len(model["trees"])))
            yield pd.DataFrame(out, columns=["lag", "target", "feature_names", "medians", "model", "best_iteration"])

    packed = store.write("models", own.mapInPandas(pack, "lag int, target string, feature_names array<string>, medians array<double>, model string, best_iteration int"))
    preds = predict_targets(packed, rows.select("target", "date_id", *columns).dropDuplicates(["target", "date_id"]), DATES)
    both = preds.join(rows.select(*KEY, "date_id", "label", "weight", "is_train"), [*KEY, "date_id"])
    side = lambda f, of, train: f(F.when(F.col("is_train") if train else ~F.col("is_train"), of))
    miss = (F.col("pred") - F.col("label")) ** 2
    figures = both.groupBy(*KEY).agg(
        F.count_if("is_train").alias("train_samples"), F.count_if(~F.col("is_train")).alias("val_samples"), F.sqrt(side(F.avg, miss, True)).alias("train_rmse"), F.sqrt(side(F.avg, miss, False)).alias("val_rmse"),
        side(F.avg, F.col("weight"), True).alias("train_weight_mean"), side(F.min, F.col("weight"), True).alias("train_weight_min"), side(F.max, F.col("weight"), True).alias("train_weight_max"),
    )
    return store.write("fitted", packed.join(figures, KEY).select(*[f.split()[0] for f in MODEL.split(", ")]))


def packed_trees(nodes: list, place: dict[int, int]) -> list[dict]:
    """Trees in the form of boosting.grown_tree, from (round, node, feature, bin, value) in order; place: a feature's position."""
    trees: list[dict] = []
    rounds: dict[int, list] = {}
    for x in nodes:
        rounds.setdefault(int(x["round"]), []).append(x)
    for _, own in sorted(rounds.items()):
        at = {int(x["node"]): i for i, x in enumerate(own)}
        split = [x["feature"] is not None for x in own]
        trees.append(
            {
                "feature": [place[int(x["feature"])] if s else -1 for x, s in zip(own, split, strict=True)],
                "bin": [int(x["bin"]) if s else 0 for x, s in zip(own, split, strict=True)],
                "left": [at[2 * int(x["node"]) + 1] if s else 0 for x, s in zip(own, split, strict=True)],
                "right": [at[2 * int(x["node"]) + 2] if s else 0 for x, s in zip(own, split, strict=True)],
                "value": [0.0 if s else float(x["value"]) for x, s in zip(own, split, strict=True)],
            }
        )
    return trees


def training_rows_of_lags(features: DataFrame, labels: DataFrame, specs: DataFrame, columns: list[str], config: BoostConfig) -> DataFrame:
    """boosting.training_rows of every target at its own lag, with `lag`: all lags in one table, for one fit."""
    own = labels.join(specs.select("target", "lag"), "target")
    own = shifted(own.select("target", "date_id", "label", "lag"), F.col("lag"), config.horizon).where("label IS NOT NULL")
    rows = features.select("target", "date_id", *columns).join(own, ["target", "date_id"]).withColumn("is_train", F.col("date_id") <= config.train_end)
    return sample_weights(rows, config.weight_scheme, config.weight_decay_rate, config.weight_floor, config.weight_cap, key=["target", "is_train"]).drop("distance")
