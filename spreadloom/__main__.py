"""python -m spreadloom COMMAND: runs over a folder with train.csv, test.csv, train_labels.csv and target_pairs.csv.

clean, features, train, grid, eda and serve; each takes what the one before wrote.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import boosting, clean, eda, panel, screen, targets
from .plans import runs
from .sources import sinks, tables
from .streaming import daily, online, source

#: Folder of the lagged labels beside test.csv. A fixed value.
LAGGED = "lagged_test_labels"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spreadloom", description=__doc__)
    p.add_argument("command", choices=["clean", "features", "train", "grid", "eda", "serve"])
    p.add_argument("--data", required=True, help="folder of the CSV tables")
    p.add_argument("--out", required=True, help="folder for stores, runs and results")
    p.add_argument("--version", default="v2", help="store: v1 (spreads) or v2 (value curves)")
    p.add_argument("--params", help="JSON file of parameters by lag; the default is the operators' own for lags 1 to 4")
    p.add_argument("--lags", nargs="*", help="the lags to train")
    p.add_argument("--train-end", type=int, default=1960)
    p.add_argument("--weight-scheme", default="none")
    p.add_argument("--weight-decay", type=float, default=0.0)
    p.add_argument("--weight-floor", type=float, default=0.1)
    p.add_argument("--weight-cap", type=float, default=0.0, help="0 or less: none")
    p.add_argument("--samples", type=int, default=0, help="settings of the grid to try; 0: all")
    p.add_argument("--seed", type=int, default=2024)
    p.add_argument("--learner", choices=["groups", "spark"], default="groups", help="a small model a target in its own task, or trees that all tasks grow together")
    p.add_argument("--days", help="folder of test.csv and the lagged labels to serve, where it isn't that of --data")
    p.add_argument("--run", default="run", help="name of the training run")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spreadloom").getOrCreate()
    store = f"{a.out}/{panel.store_name(a.version)}"
    specs = targets.parse_pairs(tables.load_pairs(spark, f"{a.data}/target_pairs.csv"))
    labels = lambda: tables.load_labels(spark, f"{a.data}/train_labels.csv")
    stored = lambda: tables.load_features(spark, f"{store}/all")
    if a.command == "clean":
        runs.build_cleaned(spark, a.data, f"{a.out}/cleaned")
    elif a.command == "features":
        runs.build_store(runs.raw_prices(spark, a.data), specs, labels(), a.out, a.train_end, a.version)
    elif a.command == "train":
        text = "\n".join(r[0] for r in spark.read.text(a.params).collect()) if a.params else '{"1": {}, "2": {}, "3": {}, "4": {}}'
        settings = {"weight_scheme": a.weight_scheme, "weight_decay_rate": a.weight_decay, "weight_floor": a.weight_floor, "weight_cap": a.weight_cap, "seed": a.seed}
        runs.train_lags(stored(), labels(), specs, runs.lag_configs(text, a.lags, a.train_end, **settings), f"{a.out}/runs/{a.run}", a.learner).show(truncate=False)
    elif a.command == "grid":
        lag = int(a.lags[0]) if a.lags else 1
        runs.search_grid(stored(), labels(), specs, boosting.BoostConfig(lag=lag, train_end=a.train_end, seed=a.seed), a.samples, a.seed, f"{a.out}/grid").orderBy(F.desc("val_ic")).show(10)
    elif a.command == "eda":
        sinks.save_csv(eda.feature_summary(screen.to_long(stored(), panel.columns_of(stored()))), f"{a.out}/eda")
    else:
        fitted = tables.load_models(spark, tables.newest_run(spark, f"{a.out}/runs"), boosting.MODEL)
        names = [r[0] for r in fitted.select("target").distinct().orderBy("target").collect()]
        primed = clean.trend_fill(clean.to_long(tables.load_prices(spark, a.data, "train")))
        # a date brings its prices and, where there are files of them, the labels of all lags
        days = a.days or a.data
        lagged = tables.load_lagged_labels(spark, f"{days}/{LAGGED}") if tables.exists(spark, f"{days}/{LAGGED}") else None
        source.write_panel(clean.to_long(tables.load_prices(spark, days, "test")), lagged, f"{a.out}/days")
        server = lambda: online.ModelServer(online.load_context(spark, specs, store, a.version), fitted)
        daily.serve(spark, f"{a.out}/days", f"{a.out}/served", server, tail=None, primed=primed, targets=names, panel=True)


if __name__ == "__main__":
    main()
