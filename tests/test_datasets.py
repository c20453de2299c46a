"""Stored sequence datasets against arrays in memory."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import datasets

NAMES = ["f0", "f1", "flat"]


def panel(n=90, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3, 3)) * [1.0, 5.0, 0.0] + [0.0, 2.0, 1.0]
    y = rng.normal(size=(n, 3))
    y[rng.random((n, 3)) < 0.3] = np.nan
    y[:, 0][20:24] = np.nan
    return x, y


def tables(spark, x, y):
    rows = [(f"t{j}", 2 * d, *map(float, x[d, j])) for d in range(len(x)) for j in range(3)]
    own = [(f"t{j}", 2 * d, None if np.isnan(y[d, j]) else float(y[d, j])) for d in range(len(y)) for j in range(3)]
    return spark.createDataFrame(rows, "target string, date_id int, f0 double, f1 double, flat double"), spark.createDataFrame(own, "target string, date_id int, label double")


def in_memory(x, y, lag, length, train_end, least):
    """(dates, normalised features, labels, mask, train and validation positions)."""
    late = np.full_like(y, np.nan)
    late[: len(y) - lag - 1] = y[lag + 1 :]
    seen = ~np.isnan(late)
    keep = seen.any(axis=1)
    dates, f, late, seen = 2 * np.arange(len(x))[keep], x[keep][:, :, :2], np.nan_to_num(late[keep]), seen[keep]
    at = np.flatnonzero(seen.sum(axis=1) >= least)
    at = at[at >= length - 1]
    train = at[dates[at] <= train_end]
    sd = f[train].std(axis=0)
    return dates, (f - f[train].mean(axis=0)) / np.where(sd < 1e-6, 1, sd), late, seen, train, at[dates[at] > train_end]


@pytest.mark.parametrize(("length", "chunk"), [(5, 16), (12, 7), (1, 100)])
def test_windows_against_arrays(spark, tmp_path, length, chunk):
    x, y = panel()
    made = datasets.create_datasets(*tables(spark, x, y), NAMES, 1, 120, str(tmp_path), length, least=2, chunk=chunk)
    assert made.columns == ["f0", "f1"]
    dates, f, late, seen, train, valid = in_memory(x, y, 1, length, 120, 2)
    for split, at in (("train", train), ("valid", valid)):
        wanted = made.batches(split, 7, 0, 4)
        got = {r.date_id: r for r in made.windows(wanted).collect()}
        assert sorted(got) == dates[at].tolist()
        for i in at:
            r = got[dates[i]]
            assert np.array(r.features).reshape(length, 3, 2) == pytest.approx(f[i - length + 1 : i + 1], abs=1e-5)
            assert r.labels == pytest.approx(late[i].tolist())
            assert r.mask == seen[i].tolist()


def test_epochs_are_seeded_and_whole(spark, tmp_path):
    made = datasets.create_datasets(*tables(spark, *panel()), NAMES, 2, 140, str(tmp_path), 6, chunk=20)
    rows = lambda *a: sorted(map(tuple, made.batches("train", *a, size=4).collect()))
    assert rows(1, 0) == rows(1, 0)
    assert len({tuple(rows(1, 0)), tuple(rows(1, 1)), tuple(rows(2, 0))}) == 3
    assert sorted(r[3] for r in rows(1, 0)) == sorted(r[3] for r in rows(1, 1)) == sorted(r.date_id for r in made.table("samples").where("split = 'train'").collect())
    sizes = made.batches("train", 1, 0, 4).groupBy("chunk", "batch").count()
    assert sizes.where("count > 4").count() == 0
    # a row is stored with its own chunk, and with the next one where that looks back on it
    stored = made.table("chunks").agg(F.sum(F.size("dates"))).first()[0]
    n = made.table("chunks").where("target = 't0'").select(F.explode("dates")).distinct().count() * 3
    assert n < stored <= 2 * n
    assert os.listdir(tmp_path)


def test_a_given_normalizer_and_no_train_samples(spark, tmp_path):
    f, y = tables(spark, *panel())
    same = spark.createDataFrame([(f"t{j}", [0.0, 0.0], [1.0, 1.0]) for j in range(3)], "target string, means array<double>, stds array<double>")
    made = datasets.create_datasets(f, y, NAMES, 1, 120, f"{tmp_path}/a", 2, normalizer=same)
    r = made.windows(made.batches("valid", 1, 0)).first()
    own = f.where(F.col("date_id") == r.date_id).orderBy("target").collect()
    assert r.features[-6:] == pytest.approx([v for o in own for v in (o.f0, o.f1)], abs=1e-5)
    with pytest.raises(ValueError, match="no train samples"):
        datasets.create_datasets(f, y, NAMES, 1, -1, f"{tmp_path}/b", 2)
