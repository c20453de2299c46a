"""Queries that once ran over some dates, or with small settings, only."""

import os

import pytest

import __spark_entry__ as entry
from spreadloom.operators import models
from spreadloom.sources import driver_tables as dt

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def panel(spark):
    """{(target, date_id): label} of every date."""
    return {(r.target, r.date_id): r.label for r in dt.labels(spark, FOLDER).collect()}


def keys(df):
    return sorted((r.target, r.date_id) for r in df.select("target", "date_id").collect())


def run(spark, name):
    return entry.queries()[name](spark, FOLDER)


def test_pca_features_has_every_date(spark, panel):
    assert keys(run(spark, "pca_features")) == sorted(panel)


def test_joins_have_every_date(spark, panel):
    known = sorted(k for k, v in panel.items() if v is not None)
    assert keys(run(spark, "feature_label_join")) == known
    assert keys(run(spark, "intersect_keys")) == known
    assert sorted(r.date_id for r in run(spark, "shared_dates").collect()) == sorted({d for _, d in known})
    dates = {d for _, d in panel}
    assert {r.is_train: r.n for r in run(spark, "mask_left_join").collect()} == {y: n for y in (True, False) if (n := sum((d <= dt.TRAIN_END) == y for d in dates))}
    out = run(spark, "full_join_blocks").collect()
    assert sorted((r.target, r.date_id) for r in out) == sorted(k for k, v in panel.items() if v is not None or k[1] <= dt.TRAIN_END)
    assert all(r.ret_1 is None for r in out if r.date_id > dt.TRAIN_END)


def test_evolution_has_fifteen_outputs_of_the_default_search(spark, panel, monkeypatch):
    from spreadloom.operators import symbolic

    scored, names = [], set()
    real = symbolic.fitness
    monkeypatch.setattr(symbolic, "fitness", lambda rows, programs, label: scored.append(len(programs)) or names.update(rows.columns) or real(rows, programs, label))
    out = run(spark, "gp_evolved")
    assert out.columns == ["target", "date_id", *[f"gp_{i}" for i in range(15)]]
    assert scored == [200] * 3
    assert len(names - {"label"}) == 15
    assert keys(out) == sorted(panel)


def test_trees_have_the_default_settings(spark, monkeypatch):
    found = []
    real = models.fit
    monkeypatch.setattr(models, "fit", lambda rows, columns, config: found.append((len(columns), config)) or real(rows, columns, config))
    assert run(spark, "gbt_train_predict").where("pred IS NULL").count() == 0
    assert found == [(15, models.TrainConfig())]


def test_windows_have_192_rows(spark, panel):
    dates = sorted({d for _, d in panel})
    out = run(spark, "sequence_windows")
    assert {r.n for r in out.select("n").distinct().collect()} == {192}
    assert keys(out) == sorted((t, d) for t in {t for t, _ in panel} for d in dates[191:])
