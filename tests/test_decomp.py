"""Loadings by power iteration against numpy's eigenvectors of the whole correlation matrix."""

import numpy as np
import pytest

from spreadloom.operators import decomp


def series(n_targets, n_dates, seed=1):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(n_dates, 3)) * [3.0, 2.0, 1.0]
    ret = common @ rng.normal(size=(3, n_targets)) + 0.5 * rng.normal(size=(n_dates, n_targets))
    return np.cumsum(ret, axis=0)


def by_numpy(px, k):
    ret = np.diff(px, axis=0)
    x = (ret - ret.mean(axis=0)) / ret.std(axis=0, ddof=1)
    vectors = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :k]
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])


def table(spark, px, drop=()):
    rows = [(f"t{j:03d}", d, float(px[d, j])) for d in range(px.shape[0]) for j in range(px.shape[1]) if (j, d) not in drop]
    return spark.createDataFrame(rows, "target string, date_id int, px double")


@pytest.mark.parametrize(("n_targets", "k", "extra"), [(7, 5, 10), (40, 3, 4), (3, 5, 10)])
def test_loadings_against_numpy(spark, n_targets, k, extra):
    px = series(n_targets, 60)
    got = decomp.pca_loadings(table(spark, px), 49, k, extra).collect()
    own = np.zeros((n_targets, min(k, n_targets)))
    for r in got:
        own[int(r.target[1:]), r.component] = r.loading
    assert own == pytest.approx(by_numpy(px[:50], min(k, n_targets)), abs=1e-6)


def test_dates_that_lack_a_target_are_left_out(spark):
    px = series(6, 40)
    # the returns of dates 10 and 11 lack target 2: the one of 11 spans two dates
    got = {(r.target, r.component): r.loading for r in decomp.pca_loadings(table(spark, px, {(2, 10)}), 39, 2).collect()}
    ret = np.diff(px, axis=0)
    ret[10, 2] = px[11, 2] - px[9, 2]
    ret = np.delete(ret, 9, axis=0)
    x = (ret - ret.mean(axis=0)) / ret.std(axis=0, ddof=1)
    vectors = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :2]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(2)])
    assert [got[f"t{i:03d}", j] for i in range(6) for j in range(2)] == pytest.approx(vectors.ravel().tolist(), abs=1e-6)
    with pytest.raises(ValueError, match="no complete train dates"):
        decomp.pca_loadings(table(spark, px), -1)
