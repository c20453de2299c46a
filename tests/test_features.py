import math

import numpy as np
import pytest

from spreadloom.operators import factors, labels, metrics, models, screen, stats, symbolic, technical


def curve(n=420, seed=0):
    return np.cumsum(np.random.default_rng(seed).normal(size=n)) / 50


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(t, i, float(v)) for t, s in (("a", 0), ("b", 1), ("c", 2)) for i, v in enumerate(curve(seed=s))]
    return spark.createDataFrame(rows, "target string, date_id int, px double")


def column(df, name, target="a"):
    return np.array([r[name] for r in df.where(f"target = '{target}'").orderBy("date_id").collect()], float)


def test_ema_is_seeded_with_a_mean():
    x = np.arange(10.0)
    e = technical.ema(x, 4)
    assert np.isnan(e[:3]).all()
    assert e[3] == 1.5
    assert e[4] == pytest.approx(1.5 + 0.4 * 2.5)


def test_indicators_of_a_line():
    x = np.arange(80.0)
    assert technical.rsi(x, 14)[14:].tolist() == [100.0] * 66
    line, signal, rest = technical.macd(x)
    assert np.isnan(line[:33]).all()
    assert np.allclose(line[33:], 7)
    assert np.allclose(rest[33:], 0)
    assert np.allclose(technical.tema(x)[27:], x[27:])
    assert np.allclose(technical.dema(x)[38:], x[38:])
    assert np.isnan(technical.kama(x)[:10]).all()
    assert technical.rsi(np.ones(40), 14)[20] == 0


def test_framed_indicators(panel):
    out = technical.framed_features(panel.withColumnRenamed("px", "x"))
    x = curve()
    assert column(out, "sma_10")[50] == pytest.approx(x[41:51].mean())
    assert column(out, "bb_upper_20")[50] == pytest.approx(x[31:51].mean() + 2 * x[31:51].std())
    slope, cut = np.polyfit(np.arange(14), x[37:51], 1)
    assert column(out, "linreg_14")[50] == pytest.approx(cut + 13 * slope)
    assert column(out, "linreg_slope_14")[50] == pytest.approx(slope)
    assert column(out, "sma_10")[0] == column(out, "sma_10")[9]  # filled backward


def test_all_thirty(panel):
    out = technical.technical_features(panel.withColumnRenamed("px", "x"))
    assert len(out.columns) == 32
    assert out.na.drop().count() == panel.count()


def test_factors(panel):
    out = factors.factor_features(panel)
    x = curve()
    d = np.diff(x)
    assert len(out.columns) == 17
    assert column(out, "vol_20")[100] == pytest.approx(d[80:100].std(ddof=1))
    assert column(out, "reversal_5")[100] == pytest.approx(-d[94:99].mean())
    assert column(out, "momentum_60")[100] == pytest.approx(d[40:100].sum())


@pytest.mark.parametrize("w", stats.FOURIER)
def test_fourier(panel, w):
    out = stats.fourier_features(panel, (w,))
    x = curve()
    amp, phase = column(out, f"fourier_amp_{w}"), column(out, f"fourier_phase_{w}")
    for i in (w - 1, w + 5, 400):
        c = np.fft.rfft(x[i - w + 1 : i + 1] - x[i - w + 1 : i + 1].mean())[1]
        assert amp[i] == pytest.approx(abs(c) / w, abs=1e-10)
        assert math.cos(phase[i]) == pytest.approx(math.cos(np.angle(c)), abs=1e-7)
    assert amp[w - 2] == 0


def test_hurst_ou_and_tails(panel):
    x = curve()
    out = stats.reversion_features(panel)
    y = x[200 - 29 : 201]
    c = np.cumsum(y - y.mean())
    assert column(out, "hurst_30")[200] == pytest.approx(np.log((c.max() - c.min()) / y.std()) / np.log(30))
    assert column(out, "hurst_30")[28] == 0.5
    b = np.cov(y[:-1], y[1:], ddof=0)[0, 1] / y[:-1].var()
    assert column(out, "ou_speed_30")[200] == pytest.approx(-np.log(b) if 0 < b < 1 else 0)
    risk = stats.risk_features(panel)
    d = np.diff(x)[110:200]
    assert column(risk, "var_5")[200] == pytest.approx(-np.quantile(d, 0.05))
    tail = np.sort(np.maximum(-d, 0))[::-1][:9]
    assert column(risk, "hill_alpha")[200] == pytest.approx(9 / (np.log(tail).sum() - 9 * np.log(tail[-1])))


def test_constant_series_has_neutral_values(spark):
    df = spark.createDataFrame([(t, i, 1.0) for t in "ab" for i in range(100)], "target string, date_id int, px double")
    assert {r[0] for r in stats.market_features(df).select("corr_market_90").collect()} == {0.0}
    assert {r[0] for r in stats.moment_features(df).select("kurt_90").collect()} == {0.0}
    assert {r[0] for r in stats.fourier_features(df, (30,)).select("fourier_amp_30").collect()} == {0.0}
    assert {r[0] for r in stats.reversion_features(df).select("hurst_90").collect()} == {0.5}


def test_cointegration_residual(spark):
    df = spark.createDataFrame([("t", 0, 3.0, 1.0), ("t", 1, 5.0, 2.0)], "target string, date_id int, y double, x double")
    out = df.select("date_id", stats.coint_column(2).alias("r")).orderBy("date_id").collect()
    assert [round(r.r, 9) for r in out] == [0.0, -0.3]


def test_label_shift_and_weights(spark):
    lab = spark.createDataFrame([("t", i, float(i)) for i in range(4)], "target string, date_id int, label double")
    assert [r.label for r in labels.shifted(lab, 1).orderBy("date_id").collect()] == [2, 3, None, None]
    df = spark.range(1958).selectExpr("'t' AS target", "CAST(id AS int) AS date_id")
    w = [r.weight for r in labels.sample_weights(df, "recency_exp", 3.0, 0.5, 10.0).collect()]
    assert np.mean(w) == pytest.approx(1)
    assert min(w) == pytest.approx(0.188, abs=1e-3)
    assert max(w) == pytest.approx(1.878, abs=1e-3)
    with pytest.raises(ValueError, match="unknown"):
        labels.sample_weights(df, "other", 1.0)
    with pytest.raises(ValueError, match="other"):
        labels.sample_weights(df, "other", 0.0)
    own = lambda *a: [r.weight for r in labels.sample_weights(df, *a).orderBy("date_id").collect()]
    assert own("EXP", 3.0) == own("recency_exp", 3.0)
    assert own("exp", -1.0) == own(None, 3.0) == own("off", 3.0) == [1.0] * len(w)
    assert own("linear", -0.5) == sorted(own("linear", -0.5), reverse=True) != own("linear", 0.0)
    assert own("linear", -4.0)[-1] == -3.0  # without a positive mean, weights stay as they are


def test_sequences_are_full_windows(panel):
    out = labels.sequences(panel, ["px"], 5).where("target = 'a'").orderBy("date_id").collect()
    assert out[0].date_id == 4
    assert [v[0] for v in out[0].sequence] == pytest.approx(curve()[:5].tolist(), rel=1e-6)


def test_rank_ic(spark):
    rows = [(f"t{i}", 0, float(p), float(y)) for i, (p, y) in enumerate(zip([1, 2, 3], [3, 2, 1], strict=True))] + [("t0", 1, 1.0, 1.0), ("t1", 1, 2.0, None)]
    ic = metrics.daily_ic(spark.createDataFrame(rows, "target string, date_id int, pred double, label double"))
    assert [(r.date_id, round(r.ic, 9), r.n) for r in ic.collect()] == [(0, -1.0, 3)]


def test_eda_and_screens(spark):
    from spreadloom.operators import eda

    long = spark.createDataFrame([("t", i, "f", v) for i, v in enumerate([0.0, 1e-13, 2.0, None])], "target string, date_id int, feature string, value double")
    r = eda.feature_summary(long).first()
    assert (round(r.zero_ratio, 4), round(r["mean"], 4), round(r["std"], 4), r.n) == (0.6667, 0.6667, 0.9428, 3)
    assert screen.impute(long, screen.fit_medians(long, 3)).where("value IS NULL").count() == 0
    with pytest.raises(Exception, match="missing value"):
        screen.require_complete(spark.createDataFrame([("t", 0, None)], "target string, date_id int, f double"), ["f"]).collect()


def test_grid(spark):
    assert models.grid(spark).count() == 26244
    assert models.sampled_grid(spark, 7, 1, {"a": [1, 2], "b": [1, 2, 3, 4, 5]}).count() == 7


def test_programs(spark):
    df = spark.createDataFrame([("t", 0, 2.0, 0.0)], "target string, date_id int, a double, b double")
    out = symbolic.evaluated(df, [("div", "a", "b"), ("log", "b"), ("add", "a", ("mul", "a", 3.0))]).first()
    assert (out.gp_0, out.gp_1, out.gp_2) == (1.0, 0.0, 8.0)
    with pytest.raises(KeyError):
        symbolic.evaluated(df, ["absent"])


def test_evolution_is_the_same_for_a_seed(panel):
    rows = factors.factor_features(panel, ["ret_1", "vol_20"]).join(panel.withColumnRenamed("px", "label"), ["target", "date_id"])
    a, b = (symbolic.evolve(rows, ["ret_1", "vol_20"], outputs=3, population=10, generations=2) for _ in range(2))
    assert a == b
    assert len(a) == 3


def test_one_exchange_by_target(panel):
    plan = factors.factor_features(panel.repartition("target"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_wide_figures_equal_the_long_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(t, d, None if rng.random() < 0.2 else float(rng.normal(k)), 3.0, None if t == "b" else float(d)) for k, t in enumerate("abc") for d in range(12)]
    wide = spark.createDataFrame(rows, "target string, date_id int, x double, flat double, z double")
    names = ["x", "flat", "z"]
    fitted, long = screen.fit_wide(wide, names, 8), screen.to_long(wide, names)
    table = lambda df: {(r.target, r.date_id, r.feature): r.value for r in df.collect()}
    for ours, theirs in ((screen.imputed_wide, screen.impute(long, screen.fit_medians(long, 8))), (screen.normalized_wide, screen.normalize(long, screen.fit_normalizer(long, 8)))):
        a, b = table(screen.to_long(ours(wide, fitted, names), names)), table(theirs)
        assert a.keys() == b.keys()
        assert all(a[k] == b[k] or a[k] == pytest.approx(b[k]) for k in a)
    got = screen.screened_wide(wide, fitted, names, 0.0).collect()
    assert all(r.flat == 0.0 and r.x is not None and (r.z == 0.0 if r.target == "b" else r.z == r.date_id) for r in got)
    with pytest.raises(ValueError, match="no feature"):
        screen.screened_wide(wide.select("target", "date_id", "flat"), screen.fit_wide(wide, ["flat"], 8), ["flat"], 0.0)
    plan = screen.normalized_wide(wide, fitted, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(target") <= 3
