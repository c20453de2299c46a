"""The queries as DuckDB SQL, written independently of the Spark expressions where that is cheap.

Recursions (trend fill, exponential averages) are recursive common tables; spectra are sums over lists.
"""

from __future__ import annotations

import math

from ..operators import models, stats, technical
from ..sources.driver_tables import SEGMENTS, SPECS, TRAIN_END

_SPECS = ", ".join(f"('{t}', {lag}, '{pair}')" for t, lag, pair in SPECS)

PANEL = f"""WITH RECURSIVE
daily AS (SELECT c_mktsegment AS asset, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::INT AS date_id, sum(o_totalprice) AS s, count(*) AS n
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
observed AS (SELECT date_id, asset, sum(s) OVER w / sum(n) OVER w AS price FROM daily WINDOW w AS (PARTITION BY asset ORDER BY date_id)),
prices AS (SELECT d.date_id, a.asset, o.price FROM (SELECT DISTINCT date_id FROM observed) d CROSS JOIN (SELECT DISTINCT asset FROM observed) a
           LEFT JOIN observed o ON o.date_id = d.date_id AND o.asset = a.asset),
seq AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date_id) AS i FROM prices),
tf(asset, i, cur, diffs) AS (
  SELECT DISTINCT asset, 0::BIGINT, NULL::DOUBLE, []::DOUBLE[] FROM prices
  UNION ALL
  SELECT s.asset, s.i, CASE WHEN s.price IS NOT NULL THEN s.price WHEN t.cur IS NOT NULL THEN t.cur + coalesce(list_avg(t.diffs), 0) END,
         CASE WHEN s.price IS NOT NULL AND t.cur IS NOT NULL THEN list_append(t.diffs, s.price - t.cur)[-5:] ELSE t.diffs END
  FROM tf t JOIN seq s ON s.asset = t.asset AND s.i = t.i + 1),
filled AS (SELECT s.date_id, s.asset, coalesce(t.cur, first_value(t.cur IGNORE NULLS) OVER (PARTITION BY s.asset ORDER BY s.date_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS price
           FROM seq s JOIN tf t ON t.asset = s.asset AND t.i = s.i),
specs(target, lag, pair) AS (VALUES {_SPECS}),
terms AS (SELECT target, lag, 0 AS pos, trim(split_part(pair, ' - ', 1)) AS asset, 1.0::DOUBLE AS weight FROM specs
          UNION ALL SELECT target, lag, 1, trim(split_part(pair, ' - ', 2)), -1.0 FROM specs WHERE pair LIKE '% - %'),
tgt AS (SELECT target, date_id, sum(weight * ln(greatest(price, 1e-8))) AS px FROM terms JOIN filled USING (asset) GROUP BY 1, 2),
ret AS (SELECT *, px - lag(px) OVER (PARTITION BY target ORDER BY date_id) AS ret, row_number() OVER (PARTITION BY target ORDER BY date_id) AS pos FROM tgt),
lab AS (SELECT target, date_id, ret AS label FROM ret)"""

O = "PARTITION BY target ORDER BY date_id"


def frame(w: int) -> str:
    return f"OVER ({O} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(w: int, x: str, value: str) -> str:
    return f"CASE WHEN count({x}) {frame(w)} = {w} THEN {value} END"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def fill(x: str, key: str = "target") -> str:
    return (
        f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({x} IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY date_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


FACTORS = {f"ret_{k}": f"px - lag(px, {k}) OVER ({O})" for k in (1, 5, 10, 20)}
FACTORS |= {f"vol_{w}": f"stddev_samp(ret) {frame(w)}" for w in (5, 20, 60)}
FACTORS |= {f"sharpe_{w}": f"CASE WHEN stddev_samp(ret) {frame(w)} = 0 THEN 0 ELSE avg(ret) {frame(w)} / stddev_samp(ret) {frame(w)} END" for w in (20, 60)}
FACTORS |= {f"zscore_{w}": f"(px - avg(px) {frame(w)}) / nullif(stddev_samp(px) {frame(w)}, 0)" for w in (20, 60)}
FACTORS |= {f"momentum_{w}": f"sum(ret) {frame(w)}" for w in (20, 60)}
FACTORS |= {"reversal_5": f"-avg(ret) OVER ({O} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "rolling_min_20": f"min(px) {frame(20)}"}


def factor_cte(names: list[str], name: str = "fac") -> str:
    raw = ", ".join(f"{FACTORS[n]} AS {n}" for n in names)
    return f"{name}_raw AS (SELECT target, date_id, {raw} FROM ret),\n{name} AS (SELECT target, date_id, {', '.join(f'{fill(n)} AS {n}' for n in names)} FROM {name}_raw)"


CORE = ["ret_1", "vol_20", "sharpe_20", "momentum_20"]


def sql(select: str, *ctes: str) -> str:
    return ",\n".join([PANEL, *ctes]) + "\n" + select


def features(names: list[str], digits: int = 6) -> str:
    return sql(f"SELECT target, date_id, {', '.join(f'{r(n, digits)} AS {n}' for n in names)} FROM fac", factor_cte(names))


def framed(columns: dict[str, str], digits: int = 6, src: str = "ret", x: str = "px") -> str:
    raw = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return sql(f"SELECT target, date_id, {', '.join(f'{r(fill(k), digits)} AS {k}' for k in columns)} FROM (SELECT target, date_id, {raw} FROM {src})")


def sma(w: int, x: str = "px") -> str:
    return full(w, x, f"avg({x}) {frame(w)}")


def linreg() -> dict[str, str]:
    slope = f"regr_slope(px, pos::DOUBLE) {frame(14)}"
    return {"linreg_14": full(14, "px", f"regr_intercept(px, pos::DOUBLE) {frame(14)} + {slope} * pos"), "linreg_slope_14": full(14, "px", slope)}


# ---------------------------------------------------------------- recursions over rows (target, i, x)


def series(src: str, x: str, name: str = "s0") -> str:
    return f"{name} AS (SELECT target, date_id, {x} AS x, row_number() OVER ({O}) AS i FROM {src})"


def ema_cte(name: str, src: str, n: int, seed: int | None = None) -> str:
    """name(target, i, x): i counts from the seed row on, as 1; off is added to get back to rows of src."""
    at = seed or n
    return (
        f"{name}_r(target, i, x) AS (SELECT target, {at}::BIGINT, avg(x) FROM {src} WHERE i BETWEEN {at - n + 1} AND {at} GROUP BY target HAVING count(*) = {n} "
        f"UNION ALL SELECT s.target, s.i, e.x + {2 / (n + 1)!r} * (s.x - e.x) FROM {name}_r e JOIN {src} s ON s.target = e.target AND s.i = e.i + 1),\n"
        f"{name} AS (SELECT target, i - {at - 1} AS i, x FROM {name}_r)"
    )


def recursive(out: dict[str, tuple[str, int]], *ctes: str, digits: int = 4, src: str = "tgt", x: str = "px") -> str:
    """out: name -> (table of (target, i, x), offset to rows of the series)."""
    joins = " ".join(f"LEFT JOIN {t} t{k} ON t{k}.target = s.target AND t{k}.i + {off} = s.i" for k, (t, off) in enumerate(out.values()))
    raw = f"j AS (SELECT s.target, s.date_id, {', '.join(f't{k}.x AS {n}' for k, n in enumerate(out))} FROM s0 s {joins})"
    return sql(f"SELECT target, date_id, {', '.join(f'{r(fill(n), digits)} AS {n}' for n in out)} FROM j", series(src, x), *ctes, raw)


def rsi_cte(name: str, n: int) -> str:
    return (
        f"{name}_d AS (SELECT target, i, greatest(x - lag(x) OVER w, 0) AS g, greatest(lag(x) OVER w - x, 0) AS l FROM s0 WINDOW w AS (PARTITION BY target ORDER BY i)),\n"
        f"{name}_r(target, i, g, l) AS (SELECT target, {n + 1}::BIGINT, avg(g), avg(l) FROM {name}_d WHERE i BETWEEN 2 AND {n + 1} GROUP BY target HAVING count(*) = {n} "
        f"UNION ALL SELECT d.target, d.i, (e.g * {n - 1} + d.g) / {n}, (e.l * {n - 1} + d.l) / {n} FROM {name}_r e JOIN {name}_d d ON d.target = e.target AND d.i = e.i + 1),\n"
        f"{name} AS (SELECT target, i, CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END AS x FROM {name}_r)"
    )


def kama_cte(n: int = 10) -> str:
    return (
        f"k_d AS (SELECT target, i, x, x - lag(x, {n}) OVER w AS ch, lag(x) OVER w AS before, abs(x - lag(x) OVER w) AS st FROM s0 WINDOW w AS (PARTITION BY target ORDER BY i)),\n"
        f"k_e AS (SELECT target, i, x, ch, sum(st) OVER (PARTITION BY target ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS path FROM k_d),\n"
        f"k_f AS (SELECT target, i, x, pow((CASE WHEN path <= ch OR path = 0 THEN 1 ELSE abs(ch / path) END) * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2) AS sc FROM k_e),\n"
        f"k_r(target, i, x) AS (SELECT target, {n}::BIGINT, x FROM s0 WHERE i = {n} "
        f"UNION ALL SELECT f.target, f.i, k.x + f.sc * (f.x - k.x) FROM k_r k JOIN k_f f ON f.target = k.target AND f.i = k.i + 1),\n"
        f"kama AS (SELECT target, i, x FROM k_r WHERE i > {n})"
    )


def combined(name: str, parts: dict[str, int], expr: str) -> str:
    """name(target, i, x) from ema tables a, b, c with offsets to rows of s0."""
    first = next(iter(parts))
    joins = " ".join(f"JOIN {t} ON {t}.target = {first}.target AND {t}.i + {off} = {first}.i + {parts[first]}" for t, off in list(parts.items())[1:])
    return f"{name} AS (SELECT {first}.target, {first}.i + {parts[first]} AS i, {expr} AS x FROM {first} {joins})"


# ---------------------------------------------------------------- statistics

MARKET = f"mk AS (SELECT *, avg(ret) OVER (PARTITION BY date_id) AS mkt FROM ret)"
LP = "lp AS (SELECT date_id, asset, ln(greatest(price, 1e-8)) AS lp FROM filled)"
INDEX = """idx AS (SELECT date_id, sum(d) OVER (ORDER BY date_id) AS idx FROM (SELECT date_id, coalesce(avg(d), 0) AS d FROM
  (SELECT date_id, lp - lag(lp) OVER (PARTITION BY asset ORDER BY date_id) AS d FROM lp) GROUP BY date_id))"""


def stat(columns: dict[str, str], src: str = "ret", digits: int = 6, *ctes: str) -> str:
    return sql(f"SELECT target, date_id, {', '.join(f'{r(f'coalesce({v}, 0)', digits)} AS {k}' for k, v in columns.items())} FROM {src}", *ctes)


def corr(w: int) -> str:
    return full(w, "ret", f"covar_samp(ret, mkt) {frame(w)} / nullif(stddev_samp(ret) {frame(w)} * stddev_samp(mkt) {frame(w)}, 0)")


def windows(w: int, x: str, src: str = "ret") -> str:
    return f"wn AS (SELECT target, date_id, CASE WHEN count({x}) {frame(w)} = {w} THEN list({x}) {frame(w)} END AS v FROM {src})"


def fourier(w: int) -> str:
    # positions within a window, without turning sums
    c = f"list_sum(list_transform(v, lambda x, i: (x - m) * cos(2 * pi() * (i - 1) / {w})))"
    s = f"list_sum(list_transform(v, lambda x, i: (x - m) * sin(2 * pi() * (i - 1) / {w})))"
    return sql(
        f"""SELECT target, date_id, {r('amp')} AS fourier_amp_{w}, {r('CASE WHEN amp > 1e-4 THEN re / (amp * ' + str(w) + ') ELSE 0 END', 4)} AS phase_cos,
        {r('CASE WHEN amp > 1e-4 THEN im / (amp * ' + str(w) + ') ELSE 0 END', 4)} AS phase_sin FROM
        (SELECT target, date_id, re, im, CASE WHEN v IS NULL OR flat THEN 0 ELSE sqrt(re * re + im * im) / {w} END AS amp FROM
        (SELECT target, date_id, v, greatest(list_max(v) - m, m - list_min(v)) <= 1e-8 AS flat, {c} AS re, -{s} AS im FROM (SELECT *, list_avg(v) AS m FROM wn)))""",
        windows(w, "px"),
    )


def hurst(w: int) -> str:
    return f"""h{w} AS (SELECT target, date_id, CASE WHEN v IS NULL THEN 0.5 WHEN sd > 1e-8 AND list_max(c) - list_min(c) > 1e-8 THEN ln((list_max(c) - list_min(c)) / sd) / {math.log(w)!r} ELSE 0.5 END AS h FROM
      (SELECT target, date_id, v, list_stddev_pop(v) AS sd, list_transform(v, lambda x, i: list_sum(v[1:i]) - i * list_avg(v)) AS c FROM
      (SELECT target, date_id, CASE WHEN count(px) {frame(w)} = {w} THEN list(px) {frame(w)} END AS v FROM ret)))"""


def ou(w: int) -> str:
    f = f"OVER ({O} ROWS BETWEEN {w - 2} PRECEDING AND CURRENT ROW)"
    return f"""ou{w} AS (SELECT target, date_id, CASE WHEN n = {w} AND b > 0 AND b < 1 THEN -ln(b) ELSE 0 END AS speed, CASE WHEN n = {w} AND abs(1 - b) > 1e-8 THEN (my - b * mx) / (1 - b) ELSE 0 END AS mean FROM
      (SELECT *, CASE WHEN vx <= 1e-8 THEN 0 ELSE cv / vx END AS b FROM
      (SELECT target, date_id, count(px) {frame(w)} AS n, var_pop(p) {f} AS vx, covar_pop(p, px) {f} AS cv, avg(px) {f} AS my, avg(p) {f} AS mx FROM (SELECT *, lag(px) OVER ({O}) AS p FROM tgt))))"""


def hill() -> str:
    k = 9
    return sql(
        f"""SELECT target, date_id, {r(f'CASE WHEN t IS NOT NULL AND t[{k}] > 0 THEN coalesce({k} / nullif(list_sum(list_transform(t, lambda x: ln(greatest(x, 1e-300)))) - {k} * ln(greatest(t[{k}], 1e-300)), 0), 0) ELSE 0 END', 4)} AS hill_alpha FROM
        (SELECT target, date_id, list_reverse_sort(list_transform(v, lambda x: greatest(-x, 0.0)))[1:{k}] AS t FROM wn)""",
        windows(90, "ret"),
    )


def coint(w: int) -> str:
    slope = f"coalesce(sum(x * y) {frame(w)} / nullif(sum(x * x) {frame(w)}, 0), 0)"
    return full(w, "y", f"y - {slope} * x - (avg(y) {frame(w)} - {slope} * avg(x) {frame(w)})")


COINT = """ci AS (SELECT t.target, t.date_id, a.lp AS y, coalesce(b.lp, idx.idx) AS x FROM tgt t JOIN terms ta ON ta.target = t.target AND ta.pos = 0
  LEFT JOIN terms tb ON tb.target = t.target AND tb.pos = 1 JOIN lp a ON a.date_id = t.date_id AND a.asset = ta.asset
  LEFT JOIN lp b ON b.date_id = t.date_id AND b.asset = tb.asset JOIN idx ON idx.date_id = t.date_id)"""

LONG = "lg AS (" + " UNION ALL ".join(f"SELECT target, date_id, '{n}' AS feature, {n} AS value FROM fac" for n in CORE) + ")"
GAPPY = "gp AS (SELECT target, date_id, feature, CASE WHEN date_id % 7 <> 0 THEN value END AS value FROM lg)"
PRED = f"pr AS (SELECT target, date_id, round(label, 9) + 0.0 AS label, round(avg(label) OVER ({O} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 9) + 0.0 AS pred FROM lab)"
IC = """rk AS (SELECT date_id, row_number() OVER (PARTITION BY date_id ORDER BY pred, target) AS x, row_number() OVER (PARTITION BY date_id ORDER BY label, target) AS y
  FROM pr WHERE pred IS NOT NULL AND label IS NOT NULL),
ic AS (SELECT date_id, corr(x, y) AS ic, count(*) AS n FROM rk GROUP BY date_id HAVING count(*) >= 3)"""
NAV = f"""nv AS (SELECT target, date_id, s.pair NOT LIKE '% - %' AS single,
  CASE WHEN s.pair NOT LIKE '% - %' THEN sum(coalesce(ret, 0)) OVER ({O}) ELSE product(1 + coalesce(ret, 0)) OVER ({O}) END AS nav FROM ret JOIN specs s USING (target))"""
OVERLAP = """ovl AS (SELECT date_id, asset, price, 0 AS src FROM observed WHERE date_id <= 1200 UNION ALL SELECT date_id, asset, price * 2, 1 FROM observed WHERE date_id > 1100)"""


# fixed values: the published grid
GRID_SQL = """SELECT * FROM (VALUES (160.0::DOUBLE), (200.0), (240.0), (280.0)) a(num_boost_round) CROSS JOIN (VALUES (0.03::DOUBLE), (0.05), (0.07)) b(learning_rate)
CROSS JOIN (VALUES (16.0::DOUBLE), (31.0), (48.0)) c(num_leaves) CROSS JOIN (VALUES (0.6::DOUBLE), (0.7), (0.8)) d(feature_fraction) CROSS JOIN (VALUES (0.6::DOUBLE), (0.7), (0.8)) e(bagging_fraction)
CROSS JOIN (VALUES (30.0::DOUBLE), (50.0), (80.0)) f(min_data_in_leaf) CROSS JOIN (VALUES (0.0::DOUBLE), (0.001), (0.01)) g(lambda_l1) CROSS JOIN (VALUES (0.001::DOUBLE), (0.01), (0.1)) h(lambda_l2)
CROSS JOIN (VALUES (10.0::DOUBLE), (20.0), (30.0)) i(early_stopping_rounds)"""


def grid_sql(values: dict[str, list]) -> str:
    return " CROSS JOIN ".join(f"(VALUES {', '.join(f'({float(v)!r}::DOUBLE)' for v in options)}) g{i}({name})" for i, (name, options) in enumerate(values.items()))


def weights(where: str, expr: str) -> str:
    return sql(
        f"SELECT target, date_id, {r('w / avg(w) OVER (PARTITION BY target)')} AS weight FROM wt",
        f"ds AS (SELECT target, date_id, date_id - min(date_id) OVER (PARTITION BY target) AS d FROM tgt WHERE {where}), rl AS (SELECT *, d::DOUBLE / max(d) OVER (PARTITION BY target) AS rel FROM ds), wt AS (SELECT target, date_id, {expr} AS w FROM rl)",
    )


EXP = "greatest(0.5, least(10.0, exp(rel * 3.0)))"


def program(p) -> str:
    if isinstance(p, str):
        return p
    if not isinstance(p, tuple):
        return repr(float(p))
    a = [f"({program(x)})" for x in p[1:]]
    return {
        "add": lambda: f"{a[0]} + {a[1]}", "sub": lambda: f"{a[0]} - {a[1]}", "mul": lambda: f"{a[0]} * {a[1]}",
        "div": lambda: f"CASE WHEN abs({a[1]}) > 0.001 THEN {a[0]} / {a[1]} ELSE 1 END", "sqrt": lambda: f"sqrt(abs({a[0]}))",
        "log": lambda: f"CASE WHEN abs({a[0]}) > 0.001 THEN ln(abs({a[0]})) ELSE 0 END", "abs": lambda: f"abs({a[0]})", "sin": lambda: f"sin({a[0]})", "cos": lambda: f"cos({a[0]})",
    }[p[0]]()


def oracle_sql() -> dict[str, str]:
    from .queries import GRID_SMALL, PROGRAMS

    core = factor_cte(CORE)
    tech = {f"sma_{n}": sma(n) for n in technical.SMA}
    moms = {f"mom_{n}": f"px - lag(px, {n}) OVER ({O})" for n in technical.MOM}
    rocs = {f"roc_{n}": f"CASE WHEN lag(px, {n}) OVER ({O}) = 0 THEN 0 ELSE 100 * (px / lag(px, {n}) OVER ({O}) - 1) END" for n in technical.ROC}
    diff = f"(avg(px) {frame(12)} - avg(px) {frame(26)})"
    band = f"stddev_pop(px) {frame(20)}"
    n_grid = {**GRID_SMALL}
    keep = lambda cols, src: f"SELECT {cols} FROM {src}"
    o = {
        "price_panel": sql(keep(f"date_id, asset, {r('price')} AS price", "prices")),
        "pair_parse": sql("SELECT target, lag, pos, asset, weight FROM terms"),
        "specs_by_lag": sql("SELECT lag, string_agg(target, ',' ORDER BY target) AS targets FROM specs GROUP BY lag"),
        "lag_filter": sql("SELECT target, count(*) AS n FROM tgt WHERE target IN (SELECT target FROM specs WHERE lag = 2) GROUP BY target"),
        "required_assets": sql("SELECT DISTINCT asset FROM terms"),
        "missing_assets": sql("SELECT DISTINCT asset FROM terms WHERE asset NOT IN (SELECT asset FROM observed WHERE asset <> 'MACHINERY')"),
        "union_common": sql(f"SELECT asset, src, count(*) AS n, {r('sum(price)', 2)} AS total FROM ovl GROUP BY asset, src", OVERLAP),
        "dedup_last": sql(f"SELECT date_id, asset, {r('arg_max(price, src)', 5)} AS price, max(src) AS src FROM ovl GROUP BY date_id, asset", OVERLAP),
        "trend_fill": sql(f"SELECT date_id, asset, {r('price', 5)} AS price FROM filled"),
        "ffill_bfill": sql(f"SELECT date_id, asset, {r(fill('price', 'asset'), 5)} AS price FROM prices"),
        "zscore_normalize": sql(f"SELECT date_id, asset, {r('(price - avg(price) OVER (PARTITION BY asset)) / stddev_samp(price) OVER (PARTITION BY asset)', 5)} AS price FROM filled"),
        "numeric_columns": "SELECT column_name AS name FROM (DESCRIBE orders) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND column_name <> 'o_orderkey'",
        "target_spread": sql(f"SELECT target, date_id, {r('px')} AS px FROM tgt"),
        "target_level": sql(f"SELECT target, date_id, {r('sum(weight * z)', 5)} AS px FROM terms JOIN zs USING (asset) GROUP BY 1, 2", "zs AS (SELECT date_id, asset, (price - avg(price) OVER (PARTITION BY asset)) / stddev_samp(price) OVER (PARTITION BY asset) AS z FROM filled)"),
        "target_returns": sql(f"SELECT target, date_id, {r('ret')} AS ret FROM ret"),
        "log_prices": sql(f"SELECT date_id, asset, {r('lp')} AS lp FROM lp", LP),
        "nav_additive": sql(f"SELECT target, date_id, {r('nav', 5)} AS nav FROM nv WHERE single", NAV),
        "nav_multiplicative": sql(f"SELECT target, date_id, {r('nav', 5)} AS nav FROM nv WHERE NOT single", NAV),
        "factor_core": features(CORE),
        "factor_returns": features(["ret_1", "ret_5", "ret_10", "ret_20"]),
        "factor_vol": features(["vol_5", "vol_20", "vol_60"]),
        "factor_sharpe": features(["sharpe_20", "sharpe_60"]),
        "factor_zscore": features(["zscore_20", "zscore_60"]),
        "factor_momentum": features(["momentum_20", "momentum_60"]),
        "factor_reversal": features(["reversal_5"]),
        "factor_rolling_min": features(["rolling_min_20"]),
        "sma": framed(tech),
        "mom": framed(moms),
        "roc": framed(rocs, 2),
        "apo": framed({"apo": full(26, "px", diff)}),
        "ppo": framed({"ppo": full(26, "px", f"CASE WHEN avg(px) {frame(26)} = 0 THEN 0 ELSE 100 * {diff} / avg(px) {frame(26)} END")}, 2),
        "bbands": framed({"bb_upper_20": full(20, "px", f"avg(px) {frame(20)} + 2 * {band}"), "bb_middle_20": sma(20), "bb_lower_20": full(20, "px", f"avg(px) {frame(20)} - 2 * {band}")}),
        "linreg": framed(linreg()),
        "ema": recursive({f"ema_{n}": (f"e{n}", n - 1) for n in technical.EMA}, *(ema_cte(f"e{n}", "s0", n) for n in technical.EMA)),
        "rsi": recursive({f"rsi_{n}": (f"rsi{n}", 0) for n in technical.RSI}, *(rsi_cte(f"rsi{n}", n) for n in technical.RSI), digits=3),
        "macd": recursive(
            {"macd": ("mline", 33), "macd_signal": ("msig", 33), "macd_hist": ("mhist", 33)},
            ema_cte("f12", "s0", 12, 26), ema_cte("f26", "s0", 26), "ml AS (SELECT f12.target, f12.i, f12.x - f26.x AS x FROM f12 JOIN f26 USING (target, i))", ema_cte("msig", "ml", 9),
            "mline AS (SELECT target, i - 8 AS i, x FROM ml WHERE i > 8)", "mhist AS (SELECT target, i, mline.x - msig.x AS x FROM mline JOIN msig USING (target, i))",
        ),
        "trix": recursive({"trix_15": ("tx", 42)}, ema_cte("t1", "s0", 15), ema_cte("t2", "t1", 15), ema_cte("t3", "t2", 15), "tx AS (SELECT target, i, CASE WHEN p = 0 THEN 0 ELSE 100 * (x / p - 1) END AS x FROM (SELECT *, lag(x) OVER (PARTITION BY target ORDER BY i) AS p FROM t3) WHERE p IS NOT NULL)", digits=3),
        "tema": recursive({"tema_10": ("tm", 0)}, ema_cte("t1", "s0", 10), ema_cte("t2", "t1", 10), ema_cte("t3", "t2", 10), combined("tm", {"t3": 27, "t1": 9, "t2": 18}, "3 * t1.x - 3 * t2.x + t3.x")),
        "dema": recursive({"dema_20": ("dm", 0)}, ema_cte("t1", "s0", 20), ema_cte("t2", "t1", 20), combined("dm", {"t2": 38, "t1": 19}, "2 * t1.x - t2.x")),
        "kama": recursive({"kama_10": ("kama", 0)}, kama_cte()),
        "technical_nav": framed({"sma_20": sma(20, "nav"), "mom_10": f"nav - lag(nav, 10) OVER ({O})", "bb_upper_20": full(20, "nav", f"avg(nav) {frame(20)} + 2 * stddev_pop(nav) {frame(20)}")}, 5, "nv").replace("\nSELECT", f",\n{NAV}\nSELECT", 1),
        "technical_nav_recursive": recursive({"ema_10": ("e10", 9), "rsi_14": ("rsi14", 0)}, ema_cte("e10", "s0", 10), rsi_cte("rsi14", 14), digits=2, src="nv", x="nav").replace("s0 AS (", f"{NAV},\ns0 AS (", 1),
        "market_return": sql(f"SELECT date_id, {r('avg(ret)')} AS mkt FROM ret GROUP BY date_id"),
        "corr_market": stat({f"corr_market_{w}": corr(w) for w in stats.CORR}, "mk", 5, MARKET),
        "beta_market": stat({f"beta_{w}": full(w, "ret", f"covar_samp(ret, mkt) {frame(w)} / nullif(var_samp(mkt) {frame(w)}, 0)") for w in stats.BETA}, "mk", 5, MARKET),
        "rolling_skew": stat({f"skew_{w}": full(w, "ret", f"skewness(ret) {frame(w)}") for w in stats.MOMENTS}, "ret", 4),
        "rolling_kurt": stat({f"kurt_{w}": full(w, "ret", f"kurtosis(ret) {frame(w)}") for w in stats.MOMENTS}, "ret", 3),
        "var_quantile": stat({f"var_{k}": full(90, "ret", f"-quantile_cont(ret, {p}) {frame(90)}") for k, p in ((1, 0.01), (5, 0.05))}),
        "hill_alpha": hill(),
        **{f"fourier_{w}": fourier(w) for w in stats.FOURIER},
        "hurst": sql(f"SELECT target, date_id, {r('h30.h', 5)} AS hurst_30, {r('h90.h', 5)} AS hurst_90 FROM h30 JOIN h90 USING (target, date_id)", hurst(30), hurst(90)),
        "ou_params": sql(f"SELECT target, date_id, {r('ou30.speed', 3)} AS ou_speed_30, {r('ou90.speed', 3)} AS ou_speed_90, {r('ou30.mean', 3)} AS ou_mean_30, {r('ou90.mean', 3)} AS ou_mean_90 FROM ou30 JOIN ou90 USING (target, date_id)", ou(30), ou(90)),
        "coint_resid": stat({f"coint_resid_{w}": coint(w) for w in stats.REVERSION}, "ci", 5, LP, INDEX, COINT),
        "market_index": sql(f"SELECT date_id, {r('idx')} AS idx FROM idx", LP, INDEX),
        "panel_unpivot": sql(f"SELECT target, date_id, feature, {r('value')} AS value FROM lg", core, LONG),
        "panel_pivot": sql("SELECT date_id, " + ", ".join(f"{r(f'max(CASE WHEN asset = {a!r} THEN price END)', 5)} AS {a}" for a in SEGMENTS) + " FROM filled GROUP BY date_id"),
        "wide_fill": sql("SELECT date_id, " + ", ".join(f"{r(f'max(CASE WHEN asset = {a!r} THEN price END)', 5)} AS {a}" for a in SEGMENTS) + " FROM filled GROUP BY date_id"),
        "lag_label_pivot": sql("SELECT date_id, " + ", ".join(f"{r(f'sum(label) FILTER (WHERE lag = {k})')} AS lag_{k}" for k in (1, 2, 3, 4)) + " FROM lab JOIN specs USING (target) GROUP BY date_id"),
        "train_mask": sql(f"SELECT DISTINCT date_id, date_id <= {TRAIN_END} AS is_train FROM tgt"),
        "train_test_split": sql(f"SELECT target, date_id <= {TRAIN_END} AS is_train, count(*) AS n, min(date_id) AS first, max(date_id) AS last FROM tgt GROUP BY 1, 2"),
        "feature_label_join": sql(f"SELECT target, date_id, {r('ret_1')} AS ret_1, {r('label')} AS label FROM fac JOIN lab USING (target, date_id) WHERE label IS NOT NULL", core),
        "mask_left_join": sql(f"SELECT date_id <= {TRAIN_END} AS is_train, count(*) AS n FROM (SELECT DISTINCT date_id FROM tgt) GROUP BY 1"),
        "full_join_blocks": sql(f"SELECT coalesce(a.target, b.target) AS target, coalesce(a.date_id, b.date_id) AS date_id, {r('ret_1')} AS ret_1, {r('vol_20')} AS vol_20 FROM (SELECT target, date_id, ret_1 FROM fac WHERE date_id <= {TRAIN_END}) a FULL JOIN (SELECT target, date_id, vol_20 FROM fac JOIN lab USING (target, date_id) WHERE label IS NOT NULL) b ON a.target = b.target AND a.date_id = b.date_id", core),
        "shared_dates": sql("SELECT DISTINCT date_id FROM lab WHERE label IS NOT NULL"),
        "intersect_keys": sql("SELECT target, date_id FROM lab WHERE label IS NOT NULL"),
        "aligned_columns": sql(f"SELECT target, date_id, {r('ret_1')} AS ret_1, NULL::DOUBLE AS absent FROM fac", core),
        "latest_row": sql(f"SELECT target, date_id, {', '.join(f'{r(n)} AS {n}' for n in CORE)} FROM fac WHERE date_id = (SELECT max(date_id) FROM fac)", core),
        "panel_preview": sql("SELECT date_id, " + ", ".join(f"{r(f'max(CASE WHEN target = {t!r} THEN {c} END)')} AS \"{t}::{c}\"" for t in ("target_0", "target_7") for c in ("ret_1", "vol_20")) + " FROM fac GROUP BY date_id ORDER BY date_id LIMIT 50", core),
        "label_shift": sql(f"SELECT target, date_id, {r(f'lead(label, 3) OVER ({O})')} AS label FROM lab"),
        "label_shift_by_lag": sql(f"SELECT target, l.date_id, {r('m.label')} AS label FROM ll l JOIN specs USING (target) LEFT JOIN ll m ON m.target = l.target AND m.i = l.i + lag + 1".replace("SELECT target,", "SELECT l.target,"), f"ll AS (SELECT *, row_number() OVER ({O}) AS i FROM lab)"),
        "label_batches": sql(
            "SELECT date_id, n_prices::INT AS n_prices, " + ", ".join(f"coalesce(n_{k}, 0)::INT AS n_lag_{k}, {r(f'coalesce(s_{k}, 0)')} AS sum_lag_{k}" for k in (1, 2, 3, 4)) + " FROM days LEFT JOIN known USING (date_id)",
            "days AS (SELECT date_id, count(*) AS n_prices FROM filled GROUP BY 1)",
            f"li AS (SELECT target, date_id, lag, label, row_number() OVER ({O}) AS i FROM lab JOIN specs USING (target))",
            "known AS (SELECT b.date_id, " + ", ".join(f"count(*) FILTER (WHERE a.lag = {k}) AS n_{k}, sum(a.label) FILTER (WHERE a.lag = {k}) AS s_{k}" for k in (1, 2, 3, 4)) + " FROM li a JOIN li b ON a.target = b.target AND b.i = a.i + a.lag + 1 GROUP BY 1)",
        ),
        "sequence_data": sql(
            f"SELECT target, date_id, count(*)::INT AS n, {r('sum(value::FLOAT::DOUBLE)', 4)} AS total, {r('coalesce(any_value(sh.label), 0)')} AS label, count(sh.label) > 0 AS mask FROM rw JOIN kf USING (feature) JOIN sh USING (target, date_id) GROUP BY 1, 2",
            core, LONG, f"sh AS (SELECT target, date_id, lead(label, 2) OVER ({O}) AS label FROM lab JOIN specs USING (target) WHERE lag = 1)",
            "rw AS (SELECT lg.* FROM lg JOIN specs USING (target) WHERE lag = 1 AND date_id IN (SELECT date_id FROM sh WHERE label IS NOT NULL))",
            "kf AS (SELECT feature FROM (SELECT target, feature, var_pop(value) AS v FROM rw GROUP BY 1, 2) GROUP BY feature HAVING avg(v) > 1e-6)",
        ),
        "dataset_windows": sql(
            f"SELECT date_id, split, n_valid, n::INT AS n, {r('total', 3)} AS total, {r('labels')} AS labels FROM sm JOIN ww USING (date_id)",
            core, LONG, f"sh AS (SELECT target, date_id, lead(label, 2) OVER ({O}) AS label FROM lab JOIN specs USING (target) WHERE lag = 1)",
            "rw AS (SELECT lg.* FROM lg JOIN specs USING (target) WHERE lag = 1 AND date_id IN (SELECT date_id FROM sh WHERE label IS NOT NULL))",
            "kf AS (SELECT feature FROM (SELECT target, feature, var_pop(value) AS v FROM rw GROUP BY 1, 2) GROUP BY feature HAVING avg(v) > 1e-6)",
            "dv AS (SELECT target, date_id, feature, value::FLOAT::DOUBLE AS v FROM rw JOIN kf USING (feature))",
            "ps AS (SELECT date_id, row_number() OVER (ORDER BY date_id) - 1 AS pos, count(label) AS n_valid, coalesce(sum(label), 0) AS labels FROM sh WHERE date_id IN (SELECT date_id FROM rw) GROUP BY date_id)",
            f"sm AS (SELECT date_id, n_valid, labels, CASE WHEN date_id <= {TRAIN_END} THEN 'train' ELSE 'valid' END AS split FROM ps WHERE pos >= 191 AND n_valid >= 1)",
            "nm AS (SELECT target, feature, avg(v) AS m, stddev_pop(v) AS s FROM dv WHERE date_id IN (SELECT date_id FROM sm WHERE split = 'train') GROUP BY 1, 2)",
            "dd AS (SELECT date_id, sum(((v - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END)::FLOAT::DOUBLE) AS x, count(*) AS k FROM dv JOIN nm USING (target, feature) GROUP BY date_id)",
            "ww AS (SELECT date_id, sum(x) OVER w AS total, sum(k) OVER w AS n FROM dd WINDOW w AS (ORDER BY date_id ROWS BETWEEN 191 PRECEDING AND CURRENT ROW))",
        ),
        "pca_first": sql(
            f"SELECT target, {r('sign(list_max(v) + list_min(v)) * v[i] / sqrt(list_inner_product(v, v))', 4)} AS loading FROM pw, (SELECT target, row_number() OVER (ORDER BY target) AS i FROM (SELECT DISTINCT target FROM tgt))",
            f"rt AS (SELECT target, date_id, ret FROM ret WHERE date_id <= {TRAIN_END} AND ret IS NOT NULL)",
            "cd AS (SELECT date_id FROM rt GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT target) FROM tgt))",
            "sx AS (SELECT target, date_id, (ret - avg(ret) OVER p) / stddev_samp(ret) OVER p AS x FROM rt JOIN cd USING (date_id) WINDOW p AS (PARTITION BY target))",
            "cv AS (SELECT a.target AS i, b.target AS j, sum(a.x * b.x) AS c FROM sx a JOIN sx b USING (date_id) GROUP BY 1, 2)",
            "cm AS (SELECT list(c ORDER BY i) AS c, list_sum(list(d)) AS trace FROM (SELECT i, list(c ORDER BY j) AS c, sum(c) FILTER (WHERE i = j) AS d FROM cv GROUP BY i))",
            # the power method: the matrix times a vector, over and over
            "pw AS (SELECT list_reduce(list_transform(range(401), lambda k: list_transform(range(1, len(c) + 1), lambda i: 1.0::DOUBLE / i)), lambda v, k: list_transform(c, lambda row: 2 * list_inner_product(row, v) / trace)) AS v FROM cm)",
        ),
        "label_mask": sql(f"SELECT target, date_id, {r('coalesce(label, 0)')} AS label, label IS NOT NULL AS mask FROM lab"),
        "valid_counts": sql(f"SELECT date_id, n_valid, CASE WHEN date_id <= {TRAIN_END} THEN 'train' ELSE 'valid' END AS split FROM (SELECT date_id, count(label) AS n_valid, row_number() OVER (ORDER BY date_id) - 1 AS p FROM lab GROUP BY date_id) WHERE p >= 191 AND n_valid >= 10"),
        "sequence_windows": sql(f"SELECT target, date_id, 192 AS n, {r(f'sum(ret_1::FLOAT::DOUBLE) {frame(192)}', 4)} AS sum_first, {r(f'first_value(ret_5::FLOAT::DOUBLE) {frame(192)}', 5)} AS oldest FROM fac QUALIFY count(*) {frame(192)} = 192", factor_cte(["ret_1", "ret_5"])),
        "recency_weights_exp": weights(f"date_id <= {TRAIN_END}", EXP),
        "recency_weights_linear": weights(f"date_id <= {TRAIN_END}", "1 + rel * 2.0"),
        "recency_weights_falling": weights(f"date_id <= {TRAIN_END}", "greatest(0.5, 1 - rel * 0.6)"),
        "recency_weights_off": weights(f"date_id <= {TRAIN_END}", "1.0"),
        "weight_summary": f"SELECT target, {r('avg(w)')} AS mean, {r('min(w)')} AS low, {r('max(w)')} AS high, count(*) AS n FROM (" + weights("true", EXP).replace(r("w / avg(w) OVER (PARTITION BY target)") + " AS weight", "w / avg(w) OVER (PARTITION BY target) AS w") + ") GROUP BY target",
        "variance_filter": sql(f"SELECT target, feature, {r('var_samp(value)')} AS variance FROM lg WHERE date_id <= {TRAIN_END} GROUP BY 1, 2 HAVING var_samp(value) > 1e-4", core, LONG),
        "screen_features": sql(f"SELECT feature, {r('avg(v)')} AS variance FROM (SELECT target, feature, var_pop(value) AS v FROM lg GROUP BY 1, 2) GROUP BY feature HAVING avg(v) > 1e-6", core, LONG),
        "normalizer": sql(f"SELECT target, date_id, feature, {r('(value - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END', 4)} AS value FROM lg JOIN (SELECT target, feature, avg(value) AS m, stddev_pop(value) AS s FROM lg WHERE date_id <= {TRAIN_END} GROUP BY 1, 2) USING (target, feature)", core, LONG),
        "median_impute": sql(f"SELECT target, date_id, feature, {r('coalesce(value, med)')} AS value FROM gp JOIN (SELECT target, feature, median(value) AS med FROM gp WHERE date_id <= {TRAIN_END} GROUP BY 1, 2) USING (target, feature)", core, LONG, GAPPY),
        "daily_ic": sql(f"SELECT date_id, n, {r('ic')} AS ic FROM ic", PRED, IC),
        "ic_summary": sql(f"SELECT count(*) AS n_dates, {r('avg(ic)')} AS ic_mean, {r('stddev_pop(ic)')} AS ic_std, {r('avg(ic) / stddev_pop(ic)')} AS ir FROM ic", PRED, IC),
        "rmse": sql(f"SELECT target, {r('sqrt(avg(pow(label - pred, 2)))', 8)} AS rmse FROM pr WHERE pred IS NOT NULL AND label IS NOT NULL GROUP BY target", PRED),
        "blended_mean": sql(f"SELECT a.target, a.date_id, {r('(a.pred + b.pred) / 2', 10)} AS pred FROM pr a JOIN pr10 b USING (target, date_id)", PRED, PRED.replace("pr AS", "pr10 AS").replace("5 PRECEDING", "10 PRECEDING")),
        "eda_summary": sql(f"SELECT feature, count(value) AS n, {r('avg((abs(value) <= 1e-12)::INT)')} AS zero_ratio, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM lg GROUP BY feature", core, LONG),
        "panel_shape": sql("SELECT count(DISTINCT date_id) AS n_dates, count(DISTINCT target) AS n_targets, count(DISTINCT feature) AS n_features FROM lg", core, LONG),
        "grid_product": GRID_SQL,
        "grid_topk": f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY learning_rate, max_depth, lambda_l2) AS i FROM {grid_sql(n_grid)}),
h AS (SELECT *, CASE WHEN i % 5 <> 0 THEN i * 0.01 END AS t, (13 - i) * 0.005 AS v FROM g WHERE i % 4 <> 0)
SELECT i::INT AS combo_id, learning_rate, max_depth, lambda_l2, round((t - v)::DOUBLE, 6) + 0.0 AS train_val_gap FROM h WHERE t - v <= 0.05 ORDER BY v DESC LIMIT 5""",
        "numeric_coerce": f"SELECT i::INT AS combo_id, CASE WHEN i % 5 <> 0 THEN (i * 0.01)::DOUBLE END AS train_ic FROM (SELECT row_number() OVER () AS i FROM {grid_sql(n_grid)})",
        "param_json": "SELECT * FROM (VALUES (1, 'learning_rate', 0.02::DOUBLE), (1, 'num_leaves', 63.0), (2, 'learning_rate', 0.05), (2, 'max_depth', 6.0)) v(lag, name, value)",
        "format_float": sql("SELECT target, format('{:.4f}', 1000 * sqrt(avg(pow(label - pred, 2)))) AS text FROM pr WHERE pred IS NOT NULL AND label IS NOT NULL GROUP BY target", PRED),
        "isclose_ratio": sql("SELECT target, (count(*) FILTER (WHERE abs(label) <= 1e-4))::BIGINT AS n_zero, count(label) AS n FROM lab GROUP BY target"),
        "gp_program_eval": sql("SELECT target, date_id, " + ", ".join(f"{r(program(p), 4)} AS gp_{i}" for i, p in enumerate(PROGRAMS)) + " FROM fac", factor_cte(list(FACTORS))),
        "pca_norms": "SELECT i::INT AS component, 1.0::DOUBLE AS norm, 15::BIGINT AS n FROM range(5) t(i)",
        "stream_daily_panel": f"SELECT date_diff('day', TIMESTAMP '1970-01-01', ts)::INT AS date_id, event_type AS asset, {r('avg(value)')} AS price FROM events GROUP BY 1, 2",
        "stream_history_features": f"""WITH e AS (SELECT date_diff('day', TIMESTAMP '1970-01-01', ts)::INT AS date_id, event_type AS target, avg(value) AS price FROM events GROUP BY 1, 2),
f AS (SELECT *, price - lag(price) OVER ({O}) AS ch FROM e)
SELECT target, date_id, {r('price')} AS price, {r(f'avg(price) {frame(5)}')} AS mean_5, {r(f'stddev_samp(ch) {frame(10)}')} AS vol_10 FROM f""",
        "ic_report": sql(
            "SELECT " + ", ".join(f"{r(f'{n}_m')} AS {n}_ic_mean, {r(f'{n}_s')} AS {n}_ic_std, {r(f'{n}_m / {n}_s')} AS {n}_ir, {n}_n AS n_{n}_dates" for n in ("train", "val")) + " FROM sides",
            PRED, IC, "sides AS (SELECT " + ", ".join(f"avg(ic) FILTER (WHERE {w}) AS {n}_m, stddev_pop(ic) FILTER (WHERE {w}) AS {n}_s, count(*) FILTER (WHERE {w}) AS {n}_n" for n, w in (("train", f"date_id <= {TRAIN_END}"), ("val", f"date_id > {TRAIN_END}"))) + " FROM ic)",
        ),
        "boost_samples": sql(
            f"SELECT target, count(*) FILTER (WHERE t) AS train_samples, count(*) FILTER (WHERE NOT t) AS val_samples, {r('avg(w / m) FILTER (WHERE t)')} AS train_weight_mean, {r('min(w / m) FILTER (WHERE t)')} AS train_weight_min, {r('max(w / m) FILTER (WHERE t)')} AS train_weight_max FROM wm GROUP BY target",
            f"sl AS (SELECT target, date_id, lead(label, 2) OVER ({O}) AS l FROM lab JOIN specs USING (target) WHERE lag = 1)",
            f"sd AS (SELECT target, date_id <= {TRAIN_END} AS t, date_id - min(date_id) OVER p AS d, date_id, min(date_id) OVER p AS d0, max(date_id) OVER p AS d1 FROM sl WHERE l IS NOT NULL WINDOW p AS (PARTITION BY target, date_id <= {TRAIN_END}))",
            "sw AS (SELECT target, t, greatest(0.5, least(10.0, exp(3.0 * d / (d1 - d0)))) AS w FROM sd)",
            "wm AS (SELECT *, avg(w) OVER (PARTITION BY target, t) AS m FROM sw)",
        ),
        "boost_root_splits": sql(
            f"SELECT lag, target, feature, {r('gain', 8)} AS gain, nl AS n_left, nt - nl AS n_right FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY gain DESC, j, bin) AS k FROM gn) WHERE k = 1 AND gain > 1e-12",
            factor_cte(CORE),
            f"sl AS (SELECT target, lag, date_id, CASE lag {' '.join(f'WHEN {k} THEN lead(label, {k + 1}) OVER ({O})' for k in (1, 2, 3, 4))} END AS l FROM lab JOIN specs USING (target))",
            f"sd AS (SELECT *, date_id - min(date_id) OVER p AS d, max(date_id) OVER p - min(date_id) OVER p AS span FROM sl WHERE l IS NOT NULL AND date_id <= {TRAIN_END} WINDOW p AS (PARTITION BY target))",
            "sw AS (SELECT *, greatest(0.5, least(10.0, exp(3.0 * d / span))) AS w0 FROM sd)",
            "wt AS (SELECT *, w0 / avg(w0) OVER (PARTITION BY target) AS w FROM sw)",
            "gr AS (SELECT *, (sum(l * w) OVER (PARTITION BY target) / sum(w) OVER (PARTITION BY target) - l) * w AS g FROM wt)",
            "un AS (" + " UNION ALL ".join(f"SELECT target, lag, {j} AS j, '{n}' AS feature, {n} AS v, g, w FROM gr JOIN fac USING (target, date_id)" for j, n in enumerate(CORE)) + ")",
            "qs AS (SELECT target, j, list_sort(list(v)) AS s, var_samp(v) AS spread FROM un GROUP BY 1, 2)",
            "qd AS (SELECT target, j, list_sort(list_distinct(list_transform(range(16), lambda i: s[greatest(1, ceil(i / 15 * len(s)))::BIGINT]))) AS q FROM qs WHERE spread > 1e-9)",
            "ed AS (SELECT target, j, list_transform(range(1, len(q)), lambda i: (q[i] + q[i + 1]) / 2) AS e FROM qd)",
            "hs AS (SELECT target, lag, j, feature, len(list_filter(e, lambda x: x < v)) AS bin, sum(g) AS g, sum(w) AS h, count(*) AS n FROM un JOIN ed USING (target, j) GROUP BY ALL)",
            "cu AS (SELECT target, lag, j, feature, bin, sum(g) OVER u AS gl, sum(h) OVER u AS hl, (sum(n) OVER u)::BIGINT AS nl, sum(g) OVER p AS gt, sum(h) OVER p AS ht, (sum(n) OVER p)::BIGINT AS nt FROM hs WINDOW p AS (PARTITION BY target, j), u AS (PARTITION BY target, j ORDER BY bin))",
            "gn AS (SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM cu WHERE nl >= 20 AND nt - nl >= 20)",
        ),
        "stream_latest": f"""WITH e AS (SELECT date_diff('day', TIMESTAMP '1970-01-01', ts)::INT AS date_id, event_type AS target, avg(value) AS price FROM events GROUP BY 1, 2)
SELECT target, date_id, {r(f'avg(price) {frame(5)}')} AS pred FROM e""",
        "stream_label_batches": f"""WITH e AS (SELECT date_diff('day', TIMESTAMP '1970-01-01', ts)::INT AS date_id, event_type AS target, avg(value) AS price FROM events GROUP BY 1, 2),
l AS (SELECT 1 + length(target) % 4 AS lag, CASE length(target) % 4 {' '.join(f'WHEN {k} THEN lead(date_id, {k + 2}) OVER ({O})' for k in range(4))} END AS date_id, price - lag(price) OVER ({O}) AS value FROM e)
SELECT date_id, 'prices' AS part, NULL::INT AS lag, count(*) AS n, {r('sum(price)', 9)} AS total FROM e GROUP BY date_id
UNION ALL SELECT date_id, 'labels', lag::INT, count(*), {r('sum(value)', 9)} FROM l WHERE date_id IS NOT NULL GROUP BY date_id, lag""",
    }
    o["stream_state_features"] = o["stream_history_features"]
    return o


