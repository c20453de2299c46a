"""Recurrences of series of any length, by blocks of dates: the recursive indicators and the trend fill.

A recurrence that is linear in its own past is a map state -> M * state + c, and such maps compose. So a series is cut
into blocks of `block` dates, and the work is three steps: each block, by itself, finds its map (a task holds one block
of one series, never a series); the maps of a series, one short row a block, are composed from the first to the last,
which gives the state that each block begins with; each block then runs from its state. What a block needs of the rows
before it (how many there are, the last ten values) comes from one aggregate by block. All steps hash by (key, block).

Exponential averages are weighted sums until the row of their seed and decay after it, which is linear with weights that
depend on the row's position only; averages of averages carry one state each; an adaptive average has weights of its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dates of a block.
BLOCK = 32_768
#: Values before a block that its first rows look back on, and values of a series within which all indicators begin.
BEFORE, HEAD = 10, 64


def prefix(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of s = a[i] * s + b[i], row by row: (A, B) where s after row i is A[i] * s + B[i]. b has columns. By doubling."""
    a, b, step = a.astype(float), b.astype(float), 1
    while step < len(a):
        b[step:] += a[step:, None] * b[:-step]
        a[step:] *= a[:-step]
        step *= 2
    return a, b


class _Block:
    """One block of a series: its values, their positions in the series, and the states that are made of them.

    A signal is an array of a row each and a column for each incoming state, and a last one for the constant; where the
    incoming states are known, it is the last column alone. Rows that aren't live keep every state.
    """

    def __init__(self, x: np.ndarray, offset: int, before: np.ndarray, states: int, known: np.ndarray | None):
        missing = np.isnan(x)
        lead = (int(np.argmin(missing)) if not missing.all() else len(x)) if offset == 0 else 0
        gaps = np.flatnonzero(missing[lead:])
        end = lead + (int(gaps[0]) if len(gaps) else len(x) - lead)
        at = np.arange(len(x))
        self.gap, self.live = end < len(x), (at >= lead) & (at < end)
        #: Position from the first value of the series on; negative before it, that of the last live row after a gap.
        self.pos = np.minimum(offset + at - lead, offset + end - lead - 1)
        self.x = np.where(self.live, x, 0.0)
        self.past = np.concatenate([np.full(BEFORE - len(before), np.nan), before, self.x[lead:]])
        self.lead, self.known, self.width, self.ends = lead, known, states if known is None else 0, []

    def constant(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), self.width + 1))
        out[:, -1] = values
        return out

    def lookback(self, n: int) -> np.ndarray:
        """The values n rows before; 0 where there is none (such rows have no weight)."""
        own = self.past[BEFORE - n : len(self.past) - n]
        return np.concatenate([np.zeros(self.lead), np.nan_to_num(own)])

    def incoming(self) -> np.ndarray:
        """The next state, as it comes in: a signal of one row."""
        j = len(self.ends)
        if self.known is not None:
            return np.array([[self.known[j]]])
        out = np.zeros((1, self.width + 1))
        out[0, j] = 1.0
        return out

    def state(self, keep: np.ndarray, add: np.ndarray) -> np.ndarray:
        """The signal of s = keep * s + add."""
        start = self.incoming()
        a, b = prefix(np.where(self.live, keep, 1.0), np.where(self.live[:, None], add, 0.0))
        out = a[:, None] * start + b
        self.ends.append(out[-1] if len(out) else start[0])
        return out

    def ema(self, signal: np.ndarray, begin: int, n: int, seed: int | None = None) -> np.ndarray:
        """Average of a signal that begins at a position; the seed is the mean of the n rows that end at row `seed` of it."""
        p, seed, k = self.pos - begin, n - 1 if seed is None else seed, 2.0 / (n + 1)
        weight = np.where(p > seed, k, np.where(p > seed - n, 1.0 / n, 0.0))
        return self.state(np.where(p > seed, 1 - k, 1.0), weight[:, None] * signal)


Outputs = dict[str, tuple[np.ndarray, int]]


def _chain(n: int, times: int) -> Callable[[_Block], list[np.ndarray]]:
    def run(b: _Block) -> list[np.ndarray]:
        out = [b.constant(b.x)]
        for i in range(times):
            out.append(b.ema(out[-1], i * (n - 1), n))
        return out[1:]

    return run


def _rsi(n: int) -> Callable[[_Block], list[np.ndarray]]:
    def run(b: _Block) -> list[np.ndarray]:
        change = np.where(b.pos >= 1, b.x - b.lookback(1), 0.0)
        keep = np.where(b.pos > n, (n - 1) / n, 1.0)
        return [b.state(keep, b.constant(np.maximum(s * change, 0) / n)) for s in (1, -1)]

    return run


def _macd(b: _Block) -> list[np.ndarray]:
    x = b.constant(b.x)
    fast, slow = b.ema(x, 0, 12, 25), b.ema(x, 0, 26)
    return [fast, slow, b.ema(fast - slow, 25, 9)]


def _trix(b: _Block) -> list[np.ndarray]:
    """Three averages and the third as it was a row before."""
    x = b.constant(b.x)
    first, start = b.ema(x, 0, 15), None
    second = b.ema(first, 14, 15)
    start = b.incoming()
    third = b.ema(second, 28, 15)
    return [first, second, third, b.state(np.zeros(len(b.x)), np.concatenate([start, third[:-1]])[: len(third)])]


def _kama(b: _Block, n: int = 10) -> list[np.ndarray]:
    steps = np.abs(np.diff(b.past))
    path = np.concatenate([np.zeros(b.lead), np.lib.stride_tricks.sliding_window_view(steps, n).sum(axis=1)]) if len(steps) >= n else np.zeros(len(b.x))
    path, change = np.nan_to_num(path), b.x - b.lookback(n)
    ratio = np.where((path <= change) | (path == 0), 1.0, np.abs(change) / np.where(path == 0, 1.0, path))
    weight = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    weight = np.where(b.pos >= n, weight, np.where(b.pos == n - 1, 1.0, 0.0))
    return [b.state(1 - weight, b.constant(weight * b.x))]


def _change(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.where(before == 0, 0.0, 100 * (now / np.where(before == 0, 1.0, before) - 1))


def _strength(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    return np.where(gain + loss == 0, 0.0, 100 * gain / np.where(gain + loss == 0, 1.0, gain + loss))


#: (states, what makes them of a block, indicators of the states with the first position that each has)
SYSTEMS: list[tuple[int, Callable[[_Block], list[np.ndarray]], Callable[..., Outputs]]] = [
    (1, _chain(5, 1), lambda a: {"ema_5": (a, 4)}),
    (3, _chain(10, 3), lambda a, b, c: {"ema_10": (a, 9), "tema_10": (3 * a - 3 * b + c, 27)}),
    (2, _chain(20, 2), lambda a, b: {"ema_20": (a, 19), "dema_20": (2 * a - b, 38)}),
    (1, _chain(60, 1), lambda a: {"ema_60": (a, 59)}),
    (2, _rsi(14), lambda g, s: {"rsi_14": (_strength(g, s), 14)}),
    (2, _rsi(28), lambda g, s: {"rsi_28": (_strength(g, s), 28)}),
    (3, _macd, lambda f, s, g: {"macd": (f - s, 33), "macd_signal": (g, 33), "macd_hist": (f - s - g, 33)}),
    (4, _trix, lambda _a, _b, c, d: {"trix_15": (_change(c, d), 43)}),
    (1, _kama, lambda k: {"kama_10": (k, 10)}),
]
STATES = sum(n for n, _, _ in SYSTEMS)


def block_map(x: np.ndarray, offset: int, before: np.ndarray) -> np.ndarray:
    """The maps of all systems, (states, states + 1) each, one after the other."""
    out = []
    for n, run, _ in SYSTEMS:
        b = _Block(x, offset, before, n, None)
        run(b)
        out.append(np.concatenate(b.ends))
    return np.concatenate(out)


def applied(maps: np.ndarray, state: np.ndarray) -> np.ndarray:
    out, at, i = np.empty(STATES), 0, 0
    for n, _, _ in SYSTEMS:
        m = maps[at : at + n * (n + 1)].reshape(n, n + 1)
        out[i : i + n] = m[:, :n] @ state[i : i + n] + m[:, n]
        at, i = at + n * (n + 1), i + n
    return out


def block_values(x: np.ndarray, offset: int, before: np.ndarray, state: np.ndarray, first: dict[str, float] | None = None) -> dict[str, np.ndarray]:
    """The indicators of a block that begins with a state; warm-up rows take `first` (else they are NaN)."""
    out, i = {}, 0
    for n, run, indicators in SYSTEMS:
        b = _Block(x, offset, before, n, state[i : i + n])
        for name, (values, begin) in indicators(*(s[:, 0] for s in run(b))).items():
            out[name] = np.where(b.pos >= begin, values, np.nan if first is None else first[name])
        i += n
    return out


def first_values(head: np.ndarray) -> dict[str, float]:
    """Each indicator's first value, from a series' first values; NaN where it has none."""
    got = block_values(head, 0, np.empty(0), np.zeros(STATES))
    return {k: next((float(v) for v in col if v == v), float("nan")) for k, col in got.items()}


NAMES = list(first_values(np.empty(0)))


def _segments(rows: DataFrame) -> DataFrame:
    """(series, part, offset, before, head) by target and block: values before the block, the last of them, and a series' first values."""
    own = Window.partitionBy("target", "block").orderBy("date_id")
    back = F.row_number().over(Window.partitionBy("target", "block").orderBy(F.col("date_id").desc()))
    seen = rows.withColumns({"back": back, "seen": F.count("x").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    pair = F.struct("date_id", "x")
    values = lambda mask: F.transform(F.sort_array(F.collect_list(F.when(mask, pair))), lambda p: p["x"])
    parts = seen.groupBy("target", "block").agg(
        F.count("x").alias("m"), values(F.col("back") <= BEFORE).alias("tail"), values(F.col("seen").between(1, HEAD)).alias("head")
    )
    order = Window.partitionBy("target").orderBy("block")
    offset = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.filter(F.flatten(F.collect_list("tail").over(order.rowsBetween(-BEFORE, -1))), lambda v: v.isNotNull())
    before = F.when(F.size(before) > BEFORE, F.slice(before, -BEFORE, BEFORE)).otherwise(before)
    head = F.when(F.col("offset") < HEAD, F.col("head")).otherwise(F.array().cast("array<double>"))
    return parts.withColumns({"offset": offset, "before": before}).select(F.col("target").alias("series"), F.col("block").alias("part"), "offset", "before", head.alias("head"))


def _floats(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], float)


def recursive_features(curves: DataFrame, block: int = BLOCK) -> DataFrame:
    """(target, date_id, x) with the recursive indicators, filled forward, then backward.

    Positions count from a series' first value. From a missing value after it on, indicators keep what they had. A
    series that is too short for an indicator has NULL. A task holds a block of one series; a target's dates are
    expected once each.
    """
    rows = curves.select("target", F.col("date_id").cast("int").alias("date_id"), F.col("x").cast("double").alias("x"))
    rows = rows.withColumn("block", F.floor(F.col("date_id") / block).cast("int"))

    def series(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        group = group.sort_values("date_id", kind="stable")
        return group, group["x"].to_numpy(float)

    def summary(group: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        s, (_, x) = segment.iloc[0], series(group)
        before = _floats(s["before"])
        b = _Block(x, int(s["offset"]), before, 0, None)
        own = block_map(x, int(s["offset"]), before)
        return pd.DataFrame({"series": [s["series"]], "part": [s["part"]], "live": [int(b.live.sum())], "gap": [b.gap and bool(b.live.any() or s["offset"] > 0)], "maps": [own], "before": [before], "head": [_floats(s["head"])]})

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        head = np.concatenate([*group["head"], np.empty(0)])[:HEAD]
        first, state, count, frozen, out = first_values(head), np.zeros(STATES), 0, False, []
        for s in group.itertuples():
            out.append((s.series, s.part, count, frozen, s.before, state, [first[k] for k in NAMES]))
            if not frozen:
                state, count, frozen = applied(np.asarray(s.maps), state), count + s.live, bool(s.gap)
        return pd.DataFrame(out, columns=["series", "part", "offset", "frozen", "before", "state", "first"])

    def finish(group: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        s, (group, x) = segment.iloc[0], series(group)
        seen = np.full(len(x), np.nan) if s["frozen"] else x
        got = block_values(seen, int(s["offset"]), _floats(s["before"]), _floats(s["state"]), dict(zip(NAMES, s["first"], strict=True)))
        return group[["target", "date_id", "x"]].assign(**{k: got[k] for k in NAMES})

    key = "series string, part int, "
    pairs = lambda other: rows.groupBy("target", "block").cogroup(other.groupBy("series", "part"))
    maps = pairs(_segments(rows)).applyInPandas(summary, key + "live long, gap boolean, maps array<double>, before array<double>, head array<double>")
    begun = maps.groupBy("series").applyInPandas(starts, key + "offset long, frozen boolean, before array<double>, state array<double>, first array<double>")
    out = pairs(begun).applyInPandas(finish, "target string, date_id int, x double, " + ", ".join(f"{k} double" for k in NAMES))
    return out.select("target", "date_id", "x", *[F.nanvl(k, F.lit(None).cast("double")).alias(k) for k in NAMES])


def trend_run(x: np.ndarray, last, steps: deque, unit=1.0) -> tuple[list, object]:
    """The filled values from a last value (None: there is none yet) and the last steps on; both may be vectors.

    A gap goes on by the mean of the steps from the value before it; a value adds the step to it from the value before.
    `steps` is changed; the second part is the last value.
    """
    out = []
    for v in x:
        if v != v:
            if last is not None and steps:
                last = last + sum(steps) / len(steps)
        else:
            now = v * unit
            if last is not None:
                steps.append(now - last)
            last = now
        out.append(last)
    return out, last


def trend_map(x: np.ndarray, offset: int, window: int) -> np.ndarray:
    """The map of a block's incoming (last value, steps in order), `offset` values being before it.

    A block forgets what came in once window + 1 values follow each other without a gap (a step over a gap depends on
    the steps before it); from there on it runs on plain numbers.
    """
    size = window + 1
    every = np.eye(size + 1)
    unit, held = every[size], min(window, max(offset - 1, 0))
    last, steps = every[0] if offset else None, deque(every[size - held : size], maxlen=window)
    run = np.convolve(~np.isnan(x), np.ones(window + 1), "valid") if len(x) > window else np.zeros(0)
    whole = np.flatnonzero(run == window + 1)
    cut = int(whole[0]) + window + 1 if len(whole) else len(x)
    _, last = trend_run(x[:cut], last, steps, unit)
    if cut < len(x):
        plain = deque((float(v[size]) for v in steps), maxlen=window)
        _, value = trend_run(x[cut:], float(last[size]), plain)
        last, steps = value * unit, deque((v * unit for v in plain), maxlen=window)
    out = np.zeros((size, size + 1))
    if last is not None:
        out[0] = last
    for i, v in enumerate(reversed(steps)):
        out[window - i] = v
    return out


def trend_fill(prices: DataFrame, window: int, arrival: str | None = None, block: int = BLOCK) -> DataFrame:
    """Gaps of each asset's series continue the mean of its last `window` steps, in blocks of dates.

    Leading gaps take the first value; a series without values is 0. arrival: a column of whole numbers that goes
    before the date in this order and stays.
    """
    split = F.col(arrival).cast("long") if arrival else F.lit(0).cast("long")
    price = F.nanvl(F.col("price").cast("double"), F.lit(None).cast("double"))
    rows = prices.select(F.col("date_id").cast("int").alias("date_id"), "asset", price.alias("price"), split.alias("arrival"))
    rows = rows.withColumn("block", F.floor(F.col("date_id") / block).cast("int"))
    parts = rows.groupBy("asset", "arrival", "block").agg(F.count("price").alias("m"), F.min_by("price", F.when(F.col("price").isNotNull(), F.col("date_id"))).alias("f"))
    order = Window.partitionBy("asset").orderBy("arrival", "block")
    offset = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("f", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    segments = parts.select(F.col("asset").alias("series"), F.col("arrival").alias("split"), F.col("block").alias("part"), offset.alias("offset"), F.coalesce(first, F.lit(0.0)).alias("first"))

    def summary(group: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        s = segment.iloc[0]
        x = group.sort_values("date_id", kind="stable")["price"].to_numpy(float)
        return segment.assign(maps=[trend_map(x, int(s["offset"]), window).ravel()])

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        group, state, out = group.sort_values(["split", "part"], kind="stable"), np.zeros(window + 1), []
        for maps in group["maps"]:
            out.append(state)
            m = np.asarray(maps).reshape(window + 1, window + 2)
            state = m[:, :-1] @ state + m[:, -1]
        return group.drop(columns="maps").assign(state=out)

    def finish(group: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        s, group = segment.iloc[0], group.sort_values("date_id", kind="stable")
        seen, state = int(s["offset"]), [float(v) for v in s["state"]]
        held = min(window, max(seen - 1, 0))
        out, _ = trend_run(group["price"].to_numpy(float), state[0] if seen else None, deque(state[window + 1 - held :], maxlen=window))
        return group.assign(price=[float(s["first"]) if v is None else float(v) for v in out]).drop(columns="block")

    key, own = "series string, split long, part int, offset long, first double, ", ("asset", "arrival", "block")
    pairs = lambda other: rows.groupBy(*own).cogroup(other.groupBy("series", "split", "part"))
    maps = pairs(segments).applyInPandas(summary, key + "maps array<double>")
    begun = maps.groupBy("series").applyInPandas(starts, key + "state array<double>")
    out = pairs(begun).applyInPandas(finish, "date_id int, asset string, price double, arrival long")
    return out.withColumnRenamed("arrival", arrival) if arrival else out.drop("arrival")
