"""Symbolic features: expression trees that compile to Spark columns, and their evolution.

A program is a nested tuple: ("add", a, b), a column name, or a number. A generation is scored in one aggregate: the
absolute correlation of every candidate column with the label, less a price on length.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import protected_div, protected_log, protected_sqrt
from .labels import hash_sample

FUNCTIONS = {
    "add": (2, lambda a, b: a + b),
    "sub": (2, lambda a, b: a - b),
    "mul": (2, lambda a, b: a * b),
    "div": (2, protected_div),
    "sqrt": (1, protected_sqrt),
    "log": (1, protected_log),
    "abs": (1, F.abs),
    "sin": (1, F.sin),
    "cos": (1, F.cos),
}
SAMPLE, SEED = 1000, 123
#: Chances of the ways to change a program, and of a node in a point mutation; the rest is reproduction. Fixed values.
CROSSOVER, SUBTREE, HOIST, POINT, POINT_REPLACE = 0.9, 0.01, 0.01, 0.01, 0.05


def compiled(program) -> Column:
    if isinstance(program, tuple):
        return FUNCTIONS[program[0]][1](*[compiled(a) for a in program[1:]])
    return F.col(program) if isinstance(program, str) else F.lit(float(program))


def length(program) -> int:
    return 1 + sum(map(length, program[1:])) if isinstance(program, tuple) else 1


def grown(rng: random.Random, names: list[str], depth: int):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(names) if rng.random() < 0.8 else round(rng.uniform(-1, 1), 3)
    f = rng.choice(sorted(FUNCTIONS))
    return (f, *(grown(rng, names, depth - 1) for _ in range(FUNCTIONS[f][0])))


def parts(program, at=()):
    yield at, program
    if isinstance(program, tuple):
        for i, a in enumerate(program[1:], 1):
            yield from parts(a, (*at, i))


def replaced(program, at, new):
    if not at:
        return new
    return tuple(replaced(a, at[1:], new) if i == at[0] else a for i, a in enumerate(program))


def pointwise(rng: random.Random, program, names: list[str], share: float = POINT_REPLACE):
    """Each node becomes, with a small chance, another of its own number of arguments."""
    if not isinstance(program, tuple):
        return grown(rng, names, 0) if rng.random() < share else program
    f = program[0]
    if rng.random() < share:
        f = rng.choice([g for g in sorted(FUNCTIONS) if FUNCTIONS[g][0] == FUNCTIONS[f][0]])
    return (f, *(pointwise(rng, a, names, share) for a in program[1:]))


def changed(rng: random.Random, a, names: list[str], pick):
    """A child of a: crossover with another pick, a new subtree, a subtree hoisted, points changed, or a itself."""
    what = rng.random()
    at, own = rng.choice(list(parts(a)))
    if what < (below := CROSSOVER):
        return replaced(a, at, rng.choice(list(parts(pick())))[1])
    if what < (below := below + SUBTREE):
        return replaced(a, at, grown(rng, names, 4))
    if what < (below := below + HOIST):
        return replaced(a, at, rng.choice(list(parts(own)))[1])
    if what < below + POINT:
        return pointwise(rng, a, names)
    return a


def fitness(rows: DataFrame, programs: list, label: str = "label", parsimony: float = 5e-4, chunk: int = 50) -> list[float]:
    """Absolute correlation with the label, less parsimony * length; 0 where it is undefined."""
    out = []
    for at in range(0, len(programs), chunk):
        part = programs[at : at + chunk]
        cols = rows.select(label, *[compiled(p).alias(f"c{i}") for i, p in enumerate(part)])
        score = lambda i: F.abs(F.try_divide(F.covar_pop(f"c{i}", label), F.stddev_pop(f"c{i}") * F.stddev_pop(label)))
        got = cols.agg(*[score(i).alias(f"s{i}") for i in range(len(part))]).first()
        out += [(0.0 if s is None or s != s else min(1.0, s)) - parsimony * length(p) for s, p in zip(got, part, strict=True)]
    return out


def evolve(rows: DataFrame, names: list[str], outputs: int = 15, population: int = 200, generations: int = 3, hall: int = 40, seed: int = SEED, sample: int = SAMPLE, label: str = "label") -> list:
    """The best programs of a seeded evolution on a sample of rows, of unlike values."""
    rng = random.Random(seed)
    rows = rows.where(F.col(label).isNotNull()).na.drop(subset=names)
    rows = hash_sample(rows, ["target", "date_id"], sample, seed).select(label, *names).cache()
    own = [grown(rng, names, rng.randint(1, 4)) for _ in range(population)]
    best: dict = {}
    for g in range(generations):
        scores = fitness(rows, own, label)
        best |= dict(zip(own, scores, strict=True))
        if g + 1 == generations:
            break

        def pick(scores=scores, own=own):
            return own[max(rng.sample(range(len(own)), min(20, len(own))), key=lambda i: scores[i])]

        new = []
        while len(new) < population:
            a = pick()
            child = changed(rng, a, names, pick)
            new.append(child if length(child) <= 40 else a)
        own = new
    rows.unpersist()
    ranked = sorted(best, key=lambda p: (-best[p], length(p), repr(p)))[:hall]
    seen, out = set(), []
    for p in ranked:
        if round(best[p] + 5e-4 * length(p), 9) not in seen:
            seen.add(round(best[p] + 5e-4 * length(p), 9))
            out.append(p)
    return (out + [p for p in ranked if p not in out])[:outputs]


def evaluated(rows: DataFrame, programs: list) -> DataFrame:
    """(target, date_id, gp_0 ..). Raises on inputs that rows lack."""
    return with_programs(rows, programs).select("target", "date_id", *[f"gp_{i}" for i in range(len(programs))])


def with_programs(rows: DataFrame, programs: list) -> DataFrame:
    """rows with gp_0 .. beside their columns."""
    needed = {x for p in programs for _, x in parts(p) if isinstance(x, str)}
    if missing := sorted(needed - set(rows.columns)):
        raise KeyError(f"missing inputs: {missing}")
    return rows.withColumns({f"gp_{i}": compiled(p) for i, p in enumerate(programs)})
