"""Spelling variants, fill-in-middle and SimHash, against brute force; SQL of the operators over a whole folder."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spreadloom.llm import common, fim, queries, simhash, variants

DOCS = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


# ---------------------------------------------------------------- spelling variants


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def brute_variants(counts):
    """By the words with a hole: two words are near if one of their holes agrees."""
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes["swap", w[:i], w[i + 1 :]].add(w)
            holes["drop", w[:i] + w[i + 1 :]].add(w)
        holes["drop", w].add(w)
    near = defaultdict(set)
    for (kind, *_), own in holes.items():
        for a in own:
            near[a] |= {b for b in own if b != a and (kind == "swap" or abs(len(a) - len(b)) == 1)}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


def got_variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_of_a_whole_table(spark):
    rows = documents(spark)
    expected = brute_variants(brute_words(rows))
    assert got_variants(queries.queries()["op11_spelling_variants"](spark, FOLDER)) == expected
    assert sum(v[2] is not None for v in expected.values()) > 10


@pytest.mark.parametrize("alphabet, most", [("ab", 9), ("aé", 7), ("abcdefgh", 6)])
def test_variants_of_crowded_words(spark, monkeypatch, alphabet, most):
    """Few letters, so that all words are near many; blocks of three words, so that keys are cut into many tiles."""
    monkeypatch.setattr(variants, "WORDS", 3)
    rng = np.random.default_rng(len(alphabet))
    words = sorted({"".join(rng.choice(list(alphabet), rng.integers(5, most + 1))) for _ in range(400)})
    counts = {w: int(n) for w, n in zip(words, rng.integers(3, 60, len(words)), strict=True)}
    got = got_variants(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_variants(counts)


def test_variant_cases(spark):
    long = "x" * 30_000
    rows = [(1, "color Color COLOR colour colour colour colours"), (1, "color Color COLOR colour colour colour colours"), (None, "colour colours colours"), (2, None), (3, ""), (4, "one 1234 ÀÉÎÕÜ ÀÉÎÕÜ àéîõü ÀÉÎÕÜ")]
    rows += [(5, f"{long} {long} {long}"), (6, f"{long}y {long}y {long}y {long[1:]}z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{DOCS}, word string")
    assert got_variants(variants.variants(variants.word_counts(df))) == brute_variants(brute_words(rows))
    plain = {r.word: r.n for r in variants.word_counts(df, damage=None).collect()}
    assert plain["colour"] == 7 and "ÀÉÎÕÜ" in plain and "àéîõü" not in plain
    assert variants.variants(variants.word_counts(df.limit(0))).count() == 0
    assert variants.variants(variants.word_counts(df.where("text IS NULL"))).count() == 0


def test_forms_follow_to_the_last(spark):
    counts = {"aaaaa" + "b" * k: 3 * 2**k for k in range(12)} | {"zzzzzz": 5, "zzzzzy": 9}
    got = got_variants(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {got["aaaaa" + "b" * k][4] for k in range(12)} == {"aaaaa" + "b" * 11}
    assert got["zzzzzz"] == (5, 1, None, None, "zzzzzz")  # not twice as common


def test_ties_go_by_code_point(spark):
    got = got_variants(variants.variants(spark.createDataFrame([("abcde", 3), ("abcdz", 9), ("abcdé", 9)], "word string, n long")))
    assert got["abcde"] == (3, 2, "abcdz", 9, "abcdz")


# ---------------------------------------------------------------- fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    rng = np.random.default_rng(4)
    parts = ["word", " ", "\n", "\t\t", "é", "漢字", "🙂", "<", "S>", "<S", "P>", "x" * 300, "\x0b", " ", " ", "\x1f", "\0"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 400))) for _ in range(150)]
    return [None, "", " ", " \n ", "one", " one", "one ", "a <P> b", "a <M>", "é" * 5000, *texts, *texts[:5]]


def test_fim_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 16)
    rows = [*enumerate(odd_texts()), (None, "text without an id"), (3, "twice"), (3, "twice")]
    out = fim.fill_in_middle(spark.createDataFrame([(*r, "y") for r in rows], f"{DOCS}, form string"))
    got = out.select("*", fim.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((i, *brute_fim(i, t)) for i, t in rows), key=str)
    assert sorted((r.doc_id or -1, r.again) for r in got) == sorted((i or -1, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_every_cut_of_a_tree():
    rng = np.random.default_rng(5)
    raw = "".join(rng.choice([" ", "ab", "é", "漢", "\n"], 700)).encode()
    ends = [m.end() for m in re.finditer(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", raw)]
    for block in (1, 7, 64, 1 << 14):
        tree = fim.Blocks(np.frombuffer(raw, np.uint8), block)
        assert (tree.units, tree.chars) == (len(ends), len(raw.decode()))
        assert [tree.cut(k) for k in range(len(ends) + 1)] == [(at, len(raw[:at].decode())) for at in [0, *ends]]


def test_fim_of_long_texts_and_empty_tables(spark):
    text = "some words of a long text " * 200_000
    rows = [(i, text) for i in range(4)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, DOCS)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("d")).collect()
    for r in got:
        *head, out = brute_fim(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.d) == (*head, hashlib.sha256(out.encode()).hexdigest())
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    own = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows):
    marks = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    x = np.array(marks, np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x) <= 3), strict=True):
        p, q = label[a], label[b]
        if p != q:
            label = [p if y == q else y for y in label]
    least = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in set(label)}
    return sorted(((i, f"{m:016x}", least[c]) for (i, _), m, c in zip(rows, marks, label, strict=True)), key=str)


def got_components(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_simhash_of_a_whole_table(spark):
    assert got_components(queries.queries()["op13_simhash_near_dedup"](spark, FOLDER)) == brute_components(documents(spark))


def hexed(df):
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def test_simhash_of_near_copies_and_odd_rows(spark, monkeypatch):
    """Small blocks, so that groups of copies are cut into many tiles; pieces of few bytes."""
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice([f"w{i}" for i in range(300)], 200)) for _ in range(6)]
    texts = [*base, *[t.replace("w7", f"W{k}", 1) for t in base for k in range(40)], "a b c", "A  b\tC ", "one", "two words", None, "", " \n"]
    rows = [*enumerate(texts), (None, base[0]), (None, "only without an id"), (2, base[3]), (2, base[3]), (500, "x " * 50_000), (501, "X " * 50_001)]
    df = spark.createDataFrame([(*r, 1) for r in rows], f"{DOCS}, fp int")
    assert got_components(hexed(simhash.near_duplicates(df))) == brute_components(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.where("text IS NULL")).collect()[0].component_id == texts.index(None)


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "WORDS", 7)
    monkeypatch.setattr(common.cut_at_space, "__defaults__", (64,))
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 6, 7, 8, 9, 500):
        text = "".join(f"{w} " for w in rng.choice(["Ab", "é", "long" * 30, "x\n", " "], n))
        assert simhash.fingerprint(np.frombuffer(text.encode(), np.uint8)) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair_in_the_radius(radius):
    found = np.array(simhash.masks(radius), np.uint64)
    assert len(found) == 2 ** (radius + 1) - 1
    rng = np.random.default_rng(radius)
    for _ in range(4000):
        places = rng.choice(64, radius, replace=False)
        assert (found & np.uint64(sum(1 << int(p) for p in places)) == 0).any()
    if radius == 3:
        assert all(32 <= int(m).bit_count() <= 36 for m in found)


def test_random_fingerprints_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(3):
        x = np.unique(np.concatenate([x, x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))]))
    labels = simhash.united(np.arange(len(x)), *np.nonzero(np.bitwise_count(x[:, None] ^ x) <= 3))
    edges = simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")).collect()
    place = {int(v): k for k, v in enumerate(x.view(np.int64))}
    assert len(edges) < 15 * len(x)
    got = simhash.united(np.arange(len(x)), np.array([place[e.a] for e in edges]), np.array([place[e.b] for e in edges]))
    assert (got == labels).all()


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_of_a_folder(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    sql = con.execute(queries.oracle_sql()[name])
    columns = sorted(x[0] for x in sql.description)
    expected = sorted(map(tuple, sql.fetchall()), key=str)
    at = [[x[0] for x in sql.description].index(c) for c in columns]
    got = queries.queries()[name](spark, FOLDER).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted((tuple(r[k] for k in at) for r in expected), key=str)


def test_fim_sql_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts()) if "\0" not in (t or "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    expected = con.execute(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256 FROM ({fim.SQL})").fetchall()
    got = fim.fill_in_middle(spark.createDataFrame(rows, DOCS)).withColumn("output", F.sha2("output", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
