"""Near-dedup, WARC, mixing, language model and pipeline, against brute force."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spreadloom.llm import common, minhash, mixing, ngram_lm, warc
from spreadloom.llm.common import WordHasher, shared_dir

DOCS = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# ---------------------------------------------------------------- near-dedup


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((root(a), root(b)))
            label[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(n, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(n):
        text = rng.choice(vocabulary, 60).tolist()
        rows.append(" ".join(text))
        for k in range(base % 7):
            new = list(text)
            for at in rng.choice(60, rng.integers(0, 5), replace=False):
                new[at] = str(rng.choice(vocabulary))
            rows.append(" ".join(new) if k % 3 else " ".join(new).upper())
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_all_pairs(spark, width):
    rows = [*near_copies(40), (900, None), (901, ""), (902, "one"), (903, "One"), (904, " \t"), (905, "two words"), (906, "two words")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), width).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_chain_of_near_copies(spark):
    """Neighbours are near, ends aren't: one component through links that no hub has."""
    base = [f"t{i}" for i in range(100)]
    rows = [(k, " ".join(base[:100 - 3 * k] + [f"x{i}" for i in range(3 * k)])) for k in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == brute_components(rows, 2)
    assert len({c for _, c in got.values()}) == 1


def test_large_group_of_copies(spark):
    rows = [(i, "the same words again and again in this text") for i in range(300)] + [(1000 + i, f"the same words again and again in this text {i}") for i in range(300)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2)
    assert {(r.component_id) for r in out.collect()} == {0}


def test_near_dedup_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5), (1, "a b c d e f", 5), (None, "a b c d e f", 6), (None, None, 7)], f"{DOCS}, bands int")
    out = minhash.near_duplicates(df, 2).collect()
    assert len(out) == 4
    assert {r.component_id for r in out if r.n_shingles} == {1}
    assert minhash.near_duplicates(df.limit(0), 2).count() == 0
    assert minhash.near_duplicates(df.where("text IS NULL"), 2).count() == 1


def test_rows_that_share_an_id(spark):
    """Texts under one id are texts of their own."""
    rng = np.random.default_rng(9)
    a, b, c, d = (" ".join(rng.choice([f"v{i}" for i in range(500)], 60)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (5, c), (6, f"{b} more"), (8, c), (3, d), (9, d), (9, f"{d} more"), (9, f"{d} more"), (None, b), (None, "alone here")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()
    sets = {k: shingles(t, 2) for k, (_, t) in enumerate(rows)}
    label = dict(brute_components([(k, t) for k, (_, t) in enumerate(rows)], 2))
    least = {k: min((rows[x][0] for x in label if label[x][1] == label[k][1] and rows[x][0] is not None), default=None) for k in label}
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == sorted(((rows[k][0], len(sets[k]), least[k]) for k in label), key=str)
    assert len({r.node for r in out if r.component_id == 3}) == 2
    stage = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t and f"{t} and five words more") for i, t in rows], DOCS), FOLDER)
    kept = sorted(((r.doc_id, r.text.removesuffix(" and five words more")) for r in stage.collect()), key=str)
    assert kept == sorted([(3, a), (3, d), (5, b), (5, c), (None, "alone here")], key=str)


def test_repeated_rows_of_a_leader_stay_once(spark):
    text = "one text of seven words in all"
    docs = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (1, text, None), (2, text, "c"), (1, f"{text} {text}", "x"), (4, None, "y"), (4, None, "z")], f"{DOCS}, kind string")
    got = [(r.doc_id, r.text, r.kind) for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(1, text, None), (1, f"{text} {text}", "x"), (4, None, "y"), (4, None, "z")], key=str)


def test_repeated_rows_with_a_map_column_stay_once(spark):
    """Maps have no order: rows that differ in them only are told apart by a hash."""
    text = "one text of seven words in all"
    docs = spark.createDataFrame([(1, text, {"a": 1}), (1, text, {"a": 2}), (1, text, None), (2, text, {}), (3, "another text of other words here", {"b": 3})], f"{DOCS}, extra map<string, int>")
    got = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, text), (3, "another text of other words here")]
    assert got.schema["extra"].dataType == docs.schema["extra"].dataType
    assert sorted(map(str, got.collect())) == sorted(map(str, corpus_pipeline.near_dedup(spark, docs.repartition(3), FOLDER).collect()))


def test_long_families_make_few_pairs(spark, monkeypatch):
    """120 long texts at similarity 0.69 or so: odd sketches that grow with the sets tell them apart."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 10**9, 6000)
    rows = []
    for i in range(120):
        own = base.copy()
        own[rng.choice(6000, 297, replace=False)] = rng.integers(0, 10**9, 297)
        rows.append((i, " ".join(map(str, own))))
    sizes = []
    plain = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, sets, percent: sizes.append(pairs.count()) or plain(pairs, sets, percent))
    a, b = shingles(rows[0][1], 2), shingles(rows[1][1], 2)
    assert 0.6 < len(a & b) / len(a | b) < 0.75
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i for i, _ in rows}
    assert sum(sizes) < 10 * len(rows)


def test_hubs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB", 3)
    rows = near_copies(30, seed=4)
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 2)


def test_sketches_of_several_lengths_fold():
    rng = np.random.default_rng(12)
    both = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([both[: 3000 - k], rng.integers(0, 2**63, m, dtype=np.uint64)])) for k, m in ((0, 0), (0, 1200), (200, 0), (2500, 2500), (1990, 0))]
    odd = minhash.Sketches([minhash.odd_sketch(x) for x in sets])
    assert len(set(odd.words.tolist())) > 1
    i, j = (x.ravel() for x in np.meshgrid(range(5), range(5)))
    sizes = np.array([len(x) for x in sets])
    got = minhash.may_link(odd, i, odd, j, sizes[i], sizes[j], 80)
    for x, y, may in zip(i, j, got, strict=True):
        common = len(np.intersect1d(sets[x], sets[y]))
        linked = 100 * common >= 80 * (len(sets[x]) + len(sets[y]) - common)
        assert may or not linked
    assert not got[(i == 0) & (j == 3)][0]


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        n = 400
        both = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]) for _ in range(2))
        x, y = (np.frombuffer(minhash.signature(minhash.minima(v)), np.uint64) for v in (a, b))
        true = len(both) / (2 * n - len(both))
        assert abs(float(minhash.estimate(x, y)) - true) < 0.13


def test_word_hashes_do_not_depend_on_place():
    h = WordHasher()
    (_, a, bounds), *_ = h.texts(pa.array(["one two", None, "", " TWO\none "]))
    assert bounds.tolist() == [0, 2, 2, 2, 4]
    assert a[0] == a[3]
    assert a[1] == a[2]
    long = "word " * 100_000
    (_, b, _), *_ = h.texts(pa.array([long]))
    assert len(b) == 100_000
    assert len(set(b.tolist())) == 1


# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string"


def brute_pages(rows):
    keeper = {}
    for i, _, h in rows:
        keeper[h or ""] = max(i if i is not None else -1, keeper.get(h or "", -1))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and sum((x[2] or "") == (h or "") for x in rows) > 1 and i != keeper[h or ""]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper[h or ""] if revisit else None))
    return sorted(out, key=str)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT", 3000)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {}\r\n\r\n"
    rng = np.random.default_rng(2)
    rows = [(i, f"http://h/{i}", "x" * int(rng.integers(0, 2500)) + trap.format(int(rng.integers(0, 9000))) * (i % 3) + "é" * int(rng.integers(0, 900))) for i in range(120)]
    rows += [(500, None, None), (501, "u\r\nX: 1", ""), (502, "u", "y" * 1500), (503, "u", "y" * 1500), (504, "u", "y" * 999), (505, "u", "y" * 999), (None, "u", "only"), (506, "u", "\r\n\r\nWARC/1.1\r\n" * 400)]
    folder = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3))
    got = warc.read_archives(spark, folder).drop("path", "offset").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_pages(rows)


@pytest.mark.parametrize("split", [3000, 4 << 20])
def test_long_urls(spark, monkeypatch, split):
    monkeypatch.setattr(warc, "SPLIT", split)
    rows = [(i, "http://h/" + "u" * (200_000 if i % 4 == 1 else 66_000 if i % 4 == 3 else 9), f"page {i} " + "WARC/1.1\r\n" * (i % 3)) for i in range(12)]
    folder = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1))
    got = warc.read_archives(spark, folder).drop("path", "offset").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_pages(rows)


def test_small_archives_have_candidates(spark, monkeypatch, tmp_path):
    plain = warc.candidates

    def marked(file, size, start, end):
        found, after = plain(file, size, start, end)
        (tmp_path / f"{size}-{start}").write_text(str(len(found)))
        return found, after

    monkeypatch.setattr(warc, "candidates", marked)
    rows = [(i, "u", f"page {i}") for i in range(7)]
    folder = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1))
    got = warc.read_archives(spark, folder).drop("path", "offset").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_pages(rows)
    assert [x.read_text() for x in tmp_path.iterdir()] == ["7"]


def test_a_walk_reads_ahead(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ", 1000)
    data = np.random.default_rng(3).integers(0, 256, 20_000, np.uint8).tobytes()

    class File:
        reads = 0

        def read_at(self, n, at):
            File.reads += 1
            return data[at : at + n]

    ahead, at = warc.Ahead(File(), len(data)), 0
    while at < len(data):
        assert ahead.read(100, at) == data[at : at + 100]
        at += 70
    assert File.reads <= 23
    assert ahead.read(5000, 100) == data[100:5100]
    assert ahead.read(5000, 19_000) == data[19_000:]


def test_broken_archive(spark, tmp_path):
    rec = lambda i, body: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)
    (tmp_path / "a.warc").write_bytes(rec(1, b"h\r\n\r\nbody") + rec(2, b"") + b"garbage" + rec(3, b"x"))
    (tmp_path / "b.warc").write_bytes(rec(4, b"h\r\n\r\nbody")[:-9])
    (tmp_path / "c.warc").write_bytes(b"")
    got = sorted(r.page_id for r in warc.read_archives(spark, f"file://{tmp_path}").collect())
    assert got == [1, 2]


def test_empty_pages(spark):
    folder = warc.write_archives(spark.createDataFrame([], PAGES))
    assert warc.read_archives(spark, folder).count() == 0


# ---------------------------------------------------------------- language model


def brute_lm(train, texts):
    uni, pairs, follow = Counter(), Counter(), Counter()
    tokens = lambda t: [*words(t), "\0"]
    for t in train:
        w = tokens(t)
        uni.update(w)
        pairs.update(zip(["\1", *w[:-1]], w, strict=True))
    for a, _ in pairs:
        follow[a] += 1
    n, v = sum(uni.values()), len(uni)
    count = lambda c: len(train) if c == "\1" else uni[c]
    base = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(c, w):
        if not count(c):
            return base(w)
        return max(pairs[c, w] - 0.75, 0) / count(c) + 0.75 * follow[c] / count(c) * base(w)

    out = []
    for t in texts:
        w = tokens(t)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, math.fsum(math.log10(base(x)) for x in w), math.fsum(math.log10(p(c, x)) for c, x in zip(["\1", *w[:-1]], w, strict=True))))
    return out


def test_scores_against_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 80), p=np.arange(300, 0, -1) / 45150)) for _ in range(200)] + [None, "", "unseen words only", "The the THE"]
    train = [t for i, t in enumerate(texts) if i % 4 and i < 202]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), DOCS)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        spec = ngram_lm.train(frame(train))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(ngram_lm.score_texts(frame(texts), spec).collect())
    for r, (n, known, total, base, score) in zip(got, brute_lm(train, texts), strict=True):
        assert (r.n_tokens, r.n_known, spec["total"]) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-9)
        assert abs(r.score - score) / n < 0.02
    # contexts that are cut into several ranges know all their successors
    pairs = {(a, b) for t in train for a, b in zip(["\1", *words(t)], [*words(t), "\0"], strict=True)}
    assert spec["cut"][spec["words"]] == Counter(a for a, _ in pairs)["\1"]


def test_long_texts_in_blocks_score_alike(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(50)], n)) for n in (700, 3, 90, 1, 400, 5, 5)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    whole = sorted(ngram_lm.score_texts(docs, ngram_lm.train(docs)).collect())
    hashers = [(list(ngram_lm.token_blocks(WordHasher(), pa.array(texts))))]
    monkeypatch.setattr(ngram_lm, "TOKENS", 32)
    monkeypatch.setattr(ngram_lm, "HELD", 128)
    monkeypatch.setattr(common, "CHUNK_BYTES", 64)
    blocks = list(ngram_lm.token_blocks(WordHasher(), pa.array(texts)))
    assert len(blocks) > len(hashers[0])
    assert max(len(b[0]) for b in blocks) <= 3 * 32
    assert sum(len(b[0]) - b[3] for b in blocks) == sum(r.n_tokens for r in whole)
    trie = ngram_lm.Trie(ngram_lm.train(docs))
    each = [ngram_lm.score_tokens(trie, b[0], b[2])[2][b[3] :] for b in blocks]
    assert sum(x.sum() for x in each) == pytest.approx(sum(r.score for r in whole), abs=1e-6)


def test_levels_that_cannot_be_mapped_are_let_go(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(200)], 40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    spec = ngram_lm.train(docs)
    (tokens, _, starts, _), *_ = ngram_lm.token_blocks(WordHasher(), pa.array(texts))
    mapped = ngram_lm.Trie(spec)
    expected = ngram_lm.score_tokens(mapped, tokens, starts)[2]
    monkeypatch.setattr(ngram_lm, "_mapped", lambda path, plain=ngram_lm._mapped: np.array(plain(path)))
    monkeypatch.setattr(ngram_lm, "OPEN_BYTES", 1)
    held = ngram_lm.Trie(spec)
    assert (ngram_lm.score_tokens(held, tokens, starts)[2] == expected).all()
    assert len(held.open) == 1 < len(mapped.open)


def test_too_many_words_raise(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "MAX_WORDS", 3)
    with pytest.raises(ValueError, match="distinct words"):
        ngram_lm.train(spark.createDataFrame([(1, "a b c d")], DOCS))


def test_language_model_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    got = sorted(ngram_lm.score_texts(docs, ngram_lm.train(docs.limit(0))).collect())
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in got] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


def test_elias_fano():
    rng = np.random.default_rng(4)
    values = np.sort(rng.integers(0, 10_000, 700))
    arrays, meta = {}, {}
    ngram_lm.Monotone.build(values, "x", arrays, meta)
    at = rng.permutation(700)
    assert (ngram_lm.Monotone(arrays, "x", meta).get(at) == values[at]).all()
    widths = rng.integers(1, 60, 500)
    data = rng.integers(0, 2**62, 500, dtype=np.uint64) & ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1))
    offsets = np.concatenate([[0], np.cumsum(widths)[:-1]])
    assert (ngram_lm.unpack(ngram_lm.pack(data, offsets, int(widths.sum())), offsets, widths) == data).all()


# ---------------------------------------------------------------- mixing


def mixing_rows(spark):
    rng = np.random.default_rng(5)
    kinds = {"good": [f"g{i}" for i in range(50)], "junk": [f"j{i}" for i in range(50)], "toxic": [f"t{i}" for i in range(50)]}
    rows = [(i, " ".join(rng.choice(kinds[k], 30)), k) for i, k in enumerate(rng.choice(list(kinds), 400, p=[0.5, 0.3, 0.2]))]
    return spark.createDataFrame(rows, f"{DOCS}, domain string")


def test_rates_meet_targets_like_numpy(spark):
    df = mixing_rows(spark)
    out = mixing.mix(df.select("doc_id", "text"), df.where("doc_id % 2 = 0").select("doc_id", "domain"), mixing.TARGETS).collect()
    t = np.array([r.n_tokens for r in out], float)
    p = np.array([[r.p_good, r.p_junk, r.p_toxic] for r in out])
    rate = np.array([r.rate for r in out])
    totals = (rate * t) @ p
    assert np.allclose(totals / totals.sum(), [0.92, 0.06, 0.02], atol=2e-3)
    assert (rate >= 0).all()
    # the same descent in numpy
    have, n = t @ p, t.sum()
    goal = have[0] / 0.92 * np.array([0.92, 0.06, 0.02])
    w = np.maximum(have / n, 1e-6)
    gram = (p * t[:, None]).T @ p / n / np.sqrt(np.outer(w, w))
    r = np.ones(len(t))
    for _ in range(200):
        r = np.maximum(r - p @ (((r * t) @ p - goal) / n / w) / gram.sum(1).max(), 0)
    assert np.abs(rate - r).max() < 0.02
    assert all(abs(x.copies - x.rate) < 1 for x in out)


def test_repeated_rows_are_weighed_once_each(spark):
    df = mixing_rows(spark)
    lab = df.where("doc_id % 2 = 0").select("doc_id", "domain")
    docs = df.select("doc_id", "text")
    thrice = docs.union(docs.where("doc_id < 100")).union(docs.where("doc_id < 100")).union(spark.createDataFrame([(900, "g1 j1"), (900, "g1 j1 j2"), (900, "g1 j1")], DOCS))
    domains, priors, table = mixing.classifier(docs, lab)
    once = {r.doc_id: r for r in mixing.posteriors(docs, domains, priors, table).collect()}
    got = mixing.posteriors(thrice, domains, priors, table).collect()
    for r in got:
        if r.doc_id != 900:
            assert r.rows == (3 if r.doc_id < 100 else 1)
            assert (r.n_tokens, r.p) == (once[r.doc_id].n_tokens, pytest.approx(once[r.doc_id].p, abs=1e-12))
    assert sorted((r.n_tokens, r.rows) for r in got if r.doc_id == 900) == [(2, 2), (3, 1)]
    # the fit's totals are those of all rows
    out = mixing.mix(thrice, lab, mixing.TARGETS).collect()
    t = np.array([r.n_tokens * r.rows for r in out], float)
    totals = (np.array([r.rate for r in out]) * t) @ np.array([[r.p_good, r.p_junk, r.p_toxic] for r in out])
    assert np.allclose(totals / totals.sum(), [0.92, 0.06, 0.02], atol=2e-3)
    assert out[0].residual < 1e-3
    copies = {(r.doc_id, r.n_tokens): r.copies * r.rows for r in out}
    emitted = Counter((r.doc_id, len(r.text.split())) for r in mixing.mixed(thrice, lab, mixing.TARGETS).collect())
    assert emitted == Counter({k: v for k, v in copies.items() if v})


def test_mixed_rows(spark):
    df = mixing_rows(spark).withColumn("__key", F.lit(1)).withColumn("copies", F.lit(2))
    lab = df.select("doc_id", "domain")
    out = mixing.mixed(df, lab, mixing.TARGETS, most=1.0, headroom=0.05)
    assert out.columns == df.columns
    kept = {r.domain: r.n for r in out.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    was = {r.domain: r.n for r in df.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    assert kept["good"] == was["good"]
    assert kept["junk"] < was["junk"]


def test_mixing_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (None, "a b"), (3, "a b")], DOCS)
    none = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.mix(docs, none, {"x": 1.0}).collect()
    assert {r.rate for r in out} == {1.0}
    one = spark.createDataFrame([(3, "x")], "doc_id long, domain string")
    got = {(r.doc_id, r.n_tokens): r for r in mixing.mix(docs, one, {"x": 0.5, "y": 0.5}).collect()}
    assert got[1, 0].p_x == 1
    assert mixing.mix(docs.limit(0), one, {"x": 1.0}).count() == 0


def test_mixing_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = mixing.label_domains(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    domains, priors, table = mixing.classifier(docs, labels)
    plan = mixing.posteriors(docs, domains, priors, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.materialised(stage(spark, docs, FOLDER), name)
        assert out.columns == columns
        if name == "language_id":
            assert out.count() == n  # these are all in a language
        if name == "near_dedup":
            five = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in five.items() if i == c}
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in out.collect())
            assert all(r.text == before[r.doc_id] or len(r.text) < len(before[r.doc_id]) for r in out.collect())
        docs = out
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert 0 < len(whole) <= docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in whole)
    assert all(r.n_tokens * 4 == len(r.ids) for r in whole)


def test_rejects_what_has_no_language(spark):
    docs = spark.createDataFrame([(1, "the of and to in that with", "en", "s", 5), (2, "123 456", "en", "s", 7), (3, None, None, None, None)] + [(10 + i, "the and of with that", "en", "s", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in out.collect()) == [1, 10, 11, 12, 13, 14]


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("rows", [0, 9])
def test_stages_take_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, repeated rows, clashing columns and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rep long, component string, copies int, key string, score double"
    good = "the and of that with in is to for be " * 3
    data = [(1, good, "en", "s", 1, 1, "c", 1, "k", 0.5), (1, good, "en", "s", 1, 1, "c", 1, "k", 0.5), (None, None, None, None, None, None, None, None, None, None), (None, good, None, "s", 1, None, None, None, None, None), (2, "", "en", None, None, 3, "", 0, "", 0.0), (3, good + "x", None, "s", 7, 1, "c", 2, "k", 1.0), (4, "der die und das ist nicht mit", "de", "s", 1, 1, "c", 1, "k", 0.5), (5, "\n\n", "de", "s", 1, 1, "c", 1, "k", 0.5), (6, None, "de", "s", 1, 1, "c", 1, "k", 0.5)][:rows]
    docs = spark.createDataFrame(data, schema)
    spark.createDataFrame([(1, 1, 0), (4, None, 1), (None, 1, 1)][:rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialised(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns or name == "byte_bpe"
        assert out.count() <= rows
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert 3 not in kept
    assert len(kept) == (0 if not rows else 6)
