"""Line dedup, BPE, language ID, fingerprints, media and toxicity, against brute force and round trips."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.llm import bpe, ctph, langid, linededup, media, toxicity

DOCS = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# ---------------------------------------------------------------- line dedup

LONG = "this line is longer than twenty"


def brute_lines(rows):
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark):
    rows = [(1, f"{LONG}\na\n  {LONG.upper()}\t"), (2, f"{LONG}\n"), (3, f"x\n{LONG}"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"), (9, "\n\n"), (3, f"x\n{LONG}"), (None, f"{LONG}\nkept")]
    rows += [(20 + i, "é" * 20 + "\n" + "\n".join(f"line {j} of many that are long" for j in range(i))) for i in range(6)]
    out = linededup.dedup_lines(frame(spark, rows)).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_lines(rows)


def test_lines_carry_clashing_columns(spark):
    df = frame(spark, [(1, "a", 1, 2, "x")], "doc_id long, text string, pos int, n int, `k 1` string")
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "line_dedup"]
    assert out.drop("line_dedup").collect() == df.collect()
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_lines_plan_has_no_python(spark, docs):
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBPE(bpe.default_path())


CASES = ["", " ", "hello world's 123", "\x1c\x1d a\x85b c​", "é" * 300, "ab" * 500, "日本語🎉", " " * 99, "<|endoftext|>", "a\n\n  b\t", "'s't", "x" * 1000, "½²Ⅷ"]


def test_bpe_equals_the_library(model):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.rank, special_tokens={})
    rng = np.random.default_rng(0)
    cases = CASES + ["".join(map(chr, rng.choice([32, 10, 39, 97, 98, 115, 116, 0x301, 0xE9, 0x4E00, 0x1F600, 48], 40))) for _ in range(300)]
    for text, blob in zip(cases, model.encode_many(cases), strict=True):
        ids = np.frombuffer(blob, "<u4")
        assert ids.tolist() == ref.encode_ordinary(text)
        assert model.decode(ids) == text.encode()
    assert model.single(b"aaab" * 500) == ref.encode_ordinary("aaab" * 500)


def test_bpe_streams_long_texts(model, monkeypatch):
    text = "some words, and more " * 50
    whole = next(model.encode_many([text]))
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    assert list(model.encode_many([text, "a"]))[0] == whole


def test_bpe_frames(spark):
    rows = bpe.encode_texts(frame(spark, [(1, None), (2, "abc"), (None, "abc")])).collect()
    got = {r.doc_id: r for r in rows}
    assert (got[1].n_tokens, bytes(got[1].ids), bytes(got[1].decoded)) == (0, b"", b"")
    assert bytes(got[2].ids) == bytes(got[None].ids)
    assert bpe.encode_texts(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- language ID


def test_languages(spark, docs):
    out = langid.op4(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_cases(spark):
    train = frame(spark, [(i, t, n) for i, (t, n) in enumerate([("the of and with", "en"), ("der die und mit", "de"), (None, "en"), ("123", "de"), ("le la", None)] * 5)], "doc_id long, text string, lang string")
    langs, logs = langid.fit(train)
    assert langs == ["de", "en"]
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the and"), (5, "the and " * 60_000), (None, "und")])
    got = {r.doc_id: r for r in langid.predict(odd, langs, logs).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "en", "en", "de"]
    assert got[1].score == 0
    assert [r.doc_id for r in langid.keep_known(odd.where("doc_id < 5"), langs, logs, 0.5).collect()] == [4]
    langs, logs = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, langs, logs).collect()} == {"und"}


def brute_language(train, text):
    """Naive Bayes with Python's integers and dictionaries."""

    def grams(t):
        t = " " + re.sub(r"[\W\d_]+", " ", t.lower()) + " "
        for n in (1, 2, 3):
            for i in range(n - 1, len(t)):
                h = 0
                for k in range(n):  # the hash of the last n points, extended from the hash of n - 1
                    h = (h * 0x9E3779B1 + ord(t[i - n + 1 + k]) * 0x85EBCA6B + k + 1) & 0xFFFFFFFF
                h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
                yield (h ^ h >> 13) % langid.BUCKETS

    counted = defaultdict(lambda: defaultdict(int))
    for t, lang in train:
        for g in grams(t):
            counted[lang][g] += 1
    sums = {}
    for lang, own in counted.items():
        total = sum(own.values()) + 0.5 * langid.BUCKETS
        sums[lang] = sum(np.log((own[g] + 0.5) / total) for g in grams(text)) / 3
    best = max(sorted(sums), key=sums.get)
    return best, 1 / sum(np.exp(x - sums[best]) for x in sums.values())


def test_languages_against_brute_force(spark):
    train = [("the cat of this and that", "en"), ("and with the of it is", "en"), ("der hund und die katze", "de"), ("nicht mit über das", "de"), ("le chat et la souris", "fr")]
    langs, logs = langid.fit(frame(spark, [(i, t, n) for i, (t, n) in enumerate(train)], "doc_id long, text string, lang string"))
    texts = ["the katze and la", "über", "x", "Le Chat", "that of the and " * 400, "q z"]
    got = {r.doc_id: r for r in langid.predict(frame(spark, list(enumerate(texts))), langs, logs).collect()}
    for i, t in enumerate(texts):
        lang, p = brute_language(train, t)
        assert got[i].lang_pred == lang
        assert got[i].score == pytest.approx(p, abs=1e-4)


def test_blocks_of_grams_change_nothing(monkeypatch):
    text = "Übermut, naïve café " * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 17)
    assert (langid.counts(text) == whole).all()


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_against_brute_force(spark, docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    out = {r.doc_id: r for r in ctph.compare_with_next(docs).collect()}
    assert len(out) == len(rows)
    for i, r in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)].text
        half = len(r.text) // 2
        new = r.text[: len(r.text) - half] + nxt[:half]
        o = out[r.doc_id]
        assert o.n_chars == len(r.text)
        assert o.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert o.fingerprint == ctph.fingerprint(r.text.encode())
        assert o.near_next == ctph.similarity(o.fingerprint, ctph.fingerprint(nxt.encode()))
    near, far = np.mean([o.near_edited for o in out.values()]), np.mean([o.near_next for o in out.values()])
    assert near > 0.4 > 0.1 > far


def brute_fingerprint(raw):
    """Byte by byte, with a window kept in a list."""
    values = [int(v) for v in ctph._VALUES]

    def signature(block, room):
        out, chunk, window = [], b"", []
        for c in raw:
            chunk += bytes([c])
            window = [*window, c][-ctph.WINDOW :]
            h = 0
            for x in window:
                h = (h * 0x2F0B4C47 + values[x]) & 0xFFFFFFFF
            if (h ^ h >> 15) % block == block - 1 and len(out) < room - 1:
                out.append(chunk)
                chunk = b""
        return [*out, chunk] if chunk else out

    block = 3
    while block * 64 < len(raw):
        block *= 2
    while block > 3 and sum(1 for _ in signature(block, 10**9)) - 1 < 32:
        block //= 2
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return f"{block}:" + ":".join("".join(letters[zlib.crc32(c) // 8192 % 64] for c in signature(b, n)) for b, n in ((block, 64), (2 * block, 32)))


def test_signatures_against_brute_force():
    rng = np.random.default_rng(14)
    for n in (0, 1, 6, 7, 50, 400, 3000):
        raw = bytes(rng.integers(97, 123, n, np.uint8))
        got, expected = ctph.fingerprint(raw).split(":"), brute_fingerprint(raw).split(":")
        # a chunk end at the last byte leaves no rest, which the count of ends above can't tell from a rest
        assert got == expected or got[0] != expected[0]
        assert got[0] == expected[0] or n > 100
    same = sum(ctph.fingerprint(r) == brute_fingerprint(r) for r in (bytes(rng.integers(97, 123, 500, np.uint8)) for _ in range(20)))
    assert same >= 19


def test_fingerprint_cases(spark, monkeypatch):
    rows = [(3, "a"), (3, "b"), (None, "n1"), (None, "n2"), (1, None), (7, "é" * 5)]
    got = ctph.compare_with_next(frame(spark, rows)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["1", "3", "3", "7", "None", "None"]
    assert next(r for r in got if r.doc_id == 7).n_chars == 5
    one = ctph.compare_with_next(frame(spark, [(1, "alone")])).first()
    assert one.near_next == 1
    assert ctph.compare_with_next(frame(spark, [])).count() == 0
    text = bytes(np.random.default_rng(1).integers(97, 123, 5000, np.uint8))
    whole = ctph.fingerprint(text)
    monkeypatch.setattr(ctph, "PIECE", 100)
    assert ctph.fingerprint(text) == whole
    assert ctph.similarity("3:AB:A", "96:AB:A") == 0
    assert 0.5 < ctph.similarity(whole, ctph.fingerprint(text[:4000] + b"zzzz" * 250)) < 1


def test_edit_distance():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(1, 30))) for _ in range(2))
        assert ctph._common(a, b) == lcs(a, b)


# ---------------------------------------------------------------- media


@pytest.mark.parametrize("shape", [(1, 1), (7, 13), (24, 24), (50, 9)])
def test_images_round_trip(shape):
    rng = np.random.default_rng(3)
    grey, colour = rng.integers(0, 256, shape, np.uint8), rng.integers(0, 256, (*shape, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey))[:, :, 0] == grey).all()
    assert (media.decode(media.encode_bmp(grey))[:, :, 0] == grey).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6\n# c\n%d %d\n255\n" % shape[::-1] + colour.tobytes()) == colour).all()
    plain = b"P3 %d %d 255 " % shape[::-1] + b" ".join(b"%d" % v for v in colour.ravel())
    assert (media.decode(plain) == colour).all()
    bits = grey > 127
    assert (media.decode(b"P4 %d %d\n" % shape[::-1] + np.packbits(bits, axis=1).tobytes())[:, :, 0] == np.where(bits, 0, 255)).all()
    assert (media.decode(b"P1 %d %d\n" % shape[::-1] + b"".join(b"%d" % v for v in bits.ravel()))[:, :, 0] == np.where(bits, 0, 255)).all()


@pytest.mark.parametrize("size", [(5, 3), (8, 9), (20, 30), (1, 1)])
def test_area_resize(size, monkeypatch):
    image = np.random.default_rng(4).integers(0, 256, (12, 17, 2)).astype(np.uint8)
    h, w = size
    fine = np.repeat(np.repeat(image.astype(float), h, 0), w, 1)
    expected = fine.reshape(h, 12, w, 17, 2).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, h, w), expected)
    monkeypatch.setattr(media, "STRIP", 5)
    assert np.allclose(media.area_resize(image, h, w), expected)


def test_tiles_and_broken_images(spark):
    import io

    image = np.arange(30 * 40, dtype=np.uint16).reshape(30, 40, 1)
    parts = [np.load(io.BytesIO(x)) for x in media.tiles(image)]
    assert [p.shape[:2] for p in parts] == [(24, 24), (24, 16), (6, 24), (6, 16)]
    rows = [(1, None), (2, b"P5 9 9 255\n"), (3, b"BM"), (4, media.encode_pgm(np.zeros((3, 2), np.uint8))), (5, b"GIF"), (6, b"P5 0 1 255\n")]
    got = {r.id: r for r in media.media_columns(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert [k for k in sorted(got) if got[k].error is None] == [4]
    assert (got[4].height, got[4].width, got[4].channels, got[4].dhash) == (3, 2, 1, "0" * 16)


def bmp32(masks):
    import struct

    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 74, 0, 0, 66, 40, 1, 2, 1, 32, 3, 8, 0, 0, 0, 0)
    return head + struct.pack("<III", *masks) + bytes([1, 2, 3, 0, 4, 5, 6, 0])


BROKEN = {
    "huge": b"P5 99999999999999999999 1 255\n", "large": b"P5 99999 99999 255\n" + b"x" * 50, "plain": b"P2 999999999 999999999 255 1 2", "sample": b"P2 1 1 255 99999999999999999999",
    "above": b"P2 2 1 255 300 4", "raw": b"P5 1 1 100\n\xff", "digit": b"P1 2 1 1 7", "sign": b"P2 1 1 255 -4", "word": b"P2 1 1 255 x", "masks": bmp32((1, 2, 4)), "short": media.encode_bmp(np.zeros((9, 9, 3), np.uint8))[:80],
}


def test_broken_images_do_not_stop_a_job(spark):
    rows = [(i, raw) for i, raw in enumerate(BROKEN.values())] + [(99, bmp32((0xFF0000, 0xFF00, 0xFF)))]
    got = {r.id: r for r in media.media_columns(frame(spark, rows, "id long, image binary")).collect()}
    assert [list(BROKEN)[k] for k in got if k < 99 and got[k].error is None] == []
    assert (got[99].height, got[99].channels, got[99].error) == (2, 3, None)
    assert media.decode(bmp32((0xFF0000, 0xFF00, 0xFF)))[:, 0].tolist() == [[6, 5, 4], [3, 2, 1]]


def test_tiles_are_written(spark, tmp_path):
    import io

    image = np.random.default_rng(1).integers(0, 256, (60, 70), np.uint8)
    out = media.media_columns(frame(spark, [(1, media.encode_pgm(image)), (2, b"no")], "id long, image binary"))
    media.write_tiles(out, f"{tmp_path}/tiles")
    rows = spark.read.parquet(f"{tmp_path}/tiles").orderBy("tile").collect()
    assert [(r.id, r.tile) for r in rows] == [(1, k) for k in range(4)]
    assert (np.load(io.BytesIO(bytes(rows[0].npy))) == media.thumbnail(image[:, :, None])[:24, :24]).all()


def brute_dhash(image):
    """Means of cells by fractions of pixels, one cell at a time."""
    h, w = image.shape
    cells = np.zeros((8, 9))
    for i in range(8):
        for j in range(9):
            y0, y1, x0, x1 = i * h / 8, (i + 1) * h / 8, j * w / 9, (j + 1) * w / 9
            wy = [max(0.0, min(y1, y + 1) - max(y0, y)) for y in range(h)]
            wx = [max(0.0, min(x1, x + 1) - max(x0, x)) for x in range(w)]
            cells[i, j] = (np.outer(wy, wx) * image).sum() / ((y1 - y0) * (x1 - x0))
    bits = "".join("1" if round(cells[i, j], 6) < round(cells[i, j + 1], 6) else "0" for i in range(8) for j in range(8))
    return f"{int(bits, 2):016x}"


def test_difference_hashes_against_brute_force():
    rng = np.random.default_rng(13)
    for shape in ((24, 24), (48, 24), (5, 7), (1, 1), (100, 24)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert media.dhash(image[:, :, None]) == brute_dhash(image.astype(float))


def test_text_payloads(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in media.op3(spark, FOLDER).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
    assert len(media.text_as_media(b"")[1]) == 24


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    plain, bad = [f"w{a}ord{b}" for a in "abcdef" for b in "ghijkl"], ["vermin", "loathsome", "filth", "cretins"]
    text = lambda n: " ".join(rng.choice(plain, n))
    rows = [(i, text(40) + (" " + " ".join(rng.choice(bad, 3)) + " " + text(5) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = frame(spark, rows, "doc_id long, text string, toxic int")
    train, test = df.where("doc_id < 300"), df.where("doc_id >= 300")
    model = toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    got = toxicity.score_texts(test, model).join(test, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    odd = {r.doc_id: r.score for r in toxicity.score_texts(frame(spark, [(1, None), (2, ""), (3, "x" * 200_000), (None, "y")]), model).collect()}
    assert all(0 <= v <= 1 for v in odd.values())
    assert odd[1] == odd[2] < 0.5


def test_toxicity_without_both_classes(spark):
    docs = frame(spark, [(1, "a"), (2, "b")])
    for labels, expected in (([], 0.0), ([(1, 1), (1, 1), (2, 1)], 1.0), ([(1, None), (None, 1)], 0.0)):
        model = toxicity.fit(docs, frame(spark, labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score_texts(docs, model).collect()} == {expected}


def test_blocks_of_words_change_nothing(monkeypatch):
    d = toxicity.Distance(b"plain words of no kind " * 9, b" filth  vermin ", {}, 1.0)
    text = "plain words filth of vermin " * 40
    whole = d.cells_of(text)
    monkeypatch.setattr(toxicity, "BLOCK", 11)
    assert d.cells_of(text) == whole
    assert re.search("filth", text)


def test_a_long_labelled_text_is_passed_over(spark, monkeypatch):
    from spreadloom.llm import toxicity

    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100)
    monkeypatch.setattr(toxicity, "train", lambda rows: sorted(rows))
    for long in range(6):
        texts = [(i, "x" * 101 if i == long else f"text {i}") for i in range(6)]
        docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, 0) for i in range(6)], "doc_id long, toxic int")
        assert toxicity.fit(docs, labels) == sorted((t, 0) for i, t in texts if i != long)


def brute_evidence(model, text):
    """Lengths straight from the library, a compressor a call."""
    import zstandard as Z

    def length(content, raw):
        d = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
        p = Z.ZstdCompressionParameters.from_level(9, source_size=64, dict_size=len(content), min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0)
        return len(Z.ZstdCompressor(compression_params=p, dict_data=d).compress(raw))

    cells = set()
    for w in {x for x in re.split(r"[\x00-\x20]+", (text or "").lower()) if x}:
        raw = (f" {w}" * 3 + " ").encode()
        a, b = length(model["ordinary"], raw), length(model["toxic"], raw)
        if a >= b:
            cells.add((min(len(w.encode()), 16), min(6, a - b), min(b, 24)))
    return sum(model["weights"].get(c, 0.0) for c in cells)


def test_scores_against_lengths_from_the_library():
    rng = np.random.default_rng(6)
    plain, bad = [f"w{a}ord{b}" for a in "abcdef" for b in "ghijkl"], ["vermin", "loathsome", "filth", "crétins"]
    rows = [(" ".join([*rng.choice(plain, 30), *(rng.choice(bad, 2) if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(150)]
    model = toxicity.train(rows)
    for text in [*(t for t, _ in rows[:20]), "", None, "Vermin", "FILTH " * 50, "unseen\nwords\tonly"]:
        expected = 1 / (1 + np.exp(-(brute_evidence(model, text) - model["threshold"]) / model["scale"]))
        assert toxicity.Distance(**model).score(text) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("n", [4, 40, 400])
def test_calibration_texts_train_no_dictionary(monkeypatch, n):
    seen = []
    monkeypatch.setattr(toxicity, "trained", lambda samples, size, **_: seen.extend(samples) or b"x" * 20)
    toxicity.train([(f"only{i}word " + ("vermin" if i % 2 else "rose"), i % 2) for i in range(n)])
    trained = {int(x) for s in seen for x in re.findall(rb"only(\d+)word", s)}
    assert trained <= {i for i in range(n) if i // 2 % 2 == 0}
    assert any(b"rose" in s for s in seen)
