"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts: distinct hashed word shingles, HASHES minima, their low BITS bits packed into a signature,
   BANDS band keys of ROWS whole minima each, and a fingerprint of the set. Texts of equal sets share one class.
2. Candidates: classes that share a band key. In each bucket, every class is paired with the bucket's least one, so a
   bucket of n classes makes n - 1 pairs. Signatures drop pairs whose collision-corrected similarity, from counts of
   equal BITS-bit slots, is below the threshold less MARGIN; odd sketches of the full sets drop pairs that provably
   differ in too many shingles; the rest is confirmed on the full sets.
   Odd sketches grow with the set, ODD bits at least and two bits a shingle, so they tell long sets apart as well.
3. Components of the confirmed links. Buckets that still hold several components are gone through again: each class is
   paired with its likeliest partner in another component, until that links nothing new; then all remaining pairs
   across components that pass both tests are confirmed. Pairs inside a component need no test.

Buckets with several components are compared in groups of bounded size: blocks of members against blocks of those
outside the bucket's largest component. At similarity 0.8 a pair shares no band with probability (1 - 0.8**6)**42,
3e-6; it fails the signature test with probability 3e-7 or so.

Cases: a null text, or one without words, has an empty set and links with nothing; with fewer words than a shingle, the
whole sequence is the one shingle; each row gets the component of its own set, also where rows share a doc_id: sets
whose least id is the same are nodes of their own, so a component's id may then stand for several components, which
`node` tells apart; rows that repeat are all kept or not; a null doc_id keeps null as its component unless its set is
that of a document with an id; long texts are hashed in blocks; ties don't occur, as the least id is unique.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, batch_of, bounded_batches, checked_broadcast, materialised, mix64, random64, salted_join

HASHES, BITS, ROWS, BANDS = 256, 4, 6, 42
MARGIN = 0.15
#: Ids that are broadcast at most; signatures that are compared at a time.
MAX_BROADCAST, BLOCK = 2_000_000, 512
#: Members of a bucket that are compared in one group, about; a member of a long odd sketch counts for more.
MEMBERS = 4096
#: Edges from which a node's least neighbour is broadcast; fewer are sorted in one task with ease.
HOT = 1_000_000
#: Bits of the shortest and longest odd sketch, and bytes of them that are compared at a time.
ODD, MAX_ODD, SKETCH_BYTES = 2048, 1 << 20, 16 << 20
#: Pairs of one node from which its rows are dealt to several tasks.
HUB = 512

_A = (random64(1, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (random64(2, HASHES) >> np.uint64(32)).astype(np.uint32)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words, or of all words where they are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = mix64(h ^ words[k : k + n]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES functions over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        np.minimum(least, (_A[:, None] * x[at : at + 1024] + _B[:, None]).min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """The low BITS bits of each minimum, two to a byte."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix64(h ^ least[k : ROWS * BANDS : ROWS].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return h


def odd_bits(n: int) -> int:
    """Bits of the odd sketch of a set of n: a power of two, so that a longer one folds onto a shorter one."""
    return min(MAX_ODD, max(ODD, 1 << (2 * n - 1).bit_length()))


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Whether an odd number of a set's members fall on each bit. Two sets differ in one member a differing bit, or more."""
    bits = odd_bits(len(shingles))
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they would be with fewer bits."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


class Sketches:
    """Odd sketches of several lengths, a matrix a length."""

    def __init__(self, column: list[bytes]):
        sizes = np.array([len(x) // 8 for x in column], np.int64)
        self.words, self.at, self.of = sizes, np.zeros(len(sizes), np.int64), {}
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            self.at[own] = np.arange(len(own))
            self.of[int(n)] = np.frombuffer(b"".join(column[i] for i in own), np.uint64).reshape(len(own), -1)


def may_link(a: Sketches, i: np.ndarray, b: Sketches, j: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """False where the differing bits of odd sketches i of a and j of b prove that a pair isn't similar enough.

    No chance is involved. size_a and size_b are the pairs' set sizes.
    """
    out = np.zeros(len(i), bool)
    wa, wb = a.words[i], b.words[j]
    for both in np.unique(wa << 20 | wb).tolist():
        n, m = both >> 20, both & ((1 << 20) - 1)
        own, words = np.flatnonzero((wa == n) & (wb == m)), min(n, m)
        for part in np.array_split(own, -(-len(own) * max(n, m) * 8 // SKETCH_BYTES)):
            x, y = folded(a.of[n][a.at[i[part]]], words), folded(b.of[m][b.at[j[part]]], words)
            least = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
            both = size_a[part] + size_b[part]
            out[part] = 100 * (both - least) >= percent * (both + least)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (uint64 words in the last axis): equal slots, less those equal by chance."""
    x = a ^ b
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set fingerprint (s1, s2), sig, bands; the last two are null for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def work(batches):
        hasher = WordHasher()
        for batch in batches:
            for first, words, bounds in hasher.texts(batch.column(1)):
                n, s1, s2, sig, bands = [], [], [], [], []
                for k in range(len(bounds) - 1):
                    own = shingle_set(words[bounds[k] : bounds[k + 1]], width)
                    a, b = fingerprint(own)
                    least = minima(own) if len(own) else None
                    n.append(len(own))
                    s1.append(a)
                    s2.append(b)
                    sig.append(None if least is None else signature(least))
                    bands.append(None if least is None else band_keys(least).view(np.int64))
                yield batch_of(schema, batch.column(0).slice(first, len(n)), batch.column(2).slice(first, len(n)), n, s1, s2, sig, bands)

    return docs.select("doc_id", "text", text_hash(F.col("text"))).mapInArrow(work, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>")


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)


def shingle_sets(docs: DataFrame, ids: DataFrame, n_ids: int, width: int) -> DataFrame:
    """(doc_id, s1, s2, shingles, odd) of the documents in ids(doc_id): sorted 64-bit hashes as bytes, and the odd sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.binary()), ("odd", pa.binary())])

    def work(batches):
        hasher = WordHasher()
        for batch in batches:
            for first, words, bounds in hasher.texts(batch.column(1)):
                sets = [shingle_set(words[bounds[k] : bounds[k + 1]], width) for k in range(len(bounds) - 1)]
                s1, s2 = zip(*map(fingerprint, sets), strict=True)
                yield batch_of(schema, batch.column(0).slice(first, len(sets)), s1, s2, [x.tobytes() for x in sets], [odd_sketch(x) for x in sets])

    own = docs.select("doc_id", "text").join(checked_broadcast(ids, n_ids, MAX_BROADCAST), "doc_id", "left_semi")
    return own.mapInArrow(work, "doc_id long, s1 long, s2 long, shingles binary, odd binary")


def joined(pairs: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """pairs joined with own on key, a or b; a node of more than HUB pairs is dealt to a task for each HUB of them.

    Such nodes are a HUB-th of the pairs at most, and are broadcast where that is few.
    """
    hubs = materialised(pairs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HUB), "hubs")
    n_hubs = hubs.count()
    if not n_hubs:
        return pairs.join(own, key)
    hubs = checked_broadcast(hubs, n_hubs, MAX_BROADCAST)
    salts = F.coalesce(F.ceil(F.col("n") / HUB).cast("int"), F.lit(1))
    left = pairs.join(hubs, key, "left").withColumn("__salt", F.pmod(F.xxhash64("b" if key == "a" else "a"), salts).cast("int")).drop("n")
    right = own.join(hubs, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return left.join(right, [key, "__salt"]).drop("__salt")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), as written, whose full sets have 100 * intersection >= percent * union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], schema=schema)

    first = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return joined(joined(pairs.select("a", "b"), first, "a"), second, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def likely(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), as written, whose sizes, signatures and odd sketches allow the similarity. own: (rep, n_shingles, sig, odd)"""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = percent / 100 - MARGIN

    def work(batches):
        for batch in batches:
            a, b, x, y, nx, ny, ox, oy = batch.columns
            p, q = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (x, y))
            near, own = estimate(p, q) >= least, np.arange(batch.num_rows)
            keep = pa.array(near & may_link(Sketches(ox.to_pylist()), own, Sketches(oy.to_pylist()), own, nx.to_numpy(), ny.to_numpy(), percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], schema=schema)

    first = own.select(F.col("rep").alias("a"), F.col("sig").alias("x"), F.col("n_shingles").alias("nx"), F.col("odd").alias("ox"))
    second = own.select(F.col("rep").alias("b"), F.col("sig").alias("y"), F.col("n_shingles").alias("ny"), F.col("odd").alias("oy"))
    both = joined(joined(pairs, first, "a"), second, "b").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return both.select("a", "b", "x", "y", "nx", "ny", "ox", "oy").mapInArrow(work, "a long, b long")


def _with_least(rows: DataFrame, edges: DataFrame, n_edges: int) -> DataFrame:
    """rows(u, v) with m, the least neighbour of u by edges(u, v), of which there are n_edges.

    Nodes of more than HOT edges are few (a HOT-th of the edges at most): theirs are broadcast, so that a node's rows
    needn't meet in one task.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if n_edges <= HOT:
        return rows.join(least.drop("n"), "u")
    least = materialised(least, "least")
    hot = least.where(F.col("n") > HOT).select("u", "m")
    hot = checked_broadcast(hot, hot.count(), MAX_BROADCAST)
    return rows.join(hot, "u").unionByName(rows.join(hot, "u", "left_anti").join(least.where(F.col("n") <= HOT).select("u", "m"), "u"))


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of the nodes of links(a, b): the least node of each connected component.

    Alternates large-star and small-star steps, each a join on the least neighbour, until the edges are stars.
    """
    edges = materialised(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    n, state = edges.count(), None
    while n:
        # large star: neighbours above a node link to the least node around it
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both.where("v > u"), both, n).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, link to the least of them
        large = materialised(large, "edges")
        small = _with_least(large, large, n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialised(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        n, state = now[0], now
    return edges.select(F.col("u").alias("rep"), F.col("v").alias("component"))


def blocks(labelled: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (bk, i, j, minor, component, rep, n_shingles, sig, odd) of the buckets that hold several components.

    labelled: (bk, rep, cost, component). A pair across components has a member outside the bucket's largest one: a
    minor. The members of a bucket are dealt to blocks i, its minors to blocks j, of a cost of MEMBERS or so each;
    group (i, j) holds both, so no group is larger than two blocks, however large the bucket or its sets.
    """
    parts = labelled.groupBy("bk", "component").agg(F.sum("cost").alias("n"))
    mixed = parts.groupBy("bk").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("bk", F.col("top.component").alias("major"), F.ceil(F.col("all") / MEMBERS).cast("int").alias("ni"), F.ceil((F.col("all") - F.col("top.n")) / MEMBERS).cast("int").alias("nj"))
    members = salted_join(labelled, mixed, ["bk"]).withColumn("h", F.xxhash64("rep"))
    at, to = F.pmod("h", "ni").cast("int"), F.pmod(F.shiftright("h", 20), F.col("nj")).cast("int")
    every = members.select("bk", at.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(False).alias("minor"), "component", "rep")
    minors = members.where(F.col("component") != F.col("major")).select("bk", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), to.alias("j"), F.lit(True).alias("minor"), "component", "rep")
    return every.union(minors).join(own, "rep")


def across(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) of different components in the groups of blocks().

    best: for each minor, its likeliest partner of a group only; else all that pass the tests of signatures and odd
    sketches. A group streams in, is kept as packed signatures and compared BLOCK by BLOCK.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = percent / 100 - MARGIN

    def pairs(x, y):
        for at in range(0, len(x["rep"]), BLOCK):
            p = {k: v[at : at + BLOCK] for k, v in x.items() if k != "odd"}
            top, partner = np.full(len(p["rep"]), -1.0), np.zeros(len(p["rep"]), np.int64)
            for to in range(0, len(y["rep"]), BLOCK):
                q = {k: v[to : to + BLOCK] for k, v in y.items() if k != "odd"}
                fits = (p["comp"][:, None] != q["comp"]) & (100 * np.minimum(p["size"][:, None], q["size"]) >= percent * np.maximum(p["size"][:, None], q["size"]))
                i, j = np.nonzero(fits)
                score = estimate(p["sig"][i], q["sig"][j])
                ok = score >= least
                i, j, score = i[ok], j[ok], score[ok]
                ok = may_link(x["odd"], i + at, y["odd"], j + to, p["size"][i], q["size"][j], percent)
                i, j, score = i[ok], j[ok], score[ok]
                if best:
                    order = np.argsort(score, kind="stable")
                    better, choice = np.full(len(top), -1.0), np.zeros(len(top), np.int64)
                    better[i[order]] = score[order]
                    choice[i[order]] = q["rep"][j[order]]
                    more = better > top
                    top[more], partner[more] = better[more], choice[more]
                else:
                    yield p["rep"][i], q["rep"][j]
            if best:
                yield p["rep"][top >= 0], partner[top >= 0]

    def packed(rows):
        ints = {k: np.array([r[c] for r in rows], np.int64) for k, c in (("comp", 1), ("rep", 2), ("size", 3))}
        return ints | {"sig": np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1), "odd": Sketches([r[5] for r in rows])}

    def compared(rows):
        minors, every = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if minors and every:
            for a, b in pairs(packed(minors), packed(every)):
                a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                if len(a):
                    yield batch_of(schema, a, b)

    def work(batches):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    yield from compared(rows)
                    key, rows = row[:3], []
                rows.append(row[3:])
        yield from compared(rows)

    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.select("bk", "i", "j", "minor", "component", "rep", "n_shingles", "sig", "odd").repartition(spread, "bk", "i", "j").sortWithinPartitions("bk", "i", "j")
    return ordered.mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, node and text_hash of each row of docs(doc_id, text).

    node is the component's least node, null for a set that no row with an id has.
    """
    with bounded_batches(docs.sparkSession):
        return _near_duplicates(docs, width, percent)


def classes_of(full: DataFrame) -> tuple[DataFrame, bool]:
    """(s1, s2, doc_id, node): the classes of equal sets with their least id; whether rows share ids.

    The node is the id, which the class of least fingerprint has; others of the same id are numbered by a hash below 0.
    """
    classes = materialised(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL"), "classes")
    if not full.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1):
        return classes.withColumn("node", F.col("doc_id")), False
    first = classes.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("first"))
    other = F.bitwise_not(F.shiftrightunsigned(F.xxhash64("s1", "s2"), 1))
    node = F.when(F.col("first") == F.struct("s1", "s2"), F.col("doc_id")).otherwise(other)
    return materialised(classes.join(first, "doc_id").select("s1", "s2", "doc_id", node.alias("node")), "classes"), True


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    base = materialised(signatures(docs, width), "signatures")
    full = base.where("n_shingles > 0")
    classes, shared = classes_of(full)
    # of the rows of a class, that of its least id; rows repeated under one id count once
    keys = ["s1", "s2", "doc_id"]
    sigs = full.join(classes, keys)
    sigs = (sigs.dropDuplicates(keys) if shared else sigs).select(F.col("node").alias("rep"), *keys, "n_shingles", "sig", "bands")
    cost = F.greatest(F.lit(1), F.ceil(2 * F.col("n_shingles") / ODD)).cast("long")
    dealt = sigs.select("rep", *keys, cost.alias("cost"), F.explode("bands").alias("bk"))
    hubs = dealt.groupBy("bk").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top").drop("top")
    buckets = materialised(salted_join(dealt.select("rep", "doc_id", "cost", "bk"), hubs, ["bk"]), "buckets")
    ids = materialised(buckets.select("doc_id").distinct(), "ids")
    sets = shingle_sets(docs, ids, ids.count(), width)
    if shared:  # an id may have several rows, and those several sets
        sets = sets.join(classes, keys).dropDuplicates(keys).withColumnRenamed("node", "rep")
    else:
        sets = sets.withColumnRenamed("doc_id", "rep")
    sets = materialised(sets.select("rep", "shingles", "odd"), "sets")
    own = materialised(sigs.select("rep", "n_shingles", "sig").join(sets.select("rep", "odd"), "rep"), "packed")
    stars = materialised(buckets.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    pairs = materialised(likely(stars, own, percent), "pairs")
    links = materialised(confirmed(pairs, sets, percent), "links")
    found = components(links)
    while True:
        for best in (True, False):
            labelled = buckets.select("bk", "rep", "cost").join(found, "rep", "left").select("bk", "rep", "cost", F.coalesce("component", "rep").alias("component"))
            new = materialised(across(blocks(labelled, own), percent, best), "pairs")
            more = materialised(confirmed(new, sets, percent), "links")
            if more.head(1):
                # the stars that there are stand for the links that made them
                found = components(found.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(more))
                break
        else:
            break
        if not best:
            break
    linked = classes.join(found.withColumnRenamed("rep", "node"), "node", "left").select("s1", "s2", "doc_id", F.coalesce("component", "node").alias("node"))
    if shared:
        linked = linked.join(linked.groupBy("node").agg(F.min("doc_id").alias("component_id")), "node")
    else:
        linked = linked.withColumn("component_id", F.col("node"))
    out = salted_join(base.select("doc_id", "text_hash", "n_shingles", "s1", "s2"), linked.drop("doc_id"), ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), "node", "text_hash")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")


def component_sql(table: str, width: int) -> str:
    """Brute force in SQL: shingle sets, all pairs that share a shingle, and labels spread along links."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
w0 AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table}),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, {shingle} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM w0 WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w0 WHERE len(w) BETWEEN 1 AND {width - 1})),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM ov JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ed AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
rc(doc_id, r) AS (SELECT DISTINCT a, a FROM ed UNION SELECT rc.doc_id, ed.b FROM rc JOIN ed ON rc.r = ed.a),
cm AS (SELECT d.doc_id, coalesce((SELECT n FROM sz WHERE sz.doc_id = d.doc_id), 0)::BIGINT AS n_shingles,
        coalesce((SELECT min(r) FROM rc WHERE rc.doc_id = d.doc_id), d.doc_id) AS component_id FROM {table} d)"""


SQL = f"WITH RECURSIVE {component_sql('documents', 2)}\nSELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM cm"
