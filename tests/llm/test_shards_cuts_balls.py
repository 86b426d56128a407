"""Sharding, fill-in-middle and ball k-means against plain versions: nulls, empty and long texts, ties, repeats, clashing names, no rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hexloom.llm import ball_kmeans, decontamination, fill_in_middle, registry, sharding

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", "a", "Ab cd", "<P> stays", "<S", "P>", "é<M", "naïve Café", "\n\t x  y", "日本 語", "🙂🙂", "Ab cd", "x" * 5000, "l'été <" * 300, "A1b2C3", "<<S>", "word " * 40]


@pytest.mark.parametrize("name", ["op11_sharding", "op12_fill_in_middle", "op13_ball_kmeans"])
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{SMALL}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    found = registry.queries()[name](spark, SMALL)
    wanted = c.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert Counter(map(tuple, found.collect())) == Counter(wanted.select(*found.columns).fetchall())


# ------------------------------------------------------------------ 11


def plain_jump(key, shards):
    state, last, at = key % 2**64, -1, 0
    while at < shards:
        last = at
        state = (state * 2862933555777941757 + 1) % 2**64
        at = int((last + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return last


def test_jump_hash_equals_the_plain_form_and_moves_only_into_the_new_shard():
    r = random.Random(1)
    keys = np.array([0, 1, -1, 2**63 - 1, -(2**63), *(r.getrandbits(64) - 2**63 for _ in range(3000))], np.int64)
    before = None
    for shards in (1, 2, 3, 7, 24, 25, 1000):
        found = sharding.jump_hash(keys, shards)
        assert found.tolist() == [plain_jump(k, shards) for k in keys.tolist()]
        if shards == 25:
            moved = found != before
            assert set(found[moved].tolist()) == {24} and 0.02 < moved.mean() < 0.06
        before = found
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)
    assert len(sharding.jump_hash(keys[:0], 24)) == 0


def test_placed_rows_have_gapless_slots(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "again")] * 300 + [(None, "no id"), (None, None)] + [(1000 + i, f"text {i % 3}") for i in range(400)]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, shard int, slot string").repartition(7)
    found = sharding.place(docs, 24).collect()
    assert len(found) == len(rows)
    crc = lambda t: zlib.crc32((t or "").encode())
    size = lambda t: len((t or "").encode()) + 8
    key = lambda i: -1 if i is None else i
    assert Counter((f.doc_id, f.size, f.text_crc32, f.shard, f.grown_shard) for f in found) == Counter((i, size(t), crc(t), plain_jump(key(i), 24), plain_jump(key(i), 25)) for i, t in rows)
    by = {}
    for f in found:
        by.setdefault(f.shard, []).append(f)
    for shard in by.values():
        shard.sort(key=lambda f: f.slot)
        assert [f.slot for f in shard] == list(range(len(shard)))
        order = [(f.doc_id is not None, f.doc_id or 0, f.text_crc32, f.size) for f in shard]
        assert order == sorted(order)
    assert sharding.place(docs.limit(0), 24).count() == 0


def test_other_keys_and_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(f"k{i}", i, "s") for i in range(200)] + [(None, 5, "s")] * 2, "name string, n int, shard string")
    dealt = sharding.with_shards(docs, "name", 8).collect()
    assert {r.shard for r in dealt} == set(range(8)) and all(r.grown_shard in (r.shard, 8) for r in dealt)
    assert {r.shard for r in dealt if r.name is None} == {plain_jump(-1, 8)}
    sharding.write_shards(docs, str(tmp_path / "out"), 8, "name")
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.name, r.n, r.shard) for r in back) == Counter((r.name, r.n, r.shard) for r in dealt)


# ------------------------------------------------------------------ 12


def plain_cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    first, second = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    prefix, middle, suffix = "".join(units[:first]), "".join(units[first:second]), "".join(units[second:])
    if d % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@pytest.mark.parametrize("chunk", [1, 64, 1 << 22])
def test_cuts_equal_the_plain_form_and_are_read_back(spark, chunk):
    texts = ODD * 6
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, "Ab cd")] * 3
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    cut = fill_in_middle.fill_in_middle(docs, chunk=chunk)
    back = fill_in_middle.restored(cut, chunk=chunk).collect()
    assert Counter(tuple(r)[:6] for r in back) == Counter(plain_cut(i, t) for i, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    texts_of = {plain_cut(i, t): t or "" for i, t in rows}
    assert all(r.restored == texts_of[tuple(r)[:6]] for r in back)
    assert fill_in_middle.restored(fill_in_middle.fill_in_middle(docs.limit(0))).count() == 0


def test_shares_of_forms_are_parameters(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    of = lambda **k: Counter(r.form for r in fill_in_middle.fill_in_middle(docs, **k).collect())
    assert of(cut=0) == {"plain": 300} and of(cut=100, suffix_first=100) == {"spm": 300} and of(cut=100, suffix_first=0) == {"psm": 300}
    assert of(seed=1) != of(seed=2)


# ------------------------------------------------------------------ 13


def plain_kmeans(vectors, clusters, rounds, seed):
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((apart(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        where = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, where, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    final = assign()
    inertia = {k: sum(d for d, c in final if c == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, final, strict=True))


def vectors_of(n, spread, seed):
    r = random.Random(seed)
    middles = [[r.uniform(-3, 3) for _ in range(4)] for _ in range(5)]
    return [(i, [m + r.gauss(0, spread) for m in middles[i % 5]]) for i in range(n)]


@pytest.mark.parametrize("spread, strayed", [(0.05, 8), (2.0, 8), (2.0, 10**9), (1.0, 0)])
def test_clusters_equal_plain_kmeans(spark, spread, strayed):
    vectors = vectors_of(300, spread, 4)
    vectors += [(1000, None), (1001, [1.0, 2.0]), (1002, [1.0, None, 0.0, 0.0]), (1003, [1.0, float("nan"), 0.0, 0.0]), (1004, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4])]
    vectors += [vectors[7]] * 40 + [(i, vectors[9][1]) for i in range(2000, 2040)]  # repeated rows and equal vectors
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in vectors], "vec_id long, embedding array<double>, cluster string, ball int").repartition(5)
    found = ball_kmeans.cluster(table, dimensions=4, clusters=6, rounds=7, strayed=strayed)
    assert Counter(map(tuple, found.collect())) == plain_kmeans(vectors, 6, 7, 3)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    three = [(i, [float(i), 0.0, 0.0, 0.0]) for i in range(3)]
    assert Counter(map(tuple, ball_kmeans.cluster(spark.createDataFrame(three, schema), dimensions=4).collect())) == plain_kmeans(three, 8, 10, 3)
    assert ball_kmeans.cluster(spark.createDataFrame([], schema), dimensions=4).count() == 0
    assert ball_kmeans.cluster(spark.createDataFrame([(1, [1.0])], schema), dimensions=4).count() == 0
    with pytest.raises(Exception, match="would not fit"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0])], schema), dimensions=4).count()


def test_ties_go_to_the_smaller_number_and_far_centroids_are_not_compared():
    r = np.random.default_rng(2)
    centroids = np.array([[0, 0], [10, 0], [0, 10], [1000, 1000], [10, 0]])
    points = np.concatenate((np.array([[5, 0], [5, 5], [0, 0], [10, 0], [1000, 999]]), r.integers(-8, 18, (400, 2))))
    every = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for ball in (np.zeros(len(points), np.int64), np.array([i % 5 for i in range(len(points))]), every.argmin(axis=1)):
        best, distance, steps = ball_kmeans.nearest(points, ball, centroids)
        assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert steps < 0.7 * every.size  # with the balls that fit


# ------------------------------------------------------------------ 5


def test_bits_tell_what_the_banded_alignment_finds():
    r, hits = random.Random(9), 0
    for _ in range(400):
        pattern = "".join(r.choice("abc") for _ in range(r.randrange(1, 90)))
        part = list(pattern)
        for _ in range(r.randrange(8)):
            k = r.randrange(len(part) + 1)
            part[k : k + r.randrange(2)] = r.choice(["", "a", "x"])
        text = "".join(r.choice("abc") for _ in range(r.randrange(40))) + "".join(part) + "".join(r.choice("abc") for _ in range(r.randrange(40)))
        most = r.randrange(7)
        found = decontamination.banded_edits(pattern, text, most) is not None
        assert decontamination.within(pattern, text, most) == found
        hits += found
    assert 100 < hits < 390
