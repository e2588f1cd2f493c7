"""Merkle manifest, sharding and periodic runs against plain Python: nulls, long texts, ties, repeats, clashes, empty tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import SCHEMA, frame, texts

from slotforge.llm import merkle, periodic, queries, sharding
from slotforge.storage import new_path

SF = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(words) if k not in gone)


def brute_plant(words, i):
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


@pytest.mark.parametrize("side", [2, 4, 8])
def test_cover_has_every_difference(side):
    c = periodic.cover(side).tolist()
    assert {(a - b) % side**2 for a in c for b in c} == set(range(side**2))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.sampled_from([2, 4, 8]))
def test_extensions(w, side):
    w = np.array(w, np.int64)
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
    if not pairs:
        return
    i, j = map(np.array, zip(*pairs, strict=True))
    want = [next((k for k in range(len(w)) if b + k >= len(w) or w[a + k] != w[b + k]), 0) for a, b in pairs]
    assert periodic.Extensions(w, side)(i, j).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs(pieces):
    w = [x for word, times in pieces for x in word * times]
    found = periodic.runs(np.array(w, np.int64))
    assert list(map(tuple, found.tolist())) == brute_runs(w)
    kept = periodic.kept_words(len(w), found)
    assert " ".join(str(x) for x, k in zip(w, kept, strict=True) if k) == brute_collapse(list(map(str, w)), brute_runs(w))


def test_runs_of_long_texts():
    rng = random.Random(2)
    w = [rng.randrange(50) for _ in range(4_200)]  # the wider cover
    for a, p, e in ((100, 7, 400), (1000, 300, 2500), (3000, 1, 3006), (4000, 11, 4200)):
        w[a:e] = [w[a + (k - a) % p] for k in range(a, e)]
    assert list(map(tuple, periodic.runs(np.array(w)).tolist())) == brute_runs(w)


def test_periodic_rows(spark):
    again = "a b c a b c a b c a b c"
    rows = [(1, None), (2, ""), (3, " \t\n\v\f\r"), (4, again), (4, again), (None, "x " * 6), (6, "x x x x x"), (7, "é é é é " * 9), (8, " ".join(["lorem", "ipsum"] * 1_500)), (9, "\x00 \x1c " * 5)]
    found = periodic.periodic_runs(frame(spark, rows).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("z")))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    want = []
    for i, t in rows:
        words = [x.decode() for x in (t or "").encode().split()]
        runs = brute_runs(words)
        want.append((str(i), len(words), runs, brute_collapse(words, runs)))
    assert got == sorted(want)
    assert periodic.digests(periodic.periodic_runs(frame(spark, rows).where("doc_id < 0"))).collect() == []


@given_tables
def test_periodic_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        words = brute_plant([x.decode() for x in t.encode().split()], i)
        runs = brute_runs(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert got[i] == (len(runs), s, n, q, 1000 * n // q if runs else None, sha(lines), sha(brute_collapse(words, runs)))


# --- sharding


def plain_differencing(sizes, k):
    parts = [[0] * (k - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts[0], parts[1]
        parts[:2] = [sorted(x + y for x, y in zip(a, reversed(b), strict=True))]
    return parts[0]


def test_differencing():
    rng = random.Random(4)
    assert sharding.differencing([8, 7, 6, 5, 4], [0, 0])[1] in ([16, 14], [14, 16])
    for _ in range(60):
        k = rng.randint(2, 16)
        sizes = [rng.randint(1, 1000) for _ in range(rng.randint(0, 40))]
        start = [rng.randint(0, 500) if rng.random() < 0.5 else 0 for _ in range(k)]
        shards, sums = sharding.differencing(sizes, start)
        assert sums == [start[j] + sum(s for s, x in zip(sizes, shards, strict=True) if x == j) for j in range(k)]
    sizes = [rng.randint(1, 10**6) for _ in range(800)]
    got = sharding.differencing(sizes, [0] * 16)[1]
    plain = plain_differencing(sizes, 16)
    assert max(got) - min(got) <= 2 * (plain[-1] - plain[0]) + 16


def check_shards(rows, docs, k=16):
    """rows: doc_id, size, text_crc32, shard, slot."""
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in docs)
    text, of, slots, sums = defaultdict(set), defaultdict(set), defaultdict(list), [0] * k
    for i, t in docs:
        text[i].add(t or "")
    for r in rows:
        t = next(t for t in text[r.doc_id] if (len(t.encode()) + 1, zlib.crc32(t.encode())) == (r.size, r.text_crc32))
        of[t].add(r.shard)
        slots[r.shard].append((r.slot, r.doc_id is not None, r.doc_id))
        sums[r.shard] += r.size
    assert all(len(x) == 1 for x in of.values())
    for s in slots.values():
        assert [x[0] for x in sorted(s)] == list(range(len(s))) and [x[1:] for x in sorted(s)] == sorted((x[1:] for x in s), key=lambda x: (x[0], x[1] or 0))
    return sums


def test_sharding_rows(spark):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, None), (None, "x"), (3, "again"), (3, "again")]
    rows += [(100 + k, "the same words " * 9) for k in range(200)] + [(400 + k, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 90)))) for k in range(600)]
    sums = check_shards(sharding.shard_rows(frame(spark, rows)).collect(), rows)
    sums = sorted(sums)
    assert sums[-1] == len(texts()[0].encode()) + 1 and sums[-2] == 200 * 136 and sums[-3] - sums[0] < 10  # the longest text and the copies fill a shard each
    sums = check_shards(sharding.shard_rows(frame(spark, rows), shards=3).collect(), rows, 3)
    assert max(sums) - min(sums) < 100
    assert sharding.shard_rows(frame(spark, rows).where("doc_id < 0")).collect() == []


def test_sharding_in_chunks_beside_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 40)
    monkeypatch.setattr(sharding, "LAST", 8)
    rng = random.Random(6)
    small = [(k, f"{k} " + "y" * rng.randint(1, 400)) for k in range(1500)]
    hot = [(10_000 + k, "a large group of copies" * 8) for k in range(400)]
    sums = sorted(check_shards(sharding.shard_rows(frame(spark, small + hot)).collect(), small + hot))
    assert sums[-1] == 400 * (23 * 8 + 1) and sums[-2] - sums[0] < 400  # nothing joins a group beyond its share


def test_written_shards(spark):
    rows = [(k, f"text {k % 50}") for k in range(300)]
    path = new_path(spark, "test-shards")
    sharding.write_shards(frame(spark, rows), path, shards=4)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows and {r.n for r in back.groupBy("text").agg(F.countDistinct("_shard").alias("n")).collect()} == {1}


@given_tables
def test_sharding_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op12_sharding(spark, SF).collect()
    sums = check_shards(rows, docs)
    plain = plain_differencing([sum(len((t or "").encode()) + 1 for _, t in docs if (t or "") == x) for x in {t or "" for _, t in docs}], 16)
    assert max(sums) - min(sums) <= 2 * (plain[-1] - plain[0]) + 16
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


# --- Merkle manifest


def brute_tree(nodes):
    """Root, and the siblings of each node from the foot up as (left, right)."""
    paths, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a - a % 8 : a - a % 8 + 8]
            paths[k].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [a // 8 for a in at]
    return level[0], paths


def brute_manifest(rows, lower):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: brute_tree([leaf(r) for r in groups[g]]) for g in names}
    root, tops = brute_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if lower(r[0]) and r[4] is not None else r[4]
            node = leaf((*r[:4], text))
            for a, b in path + top:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), trees[g][0], root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


def manifest(spark, rows):
    path = new_path(spark, "test-manifest")
    docs = spark.createDataFrame([(i, t, g, s, n, 7, True, 0.5, "z", 1, "r", 1, 1, 0.0) for i, s, g, n, t in rows], SCHEMA).withColumns({"tree": F.lit("x"), "node": F.lit(2), "at": F.lit(3)}).repartition(3)
    merkle.build(docs, path, received={"text": F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))})
    return path


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 700])
def test_manifest(spark, n):
    rng = random.Random(n)
    rows = [(k * 2, rng.choice(["s", "ü", None]), "en" if n < 9 or rng.random() < 0.8 else rng.choice([None, "", "é", "zz"]), rng.choice([None, k]), rng.choice([None, "", "A b", "straße Ünï", "low"])) for k in range(n)]
    if n > 8:
        rows += [rows[3], rows[3], (None, None, None, None, None), (None, "s", "en", 1, "X" * 100_000)]
    path = manifest(spark, rows)
    assert sorted((tuple(r) for r in merkle.proofs(spark, path).collect()), key=str) == brute_manifest(rows, lambda i: i is not None and i % 3 == 0)
    full = merkle.proofs(spark, path, siblings=True).collect()
    for r in full:
        node = r.leaf
        for a, b in zip(r.lefts, r.rights, strict=True):
            node = sha(a + node + b)
        assert node == r.root and sha("".join(a + b for a, b in zip(r.lefts, r.rights, strict=True))) == r.proof_sha256


def test_manifest_of_many_trees_and_none(spark):
    rows = [(k, "s", f"l{k % 600}", 1, "t") for k in range(1300)]
    assert sorted((tuple(r) for r in merkle.proofs(spark, manifest(spark, rows)).collect()), key=str) == brute_manifest(rows, lambda i: i % 3 == 0)
    path = new_path(spark, "test-manifest")
    merkle.build(frame(spark, [(1, "x")]).where("doc_id < 0"), path)
    assert merkle.proofs(spark, path).collect() == []
