"""Embedding near-deduplication with a pivot-permutation index."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm.common import materialize, shuffle_parts
from slotforge.llm.graph import connected_components, join_labels

#: Nearest pivots that describe a vector, and how many of them two vectors must share to be compared.
NEAREST, SHARED = 7, 4
#: Pivots grow with the root of the number of vectors, so that inverted lists keep their length. The sample that they
#: are chosen from is bounded by PIVOTS[1] * SAMPLE vectors.
PIVOTS, SAMPLE = (128, 4096), 4
#: Pivots are no nearer to each other than this cosine, so that a dense group can't draw them all.
APART = 0.5
#: Longer inverted lists are cut into chunks, and each pair of chunks is a group of its own; rows compared at once.
CHUNK, TILE = 4096, 1024
#: Bits of a pivot's number in a key.
PIVOT_BITS = 20


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` unit vectors that stand apart; where these are too few, fixed random directions make it up,
    as the order of such directions tells more about a dense group than its own members would."""
    width = sample.shape[1]
    chosen, n = np.zeros((count, width)), 0
    for v in sample:
        if n == count:
            break
        if not n or (chosen[:n] @ v).max() <= APART:
            chosen[n] = v
            n += 1
    if n < count and width > 1:
        chosen[n:] = _unit(np.random.default_rng(7).normal(size=(count - n, width)))
        n = count
    return chosen[:n]


def _valid(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each width: rows of finite vectors that aren't zero, and the vectors."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    values = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        x = values[starts[rows][:, None] + np.arange(width)] + 0.0
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield width, rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _payload(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, pivots: int | None = None) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Equal vectors form one class. Each class is described by its nearest pivots; classes that share SHARED of them are
    compared. A class enters the inverted lists of pairs of its lower pivots, as the two lowest that are shared must be
    among these, and a pair of classes is treated in the list of its two lowest shared pivots only. Lists are first
    joined by pivots alone; the vectors are sent only to lists in which they have a candidate, and verified there by
    cosine in double precision. Only counts and a spanning forest leave a task.

    Vectors that are null, of norm zero, or hold a null or non-finite component link with nothing, nor do rows with a
    null id; vectors of different length never link. Rows that share an id are one node, of which one vector counts (the
    one with the smallest digest), so an id never links with itself. n_links: other ids linked directly; component_id:
    smallest id reachable, itself included; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, x in _valid(batch.column("v")):
                raw = [r.tobytes() for r in x.astype(kind)]
                digests = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array([width] * len(at), pa.int32()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["id", "width", "digest", "raw"])

    found = materialize(rows.where("id IS NOT NULL").mapInArrow(keep, "id long, width int, digest binary, raw binary"), "vectors")
    again = materialize(found.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if again.head(1):
        one = found.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("digest", "width", "raw")).alias("s")).select("id", "s.width", "s.digest", "s.raw")
        found = materialize(found.join(again, "id", "left_anti").unionByName(one), "vectors")
    classes = materialize(found.groupBy("width", "digest").agg(F.min("id").alias("class"), F.count("*").alias("m")), "classes")
    sizes = {r.width: r.n for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()}
    each = [_links(found.where(F.col("width") == d), classes.where(F.col("width") == d), d, n, threshold, pivots, kind) for d, n in sorted(sizes.items()) if n > 1]
    if each:
        links = each[0]
        for other in each[1:]:
            links = links.unionByName(other)
        links = materialize(links, "links")
        named = connected_components(links.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class")
        direct = links.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked"))
    else:
        none = spark.createDataFrame([], "class long, linked long, component long")
        named, direct = none.select("class", "component"), none.select("class", "linked")
    known = classes.join(direct, "class", "left").join(named, "class", "left")
    known = known.select("width", "digest", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("component", "class").alias("component"))
    known = materialize(found.select("id", "width", "digest").join(known, ["width", "digest"]).select(F.col("id").alias("_id"), "n_links", "component"), "known")
    out = rows.select("id").join(known, F.col("id") == F.col("_id"), "left")
    alone = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(F.col("id") == alone, F.lit(True)).alias("kept"))


def _links(found: DataFrame, classes: DataFrame, width: int, count: int, threshold: float, pivots: int | None, kind: str) -> DataFrame:
    """a, b, n: an edge where b is set, else n links of a in one list."""
    spark = classes.sparkSession
    wanted = pivots or min(PIVOTS[1], max(PIVOTS[0], math.isqrt(count)))
    drawn = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE * wanted).select(F.col("class").alias("id"))  # SAMPLE * PIVOTS[1] ids at most
    sample = found.join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "id").select("raw").toArrow().column(0)
    points = choose_pivots(_payload(sample, width, kind), wanted)
    shared = spark.sparkContext.broadcast(points)  # at most PIVOTS[1] vectors
    near = min(NEAREST, len(points))
    meet = min(SHARED, near)
    lower = list(combinations(range(near - meet + min(2, meet)), min(2, meet)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                score = _payload(batch.column("raw"), width, kind) @ shared.value.T
                tops = np.sort(np.argsort(-score, axis=1, kind="stable")[:, :near], axis=1).astype(np.int32)
                keys = np.stack([sum(tops[:, p].astype(np.int64) << (PIVOT_BITS * k) for k, p in enumerate(pair)) for pair in lower], axis=1)
                n = len(tops) * len(lower)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * near), pa.array(np.repeat(tops, len(lower), axis=0).reshape(-1)))
                ids = np.repeat(np.asarray(batch.column("class")), len(lower))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.reshape(-1)), flat], names=["class", "key", "tops"])

    members = found.join(classes.select("class", "m"), F.col("id") == F.col("class")).select("class", "m", "raw")
    postings = materialize(members.select("class", "raw").mapInArrow(describe, "class long, key long, tops array<int>"), "postings")
    long = materialize(postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(F.col("key").alias("_key"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "lists")
    if long.head(1):
        cut = postings.join(long, F.col("key") == F.col("_key"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        cut = cut.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")).select("class", "key", "tops", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        cut = cut.select("class", "key", "tops", "mine", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"))
    else:
        cut = postings.select("class", "key", "tops", *(F.lit(0).alias(c) for c in ("mine", "c1", "c2")))
    group = ["key", "c1", "c2"]
    dealt = cut.repartition(shuffle_parts(spark), *group).sortWithinPartitions(*group)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, group):
            live = np.zeros(rows.num_rows, dtype=bool)
            for i, j, mask in _candidates(rows, near, meet):
                live[i[mask.any(axis=1)]] = True
                live[j[mask.any(axis=0)]] = True
            if live.any():
                yield from rows.filter(pa.array(live)).combine_chunks().to_batches()

    kinds = "class long, key long, tops array<int>, mine int, c1 int, c2 int"
    live = materialize(dealt.select("class", "key", "tops", "mine", "c1", "c2").mapInArrow(meeting, kinds), "live")
    sent = live.join(members.withColumnRenamed("class", "_class"), F.col("class") == F.col("_class")).drop("_class")
    sent = sent.repartition(shuffle_parts(spark), *group).sortWithinPartitions(*group)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, group):
            yield from _verified(rows, width, near, meet, threshold, kind)

    return sent.select("class", "key", "tops", "mine", "c1", "c2", "m", "raw").mapInArrow(verify, "a long, b long, n long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one group at a time from a sorted partition, where there are several; about two chunks at most."""
    held: list[pa.RecordBatch] = []
    last, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in keys]
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = [0, *changes.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            ident = tuple(c[a] for c in columns)
            if ident != last:
                if size > 1:
                    yield pa.Table.from_batches(held)
                held, last, size = [], ident, 0
            held.append(batch.slice(a, b - a))
            size += b - a
    if size > 1:
        yield pa.Table.from_batches(held)


def _candidates(rows: pa.Table, near: int, meet: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of a list: two sets of rows, and which of their pairs share enough pivots and are treated in this list."""
    tops = rows.column("tops").combine_chunks().flatten().to_numpy().reshape(-1, near)
    key, mine = rows.column("key")[0].as_py(), np.asarray(rows.column("mine"))
    last = (key >> PIVOT_BITS) & ((1 << PIVOT_BITS) - 1) if meet > 1 else key
    names, at = np.unique(tops, return_inverse=True)
    has = np.zeros((len(tops), len(names)), dtype=np.float32)
    has[np.arange(len(tops))[:, None], at.reshape(tops.shape)] = 1
    low = has[:, names <= last]
    same = rows.column("c1")[0].as_py() == rows.column("c2")[0].as_py()
    first = np.flatnonzero(mine == rows.column("c1")[0].as_py())
    second = first if same else np.flatnonzero(mine == rows.column("c2")[0].as_py())
    for a in range(0, len(first), TILE):
        for b in range(a if same else 0, len(second), TILE):
            i, j = first[a : a + TILE], second[b : b + TILE]
            mask = (has[i] @ has[j].T >= meet - 0.5) & (low[i] @ low[j].T < min(2, meet) + 0.5)
            if same and a == b:
                mask &= np.tri(len(i), dtype=bool).T & ~np.eye(len(i), dtype=bool)
            if mask.any():
                yield i, j, mask


def _verified(rows: pa.Table, width: int, near: int, meet: int, threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    x = _payload(rows.column("raw"), width, kind)
    classes, m = np.asarray(rows.column("class")), np.asarray(rows.column("m"))
    linked, labels = np.zeros(n, dtype=np.int64), np.arange(n)
    for i, j, mask in _candidates(rows, near, meet):
        p, q = np.nonzero(mask & (x[i] @ x[j].T >= threshold))
        if len(p):
            a, b = i[p], j[q]
            linked += np.bincount(a, m[b], n).astype(np.int64) + np.bincount(b, m[a], n).astype(np.int64)
            labels = join_labels(labels, a, b)
    some, moved = np.flatnonzero(linked), np.flatnonzero(labels != np.arange(n))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(classes[some]), pa.nulls(len(some), pa.int64()), pa.array(linked[some])], names=["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(classes[moved]), pa.array(classes[labels[moved]]), pa.nulls(len(moved), pa.int64())], names=["a", "b", "n"])
