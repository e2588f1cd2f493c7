"""Sharding by bytes: groups of equal texts stay together, Karmarkar-Karp differencing balances them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm.common import materialize, shuffle_parts
from slotforge.llm.order import numbered

SHARDS = 16
#: A group with this share of all bytes or rows is large: there are twice as many at most.
LARGE = 1_024
#: Groups that a task differences at once, and those left for the last round (or one for each task).
CHUNK, LAST = 1 << 16, 1 << 14


def differencing(sizes: list[int], start: list[int]) -> tuple[list[int], list[int]]:
    """The shard of each item and the final sums, from ``start`` sums on.

    Each item is a partial partition with one filled part, the start is one too. The two with the largest spread are
    combined, the largest part with the smallest, until one is left; the part that holds a start sum is that shard.
    """
    k = len(start)
    order = sorted(range(k), key=lambda j: -start[j])
    # (minus spread, number, parts in descending order, what each part holds: an item, ~shard, or a pair of such)
    heap: list[tuple] = [(-(max(start) - min(start)), -1, [start[j] for j in order], [~j for j in order])]
    zeros, none = [0] * (k - 1), [None] * (k - 1)
    heap += [(-s, i, [s, *zeros], [i, *none]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heap[0]
        parts = sorted(((x + y, y and x, p, q) for x, y, p, q in zip(a, reversed(b), held_a, reversed(held_b), strict=True)), key=lambda t: t[0], reverse=True)
        sums = [t[0] for t in parts]
        held = [q if p is None else p if q is None else (p, q) for _, _, p, q in parts]
        heapq.heapreplace(heap, (sums[-1] - sums[0], number, sums, held))
        number += 1
    _, _, sums, held = heap[0]
    shards, totals = [0] * len(sizes), [0] * k
    for total, top in zip(sums, held, strict=True):
        items, stack, shard = [], [top], None
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x < 0:
                shard = ~x
            else:
                items.append(x)
        totals[shard] = total
        for i in items:
            shards[i] = shard
    return shards, totals


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, digest, shard, slot (from 0 in each shard, by id), shard_rows.

    A row's size is its text's bytes plus one; rows of equal texts (null counts as empty) go to one shard. Groups of
    LARGE share (2,048 at most) are differenced first, on the driver. Each task then differences chunks of its other
    groups onto the chunk's share of those sums, and a bounded number of groups is left over for a last round onto the
    sums so far. A group larger than its fair share fills a shard alone as far as the others can take the rest.

    Null and repeated ids are rows like others; ties in slots are settled once; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, count = groups.agg(F.sum("bytes"), F.sum("n")).first()
    is_large = (F.col("bytes") * LARGE >= (total or 0)) | (F.col("n") * LARGE >= (count or 0))
    large = sorted((-r.bytes, bytes(r.digest)) for r in groups.where(is_large).collect()) if total else []
    placed, sums = differencing([-b for b, _ in large], [0] * shards)
    first = spark.createDataFrame([(d, j) for (_, d), j in zip(large, placed, strict=True)], "digest binary, shard int")
    small = (total or 0) - sum(sums)
    tasks = shuffle_parts(spark)
    leave = max(1, LAST // tasks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, carry = leave, [0] * shards
        digests: list[bytes] = []
        sizes: list[int] = []

        def deal() -> pa.RecordBatch:
            nonlocal carry
            own = sum(sizes)
            start = [x * own // small + c for x, c in zip(sums, carry, strict=True)]
            got, after = differencing(sizes, start)
            level = min(after)
            carry = [x - level if x > s else 0 for x, s in zip(after, start, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(got, pa.int32())], names=["digest", "bytes", "shard"])

        for batch in batches:
            d, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if left:
                now, left = min(left, len(d)), max(0, left - len(d))
                yield pa.RecordBatch.from_arrays([pa.array(d[:now], pa.binary()), pa.array(b[:now], pa.int64()), pa.nulls(now, pa.int32())], names=["digest", "bytes", "shard"])
                d, b = d[now:], b[now:]
            digests += d
            sizes += b
            if len(sizes) >= CHUNK:
                yield deal()
                digests, sizes = [], []
        if sizes:
            yield deal()

    others = groups.where(~is_large).select("digest", "bytes") if total else groups.select("digest", "bytes").limit(0)
    dealt = materialize(others.repartition(tasks, "digest").sortWithinPartitions("digest").mapInArrow(work, "digest binary, bytes long, shard int"), "shard-dealt")
    for r in dealt.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("bytes").alias("b")).collect():
        sums[r.shard] += r.b
    rest = sorted((-r.bytes, bytes(r.digest)) for r in dealt.where("shard IS NULL").select("bytes", "digest").collect())  # LAST, or one for each task
    placed, sums = differencing([-b for b, _ in rest], sums)
    last = spark.createDataFrame([(d, j) for (_, d), j in zip(rest, placed, strict=True)], "digest binary, shard int")
    hot = rows.join(F.broadcast(first), "digest")  # 2 * LARGE groups at most
    other = rows.join(F.broadcast(first.select("digest")), "digest", "left_anti").join(dealt.where("shard IS NOT NULL").select("digest", "shard").unionByName(last), "digest")
    out = numbered(hot.unionByName(other), "shard", ["id", "digest"], "shard-slots", at="slot", n="shard_rows")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "digest", "shard", "slot", "shard_rows")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows with all their columns as Parquet folders ``_shard=j``, each text of a group in the same one.

    A shard's files are cut by the cluster's partitions: a large shard is written by many tasks.
    """
    found = shard_rows(docs, shards, id_col, text_col).groupBy("digest").agg(F.first("shard").alias("_shard"))
    keyed = docs.withColumn("_digest", F.unhex(F.sha2(F.coalesce(docs[f"`{text_col}`"], F.lit("")), 256)))
    keyed.join(found.withColumnRenamed("digest", "_digest"), "_digest").drop("_digest").write.partitionBy("_shard").parquet(path)
