"""Exact deduplication by sorting content."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from slotforge.llm.common import materialize, parts, shuffle_parts

#: Sampled rows for each partition, and characters of a sampled text that come to the driver at first; those that tie come
#: again with LONGER times as many.
SAMPLED, HEAD, LONGER = 64, 32, 8

_RUNS = "id long, text_sha256 string, part int, run int, run_rows long, run_last long, is_last boolean, edge string, edge_text string"


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Column | None = None,
    keep: str = "smallest",
    partitions: int | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Sampled splitters range-partition the normalised texts by their bytes, each task sorts its range externally, and
    neighbours are compared in full. A splitter is a prefix just long enough to part two neighbours of the sample; where a
    whole text fills a range, its copies are parted by id. A group of copies that spans several ranges is rejoined
    through the two edge runs of each partition, so no task ever holds a whole group. ``keep``: which id stays,
    ``smallest`` or ``largest``.

    Null text counts as empty. A null id sorts as the one to drop; of rows tied on text and id exactly one is kept.
    An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    n = partitions or shuffle_parts(spark)
    text = F.coalesce(docs[text_col] if normalise is None else normalise, F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"))
    runs = materialize(_sorted(rows, n, keep).select("id", "text", F.sha2("text", 256).alias("digest")).mapInArrow(_runs, _RUNS), "exact-runs")

    edges = _edge_groups(runs)
    out = runs.join(F.broadcast(edges), ["part", "run"], "left")  # two rows for each partition at most
    joined = F.col("all_rows").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(joined, F.col("all_last")).otherwise(F.col("run_last")).alias("keep_id"),
        F.coalesce("all_rows", "run_rows").alias("group_size"),
        (F.col("is_last") & F.coalesce("ends_group", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def _sorted(rows: DataFrame, n: int, keep: str) -> DataFrame:
    """Rows with ``id`` and ``text`` in ``n`` ranges of (text's bytes, id), each sorted; the id to keep comes last."""
    bounds = _splitters(rows, n, keep)
    at = rows.columns.index("id"), rows.columns.index("text")
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            ids, texts = part.column(at[0]).to_pylist(), part.column(at[1]).cast(pa.binary()).to_pylist()
            place = [bisect_right(bounds, (t, _order(i, keep))) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(place, pa.int32())], names=schema.names)

    last = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    return rows.mapInArrow(deal, schema).repartitionById(len(bounds) + 1, "_part").sortWithinPartitions("text", last)


def _order(i: int | None, keep: str) -> int:
    """Ascending in this, the id to keep comes last; a null id comes first."""
    return -(2**63) - 1 if i is None else i if keep == "largest" else -i


def _splitters(rows: DataFrame, n: int, keep: str) -> list[tuple[bytes, int]]:
    """At most n-1 bounds (bytes, id order). Sampled rows are sorted by prefixes; a bound whose prefix ties with another
    sampled text's, and isn't its whole text, is looked at again with a longer prefix. Only such prefixes come to the
    driver, and whole texts only if they are short or fill a range."""
    total = rows.count()
    if n < 2 or not total:
        return []
    drawn = rows.select("id", "text").sample(min(1.0, SAMPLED * n / total), seed=23).withColumn("k", F.monotonically_increasing_id())
    sample = materialize(drawn, "exact-sample")
    head = lambda chars: F.struct(F.substring("text", 1, chars).cast("binary").alias("head"), (F.length("text") <= chars).alias("whole"))
    held = {r.k: (bytes(r.h.head), r.h.whole, _order(r.id, keep)) for r in sample.select("k", "id", head(HEAD).alias("h")).collect()}
    chars = HEAD
    while True:
        keys = sorted(held, key=lambda k: (held[k][0], held[k][2], k))
        chosen = sorted({keys[len(keys) * j // n] for j in range(1, n)}) if keys else []
        same = Counter(x[0] for x in held.values())
        tied = {held[k][0] for k in chosen if not held[k][1] and same[held[k][0]] > 1}
        if not tied:
            break
        again = [k for k, x in held.items() if x[0] in tied and not x[1]]
        chars *= LONGER
        longer = sample.join(F.broadcast(sample.sparkSession.createDataFrame([(k,) for k in again], "k long")), "k")  # sampled rows
        for r in longer.select("k", head(chars).alias("h")).collect():
            held[r.k] = (bytes(r.h.head), r.h.whole, held[r.k][2])
    whole = Counter(x[0] for x in held.values() if x[1])
    return sorted({(held[k][0], held[k][2] if held[k][1] and whole[held[k][0]] > 1 else -(2**63) - 2) for k in chosen})


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns, after a single shuffle of the texts.

    A task holds one row at a time: the last of each run in its sorted partition goes on, and the last of the partition
    only if the next partition doesn't begin with an equal text. The same cases are defined as in ``exact_dedup``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = F.coalesce(docs[text_col] if normalise is None else normalise, F.lit(""))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("id"), text.alias("text"))
    dealt = _sorted(rows, partitions or shuffle_parts(docs.sparkSession), keep).select("row", "text", F.sha2("text", 256).alias("digest"))
    kind = StructType([StructField("row", rows.schema["row"].dataType), StructField("part", IntegerType()), StructField("edge", StringType()), StructField("edge_text", StringType())])
    kept = materialize(dealt.mapInArrow(_last_of_runs, kind), "exact-kept")
    firsts = kept.where("edge IN ('F', 'FL')").select("part", "edge_text")
    before = firsts.select("part", F.lag("part").over(Window.orderBy("part")).alias("prev"))  # one row for each partition
    lasts = kept.where("edge IN ('L', 'FL')").select(F.col("part").alias("prev"), F.col("edge_text").alias("prev_text"))
    goes_on = firsts.join(before, "part").join(lasts, "prev").where("edge_text = prev_text").select(F.col("prev").alias("part"), F.lit(True).alias("goes_on"))
    out = kept.withColumn("ends", F.col("edge").isin("L", "FL")).join(F.broadcast(goes_on), "part", "left")  # one row for each partition at most
    return out.where(~(F.coalesce("ends", F.lit(False)) & F.coalesce("goes_on", F.lit(False)))).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _last_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each run of equal neighbours; the first and last run of the partition are marked."""
    part, held, first = TaskContext.get().partitionId(), None, True

    def out(rows: pa.RecordBatch, end: bool) -> pa.RecordBatch:
        nonlocal first
        edges = [None] * rows.num_rows
        if first:
            edges[0] = "F"
        if end:
            edges[-1] = (edges[-1] or "") + "L"
        first = False
        text = rows.column(1)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([part] * rows.num_rows, pa.int32()), pa.array(edges, pa.string()), pa.array([text[k].as_py() if e else None for k, e in enumerate(edges)], pa.string())], names=["row", "part", "edge", "edge_text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = rows.num_rows
        ends = [k for c in (1, 2) for k in pc.indices_nonzero(pc.not_equal(rows.column(c).slice(0, n - 1), rows.column(c).slice(1))).to_pylist()]
        if ends:
            yield out(rows.take(pa.array(sorted(set(ends)), pa.int64())), False)
        held = rows.slice(n - 1)
    if held is not None:
        yield out(held, True)


def _edge_groups(runs: DataFrame) -> DataFrame:
    """For the first and last run of each partition: rows and last id of the whole group they belong to."""
    ends = runs.where("edge IS NOT NULL").select("part", "run", "run_rows", "run_last", "edge", "edge_text")
    firsts = ends.where("edge IN ('F', 'FL')")
    lasts = ends.where("edge IN ('L', 'FL')")
    after = Window.orderBy("part")  # one row for each partition
    follows = firsts.select("part").withColumn("prev", F.lag("part").over(after))
    same = (
        firsts.join(follows, "part")
        .join(lasts.select(F.col("part").alias("prev"), F.col("edge_text").alias("prev_text")), "prev", "left")
        .select("part", "run", F.coalesce(F.col("edge_text") == F.col("prev_text"), F.lit(False)).alias("same"))
    )
    chain = Window.orderBy("part", "run")
    links = (
        ends.drop("edge_text", "edge").join(same, ["part", "run"], "left")
        .withColumn("group", F.sum(F.when(F.coalesce("same", F.lit(False)), 0).otherwise(1)).over(chain))
    )
    whole = Window.partitionBy("group")
    tail = Window.partitionBy("group").orderBy(F.desc("part"), F.desc("run"))
    return links.select(
        "part",
        "run",
        F.sum("run_rows").over(whole).alias("all_rows"),
        F.first("run_last").over(tail).alias("all_last"),
        (F.row_number().over(tail) == 1).alias("ends_group"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare neighbours of a sorted partition in full; the ids of one run at a time are held."""
    part = TaskContext.get().partitionId()
    ids: list[int | None] = []
    done: list[tuple] = []
    text, digest, run = None, None, 0
    schema = pa.schema([("id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32()), ("run", pa.int32()), ("run_rows", pa.int64()), ("run_last", pa.int64()), ("is_last", pa.bool_()), ("edge", pa.string()), ("edge_text", pa.string())])

    def close(end: bool) -> None:
        edge = ("F" if run == 0 else "") + ("L" if end else "") or None
        size = len(ids)
        for k, i in enumerate(ids):
            last = k == size - 1
            done.append((i, digest, part, run, size, ids[-1], last, edge if last else None, text if last and edge else None))
        ids.clear()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        done.clear()
        return out

    for batch in batches:
        texts = batch.column(1)
        for k, (i, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if ids and (d != digest or texts[k].as_py() != text):
                close(False)
                run += 1
            if not ids:
                digest, text = d, texts[k].as_py()
            ids.append(i)
        if len(done) >= 10_000:
            yield flush()
    if ids:
        close(True)
    if done:
        yield flush()
