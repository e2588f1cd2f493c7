"""The live tables as Structured Streaming: candles, slots, gates, books, silence, all in event time.

Queries run with ``availableNow`` over landed files. In update mode each micro-batch is appended with its number, and
the newest row of a key counts. A run over all files equals the batch form where rows come no more than ``LATE`` behind
the newest one of earlier micro-batches. What comes later than that may be dropped: a window is closed for good one
micro-batch after the watermark has passed its end. ``run_to_table`` says how many groups of rows that were, and
``late_rows`` counts every row that came behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from slotforge import fixtures as X
from slotforge.operators import flow, ledger
from slotforge.sources import versioned
from slotforge.storage import new_path

LATE = "120 seconds"
#: Files of a micro-batch.
FILES = 64


def landed_events(spark: SparkSession, sf_dir: str, files: int = FILES) -> DataFrame:
    """Events as a stream, ``files`` of them a micro-batch. Watermarks need a timestamp with zone, so ``at`` is the same instant in UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parq*")  # a file or a folder
    us = F.expr(X.EPOCH_US)
    return e.withColumn("us", us).withColumn("at", F.timestamp_micros("us"))


def newest_rows(rows: DataFrame, keys: list[str], version: str, rest: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def dropped(query: StreamingQuery) -> int:
    """What stateful operators have dropped for coming behind the watermark, of the progress that the query remembers; an
    aggregation counts its partial groups, not rows."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def run_to_table(stream: DataFrame, keys: list[str], mode: str = "update", counts: dict[str, int] | None = None) -> DataFrame:
    """Process all that has landed; the newest row of each key. ``counts`` gets the micro-batches and the rows dropped as late."""
    spark = stream.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    schema = stream.schema

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/_b={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if counts is not None:
        counts |= {"batches": sum(p.numInputRows > 0 for p in query.recentProgress), "dropped": dropped(query)}
    columns = [f.name for f in schema.fields]
    wide = StructType([*schema.fields, StructField("_batch", IntegerType())])
    read = spark.read.schema(wide).parquet(f"{out}/*")
    return newest_rows(read, keys, "_batch", [c for c in columns if c not in keys])


def candles(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Bars from single values: the first opens, the last closes, highs and lows follow; late rows update their bar."""
    order = F.struct("us", "event_id")
    return events.withWatermark("at", LATE).groupBy(F.window("at", width).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    ).select(F.unix_seconds("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two feeds of the same events: what both deliver within the watermark counts once."""
    return first.unionByName(second).withWatermark("at", LATE).dropDuplicatesWithinWatermark([key])


def as_ticks(events: DataFrame) -> DataFrame:
    """The tick columns of ``fixtures.ticks`` on a stream."""
    slot = F.expr(f"us div {X.SLOT}000000 * {X.SLOT}")
    return events.select(
        "at", "event_id", slot.alias("slot_ts"), (F.col("us") / 1e6 - slot).alias("t_sec"), F.when(F.col("event_type").isin("purchase", "signup"), "Up").otherwise("Down").alias("outcome"),
        F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), ((F.get_json_object("props", "$.k").cast("int") + 1) / 101.0).alias("price"), F.col("value").alias("size_usdc"),
    )


def slot_flow(ticks: DataFrame) -> DataFrame:
    """The batch flow features on a stream, from the same aggregate columns, one row a slot and update."""
    seen = ticks.where((F.col("t_sec") >= 0) & (F.col("t_sec") < X.OBS)).withWatermark("at", LATE)
    w = F.window("at", f"{X.SLOT} seconds")
    return seen.groupBy(w.alias("w")).agg(*flow.flow_sums(X.OBS, X.WINDOWS, X.DECAY)).select(F.unix_seconds("w.start").alias("slot_ts"), *flow.flow_features(X.WINDOWS))


def sliding_rate(ticks: DataFrame, width: str, step: str) -> DataFrame:
    """Events, mean price and price slope of overlapping windows."""
    t = F.unix_micros("at") / 1e6
    w = F.window("at", width, step).alias("w")
    g = ticks.withWatermark("at", LATE).withColumn("t", t).groupBy(w).agg(F.count("*").alias("n"), F.avg("price").alias("price"), F.regr_slope("price", F.col("t") - 1.7e9).alias("slope"))
    return g.select(F.unix_seconds("w.start").alias("start"), "n", "price", F.coalesce("slope", F.lit(0.0)).alias("slope"))


def latest_price(ticks: DataFrame, below: float = 0.97) -> DataFrame:
    """The newest price under ``below`` and its time for each side and hour: what a cache of best prices holds."""
    kept = ticks.where(F.col("price") < below).withWatermark("at", LATE)
    return kept.groupBy(F.window("at", "1 hour").alias("w"), "side").agg(F.max_by("price", F.struct("at", "event_id")).alias("price"), F.max("at").alias("seen")).select(F.unix_seconds("w.start").alias("hour"), "side", "price", F.unix_micros("seen").alias("seen_us"))


def opening_state(ticks: DataFrame, low: float, high: float) -> DataFrame:
    """First price of a slot inside [low, high) and the last before the end of the observation window."""
    order = F.struct("at", "event_id")
    early = (F.col("t_sec") >= low) & (F.col("t_sec") < high)
    g = ticks.withWatermark("at", LATE).groupBy(F.window("at", f"{X.SLOT} seconds").alias("w")).agg(
        F.min_by(F.when(early, F.col("price")), F.when(early, order)).alias("open_price"), F.max_by(F.when(F.col("t_sec") < X.OBS, F.col("price")), F.when(F.col("t_sec") < X.OBS, order)).alias("last_price")
    )
    return g.select(F.unix_seconds("w.start").alias("slot_ts"), "open_price", "last_price", (F.col("last_price") - F.col("open_price")).alias("drift"))


def late_rows(events: DataFrame, limit_us: int) -> DataFrame:
    """hour, n, late: rows of each hour, and those that came more than a limit behind the newest row of earlier micro-batches.

    That is what a watermark of this limit leaves out of windows it has closed. Nothing is dropped here; the newest time
    is taken from the counts that earlier batches have written, so a repeated batch gives the same rows.
    """
    spark, out = events.sparkSession, new_path(events.sparkSession, "late")
    schema = "hour long, n long, late long, newest_us long"

    def count(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(*(f"{out}/_b={k}" for k in range(number))).agg(F.max("newest_us")).first()[0] if number else None
        late = F.lit(0) if before is None else F.when(F.col("us") < before - limit_us, 1).otherwise(0)
        hours = batch.groupBy(F.expr("us div 3600000000 * 3600").alias("hour"))
        hours.agg(F.count("*").alias("n"), F.sum(late).cast("long").alias("late"), F.max("us").alias("newest_us")).write.mode("overwrite").parquet(f"{out}/_b={number}")

    events.writeStream.foreachBatch(count).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/*").groupBy("hour").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


def resolved_log(log: DataFrame, labels: DataFrame, key: str, bound: str) -> DataFrame:
    """A feature log joined with resolutions that come within ``bound``; both sides keep bounded state. A row without one
    comes out once both feeds are past the bound."""
    l = log.withWatermark("at", LATE)
    r = labels.withWatermark("resolved_at", LATE)
    return l.join(r, F.expr(f"{key} = r_{key} AND resolved_at >= at AND resolved_at <= at + INTERVAL {bound}"), "leftOuter")


def freshness(events: DataFrame) -> DataFrame:
    """Rows and newest instant of each hour and feed."""
    return events.withWatermark("at", LATE).groupBy(F.window("at", "1 hour").alias("w"), F.col("event_type").alias("feed")).agg(F.count("*").alias("n"), F.max("us").alias("newest_us")).select(F.unix_seconds("w.start").alias("hour"), "feed", "n", "newest_us")


def keyed_history(ticks: DataFrame, last: int = 25) -> DataFrame:
    """The last ``last`` prices of each side with their mean: keyed state of bounded length."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held = sorted(held + list(zip(f["us"].tolist(), f["event_id"].tolist(), f["price"].tolist(), strict=True)))[-last:]
        state.update(tuple(list(c) for c in zip(*held, strict=True)) if held else ([], [], []))
        yield pd.DataFrame({"side": [key[0]], "n": [len(held)], "mean_price": [sum(p for _, _, p in held) / max(1, len(held))], "newest_us": [held[-1][0] if held else 0]})

    rows = ticks.select("side", F.unix_micros("at").alias("us"), "event_id", "price")
    return rows.groupBy("side").applyInPandasWithState(update, "side string, n long, mean_price double, newest_us long", "us array<long>, ids array<long>, prices array<double>", "update", GroupStateTimeout.NoTimeout)


def silence(events: DataFrame, quiet_us: int, checks: int = 3) -> DataFrame:
    """Gaps of each feed longer than a limit, and whether ``checks`` limits passed inside one: keyed state holds the newest time."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, gaps, alarms = state.get if state.exists else (0, 0, 0)
        times = sorted(t for f in frames for t in f["us"].tolist())
        for t in times:
            if last and t - last > quiet_us:
                gaps += 1
                alarms += int(t - last > checks * quiet_us)
            last = max(last, t)
        state.update((last, gaps, alarms))
        yield pd.DataFrame({"feed": [key[0]], "gaps": [gaps], "alarms": [alarms]})

    rows = events.select(F.col("event_type").alias("feed"), "us")
    return rows.groupBy("feed").applyInPandasWithState(update, "feed string, gaps long, alarms long", "last long, gaps long, alarms long", "update", GroupStateTimeout.NoTimeout)


def silent_feeds(events: DataFrame, quiet_us: int, checks: int = 3) -> DataFrame:
    """feed, newest_us, silent. A feed turns silent by a timer, without an event of its own, once the watermark is
    ``checks`` limits past its newest row; its next row ends that. State is one instant a feed."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        if not state.hasTimedOut:
            last = max([last, *(int(f["us"].max()) for f in frames if len(f))])
            state.update((last,))
        due = (last + checks * quiet_us) // 1000
        silent = state.hasTimedOut or due <= state.getCurrentWatermarkMs()
        if not silent:
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"feed": [key[0]], "newest_us": [last], "silent": [bool(silent)]})

    rows = events.withWatermark("at", LATE).select(F.col("event_type").alias("feed"), "us", "at")
    return rows.groupBy("feed").applyInPandasWithState(update, "feed string, newest_us long, silent boolean", "last long", "update", GroupStateTimeout.EventTimeTimeout)


def cached_asks(ticks: DataFrame, reset: Column, end: int, limit: int, below: float = 0.97) -> DataFrame:
    """Newest price under ``below`` of each token and slot, ``end`` seconds into it: null where a reset came later (the
    cache was cleared) or nothing came yet, and not fresh if older than ``limit`` seconds. A slot's state ends with it."""
    t = ticks.where(F.col("t_sec") <= end).withColumn("_reset", reset).withWatermark("at", LATE)
    order = F.when(~F.col("_reset") & (F.col("price") < below), F.struct("at", "event_id"))
    g = t.groupBy(F.window("at", f"{X.SLOT} seconds").alias("w"), "outcome").agg(F.max_by("price", order).alias("p"), F.max(order).alias("seen"), F.max(F.when(F.col("_reset"), F.struct("at", "event_id"))).alias("cleared"))
    held = F.col("seen").isNotNull() & (F.col("cleared").isNull() | (F.col("seen") > F.col("cleared")))
    age = F.unix_seconds("w.start") + end - F.unix_micros("seen.at") / 1e6
    return g.select(F.unix_seconds("w.start").alias("slot_ts"), "outcome", F.when(held, F.col("p")).alias("price"), (held & (age <= limit)).alias("fresh"))


def coverage(events: DataFrame, now_us: int, least: int = 180) -> DataFrame:
    """Age, rows of the last hour and of the last four of each feed at an instant, and whether the four hours are thin."""
    past = lambda hours: F.count_if((F.col("us") <= now_us) & (F.col("us") >= now_us - hours * 3_600_000_000))
    g = events.groupBy(F.col("event_type").alias("feed")).agg(F.max("us").alias("newest"), past(1).alias("n_1h"), past(4).alias("n_4h"))
    return g.select("feed", F.expr(f"({now_us} - newest) div 1000000").alias("age"), "n_1h", "n_4h", (F.col("n_4h") < least).alias("low"))


def slot_targets(events: DataFrame) -> DataFrame:
    """Label of each slot as it stands: 1 if its last value is above its first."""
    order = F.struct("us", "event_id")
    g = events.withWatermark("at", LATE).groupBy(F.window("at", f"{X.SLOT} seconds").alias("w")).agg((F.max_by("value", order) > F.min_by("value", order)).alias("up"))
    return g.select(F.unix_seconds("w.start").alias("slot_ts"), F.col("up").cast("int").alias("target"))


def settle_stream(labels: DataFrame, root: str, slot: int, grace: int) -> None:
    """Settle the open rows of a versioned ledger (partitioned by ``ledger_day``) with final labels, a version a micro-batch.

    Only the days that a batch has labels of are read, rewritten and swapped in. The manifest holds the batch's number, so
    a batch that is repeated after a failure changes nothing, whether it failed before or after the swap.
    """
    spark = labels.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        known = batch.persist()
        try:
            days = [r[0] for r in known.select(ledger_day(F.col("slot_ts")).cast("string")).distinct().collect()]
            if days:
                now = known.agg(F.max("slot_ts")).first()[0] + slot + grace
                versioned.replace(ledger.settle(versioned.read(spark, root, parts=days), known, now, slot, grace), root, ledger_day(F.col("slot_ts")), batch=number)
        finally:
            known.unpersist()

    labels.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ledger_day(slot_ts: Column) -> Column:
    return F.floor(slot_ts / 86_400)


def stateful_gates(settled: DataFrame, last: int = 20, least: float = 0.4, warm: int = 3, run: int = 3) -> DataFrame:
    """feed, us, id, won, signature to the gates of each feed: win rate of the last rows, the latch that stays, whether
    the last ``run`` signatures were ever the same, and whether the feed still warms up. State has ``last`` rows a feed.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, wins, signs, paused, stale = state.get if state.exists else (0, [], [], False, False)
        wins, signs = list(wins), list(signs)
        rows = sorted(r for f in frames for r in zip(f["us"].tolist(), f["id"].tolist(), f["won"].tolist(), f["signature"].tolist(), strict=True))
        for _, _, won, sign in rows:
            seen, wins, signs = seen + 1, [*wins, int(won)][-last:], [*signs, sign][-run:]
            paused = paused or (len(wins) == last and sum(wins) / last < least)
            stale = stale or (len(signs) == run and len(set(signs)) == 1)
        state.update((seen, wins, signs, paused, stale))
        yield pd.DataFrame({"feed": [key[0]], "n": [seen], "win_rate": [sum(wins) / max(1, len(wins))], "paused": [paused], "stale": [stale], "warming": [seen <= warm]})

    return settled.groupBy("feed").applyInPandasWithState(
        update, "feed string, n long, win_rate double, paused boolean, stale boolean, warming boolean", "seen long, wins array<long>, signs array<string>, paused boolean, stale boolean", "update", GroupStateTimeout.NoTimeout
    )
