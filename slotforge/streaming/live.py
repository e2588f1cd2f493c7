"""Keyed live state with timers: arbitrated candles, slot history with later labels, microstructure, total silence.

State of a key is bounded: by a number of bars or slots, by a retention in time, or by one count. Rows of one key are
taken in the order of their arrival; a micro-batch sorts them, so files only have to arrive in that order.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from slotforge.storage import new_path
from slotforge.streaming.tables import newest_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of the table for each file of a replayed piece.
ROWS = 250_000


def replay(df: DataFrame, arrival: str, pieces: int = 4, rows: int = ROWS) -> DataFrame:
    """A table as a stream that arrives in ``pieces`` micro-batches, in the order of ``arrival``.

    A piece has a file for each ``rows`` rows of the table, two for each core at most, so that all tasks write it. All
    pieces have the same number of files, empty ones if need be, as a micro-batch takes that many.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "arrivals")
    low, high, n = df.agg(F.min(arrival), F.max(arrival), F.count("*")).first()
    low, high = (low, high) if low is not None else (0, 0)
    step, files = (high - low) // pieces + 1, min(n // rows + 1, 2 * spark.sparkContext.defaultParallelism)
    for k in range(pieces):  # one after the other: a file source reads files by their time
        part = df.where((F.col(arrival) >= low + k * step) & (F.col(arrival) < low + (k + 1) * step))
        part.coalesce(files).write.mode("append").parquet(path)
        for _ in range((k + 1) * files - len(spark.read.schema(df.schema).parquet(path).inputFiles()) if files > 1 else 0):
            spark.createDataFrame([], df.schema).write.mode("append").parquet(path)
        time.sleep(0.01)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str = "None", mode: str = "Update") -> DataFrame:
    """``rows`` by key through a processor. Its list and map state need the RocksDB store, which is set on the session."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, time_mode)


def _sorted(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame | None:
    frames = [f for f in rows if len(f)]
    return pd.concat(frames).sort_values(list(order), kind="stable") if frames else None


class Candles(StatefulProcessor):
    """Bars of one symbol from a pushed feed and a polled one.

    A pushed row updates its minute's bar or opens it. A polled row counts only if its minute isn't older than the newest
    one so far. The row that counts last gives close and volume, highs and lows widen. The last ``keep`` bars are held;
    a row older than all of them, with that many held, is left out.
    """

    schema = "symbol string, minute long, close double, high double, low double, volume double, version long"

    def __init__(self, keep: int = 300):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getMapState("bars", "minute long", "close double, high double, low double, volume double, version long")
        self.count = handle.getValueState("count", "rows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = _sorted(rows, "arrival", "id")
        if got is None:
            return
        held = {k[0]: tuple(v) for k, v in self.bars.iterator()}
        seen, before = (self.count.get()[0] if self.count.exists() else 0), set(held)
        newest, changed = max(held, default=None), {}
        for minute, close, high, low, volume, polled in got[["minute", "close", "high", "low", "volume", "polled"]].itertuples(index=False):
            seen += 1
            minute = int(minute)
            if polled and newest is not None and minute < newest:
                continue
            if minute not in held and len(held) >= self.keep and minute < min(held):
                continue
            old = held.get(minute)
            held[minute] = (close, max(high, old[1]), min(low, old[2]), volume, seen) if old else (close, high, low, volume, seen)
            changed[minute] = held[minute]
            newest = minute if newest is None else max(newest, minute)
            if len(held) > self.keep:
                held.pop(min(held))
        for m in before - set(held):
            self.bars.removeKey((m,))
        for m in set(changed) & set(held):
            self.bars.updateValue((m,), tuple(held[m]))
        self.count.update((seen,))
        yield pd.DataFrame([(key[0], m, *bar) for m, bar in sorted(changed.items())], columns=["symbol", "minute", "close", "high", "low", "volume", "version"])


def arbitrated(rows: DataFrame, keep: int = 300) -> DataFrame:
    """symbol, minute, close, high, low, volume, polled, arrival, id to the bars that a batch changes, with a growing version."""
    return stateful(rows, "symbol", Candles(keep), Candles.schema)


class History(StatefulProcessor):
    """The last ``last`` slots of a market; a label that comes later changes its slot, one for a slot gone is left out.

    A label that comes before its slot waits for it, ``last`` labels at most.
    """

    schema = "market string, slot_ts long, up_ratio double, n_ticks double, vol_tot double, target double, gone boolean"

    def __init__(self, last: int = 25):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot_ts long", "up_ratio double, n_ticks double, vol_tot double, target double")
        self.early = handle.getListState("early", "slot_ts long, target double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = _sorted(rows, "arrival", "id")
        if got is None:
            return
        held = {k[0]: tuple(v) for k, v in self.slots.iterator()}
        early = {int(s): t for s, t in self.early.get()}
        before, changed = set(held), set()
        for slot, ratio, n, vol, target in got[["slot_ts", "up_ratio", "n_ticks", "vol_tot", "target"]].itertuples(index=False):
            slot, label = int(slot), None if pd.isna(target) else float(target)
            if label is not None:
                if slot in held:
                    held[slot] = (*held[slot][:3], label)
                    changed.add(slot)
                elif not held or slot > max(held):
                    early[slot] = label
                continue
            if slot in held or (len(held) >= self.last and slot < min(held)):
                continue
            held[slot] = (float(ratio), float(n), float(vol), early.pop(slot, None))
            changed.add(slot)
            if len(held) > self.last:
                held.pop(min(held))
        early = dict(sorted(early.items())[-self.last :])
        gone = sorted((before | changed) - set(held))
        for s in set(gone) & before:
            self.slots.removeKey((s,))
        for s in changed & set(held):
            self.slots.updateValue((s,), tuple(held[s]))
        self.early.put(list(early.items())) if early else self.early.clear()
        out = [(key[0], s, *held[s], False) for s in sorted(changed & set(held))] + [(key[0], s, None, None, None, None, True) for s in gone]
        frame = pd.DataFrame(out, columns=["market", "slot_ts", "up_ratio", "n_ticks", "vol_tot", "target", "gone"])
        yield frame.astype({c: "float64" for c in ("up_ratio", "n_ticks", "vol_tot", "target")})


def history(rows: DataFrame, last: int = 25) -> DataFrame:
    """market, slot_ts, up_ratio, n_ticks, vol_tot, target, arrival, id to the entries that a batch changes.

    A row with a target is a label (its other values are ignored), one without is a new slot.
    """
    return stateful(rows, "market", History(last), History.schema)


_FEATURES = ("imb_mean", "imb_std", "imb_drift", "spread_mean", "spread_trend", "mid_velocity", "mid_volatility", "activity_rate", "depth_trend", "ask_pressure")


def _slope(t: np.ndarray, y: np.ndarray) -> float:
    d = t - t.mean() if len(t) else t
    return float((d * (y - y.mean())).sum() / (d * d).sum()) if len(t) > 1 and (d * d).sum() > 0 else 0.0


def window_features(e: pd.DataFrame, span: float, least_events: int = 5, least_mids: int = 2) -> tuple[float, ...]:
    """The ten features of ``book.microstructure`` for the events of one window in order of time."""
    mids = e["mid"].notna().to_numpy()
    if len(e) < least_events or mids.sum() < least_mids:
        return (0.0,) * len(_FEATURES)
    t = e["t"].to_numpy(float)
    mid, spread = e["mid"].to_numpy(float)[mids], e["spread"].to_numpy(float)
    imb, depth, sell = (e[c].dropna().to_numpy(float) for c in ("imbalance", "depth", "sell_price"))
    moves, asks = np.diff(mid), np.diff(sell)
    known = ~np.isnan(spread)
    return (
        float(imb.mean()) if len(imb) else 0.0, float(imb.std()) if len(imb) else 0.0, float(imb[-1] - imb[0]) if len(imb) else 0.0,
        float(spread[known].mean()) if known.any() else 0.0, _slope(t[known], spread[known]), _slope(t[mids], mid), float(moves.std()) if len(moves) else 0.0,
        len(e) / span, _slope(t[e["depth"].notna().to_numpy()], depth), float((asks < 0).sum() / (asks != 0).sum()) if (asks != 0).any() else 0.0,
    )


class Microstructure(StatefulProcessor):
    """Ten features of the last ``window`` seconds of a token at each multiple of ``step``, by event-time timer.

    Events are kept ``retain`` seconds (a window's width at least). A timer fires once the watermark passes it; events
    that the watermark has left behind by then are dropped by the engine before they get here.
    """

    schema = "token string, window_end long, " + ", ".join(f"{n} double" for n in _FEATURES)
    kept = ("t", "id", "mid", "spread", "imbalance", "depth", "sell_price")

    def __init__(self, window: int = 60, step: int = 60, retain: int = 180):
        self.window, self.step, self.retain = window, step, max(retain, window)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "t double, id long, mid double, spread double, imbalance double, depth double, sell_price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = _sorted(rows, "t", "id")
        if got is None:
            return
        self.events.appendList([tuple(None if pd.isna(x) else x for x in r) for r in got[list(self.kept)].itertuples(index=False, name=None)])
        set_ = set(self.handle.listTimers())
        for due in {int(t // self.step + k + 1) * self.step * 1000 for t in got["t"] for k in range(max(1, self.window // self.step))} - {x[0] if isinstance(x, tuple) else x for x in set_}:
            self.handle.registerTimer(due)
        yield pd.DataFrame(columns=["token", "window_end", *_FEATURES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000
        e = pd.DataFrame(list(self.events.get()), columns=list(self.kept)).sort_values(["t", "id"])
        inside = e[(e["t"] >= end - self.window) & (e["t"] < end)]
        live = e[e["t"] >= end - self.retain]
        if len(live) < len(e):
            self.events.put([tuple(None if pd.isna(x) else x for x in r) for r in live.itertuples(index=False, name=None)]) if len(live) else self.events.clear()
        if len(inside):
            yield pd.DataFrame([(key[0], end, *window_features(inside, float(self.window)))], columns=["token", "window_end", *_FEATURES])


def live_microstructure(events: DataFrame, delay: str = "30 seconds", window: int = 60, step: int = 60, retain: int = 180) -> DataFrame:
    """token, at (timestamp), t (seconds), id and the columns of ``book.microstructure`` to the features of each window."""
    return stateful(events.withWatermark("at", delay), "token", Microstructure(window, step, retain), Microstructure.schema, "EventTime", "Append")


class Silence(StatefulProcessor):
    """Counts checks without a new row of a feed, by processing-time timer: an alarm after ``checks`` quiet ones in a row.

    A check is quiet if no row came since the last check and none for ``limit_ms``. The clock alone drives it: it needs no
    event of this feed or of another. A new row ends an alarm.
    """

    schema = "feed string, rows long, quiet long, alarm boolean, version long"

    def __init__(self, every_ms: int, limit_ms: int, checks: int = 3):
        self.every_ms, self.limit_ms, self.checks = every_ms, limit_ms, checks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "rows long, checked long, last_ms long, quiet long, version long")

    def _out(self, key, rows: int, quiet: int, version: int) -> pd.DataFrame:
        return pd.DataFrame({"feed": [key[0]], "rows": [rows], "quiet": [quiet], "alarm": [quiet >= self.checks], "version": [version]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, now = sum(len(f) for f in rows), timerValues.getCurrentProcessingTimeInMs()
        if not n:
            return
        started = self.state.exists()
        total, checked, _, _, version = self.state.get() if started else (0, 0, 0, 0, 0)
        self.state.update((total + n, checked, now, 0, version + 1))
        if not started:
            self.handle.registerTimer(now + self.every_ms)
        yield self._out(key, total + n, 0, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        total, checked, last, quiet, version = self.state.get()
        quiet = 0 if total > checked else quiet + 1 if now - last > self.limit_ms else quiet
        self.state.update((total, total, last, quiet, version + 1))
        self.handle.registerTimer(now + self.every_ms)
        yield self._out(key, total, quiet, version + 1)


def watch(feeds: DataFrame, every_ms: int, limit_ms: int, checks: int = 3) -> DataFrame:
    """Rows with a column ``feed`` to each feed's count of quiet checks and alarm."""
    return stateful(feeds.select("feed"), "feed", Silence(every_ms, limit_ms, checks), Silence.schema, "ProcessingTime")


def run_until(stream: DataFrame, keys: list[str], version: str, done, seconds: float, trigger: str = "500 milliseconds") -> DataFrame:
    """Run a stream by the clock until ``done(newest rows)`` or for some time; the newest row of each key."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, "watch")
    columns, schema = stream.columns, stream.schema
    spark.createDataFrame([], schema).write.parquet(f"{out}/_b=none")  # there is something to read from the start

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_b={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", new_path(spark, "state")).trigger(processingTime=trigger).start()
    rest, until = [c for c in columns if c not in keys], time.time() + seconds
    try:
        while time.time() < until and query.isActive:
            time.sleep(0.5)
            if done(newest_rows(spark.read.schema(schema).parquet(f"{out}/*"), keys, version, rest)):
                break
    finally:
        query.stop()
    return newest_rows(spark.read.schema(schema).parquet(f"{out}/*"), keys, version, rest)


def end_of_state(spark: SparkSession) -> None:
    """Give the session its default state store back."""
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
