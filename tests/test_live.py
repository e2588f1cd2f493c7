"""Streaming tables over several micro-batches and timers; versioned tables; series joins; plans and plugins."""

import datetime as dt
import os
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotforge import fixtures as X
from slotforge import plugins
from slotforge.operators import book, evaluate, ledger, ordering, timejoins
from slotforge.plans import time_queries
from slotforge.sources import landed, versioned
from slotforge.storage import new_path
from slotforge.streaming import live as L
from slotforge.streaming import tables as T

BASE = 1_704_067_200  # a day's start


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A small state store for each micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def events(rows):
    """(seconds after BASE, event_id, type, user, value)."""
    return [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), u, kind, float(v), '{"k": %d}' % (i % 100)) for s, i, kind, u, v in rows]


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def drawn(n, seed, days=3):
    rng = random.Random(seed)
    return sorted((rng.randrange(days * 86_400), k, rng.choice(["purchase", "signup", "click"]), rng.randrange(9), round(rng.random() * 100, 2)) for k in range(n))


def folder(spark, tmp_path, parts):
    """An events table of one file for each part, in that order of arrival."""
    path = tmp_path / "events.parquet"
    os.makedirs(path)
    for k, rows in enumerate(parts):
        spark.createDataFrame(events(rows), SCHEMA).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(path / f"part-{k:05}.parquet")
        os.utime(path / f"part-{k:05}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(tmp_path)


def rows_of(df, *keys):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in df.collect()), key=str)


BATCH = {
    "candles": (lambda e: T.candles(e), ["ts"]),
    "slot_flow": (lambda e: T.slot_flow(T.as_ticks(e)), ["slot_ts"]),
    "sliding_rate": (lambda e: T.sliding_rate(T.as_ticks(e), "6 hours", "2 hours"), ["start"]),
    "latest_price": (lambda e: T.latest_price(T.as_ticks(e)), ["hour", "side"]),
    "opening_state": (lambda e: T.opening_state(T.as_ticks(e), 3600, 7200), ["slot_ts"]),
    "freshness": (lambda e: T.freshness(e), ["hour", "feed"]),
    "keyed_history": (lambda e: T.keyed_history(T.as_ticks(e)), ["side"]),
    "silence": (lambda e: T.silence(e, 3_600_000_000), ["feed"]),
    "slot_targets": (lambda e: T.slot_targets(e), ["slot_ts"]),
    "cached_asks": (lambda e: T.cached_asks(T.as_ticks(e), F.col("event_id") % 11 == 0, 17_280, 1_080), ["slot_ts", "outcome"]),
    "silent_feeds": (lambda e: T.silent_feeds(e, 600_000_000), ["feed"]),
}


@pytest.fixture(scope="module")
def one_and_many(spark, tmp_path_factory):
    """The same events as one file, as four files in order, and as four that overlap by less than the watermark's delay."""
    rows = drawn(320, 1)
    cut = [rows[k * 80 : (k + 1) * 80] for k in range(4)]
    near = [list(c) for c in cut]
    for k in range(3):  # the last rows of a file and the first of the next one trade places where they lie close together
        if near[k + 1][0][0] - near[k][-1][0] < 100:
            near[k][-1], near[k + 1][0] = near[k + 1][0], near[k][-1]
    return tuple(folder(spark, tmp_path_factory.mktemp("e"), p) for p in ([rows], cut, near))


@pytest.mark.parametrize("name", sorted(BATCH))
def test_micro_batches_in_order_equal_one(spark, one_and_many, name):
    make, keys = BATCH[name]
    one, many, near = one_and_many
    want = rows_of(T.run_to_table(make(T.landed_events(spark, one)), keys))
    for path in (many, near) if name in ("candles", "slot_flow", "cached_asks") else (near,):
        counts = {}
        assert rows_of(T.run_to_table(make(T.landed_events(spark, path, files=1)), keys, counts=counts)) == want
        assert counts["batches"] == 4


def test_rows_behind_the_watermark_are_counted_and_only_they_are_lost(spark, tmp_path):
    rows = drawn(600, 3)
    random.Random(4).shuffle(rows)
    parts = [rows[k * 150 : (k + 1) * 150] for k in range(4)]
    path = folder(spark, tmp_path, parts)
    late = {r.hour: (r.n, r.late) for r in T.late_rows(T.landed_events(spark, path, files=1), 120_000_000).collect()}
    newest, closed, kept, want_late = None, None, [], {}
    for p in parts:
        for s, *rest in p:
            hour = (BASE + s) // 3600 * 3600
            behind = newest is not None and s < newest - 120
            n, x = want_late.get(hour, (0, 0))
            want_late[hour] = (n + 1, x + behind)
            if closed is None or hour - BASE + 3600 > closed - 120:  # its window is still open: it closes a batch after the watermark
                kept.append((s, *rest))
        closed = newest
        newest = max([s for s, *_ in p] + ([newest] if newest is not None else []))
    assert late == want_late and sum(x for _, x in late.values()) > 100
    counts = {}
    got = {r.ts: r.volume for r in T.run_to_table(T.candles(T.landed_events(spark, path, files=1)), ["ts"], counts=counts).collect()}
    want = {}
    for s, *_ in kept:
        want[(BASE + s) // 3600 * 3600] = want.get((BASE + s) // 3600 * 3600, 0) + 1
    assert got == want and counts["dropped"] > 0


# --- keyed state


def plain_bars(rows, keep):
    """rows in order of arrival: symbol, minute, close, high, low, volume, polled."""
    bars, seen = {}, {}
    for sym, minute, close, high, low, volume, polled in rows:
        held = bars.setdefault(sym, {})
        if polled and held and minute < max(held):
            continue
        if minute in held:
            c, h, l, v = held[minute]
            held[minute] = (close, max(h, high), min(l, low), volume)
        elif len(held) >= keep and minute < min(held):
            continue
        else:
            held[minute] = (close, high, low, volume)
        seen[sym, minute] = held[minute]
        if len(held) > keep:
            held.pop(min(held))
    return {(*k, *v) for k, v in seen.items()}


@pytest.mark.parametrize("keep", [300, 4])
def test_arbitrated_candles(spark, keep):
    rng = random.Random(keep)
    rows, minute = [], 0
    for k in range(240):
        minute += 60 * (rng.random() < 0.3)
        polled = rng.random() < 0.4
        m = minute - 60 * rng.randrange(4) if polled or rng.random() < 0.1 else minute
        v = round(rng.random() * 10, 3)
        rows.append((rng.choice("ab"), m, v, v + rng.randrange(3), v - rng.randrange(3), float(k), polled, k // 2, k))
    rows += rows[-3:]  # delivered twice
    df = spark.createDataFrame(rows, "symbol string, minute long, close double, high double, low double, volume double, polled boolean, arrival long, id long")
    counts = {}
    got = T.run_to_table(L.arbitrated(L.replay(df, "arrival", 4), keep), ["symbol", "minute"], counts=counts).drop("version")
    want = plain_bars([r[:7] for r in sorted(rows, key=lambda r: (r[7], r[8]))], keep)
    assert {tuple(r) for r in got.select("symbol", "minute", "close", "high", "low", "volume").collect()} == want and counts["batches"] == 4


def test_slot_history_with_later_labels(spark):
    rng = random.Random(8)
    slots = [("m0" if k % 2 else "m1", k * 300, rng.random(), float(k), 2.0 * k) for k in range(40)]
    none = None
    rows = [(m, s, u, n, v, none, s + 100, 0) for m, s, u, n, v in slots] + [(m, s, none, none, none, float(k % 2), s + 700 + 900 * (k % 3), 1) for k, (m, s, *_) in enumerate(slots)]
    rows += [rows[5], ("m0", 99_999, none, none, none, 1.0, 50, 1)]  # a slot twice; a label long before its slot
    df = spark.createDataFrame(rows, "market string, slot_ts long, up_ratio double, n_ticks double, vol_tot double, target double, arrival long, id long")
    counts = {}
    got = T.run_to_table(L.history(L.replay(df, "arrival", 5), 8), ["market", "slot_ts"], counts=counts).where("NOT gone")
    label = {(m, s): float(k % 2) for k, (m, s, *_) in enumerate(slots)}
    want = set()
    for market in ("m0", "m1"):
        want |= {(m, s, u, n, v, label[m, s]) for m, s, u, n, v in sorted((x for x in slots if x[0] == market), key=lambda x: x[1])[-8:]}
    assert {tuple(r) for r in got.select("market", "slot_ts", "up_ratio", "n_ticks", "vol_tot", "target").collect()} == want and counts["batches"] >= 4


def test_live_microstructure_equals_the_batch_form(spark):
    rng = random.Random(9)
    rows = []
    for k in range(400):
        t, whole = float(rng.randrange(0, 3000)) / 10, rng.random() < 0.6
        rows.append((rng.choice(["a", "b"]), BASE + t, k, 0.5 + rng.randrange(-9, 9) / 100, rng.randrange(1, 5) / 100, rng.random() if whole else None, rng.random() * 100 if whole else None, None if whole else rng.randrange(40, 60) / 100))
    rows += [("thin", BASE + 5.0, 900, 0.5, 0.01, 0.1, 3.0, None)]
    df = spark.createDataFrame(rows, "token string, t double, id long, mid double, spread double, imbalance double, depth double, sell_price double").withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = T.run_to_table(L.live_microstructure(L.replay(df, "t", 4), "20 seconds"), ["token", "window_end"], mode="append")
    keyed = df.withColumn("window_end", (F.floor(F.col("t") / 60) * 60 + 60)).withColumn("key", F.concat_ws("|", "token", F.col("window_end").cast("string")))
    want = book.microstructure(keyed.withColumn("t", F.col("t") - BASE), "key", 60.0)
    names = [c for c in want.columns if c != "key"]
    batch = {r.key: [r[n] for n in names] for r in want.collect()}
    live_ = {f"{r.token}|{r.window_end}": [r[n] for n in names] for r in got.collect()}
    last = max(r[1] for r in rows) - 20
    assert set(live_) == {k for k in batch if int(k.split("|")[1]) <= last} and len(live_) >= 7
    for k, v in live_.items():
        assert v == pytest.approx(batch[k], abs=1e-7), k


def test_sliding_windows_and_retention(spark):
    rows = [("a", BASE + float(t), t, 0.5 + t / 1000, 0.01, 0.1, 5.0, None) for t in range(0, 400, 4)]
    df = spark.createDataFrame(rows, "token string, t double, id long, mid double, spread double, imbalance double, depth double, sell_price double").withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = T.run_to_table(L.live_microstructure(L.replay(df, "t", 3), "10 seconds", window=60, step=20, retain=60), ["token", "window_end"], mode="append").collect()
    ends = {r.window_end - BASE: r.activity_rate for r in got}
    assert set(ends) == set(range(20, 381, 20)) and ends[20] == pytest.approx(5 / 60) and all(ends[e] == pytest.approx(15 / 60) for e in range(60, 381, 20))


def test_alarm_when_every_feed_is_silent(spark, tmp_path):
    path = folder(spark, tmp_path, [drawn(30, 5), drawn(20, 6)])
    e = T.landed_events(spark, path, files=1).select(F.col("event_type").alias("feed"))
    seen = L.run_until(L.watch(e, 300, 100), ["feed"], "version", lambda now: not now.isEmpty() and now.where("NOT alarm").isEmpty(), 60)
    assert {r.feed: (r.alarm, r.quiet >= 3) for r in seen.collect()} == dict.fromkeys(["purchase", "signup", "click"], (True, True)) and seen.agg(F.sum("rows")).first()[0] == 50


def test_unmatched_log_rows_come_out(spark, tmp_path):
    rows = [(10, 1, "purchase", 1, 1), (20, 2, "signup", 1, 1), (30, 3, "purchase", 2, 1), (90_000, 4, "signup", 5, 1), (90_010, 5, "purchase", 6, 1)]
    e = T.landed_events(spark, folder(spark, tmp_path, [rows]))
    log = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    labels = e.where("event_type = 'signup'").select(F.col("event_id").alias("rid"), F.col("user_id").alias("r_user_id"), F.col("at").alias("resolved_at"))
    got = T.run_to_table(T.resolved_log(log, labels, "user_id", "6 hours").select("event_id", "rid", F.lit(1).alias("one")), ["event_id", "rid"], mode="append")
    assert {(r.event_id, r.rid) for r in got.collect()} == {(1, 2), (3, None)}  # the last one may still be resolved


# --- versioned tables and settlement


def test_versions_swap_and_compact(spark):
    root = new_path(spark, "versioned")
    day = F.expr("k div 10")
    table = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    assert versioned.latest(spark, root) is None
    versioned.replace(table(0, 40, 1), root, day)
    versioned.replace(table(10, 15, 2), root, day, gone=["3"])
    now = {r.k: r.v for r in versioned.read(spark, root).collect()}
    assert now == {**{k: 1 for k in range(10)}, **{k: 2 for k in range(10, 15)}, **{k: 1 for k in range(20, 30)}}
    assert versioned.read(spark, root, version=0).count() == 40 and versioned.read(spark, root, parts=["1"]).count() == 5
    versioned.compact(spark, root, day)
    assert {r.k: r.v for r in versioned.read(spark, root).collect()} == now and len(versioned.read(spark, root).inputFiles()) == 3
    with pytest.raises(versioned.Conflict):
        versioned.replace(table(0, 5, 9), root, day, based_on=0)
    with pytest.raises(Exception, match="no partition"):
        versioned.replace(table(0, 5, 9), root, F.lit(None).cast("string"))
    assert {r.k: r.v for r in versioned.read(spark, root).collect()} == now
    versioned.replace(table(0, 5, 5), root, day, batch=3)
    version = versioned.latest(spark, root)
    assert versioned.replace(table(0, 5, 6), root, day, batch=3) == version == versioned.latest(spark, root) and versioned.read(spark, root).where("v = 6").isEmpty()


def test_a_reader_never_sees_half_a_table(spark):
    root, part = new_path(spark, "versioned"), F.expr("k % 3")
    table = lambda v: spark.range(30).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    versioned.replace(table(0), root, part)
    seen, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append(tuple(sorted({r.v for r in versioned.read(spark, root).groupBy("v").count().where("count = 30").collect()})))

    t = threading.Thread(target=reader)
    t.start()
    for v in range(1, 6):
        versioned.replace(table(v), root, part)
    stop.set()
    t.join()
    assert len(seen) > 1 and all(len(s) == 1 for s in seen)


@pytest.mark.parametrize("fails", ["before the swap", "after the swap"])
def test_settlement_survives_a_restart(spark, monkeypatch, fails):
    slots = [(BASE + k * 21_600, "UP" if k % 2 else "DOWN") for k in range(12)]
    open_ = spark.createDataFrame([(s, d, 10.0, 5.0, "open", None, None) for s, d in slots], "slot_ts long, direction string, shares double, actual_cost double, status string, pnl_usdc double, result string")
    e = spark.createDataFrame(events([(k * 1800, k, "click", 1, (k * 7) % 13) for k in range(12 * 12)]), SCHEMA).withColumn("us", F.expr(X.EPOCH_US)).withColumn("at", F.timestamp_micros("us"))

    def run(root, stream):
        T.settle_stream(T.slot_targets(stream), root, X.SLOT, 60)
        return sorted(map(tuple, versioned.read(spark, root).collect()), key=str)

    plain, root = new_path(spark, "ledger"), new_path(spark, "ledger")
    for r in (plain, root):
        versioned.replace(open_, r, T.ledger_day(F.col("slot_ts")))
    want = run(plain, L.replay(e, "us"))
    stream, calls, publish = L.replay(e, "us"), [], versioned._publish

    def failing(*a):
        calls.append(1)
        if len(calls) == 2 and fails == "before the swap":
            raise OSError("lost")
        publish(*a)
        if len(calls) == 2:
            raise OSError("lost")

    monkeypatch.setattr(versioned, "_publish", failing)
    with pytest.raises(Exception, match="lost"):
        run(root, stream)
    assert run(root, stream) == want and sum(r[4] == "settled" for r in want) >= 10 and any(r[4] == "open" for r in want)


# --- joins by symbol, ladders, scans, plugins


@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of_by_symbol(spark, inclusive):
    rng = random.Random(10)
    series = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 2000, 7)]), k, float(k)) for k in range(300)]
    points = [(k, rng.choice(["a", "b", "c", "unknown", None]), rng.choice([None, *range(-50, 2200, 5)]), "x") for k in range(300)]
    s = spark.createDataFrame(series, "sym string, ts long, tie long, v double")
    p = spark.createDataFrame(points, "id long, sym string, at long, tag string")
    for clamp in (False, True):
        got = {r.id: (r.v, r.as_of_ts, r.tag) for r in timejoins.as_of_join(p, s, ["sym"], "at", "ts", ["v"], 100, inclusive=inclusive, clamp=clamp, tie="tie").collect()}
        for i, sym, at, tag in points:
            own = [r for r in series if r[0] == sym and sym is not None and r[1] is not None] if at is not None else []
            past = [r for r in own if r[1] <= at and (inclusive or r[1] < at)]
            hit = max(past, key=lambda r: r[1:3]) if past else max(own, key=lambda r: (-r[1], r[2])) if own and clamp else None
            assert got[i] == ((hit[3], hit[1], tag) if hit else (None, None, tag)), (i, sym, at)


def test_interval_sums_by_symbol(spark):
    rng = random.Random(11)
    series = [(rng.choice("ab"), rng.randrange(1000), float(rng.randrange(9))) for _ in range(200)]
    points = [(k, rng.choice("abz"), a := rng.randrange(-50, 1000), a + rng.randrange(-20, 400)) for k in range(200)]
    s, p = spark.createDataFrame(series, "sym string, ts long, v double"), spark.createDataFrame(points, "id long, sym string, a long, b long")
    for closed in (False, True):
        got = {r.id: (r.n, r.total) for r in timejoins.interval_sums(p, s, ["sym"], "a", "b", "ts", {"n": F.lit(1.0), "total": F.col("v")}, 64, closed=closed).collect()}
        for i, sym, a, b in points:
            inside = [v for y, t, v in series if y == sym and a <= t and (t < b or (closed and t == b))]
            assert got[i] == (len(inside), sum(inside)), (i, a, b)


def test_inslot_return_over_a_candle_gap(spark):
    h = 3600
    slot = BASE
    candles = [(slot - 3 * h, 10.0, 11.0, 9.0, 10.0, 4), (slot - h, 10.0, 13.0, 9.0, 12.0, 6), (slot + h, 12.0, 21.0, 11.0, 15.0, 8), (slot + 2 * h, 15.0, 19.0, 14.0, 18.0, 2), (slot + 4 * h, 1.0, 99.0, 1.0, 50.0, 1)]
    c = spark.createDataFrame(candles, "ts long, open double, high double, low double, close double, volume long")
    s = spark.createDataFrame([(slot,), (slot + 400 * h,)], "slot_ts long")
    r, empty = sorted(time_queries.inslot_features(s, c).collect(), key=lambda x: x.slot_ts)
    assert r.ret_0h == pytest.approx(18 / 15 - 1)  # not 18 / 12, the price as of slot start
    assert r.inslot_range == pytest.approx((21 - 11) / 18) and r.vol_inslot == 0.0 and r.vol_6h == 0.0 and r.spot_vol_ratio == pytest.approx(6 / (10 / 5 + 1e-9))
    assert tuple(empty)[1:] == (0.0,) * 6
    px = [10.0, 12.0, 15.0]
    more = spark.createDataFrame([(slot - k * h, 1.0, 1.0, 1.0, p, 1) for k, p in zip((9, 6, 0), px, strict=True)], "ts long, open double, high double, low double, close double, volume long")
    r = time_queries.inslot_features(s.where(F.col("slot_ts") == slot), more).first()
    assert r.vol_24h == pytest.approx(np.std([0.2, 0.25])) and r.vol_6h == 0.0


def test_ladders_of_any_shape(spark):
    levels = [(0.4, 5.0), (0.5, 2.0)]
    texts = {
        '[{"price": 0.4, "size": 5}, {"price": "0.5", "size": "2"}]': levels, '[{"p": "0.4", "s": "5"}, {"p": 0.5, "s": 2.0}]': levels, "[[0.4, 5], [\"0.5\", \"2\"]]": levels, '{"0.4": 5, "0.5": "2"}': levels,
        '"[[0.4, 5], [0.5, 2]]"': levels, "[]": [], "{}": [], '[{"price": "x", "size": 1}, [0.5, 2], 7, null, [0.3]]': [(0.5, 2.0)], "[{broken": None, "7": None, '"text"': None, "": None, "null": None,
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.l for r in df.select("t", landed.ladder(F.col("t")).alias("l")).collect()}
    assert got[None] is None
    for t, want in texts.items():
        assert (None if got[t] is None else [tuple(x) for x in got[t]]) == want, t


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    path = new_path(spark, "ticks")
    spark.range(1000).select((F.col("id") % 50).cast("string").alias("market_id"), "id").write.parquet(path)
    few = landed.read_markets(spark, path, ["3", "4"])
    scan = next(x for x in plan(few).splitlines() if "PushedFilters" in x)
    assert "In(market_id, [3,4])" in scan and few.count() == 40
    many = landed.read_markets(spark, path, [str(k) for k in range(45)], most=20)
    assert "LeftSemi" in plan(many) and many.count() == 900 and landed.read_markets(spark, path, []).count() == 0
    days = new_path(spark, "days")
    spark.range(1000).select((F.col("id") % 20).alias("day"), "id").write.partitionBy("day").parquet(days)
    chosen = spark.range(20).select(F.col("id").alias("day"), F.col("id").alias("x")).where("x % 7 = 3")
    pruned = spark.read.parquet(days).join(chosen, "day")
    assert "dynamicpruning" in plan(pruned).lower() and pruned.count() == 150


def test_plugins(spark):
    with pytest.raises(KeyError, match="six_hour_updown"):
        plugins.get("none")
    p = plugins.get("six_hour_updown")
    assert plugins.register(p) is p
    with pytest.raises(ValueError, match="registered"):
        plugins.register(plugins.Plugin(p.name, "id", p.discover, p.features, p.truth))
    ticks = [(k, f"m{k % 8}", (k % 8) * X.SLOT, 1 + k, float(k * 50), "Up", "BUY", 0.5, float(k)) for k in range(80)]
    df = spark.createDataFrame(ticks, "event_id long, market_id string, slot_ts long, timestamp_ms long, t_sec double, outcome string, side string, price double, size_usdc double")
    train, serve = plugins.training_rows(p.name, df), plugins.serving_rows(p.name, df)
    assert train.columns == ["market_id", *p.ordered, "target"] and {r.market_id for r in train.collect()} == {f"m{k}" for k in range(1, 7)} and {r.market_id for r in serve.collect()} == {"m0", "m7"}
    assert {r.ob_mid for r in train.collect()} == {0.5}


# --- model checks


@pytest.mark.parametrize("n", [1, 2, 5, 37, 100, 1000])
def test_shuffled_is_one_to_one(spark, n):
    got = spark.range(n).select(*(evaluate.shuffled(F.col("id"), n, F.lit(k)).alias(f"k{k}") for k in (1, 2))).collect()
    a, b = [r.k1 for r in got], [r.k2 for r in got]
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 37 or (a != b and sum(x == k for k, x in enumerate(a)) < n / 4))


def test_permutation_importance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.2 * rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"slot_ts": np.arange(400), "target": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    model = evaluate.logistic(["a", "b", "c"]).fit(df)
    got = {r.feature: (r.auc_drop, r.harmful) for r in evaluate.permutation_importance(model, df, ["a", "b", "c"]).collect()}
    w, c = np.array(model.stages[-1].coefficients), model.stages[-1].intercept

    def auc(scores):
        o = scores.argsort().argsort() + 1.0
        return (o[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (400 - y.sum()))

    moved = spark.range(400).select("id", *(evaluate.shuffled(F.col("id"), 400, F.lit(k + 1)).alias(f"t{k}") for k in range(3))).toPandas()
    for k, name in enumerate("abc"):
        z = x.copy()
        z[moved[f"t{k}"], k] = x[moved["id"], k]
        assert got[name][0] == pytest.approx(auc(x @ w + c) - auc(z @ w + c), abs=1e-9) and got[name][1] == (got[name][0] < -0.005)
    assert got["a"][0] > 0.2


def test_stratified_folds_and_early_stopping(spark):
    rng = np.random.default_rng(2)
    n = 203
    x = rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"slot_ts": np.arange(n), "x": x, "target": (x + rng.normal(size=n) > 0.8).astype(int)}))
    counts = evaluate.stratified_folds(df, "target", F.col("slot_ts")).groupBy("target", "fold").count().toPandas()
    assert all(g["count"].max() - g["count"].min() <= 1 and len(g) == 5 for _, g in counts.groupby("target"))
    p, used = evaluate.cross_validated(df, ["x"], "target", F.col("slot_ts"), folds=2, rounds=8, tolerance=0.05)
    assert p.count() == n and p.select("slot_ts").distinct().count() == n and len(used) == 2 and all(1 <= u <= 8 for u in used) and min(used) < 8


def test_calibration_blend_and_screening_by_numpy(spark):
    rng = np.random.default_rng(3)
    n = 300
    x, noise = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"slot_ts": np.arange(n), "x": x, "noise": noise, "target": (x + rng.normal(size=n) > 0).astype(int)}))
    train, test = df.where("slot_ts < 240"), df.where("slot_ts >= 240")
    got = {r.slot_ts: r.p for r in evaluate.calibrated(train, test, ["x", "noise"], parts=2).collect()}
    want = dict.fromkeys(got, 0.0)
    dealt = evaluate.stratified_folds(train, "target", F.col("slot_ts"), 2)
    for k in range(2):
        model = evaluate.gbt(["x", "noise"]).fit(dealt.where(F.col("fold") != k))
        held = sorted((r.s, r.target) for r in evaluate.predict(model, dealt.where(F.col("fold") == k), "s").collect())
        blocks = []  # pool adjacent violators over distinct scores
        for s in sorted({s for s, _ in held}):
            ys = [y for t, y in held if t == s]
            blocks.append([sum(ys), len(ys), [s]])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
        xs, ys = [s for b in blocks for s in b[2]], [b[0] / b[1] for b in blocks for _ in b[2]]
        for r in evaluate.predict(model, test, "s").collect():
            want[r.slot_ts] += float(np.interp(r.s, xs, ys)) / 2
    assert got == pytest.approx(want, abs=1e-6)
    mixed = df.select(F.lit(0.2).alias("a"), F.lit(0.8).alias("b")).select(evaluate.blend("a", "b").alias("p")).first().p
    assert mixed == pytest.approx(0.65 * 0.2 + 0.35 * 0.8)
    ranked = ordering.global_rank(df, "slot_ts")
    folds = evaluate.walk_forward(ranked, n, folds=2)
    means = {}
    for k in range(2):
        m = evaluate.gbt(["noise", "x"], rounds=5).fit(folds.where(f"fold = {k} AND role = 'train'")).stages[-1].featureImportances.toArray()
        means = {c: means.get(c, 0) + v / 2 for c, v in zip(["noise", "x"], m, strict=True)}
    assert evaluate.screen(folds, ["noise", "x"], 1, 2) == [("x", pytest.approx(means["x"]))] and means["x"] > means["noise"]


def test_reconcile_raises(spark):
    rows = [(1, 1)] * 199 + [(0, 1), (None, 1)]
    df = spark.createDataFrame(rows, "derived int, target int")
    r = ledger.reconcile(df, "derived", "target").first()
    assert (r.n_match, r.n_mismatch, r.n_missing) == (199, 1, 1) and r.agreement == pytest.approx(0.995)
    assert ledger.reconcile(df, "derived", "target", 0.995).first().agreement == pytest.approx(0.995)
    with pytest.raises(Exception, match="labels agree"):
        ledger.reconcile(df.union(spark.createDataFrame([(0, 1)], "derived int, target int")), "derived", "target", 0.995).collect()


def test_microstructure_variants(spark):
    """Hand-made windows: too few books, too short a span, price changes that lend mid and spread."""
    col = "m string, t double, id long, mid double, spread double, imbalance double, depth double, sell_price double"
    book_ = lambda m, t, k, mid, imb: (m, float(t), k, mid, 0.02, imb, 10.0 + t, None)
    change = lambda m, t, k, mid, sell: (m, float(t), k, mid, None if mid is None else 0.04, None, None, sell)
    rows = [book_("two", 0, 1, 0.5, 0.2), change("two", 3, 2, 0.6, 0.7), change("two", 4, 3, None, 0.6), change("two", 5, 4, 0.4, None), book_("two", 10, 5, 0.7, 0.4)]
    rows += [book_("one", 0, 10, 0.5, 0.2)] + [change("one", 2 * k, 11 + k, None, 0.5 - k / 100) for k in range(1, 6)]
    rows += [book_("short", k, 30 + k, 0.5, 0.1) for k in range(4)] + [change("short", 0, 36, None, 0.4), change("short", 8, 37, None, 0.5)]
    rows += [book_("few", 0, 40, 0.5, 0.2), book_("few", 30, 41, 0.5, 0.2)]
    df = spark.createDataFrame(rows, col)
    got = {v: {r.m: r for r in book.microstructure(df, "m", 60.0, variant=v).collect()} for v in ("books", "live", "window")}
    books, live_ = got["books"], got["live"]
    assert books["two"].spread_mean == pytest.approx(0.02) and books["two"].mid_velocity == pytest.approx(0.02) and books["two"].activity_rate == pytest.approx(0.5) and books["two"].ask_pressure == 1.0
    assert live_["two"].spread_mean == pytest.approx(0.03) and live_["two"].mid_volatility == pytest.approx(np.std([0.1, -0.2, 0.3])) and live_["two"].activity_rate == pytest.approx(0.5) and live_["two"].imb_drift == pytest.approx(0.2)
    assert tuple(books["one"])[1:] == (0.0,) * 10 and live_["one"].activity_rate == pytest.approx(6 / 8) and live_["one"].ask_pressure == 1.0 and live_["one"].imb_std == 0.0
    assert tuple(books["short"])[1:] == (0.0,) * 10 and live_["short"].activity_rate == pytest.approx(6 / 8)  # the price changes' span
    assert books["few"].activity_rate == pytest.approx(2 / 30) and tuple(live_["few"])[1:] == (0.0,) * 10
    assert got["window"]["two"].activity_rate == pytest.approx(5 / 60) and tuple(got["window"]["few"])[1:] == (0.0,) * 10
    sound = spark.createDataFrame([(0.4, 0.6), (0.6, 0.6), (0.0, 0.5), (0.7, 0.6), (None, 0.5)], "b double, a double").select(*book.synthetic(F.col("b"), F.col("a"))).collect()
    assert [tuple(r) for r in sound] == [(pytest.approx(0.5), pytest.approx(0.2))] + [(None, None)] * 4


def test_replay_writes_each_piece_in_many_files(spark):
    """Pieces of different size, one of them without a row: still a micro-batch each, in order, none of one file."""
    ids = [*range(50), *range(75, 78), *range(80, 100)]
    df = spark.createDataFrame([(k,) for k in ids], "at long").repartition(6)
    stream, seen = L.replay(df, "at", 4, rows=10), []

    def look(batch, number):
        got = batch.collect()
        seen.append((sorted(r.at for r in got), len({r.f for r in got})))

    stream.select("at", F.col("_metadata.file_path").alias("f")).writeStream.foreachBatch(look).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    low, high = min(ids), max(ids)
    step = (high - low) // 4 + 1
    want = [[k for k in ids if low + p * step <= k < low + (p + 1) * step] for p in range(4)]
    assert [ids for ids, _ in seen if ids] == [w for w in want if w]
    assert all(n > 1 for ids, n in seen if len(ids) >= 20)
