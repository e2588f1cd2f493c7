"""Streaming tables run over all landed files; their SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotforge import fixtures as X
from slotforge.operators import book, ledger, ordering
from slotforge.plans.book_queries import _MICRO, _MS, _OC, _OPEN_CLOSE, _SNAPS, snapshots
from slotforge.plans.flow_queries import FLOW, FLOW_DOUBLES, r6, slot_flow
from slotforge.plans.registry import query, rounded
from slotforge.sources import versioned
from slotforge.storage import new_path, pin
from slotforge.streaming import live as L
from slotforge.streaming import tables as T


@query(f"{X.ctes('candles')} SELECT ts, {r6('open', 'high', 'low', 'close')}, volume FROM candles")
def t_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.run_to_table(T.candles(T.landed_events(spark, sf_dir)), ["ts"]))


@query(f"{X.ctes('candles')} SELECT ts, {r6('open', 'high', 'low', 'close')}, volume FROM candles")
def t_merged_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds deliver overlapping halves of the events; each event counts once."""
    e = T.landed_events(spark, sf_dir)
    both = T.merged(e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1"), "event_id")
    order = F.struct("us", "event_id")
    bars = both.groupBy(F.window("at", "1 hour").alias("w")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))
    out = bars.select(F.unix_seconds("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    return rounded(T.run_to_table(out, ["ts"]))


@query(f"{FLOW} SELECT slot_ts, n_ticks, {r6(*FLOW_DOUBLES)} FROM flow WHERE n_ticks > 0")
def t_slot_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.run_to_table(T.slot_flow(T.as_ticks(T.landed_events(spark, sf_dir))), ["slot_ts"]))


@query(f"""{X.ctes("ticks")}, w AS (SELECT (timestamp_ms // 1000 // 7200 - k) * 7200 AS start, slot_ts + t_sec - 1.7e9 AS t, price FROM ticks, (SELECT unnest([0, 1, 2]) AS k))
    SELECT start, count(*) AS n, round(avg(price), 6) AS price, round(CASE WHEN var_pop(t) > 0 THEN regr_slope(price, t) ELSE 0 END * 1e6, 3) AS slope FROM w GROUP BY 1""")
def t_sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.run_to_table(T.sliding_rate(T.as_ticks(T.landed_events(spark, sf_dir)), "6 hours", "2 hours"), ["start"])
    return r.select("start", "n", F.round("price", 6).alias("price"), F.round(F.col("slope") * 1e6, 3).alias("slope"))


@query(f"""{X.ctes("ticks")} SELECT timestamp_ms // 3600000 * 3600 AS hour, side, round(arg_max(price, (us, event_id)), 6) AS price, max(us) AS seen_us
    FROM ticks JOIN (SELECT event_id, epoch_us(ts) AS us FROM events) USING (event_id) WHERE price < 0.97 GROUP BY 1, 2""")
def t_latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.run_to_table(T.latest_price(T.as_ticks(T.landed_events(spark, sf_dir))), ["hour", "side"]))


@query(f"""{X.ctes("ticks")}, g AS (SELECT slot_ts, arg_min(price, (t_sec, event_id)) FILTER (t_sec >= 3600 AND t_sec < 7200) AS o, arg_max(price, (t_sec, event_id)) FILTER (t_sec < {X.OBS}) AS l FROM ticks GROUP BY 1)
    SELECT slot_ts, round(o, 6) AS open_price, round(l, 6) AS last_price, round(l - o, 6) AS drift FROM g""")
def t_opening_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.run_to_table(T.opening_state(T.as_ticks(T.landed_events(spark, sf_dir)), 3600, 7200), ["slot_ts"]))


_ARRIVAL = "us + event_id % 7 * 7200000000"


@query(f"""WITH e AS (SELECT epoch_us(ts) AS us, event_id FROM events), a AS (SELECT us, {_ARRIVAL} AS arrival FROM e), p AS (SELECT us, (arrival - min(arrival) OVER ()) // ((max(arrival) OVER () - min(arrival) OVER ()) // 5 + 1) AS piece FROM a),
    w AS (SELECT piece, max(max(us)) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 120000000 AS mark FROM p GROUP BY 1)
    SELECT us // 3600000000 * 3600 AS hour, count(*) AS n, count(*) FILTER (us < mark) AS late FROM p JOIN w USING (piece) GROUP BY 1""")
def t_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come up to twelve hours late, in five micro-batches."""
    e = X.table(spark, sf_dir, "events").withColumn("us", F.expr(X.EPOCH_US)).withColumn("arrival", F.expr(_ARRIVAL))
    return T.late_rows(L.replay(e, "arrival", 5), 120_000_000)


@query("""SELECT epoch_us(ts) // 3600000000 * 3600 AS hour, event_type AS feed, count(*) AS n, max(epoch_us(ts)) AS newest_us FROM events GROUP BY 1, 2""")
def t_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.run_to_table(T.freshness(T.landed_events(spark, sf_dir)), ["hour", "feed"])


@query(f"""{X.ctes("ticks")}, k AS (SELECT t.side, t.price, epoch_us(e.ts) AS us, row_number() OVER (PARTITION BY t.side ORDER BY e.ts DESC, event_id DESC) AS r FROM ticks t JOIN events e USING (event_id))
    SELECT side, count(*) AS n, round(avg(price), 6) AS mean_price, max(us) AS newest_us FROM k WHERE r <= 25 GROUP BY 1""")
def t_keyed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.run_to_table(T.keyed_history(T.as_ticks(T.landed_events(spark, sf_dir))), ["side"]))


@query("""SELECT feed, count(*) FILTER (gap > 3600000000) AS gaps, count(*) FILTER (gap > 10800000000) AS alarms FROM (
    SELECT event_type AS feed, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events) GROUP BY 1""")
def t_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.run_to_table(T.silence(T.landed_events(spark, sf_dir), 3_600_000_000), ["feed"])


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, user_id AS ruser, ts AS rts FROM events WHERE event_type = 'signup'),
    m AS (SELECT least((SELECT max(ts) FROM l), (SELECT max(rts) FROM r)) - INTERVAL 120 SECOND AS mark)
    SELECT l.event_id, count(rid) AS n_resolved FROM l LEFT JOIN r ON ruser = user_id AND rts >= ts AND rts <= ts + INTERVAL 6 HOUR, m GROUP BY 1, ts, mark HAVING count(rid) > 0 OR ts + INTERVAL 6 HOUR < mark""")
def t_resolved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the number of the same user's sign-ups in the next six hours, as two streams; none once those are over."""
    e = T.landed_events(spark, sf_dir)
    log = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    labels = e.where("event_type = 'signup'").select(F.col("event_id").alias("rid"), F.col("user_id").alias("r_user_id"), F.col("at").alias("resolved_at"))
    joined = T.resolved_log(log, labels, "user_id", "6 hours").select("event_id", "rid", F.lit(1).alias("one"))
    rows = T.run_to_table(joined, ["event_id", "rid"], mode="append")
    return rows.groupBy("event_id").agg(F.count("rid").alias("n_resolved"))


@query("""WITH e AS (SELECT event_type AS feed, event_id AS id, epoch_us(ts) AS us, user_id % 5 < 2 AS won, CAST(user_id % 2 AS VARCHAR) AS s FROM events),
    w AS (SELECT *, avg(CAST(won AS INT)) OVER a AS wr, count(*) OVER a AS n, count(DISTINCT s) OVER b AS kinds, count(*) OVER b AS m, row_number() OVER (PARTITION BY feed ORDER BY us DESC, id DESC) AS back FROM e
        WINDOW a AS (PARTITION BY feed ORDER BY us, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY feed ORDER BY us, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT feed, count(*) AS n, round(max(wr) FILTER (back = 1), 6) AS win_rate, bool_or(n = 20 AND wr < 0.1) AS paused, bool_or(m = 3 AND kinds = 1) AS stale, count(*) <= 3 AS warming FROM w GROUP BY 1""")
def t_stateful_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.landed_events(spark, sf_dir).select(F.col("event_type").alias("feed"), "us", F.col("event_id").alias("id"), (F.col("user_id") % 5 < 2).alias("won"), (F.col("user_id") % 2).cast("string").alias("signature"))
    return rounded(T.run_to_table(T.stateful_gates(e, least=0.1), ["feed"]))


@query(f"""{X.ctes("slots")} SELECT slot_ts, 'settled' AS status, CASE WHEN (slot_ts // 21600 % 2 = 0) = (target = 1) THEN 'WIN' ELSE 'LOSS' END AS result,
    round(CASE WHEN (slot_ts // 21600 % 2 = 0) = (target = 1) THEN 9.8 - 5 ELSE -5 END, 6) AS pnl_usdc FROM slots""")
def t_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open ledger rows settled by labels that a stream resolves."""
    labels = T.run_to_table(T.slot_targets(T.landed_events(spark, sf_dir)), ["slot_ts"])
    open_ = X.slots(spark, sf_dir).select("slot_ts", F.when(F.expr("slot_ts div 21600 % 2 = 0"), "UP").otherwise("DOWN").alias("direction"), F.lit(10.0).alias("shares"), F.lit(5.0).alias("actual_cost"),
                                          F.lit("open").alias("status"), F.lit(None).cast("double").alias("pnl_usdc"), F.lit(None).cast("string").alias("result"))
    s = ledger.settle(open_, labels, 9_999_999_999, X.SLOT, 60)
    return rounded(s.select("slot_ts", "status", "result", "pnl_usdc"))


@query("""SELECT event_type AS feed, max(epoch_us(ts)) AS newest_us, (max(epoch_us(ts)) + 1800000000) // 1000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 - 120000 AS silent FROM events GROUP BY 1""")
def t_silent_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that a timer finds silent when all that has landed is processed."""
    return T.run_to_table(T.silent_feeds(T.landed_events(spark, sf_dir), 600_000_000), ["feed"])


_END, _FRESH = X.SLOT * 240 // 300, X.SLOT * 15 // 300


@query(f"""{X.ctes("ticks")}, r AS (SELECT *, event_id % 101 = 0 AS cleared, (slot_ts + t_sec, event_id) AS o FROM ticks WHERE t_sec <= {_END}),
    g AS (SELECT slot_ts, outcome, arg_max(price, o) FILTER (NOT cleared AND price < 0.97) AS p, max(o) FILTER (NOT cleared AND price < 0.97) AS seen, max(t_sec) FILTER (NOT cleared AND price < 0.97) AS t, max(o) FILTER (cleared) AS c FROM r GROUP BY 1, 2)
    SELECT slot_ts, outcome, round(CASE WHEN seen IS NOT NULL AND (c IS NULL OR seen > c) THEN p END, 6) AS price, seen IS NOT NULL AND (c IS NULL OR seen > c) AND {_END} - t <= {_FRESH} AS fresh FROM g""")
def t_cached_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of best prices at the end of the entry window; every event whose id divides by 101 stands for a reconnect."""
    ticks = T.as_ticks(T.landed_events(spark, sf_dir))
    return rounded(T.run_to_table(T.cached_asks(ticks, F.col("event_id") % 101 == 0, _END, _FRESH), ["slot_ts", "outcome"]))


@query("""WITH n AS (SELECT max(epoch_us(ts)) AS now FROM events)
    SELECT event_type AS feed, (max(now) - max(epoch_us(ts))) // 1000000 AS age, count(*) FILTER (epoch_us(ts) >= now - 3600000000) AS n_1h, count(*) FILTER (epoch_us(ts) >= now - 14400000000) AS n_4h,
    count(*) FILTER (epoch_us(ts) >= now - 14400000000) < 180 AS low FROM events, n GROUP BY 1""")
def t_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each feed when the newest event came."""
    now = X.table(spark, sf_dir, "events").agg(F.max(F.expr(X.EPOCH_US))).first()[0] or 0
    return T.run_to_table(T.coverage(T.landed_events(spark, sf_dir), now), ["feed"])


@query("""WITH r AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS id, event_id % 3 = 0 AS polled, epoch_us(ts) // 3600000000 * 3600 - CASE WHEN event_id % 3 = 0 THEN event_id % 4 * 3600 ELSE 0 END AS minute, value, user_id FROM events),
    a AS (SELECT *, max(minute) OVER (PARTITION BY symbol ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM r)
    SELECT symbol, minute, round(arg_max(value, (us, id)), 6) AS close, round(max(value + id % 5), 6) AS high, round(min(value - id % 7), 6) AS low, CAST(arg_max(user_id, (us, id)) AS DOUBLE) AS volume FROM a
    WHERE NOT polled OR newest IS NULL OR minute >= newest GROUP BY 1, 2""")
def t_arbitrated_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from partial ones of a pushed and a polled feed, in four micro-batches; polled rows come up to three bars late."""
    e = X.table(spark, sf_dir, "events").withColumn("arrival", F.expr(X.EPOCH_US))
    polled = F.col("event_id") % 3 == 0
    rows = e.select(
        F.col("event_type").alias("symbol"), (F.expr("arrival div 3600000000 * 3600") - F.when(polled, F.col("event_id") % 4 * 3600).otherwise(0)).alias("minute"), F.col("value").alias("close"),
        (F.col("value") + F.col("event_id") % 5).alias("high"), (F.col("value") - F.col("event_id") % 7).alias("low"), F.col("user_id").cast("double").alias("volume"), polled.alias("polled"), "arrival", F.col("event_id").alias("id"),
    )
    return rounded(T.run_to_table(L.arbitrated(L.replay(rows, "arrival")), ["symbol", "minute"]).drop("version"))


_HISTORY = f"""hist AS (SELECT 'm' || (slot_ts // {X.SLOT} % 3) AS market, slot_ts, up_ratio, CAST(n_ticks AS DOUBLE) AS n_ticks, vol_tot, CAST(target AS DOUBLE) AS target,
        row_number() OVER (PARTITION BY slot_ts // {X.SLOT} % 3 ORDER BY slot_ts DESC) AS back FROM flow), kept25 AS (SELECT * FROM hist WHERE back <= 25),
    l AS (SELECT *, slot_ts - lag(slot_ts) OVER w AS gap1, slot_ts - lag(slot_ts, 2) OVER w AS gap2, lag(target) OVER w AS t1, lag(target, 2) OVER w AS t2, lag(up_ratio) OVER w AS u1,
        list(CASE WHEN n_ticks > 0 THEN up_ratio END) OVER (PARTITION BY market ORDER BY slot_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS raw FROM kept25 WINDOW w AS (PARTITION BY market ORDER BY slot_ts)),
    z AS (SELECT *, list_filter(coalesce(raw, []), lambda x: x IS NOT NULL) AS past, CASE WHEN gap1 <= {3 * 3 * X.SLOT} THEN u1 ELSE 0.5 END AS cur FROM l)"""


@query(f"""{FLOW}, {_HISTORY} SELECT market, slot_ts, target, CASE WHEN gap1 IS NULL THEN 0.5 WHEN gap1 <= {9 * X.SLOT} THEN t1 ELSE 0.5 END AS lag1_target, CASE WHEN gap2 IS NULL THEN 0.5 WHEN gap2 <= {18 * X.SLOT} THEN t2 ELSE 0.5 END AS lag2_target,
    round(CASE WHEN gap1 IS NULL THEN 0.5 WHEN gap1 <= {9 * X.SLOT} THEN u1 ELSE 0.5 END, 6) AS lag1_up_ratio,
    round(CASE WHEN len(past) >= 3 THEN greatest(least((cur - list_avg(past)) / greatest(list_stddev_pop(past), 0.01), 5), -5) ELSE 0 END, 4) AS lag_ur_z20 FROM z""")
def t_slot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags and scores from the last 25 slots of each of three markets, as keyed state; labels come two slots later."""
    f = slot_flow(spark, sf_dir).select(F.concat(F.lit("m"), F.expr(f"slot_ts div {X.SLOT} % 3").cast("string")).alias("market"), "slot_ts", "up_ratio", F.col("n_ticks").cast("double").alias("n_ticks"), "vol_tot", F.col("target").cast("double").alias("target"))
    none = F.lit(None).cast("double")
    slots = f.withColumns({"target": none, "arrival": F.col("slot_ts") + X.OBS, "id": F.lit(0)})
    labels = f.withColumns({"up_ratio": none, "n_ticks": none, "vol_tot": none, "arrival": F.col("slot_ts") + 2 * X.SLOT + 60, "id": F.lit(1)})
    held = T.run_to_table(L.history(L.replay(pin(slots.unionByName(labels), "slots"), "arrival")), ["market", "slot_ts"]).where("NOT gone")
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("market").orderBy("slot_ts")) - 1)  # 25 rows a market
    lags = ordering.lag_features(ranked, 3 * X.SLOT, lags=2, unknown=ordering.LAGS, by=("market",))
    z = ordering.zscores(ranked, "up_ratio", F.col("n_ticks") > 0, 3 * X.SLOT, by=("market",)).select("market", "slot_ts", F.round("lag_ur_z20", 4).alias("lag_ur_z20"))
    return lags.select("market", "slot_ts", "target", "lag1_target", "lag2_target", F.round("lag1_up_ratio", 6).alias("lag1_up_ratio")).join(z, ["market", "slot_ts"])


_BASE = 1_699_999_980  # divides by the window's 60 seconds
_WINDOWED = _MICRO.replace("SELECT market, t, id, mid", "SELECT market * 1000 + CAST(floor(t / 60) AS BIGINT) AS market, t, id, mid", 1).replace(" WHERE t >= 108 AND t < 168", "", 1)


@query(f"""WITH {_SNAPS}, {_WINDOWED} SELECT CAST(market // 1000 AS VARCHAR) AS token, market % 1000 * 60 + 60 AS window_end, {", ".join(f"round({n} + 1e-9, 5) AS {n}" for n in _MS)} FROM micro
    WHERE market % 1000 * 60 + 60 <= (SELECT max(t) FROM snaps) - 30""")
def t_live_microstructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten features of each market's whole minutes from events held in state; those the watermark hasn't passed don't come out."""
    s, whole = snapshots(spark, sf_dir), F.col("id") % 4 != 0
    e = s.select(
        F.col("market").cast("string").alias("token"), F.timestamp_seconds(F.col("t") + _BASE).alias("at"), (F.col("t") + _BASE).alias("t"), "id", "mid", "spread", F.when(F.col("id") % 8 == 0, F.col("ask")).alias("sell_price"),
        F.when(whole, F.col("imbalance")).alias("imbalance"), F.when(whole, F.col("total_depth")).alias("depth"),
    )
    m = T.run_to_table(L.live_microstructure(L.replay(pin(e, "events"), "t")), ["token", "window_end"], mode="append")
    return m.select("token", (F.col("window_end") - _BASE).alias("window_end"), *(F.round(F.col(n) + 1e-9, 5).alias(n) for n in _MS))


@query("SELECT event_type AS feed, count(*) AS rows, TRUE AS alarm FROM events GROUP BY 1")
def t_total_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed has ended, and no event comes any more: the clock alone raises each feed's alarm."""
    e = T.landed_events(spark, sf_dir).select(F.col("event_type").alias("feed"))
    seen = L.run_until(L.watch(e, 400, 200), ["feed"], "version", lambda now: now.where("NOT alarm").isEmpty() and not now.isEmpty(), 90)
    return seen.select("feed", "rows", "alarm")


@query(f"""{X.ctes("slots")}, m AS (SELECT max(ts) - INTERVAL 120 SECOND AS mark FROM events), d AS (SELECT *, make_timestamp((slot_ts + {X.SLOT}) * 1000000) <= mark AS final, (slot_ts // 21600 % 2 = 0) = (target = 1) AS won FROM slots, m)
    SELECT slot_ts, CASE WHEN final THEN 'settled' ELSE 'open' END AS status, CASE WHEN final THEN CASE WHEN won THEN 'WIN' ELSE 'LOSS' END END AS result, round(CASE WHEN final THEN CASE WHEN won THEN 9.8 - 5 ELSE -5 END END, 6) AS pnl_usdc FROM d""")
def t_settled_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open ledger rows settled in the stream as slots become final, by partitions of a versioned table."""
    root = new_path(spark, "ledger")
    open_ = X.slots(spark, sf_dir).select("slot_ts", F.when(F.expr("slot_ts div 21600 % 2 = 0"), "UP").otherwise("DOWN").alias("direction"), F.lit(10.0).alias("shares"), F.lit(5.0).alias("actual_cost"),
                                          F.lit("open").alias("status"), F.lit(None).cast("double").alias("pnl_usdc"), F.lit(None).cast("string").alias("result"))
    versioned.replace(open_, root, T.ledger_day(F.col("slot_ts")))
    e = X.table(spark, sf_dir, "events").withColumn("us", F.expr(X.EPOCH_US)).withColumn("at", F.timestamp_micros("us"))
    T.settle_stream(T.slot_targets(L.replay(e, "us")), root, X.SLOT, 60)
    return rounded(versioned.read(spark, root).select("slot_ts", "status", "result", "pnl_usdc"))


@query(f"WITH {_SNAPS}, {_OPEN_CLOSE} SELECT market, n_snapshots, {r6(*_OC)} FROM oc")
def t_opening_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and decision books of each market's slot as they stand, in four micro-batches, by the batch form's aggregates."""
    s = pin(snapshots(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("t") + _BASE)), "snapshots")
    live = L.replay(s, "t").withWatermark("at", "30 seconds").withColumn("slot", F.window("at", "180 seconds", startTime=f"{_BASE % 180} seconds"))
    return rounded(T.run_to_table(book.open_close(live, ["slot", "market"]), ["slot", "market"]).drop("slot"))
