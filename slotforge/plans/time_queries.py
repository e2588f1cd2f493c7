"""As-of and interval joins, ranks, lags, z-scores and the named feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotforge import fixtures as X
from slotforge.functions import features
from slotforge.operators import flow, ordering, timejoins
from slotforge.plans.book_queries import BOOK_SET, MARKET_OF_SLOT, slot_books
from slotforge.plans.flow_queries import FLOW, flow_cte, r6, slot_flow
from slotforge.plans.registry import query, rounded
from slotforge.storage import pin

#: Hours looked back; they stand for 5, 15 and 30 minutes, one hour and four of the five-minute slots.
_H = (1, 2, 3, 6, 24)


def _asof(name: str, at: str, source: str = "slots") -> str:
    """DuckDB: last candle at or before a time, clamped to the first candle."""
    return f"(SELECT coalesce((SELECT arg_max(close, c.ts) FROM candles c WHERE c.ts <= {at}), (SELECT arg_min(close, ts) FROM candles))) AS {name}"


def spot(slots: DataFrame, candles: DataFrame) -> DataFrame:
    """Spot at the end of the observation window and at slot start less each horizon, with returns."""
    at = F.col("slot_ts")
    times = {"px": at + X.OBS} | {f"px_{h}h": at - h * X.HOUR for h in _H}
    s = timejoins.as_of_all(slots.select("slot_ts"), "slot_ts", times, candles, X.HOUR)
    returns = [timejoins.ratio_return(F.col("px"), F.col(f"px_{h}h")).alias(f"ret_{h}h") for h in _H]
    near, inside = timejoins.round_distance(F.col("px"), 10.0)
    s = s.select("*", *returns, near.alias("round_near"), inside.alias("round_pos"))
    return s.withColumn("ratio_1h_24h", timejoins.guarded_ratio(F.col("px"), F.col("px_1h"), F.col("px_24h")))


SPOT = f"""spot0 AS (SELECT slot_ts, {_asof("px", f"slot_ts + {X.OBS}")}, {", ".join(_asof(f"px_{h}h", f"slot_ts - {h * X.HOUR}") for h in _H)} FROM slots),
    spot1 AS (SELECT *, {", ".join(f"CASE WHEN px_{h}h > 0 THEN px / px_{h}h - 1 ELSE 0 END AS ret_{h}h" for h in _H)},
        least(px / 10 - floor(px / 10), ceil(px / 10) - px / 10) AS round_near, (px - 10 * floor(px / 10)) / 10 AS round_pos FROM spot0),
    spot AS (SELECT *, CASE WHEN px > 0 AND px_1h > 0 AND px_24h > 0 AND abs(px - px_24h) > 1 THEN (px - px_1h) / (px - px_24h + 1e-9) ELSE 0 END AS ratio_1h_24h FROM spot1)"""
_SPOT_COLS = ["px", *(f"px_{h}h" for h in _H), *(f"ret_{h}h" for h in _H), "round_near", "round_pos", "ratio_1h_24h"]


@query(f"{X.ctes('candles', 'slots')}, {SPOT} SELECT slot_ts, {r6(*_SPOT_COLS)} FROM spot")
def j_asof_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spot(X.slots(spark, sf_dir), X.candles(spark, sf_dir)))


def with_returns(candles: DataFrame) -> DataFrame:
    """Simple return of each candle on the one before it, and that one's time: lag inside days, the day's first from the day before."""
    day = F.floor(F.col("ts") / 86_400)
    last = candles.groupBy(day.alias("d")).agg(F.max_by(F.struct("ts", "close"), "ts").alias("last"))
    carried = last.select("d", F.lag("last").over(Window.orderBy("d")).alias("carry"))  # one row a day
    w = Window.partitionBy("d").orderBy("ts")
    c = candles.withColumn("d", day).join(carried, "d", "left")
    prev = F.coalesce(F.lag(F.struct("ts", "close")).over(w), F.col("carry"))
    return c.select(*candles.columns, prev.alias("_p")).select(*candles.columns, F.col("_p.ts").alias("prev_ts"), F.when(F.col("_p.close") > 0, F.col("close") / F.col("_p.close") - 1).alias("ret"))


def volatility(start: Column, end: Column, least: int = 3) -> Column:
    """std_pop of the returns between candles with start <= ts <= end, 0 for fewer than ``least`` candles: an aggregate."""
    inside = (F.col("ts") >= start) & (F.col("ts") <= end)
    return F.when(F.count_if(inside) >= least, F.coalesce(F.stddev_pop(F.when(inside & (F.col("prev_ts") >= start), F.col("ret"))), F.lit(0.0))).otherwise(0.0)


def inslot_features(slots: DataFrame, candles: DataFrame) -> DataFrame:
    """Return and range between the first candle at or after slot start and the last one observed, volatilities inside the
    slot, of six hours and of a day, and the last hour's volume against the hours before. Both ends of a window belong to
    it. What no candle shows is 0, a price over the range is as of the end of the observation window.
    """
    at, end, ts = F.col("slot_ts"), F.col("slot_ts") + X.OBS, F.col("ts")
    seen = (ts >= at) & (ts <= end)
    volume = lambda a, b: F.coalesce(F.sum(F.when((ts >= a) & (ts <= b), F.col("volume"))), F.lit(0)).cast("double")
    g = timejoins.interval_aggregate(
        slots.select("slot_ts"), at - 24 * X.HOUR, end + 1, with_returns(candles), X.HOUR, "slot_ts",
        F.min_by(F.when(seen, F.col("close")), F.when(seen, ts)).alias("first"), F.max_by(F.when(seen, F.col("close")), F.when(seen, ts)).alias("last"),
        (F.max(F.when(seen, F.col("high"))) - F.min(F.when(seen, F.col("low")))).alias("span"),
        volatility(at, end).alias("vol_inslot"), volatility(at - 6 * X.HOUR, at).alias("vol_6h"), volatility(at - 24 * X.HOUR, at).alias("vol_24h"),
        (volume(at - X.HOUR, at) / (volume(at - 6 * X.HOUR, at - X.HOUR) / 5 + 1e-9)).alias("spot_vol_ratio"),
    )
    known = slots.select("slot_ts").join(g, "slot_ts", "left")
    # an observed candle is the last one at the end of the window, so its close is the price there
    return known.select(
        "slot_ts", F.coalesce(timejoins.ratio_return(F.col("last"), F.col("first")), F.lit(0.0)).alias("ret_0h"), F.coalesce(F.when(F.col("last") > 0, F.col("span") / F.col("last")), F.lit(0.0)).alias("inslot_range"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vol_inslot", "vol_6h", "vol_24h", "spot_vol_ratio")),
    )


def _within(what: str, a: str, b: str, f: str = "list({} ORDER BY c.ts)") -> str:
    return f"(SELECT {f.format(what)} FROM candles c WHERE c.ts >= {a} AND c.ts <= {b})"


def _vol_sql(px: str) -> str:
    return f"CASE WHEN len({px}) >= 3 THEN list_stddev_pop(list_transform(range(2, len({px}) + 1), lambda i: {px}[i] / {px}[i - 1] - 1)) ELSE 0 END"


_INSLOT = f"""inslot0 AS (SELECT slot_ts, {_within("close", "slot_ts", f"slot_ts + {X.OBS}")} AS p0, {_within("close", f"slot_ts - {6 * X.HOUR}", "slot_ts")} AS p6, {_within("close", f"slot_ts - {24 * X.HOUR}", "slot_ts")} AS p24,
        {_within("high", "slot_ts", f"slot_ts + {X.OBS}", "max({})")} AS hi, {_within("low", "slot_ts", f"slot_ts + {X.OBS}", "min({})")} AS lo, {_asof("px", f"slot_ts + {X.OBS}")},
        {_within("volume", f"slot_ts - {X.HOUR}", "slot_ts", "coalesce(sum({}), 0)")} AS v1, {_within("volume", f"slot_ts - {6 * X.HOUR}", f"slot_ts - {X.HOUR}", "coalesce(sum({}), 0)")} AS v6 FROM slots),
    inslot AS (SELECT slot_ts, coalesce(CASE WHEN p0[1] > 0 THEN p0[-1] / p0[1] - 1 END, 0) AS ret_0h, coalesce(CASE WHEN len(p0) > 0 AND px > 0 THEN (hi - lo) / px END, 0) AS inslot_range,
        {_vol_sql("p0")} AS vol_inslot, {_vol_sql("p6")} AS vol_6h, {_vol_sql("p24")} AS vol_24h, v1 / (v6 / 5.0 + 1e-9) AS spot_vol_ratio FROM inslot0)"""
_INSLOT_COLS = ["ret_0h", "inslot_range", "vol_inslot", "vol_6h", "vol_24h", "spot_vol_ratio"]


@query(f"{X.ctes('candles', 'slots')}, {_INSLOT} SELECT slot_ts, {r6(*_INSLOT_COLS)} FROM inslot")
def j_inslot_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inslot_features(X.slots(spark, sf_dir), X.candles(spark, sf_dir)))


def interval_features(slots: DataFrame, candles: DataFrame) -> DataFrame:
    """Volatility, range and volume of the day before each slot, and volume against the part before its last 6 hours."""
    at = F.col("slot_ts")
    recent = F.col("ts") >= at - 6 * X.HOUR
    s = slots.select("slot_ts")
    g = timejoins.interval_aggregate(
        s, at - 24 * X.HOUR, at, with_returns(candles), X.HOUR, "slot_ts",
        F.count("*").alias("n_candles"), volatility(at - 24 * X.HOUR, at).alias("ret_vol"),
        F.sort_array(F.collect_list(F.struct("ts", "close"))).alias("_c"),  # the candles of one window
        F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", "ts").alias("last_px"),
        F.avg("close").alias("px_mean"), F.stddev_pop("close").alias("px_std"),
        F.sum(F.when(recent, F.col("volume")).otherwise(0)).alias("vol_recent"), F.sum(F.when(~recent, F.col("volume")).otherwise(0)).alias("vol_before"),
    )
    middle = F.element_at("_c", (F.floor(F.size("_c") / 2) + 1).cast("int"))["close"]
    return s.join(g, "slot_ts", "left").select(
        "slot_ts", F.coalesce("n_candles", F.lit(0)).alias("n_candles"),
        F.coalesce("ret_vol", F.lit(0.0)).alias("ret_vol"),
        F.coalesce(F.col("px_std") / F.col("px_mean"), F.lit(0.0)).alias("level_vol"),
        F.coalesce((F.col("hi") - F.col("lo")) / F.col("last_px"), F.lit(0.0)).alias("day_range"),
        F.coalesce(F.when(F.col("vol_before") > 0, F.col("vol_recent") / (F.col("vol_before") / 3)), F.lit(0.0)).alias("volume_ratio"),
        F.coalesce(F.col("last_px") / middle - 1, F.lit(0.0)).alias("half_momentum"),
        F.coalesce((F.col("last_px") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9), F.lit(0.5)).alias("range_pos"),
    )


_INTERVAL = f"""interval_rows AS (SELECT s.slot_ts, c.*, row_number() OVER (PARTITION BY s.slot_ts ORDER BY c.ts) AS k, count(*) OVER (PARTITION BY s.slot_ts) AS m
    FROM slots s JOIN (SELECT *, close / lag(close) OVER (ORDER BY ts) - 1 AS ret FROM candles) c ON c.ts >= s.slot_ts - {24 * X.HOUR} AND c.ts < s.slot_ts),
    interval_agg AS (SELECT slot_ts, count(*) AS n_candles, stddev_pop(ret) FILTER (k > 1) AS rv, max(high) AS hi, min(low) AS lo, arg_max(close, ts) AS last_px, avg(close) AS pm, stddev_pop(close) AS ps,
        sum(CASE WHEN ts >= slot_ts - {6 * X.HOUR} THEN volume ELSE 0 END) AS vr, sum(CASE WHEN ts < slot_ts - {6 * X.HOUR} THEN volume ELSE 0 END) AS vb,
        max(close) FILTER (k = m // 2 + 1) AS middle FROM interval_rows GROUP BY 1),
    intervals AS (SELECT s.slot_ts, coalesce(n_candles, 0) AS n_candles, CASE WHEN n_candles >= 3 THEN rv ELSE 0 END AS ret_vol, coalesce(ps / pm, 0) AS level_vol,
        coalesce((hi - lo) / last_px, 0) AS day_range, coalesce(CASE WHEN vb > 0 THEN vr / (vb / 3) END, 0) AS volume_ratio, coalesce(last_px / middle - 1, 0) AS half_momentum,
        coalesce((last_px - lo) / (hi - lo + 1e-9), 0.5) AS range_pos FROM slots s LEFT JOIN interval_agg USING (slot_ts))"""
_INTERVAL_COLS = ["ret_vol", "level_vol", "day_range", "volume_ratio", "half_momentum", "range_pos"]


@query(f"{X.ctes('candles', 'slots')}, {_INTERVAL} SELECT slot_ts, n_candles, {r6(*_INTERVAL_COLS)} FROM intervals")
def j_interval_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interval_features(X.slots(spark, sf_dir), X.candles(spark, sf_dir)))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of customers (as symbols) over days, irregular, several a day: symbol, ts, price, amount, id."""
    o = X.table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 97).alias("symbol"), F.expr("unix_date(CAST(o_orderdate AS DATE)) * 86400L").alias("ts"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_orderkey") % 50 + 1.0).alias("amount"), F.col("o_orderkey").alias("id"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points; some symbols have no series."""
    li = X.table(spark, sf_dir, "lineitem")
    one = li.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point")).agg(F.min("l_suppkey").alias("s"), F.min("l_shipdate").alias("d"), F.min("l_partkey").alias("p"))
    at = F.expr("unix_date(CAST(d AS DATE)) * 86400L")
    return one.select("point", (F.col("s") % 101).alias("symbol"), at.alias("at"), (at - (F.col("p") % 90) * 86_400).alias("since"))


_SERIES = """series AS (SELECT o_custkey % 97 AS symbol, epoch(date_trunc('day', o_orderdate))::BIGINT AS ts, o_totalprice / 1000 AS price, o_orderkey % 50 + 1.0 AS amount, o_orderkey AS id FROM orders),
    asked AS (SELECT l_orderkey * 10 + l_linenumber AS point, min(l_suppkey) % 101 AS symbol, epoch(date_trunc('day', min(l_shipdate)))::BIGINT AS at_, epoch(date_trunc('day', min(l_shipdate)))::BIGINT - min(l_partkey) % 90 * 86400 AS since FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_SERIES}, newest AS (SELECT symbol, ts, arg_max(price, id) AS price FROM series GROUP BY 1, 2), firsts AS (SELECT symbol, min(ts) AS ts, arg_min(price, ts) AS price FROM newest GROUP BY 1)
    SELECT point, a.symbol, round(coalesce(n.price, f.price), 6) AS price, coalesce(n.ts, f.ts) AS as_of_ts FROM asked a ASOF LEFT JOIN newest n ON a.symbol = n.symbol AND a.at_ >= n.ts LEFT JOIN firsts f ON f.symbol = a.symbol""")
def j_asof_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of prices of many irregular series, without a grid; points before a series take its first row."""
    found = timejoins.as_of_join(_asked(spark, sf_dir), _series(spark, sf_dir), ["symbol"], "at", "ts", ["price"], 30 * 86_400, clamp=True, tie="id")
    return rounded(found.select("point", "symbol", "price", "as_of_ts"))


@query(f"""WITH {_SERIES} SELECT point, count(id) AS n, round(coalesce(sum(amount), 0), 4) AS amount, round(coalesce(sum(amount * price), 0) + 1e-7, 3) AS paid, round(CASE WHEN count(id) > 1 THEN stddev_pop(price) ELSE 0 END + 1e-7, 3) AS spread
    FROM asked a LEFT JOIN series s ON s.symbol = a.symbol AND ts >= since AND ts < at_ GROUP BY 1""")
def j_interval_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, amount, paid and spread of prices of each point's series over its own interval of up to 90 days, from running totals."""
    one = {"n": F.lit(1.0), "amount": F.col("amount"), "paid": F.col("amount") * F.col("price"), "p1": F.col("price"), "p2": F.col("price") * F.col("price")}
    g = timejoins.interval_sums(_asked(spark, sf_dir), _series(spark, sf_dir), ["symbol"], "since", "at", "ts", one, 30 * 86_400)
    mean = F.col("p1") / F.col("n")
    return g.select("point", F.col("n").cast("long").alias("n"), F.round("amount", 4).alias("amount"), F.round(F.col("paid") + 1e-7, 3).alias("paid"), F.round(F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("p2") / F.col("n") - mean * mean, F.lit(0.0)))).otherwise(0.0) + 1e-7, 3).alias("spread"))


def ranked_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = slot_flow(spark, sf_dir)
    return ordering.global_rank(f.select("slot_ts", "market_id", "target", "n_ticks", "vol_tot", "up_ratio", "up_w5", "momentum"), "slot_ts")


def _lag_sql() -> str:
    fill = {"target": "0.5", "up_ratio": "0.5", "n_ticks": "0", "vol_tot": "0"}
    then = {k: f"lag(slot_ts, {k}) OVER w" for k in range(1, 6)}
    fresh = {k: f"coalesce(slot_ts - {then[k]} <= {k * X.SLOT * 3}, FALSE)" for k in then}
    cols = [f"CASE WHEN {then[k]} IS NULL THEN 0 WHEN {fresh[k]} THEN CAST(lag({c}, {k}) OVER w AS DOUBLE) ELSE {v} END AS lag{k}_{c}" for k in then for c, v in fill.items()]
    same = {k: f"({fresh[k]} AND coalesce(lag(target, {k}) OVER w = lag(target, 1) OVER w, FALSE))" for k in range(2, 6)}
    matches = " + ".join(f"CAST({s} AS INT)" for s in same.values())
    run = " + ".join("CAST(" + " AND ".join(same[j] for j in range(2, k + 1)) + " AS INT)" for k in same)
    return f"""lags AS (SELECT slot_ts, market_id, target, n_ticks, vol_tot, up_ratio, up_w5, momentum, row_number() OVER w - 1 AS rank, {", ".join(cols)},
        CASE WHEN {fresh[1]} THEN 1 + {matches} ELSE 0 END AS lag_streak, CASE WHEN {fresh[1]} THEN 1 + {run} ELSE 0 END AS true_streak FROM flow WINDOW w AS (ORDER BY slot_ts))"""


_LAG_COLS = [f"lag{k}_{c}" for k in range(1, 6) for c in ("target", "up_ratio", "n_ticks", "vol_tot")]


@query(f"{FLOW}, {_lag_sql()} SELECT slot_ts, market_id, target, rank, n_ticks, lag_streak, true_streak, {r6('vol_tot', 'up_ratio', 'up_w5', 'momentum', *_LAG_COLS)} FROM lags")
def w_rank_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ordering.lag_features(ranked_flow(spark, sf_dir), X.SLOT))


_Z = f"""zbase AS (SELECT slot_ts, up_ratio, up_w5, CASE WHEN slot_ts - lag(slot_ts) OVER w <= {3 * X.SLOT} THEN lag(up_ratio) OVER w ELSE 0.5 END AS lagged,
        list(CASE WHEN n_ticks > 0 THEN up_ratio END) OVER (ORDER BY slot_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS raw FROM flow WINDOW w AS (ORDER BY slot_ts)),
    zpast AS (SELECT *, list_filter(coalesce(raw, []), lambda x: x IS NOT NULL) AS past FROM zbase),
    zmom AS (SELECT *, list_avg(past) AS m, list_stddev_pop(past) AS s, past[greatest(len(past) - 4, 1):] AS recent FROM zpast),
    z AS (SELECT slot_ts, up_ratio, CASE WHEN len(past) >= 3 THEN (up_ratio - m) / (s + 1e-6) ELSE 0 END AS up_ratio_z20, CASE WHEN len(past) >= 3 THEN (up_w5 - m) / (s + 1e-6) ELSE 0 END AS up_w5_z20,
        CASE WHEN len(recent) >= 2 THEN (up_ratio - list_avg(recent)) / (list_stddev_pop(recent) + 1e-6) ELSE 0 END AS up_ratio_z5,
        CASE WHEN len(past) >= 3 THEN greatest(least((lagged - m) / greatest(s, 0.01), 5), -5) ELSE 0 END AS lag_ur_z20,
        CASE WHEN len(recent) >= 2 THEN greatest(least((lagged - list_avg(recent)) / greatest(list_stddev_pop(recent), 0.01), 5), -5) ELSE 0 END AS lag_ur_z5 FROM zmom)"""
_ZS = ["up_ratio_z20", "up_ratio_z5", "up_w5_z20", "lag_ur_z20", "lag_ur_z5"]


def scored(ranked: DataFrame) -> DataFrame:
    z = ordering.zscores(ranked.select("slot_ts", "rank", "up_ratio", "up_w5", "n_ticks"), "up_ratio", F.col("n_ticks") > 0, X.SLOT, late="up_w5")
    return z.select("slot_ts", "up_ratio", *_ZS)


@query(f"{FLOW}, {_Z} SELECT slot_ts, {r6('up_ratio', *_ZS, places=4)} FROM z")
def w_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(ranked_flow(spark, sf_dir)), 4)


def feature_table(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """One wide row a slot with the columns and cross features of a named set."""
    return features.select_set(wide_table(spark, sf_dir)[0], version)


def wide_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One wide row a slot: flow, z-scores, spot, lags, calendar and books; and the slots and candles that it is made from.

    Events are aggregated to flow rows and to candles once each; both tables are written, all else starts from them.
    """
    ranked = ordering.global_rank(slot_flow(spark, sf_dir), "slot_ts")
    candles, slots = pin(X.candles(spark, sf_dir), "candles"), ranked.select("slot_ts")
    lags = ordering.lag_features(ranked.select("slot_ts", "rank", "target", "up_ratio", "n_ticks", "vol_tot"), X.SLOT).drop("target", "rank", "up_ratio", "n_ticks", "vol_tot")
    wide = ranked.join(scored(ranked).drop("up_ratio"), "slot_ts").join(lags, "slot_ts").join(spot(slots, candles), "slot_ts").join(inslot_features(slots, candles), "slot_ts")
    wide = features.with_books(wide.withColumn("market", F.expr(MARKET_OF_SLOT)), slot_books(spark, sf_dir), "market")
    return features.calendar(wide, "slot_ts"), slots, candles


_CAL = f"""cal AS (SELECT *, sin(2 * pi() / 24 * (slot_ts % 86400 / 3600.0)) AS hour_sin, cos(2 * pi() / 24 * (slot_ts % 86400 / 3600.0)) AS hour_cos, slot_ts % 86400 / 86400.0 AS hour_share, b.m IS NOT NULL AS has_book,
    sin(2 * pi() / 7 * ((slot_ts // 86400 + 3) % 7)) AS weekday_sin, cos(2 * pi() / 7 * ((slot_ts // 86400 + 3) % 7)) AS weekday_cos
    FROM flow JOIN (SELECT * EXCLUDE (up_ratio) FROM z) z USING (slot_ts) JOIN (SELECT * EXCLUDE (market_id, target, n_ticks, vol_tot, up_ratio, up_w5, momentum) FROM lags) lags USING (slot_ts)
    JOIN spot USING (slot_ts) JOIN inslot USING (slot_ts) LEFT JOIN books b ON b.m = slot_ts // 21600 % 211)"""


def _neutral(n: str) -> str:
    """Neutral values are written out by hand here: ratios and imbalances 0, spreads 0.02, near depths and mids one half."""
    half, spread = ("ob_mid", "ob_bid_depth_5c", "ob_ask_depth_5c"), ("ob_spread", "ob_spread_end")
    return f"coalesce({n}, {0.5 if n in half else 0.02 if n in spread else 0})" if n.startswith(("ob_", "clob_")) else n


def _set_sql(version: str) -> str:
    plain = {n: _neutral(n) for n in features.SETS[version]}
    crosses = {n: f"CASE WHEN has_book THEN {a} * {b} ELSE 0 END" if a.startswith("ob_") else f"{a} * {b}" for n, (a, b) in features.CROSS[version].items()}
    cols = ", ".join(f"round(CAST({e} AS DOUBLE), 4) AS {n}" for n, e in (plain | crosses).items())
    return f"{_WIDE} SELECT slot_ts, target, {cols} FROM cal"


_WIDE = f"{X.ctes('ticks', 'slots', 'candles')}, {BOOK_SET}, {flow_cte()}, {_Z}, {_lag_sql()}, {SPOT}, {_INSLOT}, {_CAL}"


@query(_set_sql("v25"))
def x_v25_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_table(spark, sf_dir, "v25"), 4)


@query(_set_sql("v26"))
def x_v26_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_table(spark, sf_dir, "v26"), 4)


def _documented_sql() -> str:
    v = ", ".join(f"coalesce(sum(size_usdc) FILTER (floor(t_sec / {X.STEP}) = {k}), 0) AS v{k}, coalesce(sum(size_usdc) FILTER (floor(t_sec / {X.STEP}) = {k} AND outcome = 'Up'), 0) AS u{k}" for k in range(6))
    w = ", ".join(f"CASE WHEN v{k} > 0 THEN u{k} / v{k} ELSE 0.5 END AS w{k}" for k in range(6))
    return f"""{X.ctes("ticks")}, g AS (SELECT slot_ts, {v}, count(*) FILTER (floor(t_sec / {X.STEP}) = 0) AS c0, count(*) FILTER (floor(t_sec / {X.STEP}) = 5) AS c5 FROM ticks WHERE t_sec >= 0 AND t_sec < {X.OBS} GROUP BY 1),
        h AS (SELECT *, {w}, v0 + v1 + v2 AS va, v3 + v4 + v5 AS vb FROM g),
        r AS (SELECT *, CASE WHEN va > 0 THEN vb / va ELSE 1 END AS accel, (w3 + w4 + w5) / 3 - (w0 + w1 + w2) / 3 AS momentum FROM h)
        SELECT slot_ts, round(accel, 6) AS vol_accel, round(CASE WHEN c0 > 0 THEN (c5 - c0) / c0 ELSE 0 END, 6) AS tick_accel,
        round(CASE WHEN va + vb > 0 THEN ({" + ".join(f"v{k} * (w{k} - 0.5)" for k in range(6))}) / (va + vb) ELSE 0 END, 6) AS vwmom, round(momentum * accel, 6) AS momentum_vol_sync FROM r"""


@query(_documented_sql())
def x_documented_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.documented_features(X.ticks(spark, sf_dir), X.OBS, X.WINDOWS))


def _past(f: str, c: str, n: int) -> str:
    return f"{f}(CASE WHEN n_ticks > 0 THEN {c} END) OVER (ORDER BY slot_ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_SCORED = {**{f"up_w{k}": 20 for k in range(5)}, "up_ratio": 10}


@query(f"""{FLOW} SELECT slot_ts, {", ".join(f"round(CASE WHEN {_past('count', c, n)} >= 3 THEN ({c} - {_past('avg', c, n)}) / ({_past('stddev_pop', c, n)} + 1e-6) ELSE 0 END, 3) AS {c}_z{n}" for c, n in _SCORED.items())} FROM flow""")
def x_documented_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that only the documents of the domain describe: each sub-window against its own 20 slots, the ratio against 10."""
    f = slot_flow(spark, sf_dir).select("slot_ts", "n_ticks", *_SCORED)
    ranked = ordering.global_rank(f, "slot_ts")
    windows = ordering.window_scores(ranked, [c for c, n in _SCORED.items() if n == 20], F.col("n_ticks") > 0, 20, "_z20")
    ten = ordering.window_scores(ranked, ["up_ratio"], F.col("n_ticks") > 0, 10, "_z10").select("slot_ts", "up_ratio_z10")
    return rounded(windows.join(ten, "slot_ts").select("slot_ts", *(f"{c}_z{n}" for c, n in _SCORED.items())), 3)


@query(f"""{FLOW}, l AS (SELECT *, count(*) OVER () AS c FROM (SELECT 'up_ratio' AS feature, up_ratio AS v FROM flow UNION ALL SELECT 'momentum', momentum FROM flow UNION ALL SELECT 'stability', stability FROM flow))
    SELECT feature, 'flow' AS category, count(v) AS n_known, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM l GROUP BY 1""")
def x_registry_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries of the flow category with what the data says about each."""
    f = slot_flow(spark, sf_dir)
    names = [n for n, (category, _) in features.REGISTRY.items() if n in ("up_ratio", "momentum", "stability") and category == "flow"]
    long = f.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names))).alias("x")).select("x.*")
    reg = features.registry(spark).select(F.col("name").alias("feature"), "category")
    return long.join(F.broadcast(reg), "feature").groupBy("feature", "category").agg(F.count("v").alias("n_known"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


_ALL = ", ".join(features.REGISTRY)


@query(f"""{_WIDE}, {_INTERVAL}, w AS (SELECT {", ".join(f"round(CAST({_neutral(n)} AS DOUBLE), 4) AS {n}" for n in features.REGISTRY)} FROM cal JOIN intervals USING (slot_ts)), long AS (UNPIVOT w ON {_ALL} INTO NAME feature VALUE v),
    listed(feature, category) AS (VALUES {", ".join(f"('{n}', '{c}')" for n, (c, _) in features.REGISTRY.items())})
    SELECT feature, category, count(v) AS n_known, round(avg(v) + 1e-7, 2) AS mean, round(min(v), 3) AS low, round(max(v), 3) AS high FROM listed LEFT JOIN long USING (feature) GROUP BY 1, 2""")
def x_registry_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the registry with what the data says about it."""
    wide, slots, candles = wide_table(spark, sf_dir)
    names = list(features.REGISTRY)
    w = wide.join(interval_features(slots, candles), "slot_ts").select(*(F.round(F.col(n).cast("double"), 4).alias(n) for n in names))
    one = w.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("n", F.count), ("mean", F.avg), ("low", F.min), ("high", F.max))))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), *(F.col(f"{n}_{k}").alias(k) for k in ("n", "mean", "low", "high"))) for n in names))).alias("x")).select("x.*")
    reg = features.registry(spark).select(F.col("name").alias("feature"), "category")
    return reg.join(long, "feature", "left").select("feature", "category", F.col("n").alias("n_known"), F.round(F.col("mean") + 1e-7, 2).alias("mean"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


_LISTED = [(k + 1, n) for k, (n, _) in enumerate(features.RANKED)] + [(None, n) for n in features.PRUNED]
_HELD = sorted({c for _, n in _LISTED if (c := features.column_of(n))})


@query(f"""WITH wide AS ({_set_sql("v25")}), long AS (UNPIVOT (SELECT {", ".join(_HELD)} FROM wide) ON {", ".join(_HELD)} INTO NAME c VALUE v),
    listed(rank, feature, c) AS (VALUES {", ".join(f"({k or 'NULL'}, '{n}', {repr(features.column_of(n)) if features.column_of(n) else 'NULL'})" for k, n in _LISTED)})
    SELECT CAST(rank AS INT) AS rank, feature, rank IS NULL AS pruned, count(v) AS n_known, round(avg(v), 3) AS mean FROM listed LEFT JOIN long USING (c) GROUP BY ALL""")
def x_ranked_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked and the pruned features with what the data says about each; a feature without a column here has no rows."""
    wide = rounded(feature_table(spark, sf_dir, "v25"), 4)
    means = wide.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in _HELD))
    long = means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n"), F.col(c).alias("mean")) for c in _HELD))).alias("x")).select("x.*")
    listed = features.ranked(spark).join(long, "column", "left")
    return listed.select("rank", F.col("name").alias("feature"), F.col("rank").isNull().alias("pruned"), F.coalesce("n", F.lit(0)).alias("n_known"), F.round("mean", 3).alias("mean"))


@query(f"""{FLOW}, l AS (SELECT slot_ts, {", ".join(f"slot_ts - lag(slot_ts, {k}) OVER w AS gap{k}, lag(up_ratio, {k}) OVER w AS u{k}, CAST(lag(n_ticks, {k}) OVER w AS DOUBLE) AS t{k}" for k in (1, 2, 3))} FROM flow WINDOW w AS (ORDER BY slot_ts))
    SELECT slot_ts, {", ".join(f"round(CASE WHEN gap{k} <= {k * 3 * X.SLOT} THEN u{k} ELSE 0.5 END, 6) AS lag{k}_up_ratio, CASE WHEN gap{k} <= {k * 3 * X.SLOT} THEN t{k} ELSE 0 END AS lag{k}_n_ticks" for k in (1, 2, 3))} FROM l""")
def w_live_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags as served live: what lies before the first slot counts like a stale one."""
    ranked = ordering.global_rank(slot_flow(spark, sf_dir).select("slot_ts", "target", "up_ratio", "n_ticks", "vol_tot"), "slot_ts")
    live = ordering.lag_features(ranked, X.SLOT, lags=3, unknown=ordering.LAGS)
    return rounded(live.select("slot_ts", *(f"lag{k}_{c}" for k in (1, 2, 3) for c in ("up_ratio", "n_ticks"))))
