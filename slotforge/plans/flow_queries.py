"""Slot flow, tick packs, labels and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge import fixtures as X
from slotforge import plugins
from slotforge.operators import flow, ledger, timejoins
from slotforge.plans.registry import query, rounded, share

_UP = "(outcome = 'Up')"


def slot_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.slot_flow(X.ticks(spark, sf_dir), X.slots(spark, sf_dir), X.OBS, X.WINDOWS, X.DECAY)


def flow_cte() -> str:
    w = ", ".join(
        f"coalesce(sum(size_usdc) FILTER ({_UP} AND floor(t_sec / {X.STEP}) = {k}), 0) AS u{k}, coalesce(sum(size_usdc) FILTER (floor(t_sec / {X.STEP}) = {k}), 0) AS a{k}"
        for k in range(6)
    )
    r = ", ".join(f"CASE WHEN a{k} > 0 THEN u{k} / a{k} ELSE 0.5 END AS up_w{k}" for k in range(6))
    decay = f"exp(-{X.DECAY!r} * ({X.OBS} - t_sec))"
    return f"""obs AS (SELECT * FROM ticks WHERE timestamp_ms > 0 AND t_sec >= 0 AND t_sec < {X.OBS}),
    g AS (SELECT slot_ts, count(*) AS n_ticks, coalesce(sum(size_usdc) FILTER ({_UP}), 0) AS vol_up, coalesce(sum(size_usdc) FILTER (NOT {_UP}), 0) AS vol_dn,
        sum(price * size_usdc) FILTER ({_UP}) AS pu, sum(price * size_usdc) FILTER (NOT {_UP}) AS pd, coalesce(sum(size_usdc) FILTER (side = 'BUY'), 0) AS buy,
        sum({decay} * CASE WHEN {_UP} THEN size_usdc ELSE 0 END) AS wu, sum({decay} * size_usdc) AS ws, sum({decay}) AS ww,
        coalesce(avg(size_usdc) FILTER ({_UP}), 0) AS mu, coalesce(avg(size_usdc) FILTER (NOT {_UP}), 0) AS md, {w} FROM obs GROUP BY slot_ts),
    h AS (SELECT *, vol_up + vol_dn AS vol_tot, vol_up / greatest(vol_up + vol_dn, 1e-9) AS up_ratio,
        CASE WHEN vol_up > 0 THEN pu / vol_up ELSE 0.5 END AS vwap_up, CASE WHEN vol_dn > 0 THEN pd / vol_dn ELSE 0.5 END AS vwap_dn, {r} FROM g),
    i AS (SELECT *, (up_w3 + up_w4 + up_w5) / 3 - (up_w0 + up_w1 + up_w2) / 3 AS momentum,
        (SELECT stddev_pop(x) FROM unnest([up_w0, up_w1, up_w2, up_w3, up_w4, up_w5]) t(x)) AS stability FROM h),
    flow AS (SELECT s.market_id, s.slug, s.slot_ts, s.target, coalesce(n_ticks, 0) AS n_ticks, coalesce(vol_up, 0) AS vol_up, coalesce(vol_dn, 0) AS vol_dn,
        coalesce(vol_tot, 0) AS vol_tot, coalesce(up_ratio, 0.5) AS up_ratio, coalesce(vwap_up, 0.5) AS vwap_up, coalesce(vwap_dn, 0.5) AS vwap_dn,
        coalesce(vwap_up - vwap_dn, 0) AS vwap_spread, coalesce(vwap_up - 0.5, 0) AS vwap_trend,
        coalesce(CASE WHEN n_ticks > 1 THEN (wu / ww) / (ws / ww + 1e-9) ELSE up_ratio END, 0.5) AS decayed_up_ratio,
        coalesce(CASE WHEN vol_tot > 0 THEN buy / vol_tot ELSE 0.5 END, 0.5) AS buy_ratio,
        {", ".join(f"coalesce(up_w{k}, 0) AS up_w{k}" for k in range(6))},
        coalesce(momentum, 0) AS momentum, coalesce(stability, 0) AS stability, coalesce(up_ratio * (1 - stability), 0) AS conviction,
        coalesce(mu - md, 0) AS size_disparity FROM slots s LEFT JOIN i USING (slot_ts))"""


FLOW = X.ctes("ticks", "slots") + ", " + flow_cte()
FLOW_DOUBLES = ["vol_up", "vol_dn", "vol_tot", "up_ratio", "vwap_up", "vwap_dn", "vwap_spread", "vwap_trend", "decayed_up_ratio", "buy_ratio", *(f"up_w{k}" for k in range(6)), "momentum", "stability", "conviction", "size_disparity"]


def r6(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


@query(f"{FLOW} SELECT slot_ts, market_id, slug, target, n_ticks, {r6(*FLOW_DOUBLES)} FROM flow")
def a_flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(slot_flow(spark, sf_dir))


def _b(condition: str) -> str:
    return f"coalesce(sum(size_usdc) FILTER ({condition}), 0)"


@query(f"""{X.ctes("ticks")}, p AS (SELECT market_id, {_b("side = 'BUY'")} AS buy_volume, {_b("side <> 'BUY'")} AS sell_volume, {_b(_UP)} AS up_volume, {_b("NOT " + _UP)} AS down_volume,
    count(*) AS n_trades, count(*) FILTER (side = 'BUY') AS n_buys, count(*) FILTER (side <> 'BUY') AS n_sells, avg(size_usdc) AS avg_size, max(size_usdc) AS max_size,
    arg_min(price, (t_sec, event_id)) AS price_first, arg_max(price, (t_sec, event_id)) AS price_last, stddev_samp(price) AS price_std, avg(price) AS price_mean,
    sum(price * size_usdc) FILTER ({_UP}) AS pu, sum(price * size_usdc) FILTER (NOT {_UP}) AS pd FROM ticks GROUP BY 1)
    SELECT market_id, n_trades, n_buys, n_sells, {r6("buy_volume", "sell_volume", "up_volume", "down_volume", "avg_size", "max_size", "price_first", "price_last", "price_std", "price_mean")},
    round(CASE WHEN buy_volume + sell_volume > 0 THEN (buy_volume - sell_volume) / (buy_volume + sell_volume) ELSE 0 END, 6) AS imbalance,
    round(CASE WHEN sell_volume > 0 THEN buy_volume / sell_volume END, 6) AS buy_sell_ratio, round(CASE WHEN price_first > 0 THEN price_last / price_first - 1 END, 6) AS price_return,
    round(CASE WHEN up_volume > 0 THEN pu / up_volume END, 6) AS vwap_up, round(CASE WHEN down_volume > 0 THEN pd / down_volume END, 6) AS vwap_down FROM p""")
def a_tick_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.tick_pack(X.ticks(spark, sf_dir)))


def _near(q: float) -> str:
    return f"round(arg_min(price, (abs(round(t_sec - (t0 + {q} * (t1 - t0)), 6)), t_sec, event_id)), 6)"


@query(f"""{X.ctes("ticks")}, p AS (SELECT market_id, count(*) AS n, arg_min(price, (t_sec, event_id)) AS price_first, arg_max(price, (t_sec, event_id)) AS price_last, avg(price) AS price_mean,
    stddev_pop(price) AS price_std, min(price) AS price_min, max(price) AS price_max, min(t_sec) AS t0, max(t_sec) AS t1, min(timestamp_ms) AS ms FROM ticks GROUP BY 1),
    q AS (SELECT market_id, {_near(0.25)} AS price_q25, {_near(0.5)} AS price_q50, {_near(0.75)} AS price_q75 FROM ticks JOIN p USING (market_id) GROUP BY 1),
    c AS (SELECT *, 2 * pi() / 24 * ((ms // 60000 % 1440) / 60.0) AS h, 2 * pi() / 7 * ((ms // 86400000 + 3) % 7) AS d FROM p)
    SELECT market_id, n, {r6("price_first", "price_last", "price_mean", "price_std", "price_min", "price_max")}, price_q25, price_q50, price_q75, round(price_last - price_first, 6) AS price_momentum,
    round(sin(h), 6) AS hour_sin, round(cos(h), 6) AS hour_cos, round(sin(d), 6) AS weekday_sin, round(cos(d), 6) AS weekday_cos FROM c JOIN q USING (market_id)""")
def a_price_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.price_pack(X.ticks(spark, sf_dir)))


@query(f"""{X.ctes("ticks")}, p AS (SELECT market_id, count(*) AS n, arg_min(price, (t_sec, event_id)) AS a, arg_max(price, (t_sec, event_id)) AS z, stddev_pop(price) AS sd FROM ticks GROUP BY 1),
    q AS (SELECT market_id, count(*) FILTER (side = 'BUY') AS n_buys, {_b("side = 'BUY'")} AS buy_volume, {_b("side <> 'BUY'")} AS sell_volume FROM ticks GROUP BY 1)
    SELECT market_id, n, n_buys, {r6("buy_volume", "sell_volume")}, round(z - a, 6) AS price_momentum, round(sd, 6) AS price_std,
    round(CASE WHEN buy_volume + sell_volume > 0 THEN (buy_volume - sell_volume) / (buy_volume + sell_volume) ELSE 0 END, 6) AS imbalance FROM p JOIN q USING (market_id)""")
def j_market_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.market_packs(X.ticks(spark, sf_dir)).select("market_id", "n", "n_buys", "buy_volume", "sell_volume", "price_momentum", "price_std", "imbalance"))


_P1, _P2 = X.SLOT * 0.3, X.SLOT * 0.7
_BINS = {"early": f"t_sec <= {_P1}", "mid": f"t_sec > {_P1} AND t_sec <= {_P2}", "late": f"t_sec > {_P2}"}


def _phase_sql() -> str:
    cols, shares = [], []
    for p, c in _BINS.items():
        for s, when in (("up", f"{c} AND {_UP}"), ("down", f"{c} AND NOT {_UP}")):
            cols += [f"{_b(when)} AS {p}_vol_{s}", f"count(*) FILTER ({when}) AS {p}_n_{s}", f"coalesce(sum(price * size_usdc) FILTER ({when}), 0) AS {p}_pv_{s}"]
        cols += [f"count(*) FILTER ({c}) AS {p}_n_ticks", f"{_b(c)} AS {p}_total_vol"]
        shares += [f"{p}_vol_up / ({p}_total_vol + 1e-8) AS {p}_up_ratio", *(f"{p}_pv_{s} / ({p}_vol_{s} + 1e-8) AS {p}_vwap_{s}" for s in ("up", "down"))]
    counts = ", ".join(f"{p}_{n}" for p in _BINS for n in ("n_ticks", "n_up", "n_down"))
    doubles = r6(*(f"{p}_{n}" for p in _BINS for n in ("vol_up", "vol_down", "up_ratio", "total_vol", "vwap_up", "vwap_down")))
    return f"""{X.ctes("ticks")}, p AS (SELECT market_id, {", ".join(cols)}, count(*) AS total_temporal_n_ticks FROM ticks GROUP BY 1), q AS (SELECT *, {", ".join(shares)} FROM p)
        SELECT market_id, total_temporal_n_ticks, {counts}, {doubles}, round(early_up_ratio / (late_up_ratio + 1e-8), 6) AS momentum_vol_ratio, round(late_n_ticks / (total_temporal_n_ticks + 1e-8), 6) AS late_surge,
        round(early_up_ratio - mid_up_ratio, 6) AS early_mid_vol_diff, round(mid_up_ratio - late_up_ratio, 6) AS mid_late_vol_diff, round(late_total_vol / (early_total_vol + 1e-8), 6) AS vol_trend FROM q"""


@query(_phase_sql())
def a_phase_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.phase_pack(X.ticks(spark, sf_dir), _P1, _P2))


def _at(q: float) -> str:
    return f"round(list_extract(l, CAST(round_even({q} * (len(l) - 1), 0) AS INT) + 1), 6) AS price_i{int(q * 100)}"


@query(f"""{X.ctes("ticks")}, p AS (SELECT market_id, list(price ORDER BY t_sec, event_id) AS l, avg(price) AS price_mean, stddev_pop(price) AS price_std, sum(size_usdc) AS volume FROM ticks GROUP BY 1)
    SELECT market_id, len(l) AS n, {", ".join(map(_at, (0.0, 0.25, 0.5, 0.75, 1.0)))}, {r6("price_mean", "price_std", "volume")} FROM p""")
def a_serving_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.serving_pack(X.ticks(spark, sf_dir)))


@query(f"""{X.ctes("ticks")} SELECT market_id, {", ".join(f"round(quantile_cont(price, {q}), 6) AS price_p{int(q * 100)}" for q in (0.25, 0.5, 0.75))},
    round({_b(_UP)} / ({_b("NOT " + _UP)} + 1e-8), 6) AS up_down_ratio, count(*) FILTER (side <> 'BUY') AS n_sells FROM ticks GROUP BY 1""")
def a_scan_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.scan_pack(X.ticks(spark, sf_dir)))


_LABELS = f"""{X.ctes("candles", "slots")}, derived AS (
    SELECT s.slot_ts, arg_min(c.open, c.ts) AS first_open, arg_max(c.close, c.ts) AS last_close FROM slots s
    JOIN candles c ON c.ts >= s.slot_ts AND c.ts <= s.slot_ts + {X.SLOT - X.HOUR} GROUP BY 1),
    r AS (SELECT s.slot_ts, s.target, CASE WHEN last_close IS NULL THEN NULL WHEN last_close > first_open THEN 1 ELSE 0 END AS derived FROM slots s LEFT JOIN derived USING (slot_ts))"""


def candle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.slots(spark, sf_dir)
    e = timejoins.endpoints(s, F.col("slot_ts"), F.col("slot_ts") + (X.SLOT - X.HOUR), X.candles(spark, sf_dir), X.HOUR, "slot_ts")
    return s.join(e, "slot_ts", "left").withColumn("derived", F.when(F.col("last_close").isNotNull(), F.when(F.col("last_close") > F.col("first_open"), 1).otherwise(0)))


@query(f"{_LABELS} SELECT slot_ts, target, derived FROM r")
def a_label_from_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candle_labels(spark, sf_dir).select("slot_ts", "target", "derived")


@query(f"""{_LABELS} SELECT count(*) FILTER (derived = target) AS n_match, count(*) FILTER (derived <> target) AS n_mismatch, count(*) FILTER (derived IS NULL) AS n_missing,
    round(count(*) FILTER (derived = target) / count(derived), 6) AS agreement, count(*) FILTER (derived = target) / count(derived) >= 0.995 AS passed FROM r""")
def j_label_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger.reconcile(candle_labels(spark, sf_dir), "derived", "target").withColumn("agreement", share("agreement"))
    return r.select("n_match", "n_mismatch", "n_missing", F.round("agreement", 6).alias("agreement"), (F.col("agreement") >= 0.995).alias("passed"))


@query(f"""{X.ctes("ticks", "slots")} SELECT target, count(DISTINCT s.market_id) AS n_markets, count(t.event_id) AS n_ticks, count(*) FILTER (t.price IS NULL) AS null_prices,
    count(DISTINCT t.outcome) AS n_outcomes FROM slots s LEFT JOIN ticks t USING (market_id) GROUP BY 1""")
def a_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = X.slots(spark, sf_dir).join(X.ticks(spark, sf_dir).drop("slot_ts"), "market_id", "left")
    return j.groupBy("target").agg(F.countDistinct("market_id").alias("n_markets"), F.count("event_id").alias("n_ticks"), F.count_if(F.col("price").isNull()).alias("null_prices"), F.countDistinct("outcome").alias("n_outcomes"))


_AUDIT = f"""{X.ctes("ticks")}, a AS (SELECT *, t_sec - 1800 AS t FROM ticks), m AS (SELECT market_id, avg(CASE WHEN t > {X.OBS} THEN 1.0 ELSE 0.0 END) AS leak, max(t) - min(t) AS length FROM a GROUP BY 1)"""


@query(f"""{_AUDIT} SELECT (SELECT count(*) FROM a WHERE t < 0) AS n_pre, (SELECT count(*) FROM a WHERE t >= 0 AND t < {X.OBS}) AS n_in, (SELECT count(*) FROM a WHERE t >= {X.OBS}) AS n_post,
    (SELECT round(count(*) FILTER (t >= {X.OBS}) / count(*), 6) FROM a) AS post_share,
    (SELECT round(count(*) FILTER (t >= {X.OBS}) / count(*), 6) FROM a WHERE t > {_P2}) AS late_post_share,
    round(avg(leak), 6) AS leak_mean, round(avg(length), 4) AS length_mean, round(median(length), 4) AS length_median, round(min(length), 4) AS length_min, round(max(length), 4) AS length_max FROM m""")
def a_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before, in and after the observation window (here the window opens half an hour into a slot)."""
    t = X.ticks(spark, sf_dir).withColumn("t", F.col("t_sec") - 1800)
    post, late = F.col("t") >= X.OBS, F.col("t") > _P2
    whole = t.agg(
        F.count_if(F.col("t") < 0).alias("n_pre"), F.count_if((F.col("t") >= 0) & ~post).alias("n_in"), F.count_if(post).alias("n_post"),
        F.round(share(F.count_if(post), F.count("*")), 6).alias("post_share"), F.round(share(F.count_if(post & late), F.count_if(late)), 6).alias("late_post_share"),
    )
    each = t.groupBy("market_id").agg(F.avg(F.when(F.col("t") > X.OBS, 1.0).otherwise(0.0)).alias("leak"), (F.max("t") - F.min("t")).alias("length"))
    markets = each.agg(F.round(F.avg("leak"), 6).alias("leak_mean"), *(F.round(f("length"), 4).alias(f"length_{n}") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))))
    return whole.join(markets)  # one row each


@query(f"""{X.ctes("ticks")} SELECT market_id, count(*) AS n_all, count(*) FILTER (t_sec < {_P1}) AS n_early, count(*) FILTER (t_sec >= {_P1} AND t_sec < {_P2}) AS n_mid,
    count(*) FILTER (t_sec >= {_P2} AND t_sec < {X.SLOT}) AS n_late FROM ticks GROUP BY 1""")
def p_live_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.ticks(spark, sf_dir).withColumn("phase", flow.phase_of(F.col("t_sec"), _P1, _P2, left_closed=True))
    return t.groupBy("market_id").agg(F.count("*").alias("n_all"), *(F.count_if(F.col("phase") == p).alias(f"n_{p}") for p in flow.PHASES))


_SERVED = ["first_price", "last_price", "price_mean", "price_std", "price_min", "price_max", "price_momentum", "n_ticks", "price_at_25pct", "price_at_50pct", "price_at_75pct", "hour_of_day_sin", "hour_of_day_cos", "day_of_week_sin", "day_of_week_cos",
           "total_volume_usdc", "buy_volume_usdc", "sell_volume_usdc", "buy_sell_imbalance", "up_volume_usdc", "down_volume_usdc", "up_down_volume_ratio", "n_trades", "n_buy_trades", "n_sell_trades", "avg_trade_size",
           "spot_price_start", "spot_price_end", "spot_return", "spot_volatility", "spot_price_mean", "vwap_up", "vwap_down"]


def _served_sql() -> str:
    quarter = lambda p: f"l[CAST(round_even({p / 100} * (len(l) - 1), 0) AS INT) + 1] AS price_at_{p}pct"
    return f"""{X.ctes("ticks", "slots", "candles")}, b AS (SELECT slot_ts, count(*) AS n, count(*) FILTER ({_UP}) AS nu, count(*) FILTER (side = 'BUY') AS nb, count(*) FILTER (side = 'SELL') AS ns, {_b("side = 'BUY'")} AS bv, {_b("side = 'SELL'")} AS sv,
        {_b(_UP)} AS uv, {_b("outcome = 'Down'")} AS dv, sum(price * size_usdc) FILTER ({_UP}) AS pu, sum(price * size_usdc) FILTER (outcome = 'Down') AS pd, min(timestamp_ms) AS t0, max(timestamp_ms) AS t1 FROM ticks GROUP BY 1),
    p AS (SELECT slot_ts, list(price ORDER BY t_sec, event_id) AS l, avg(price) AS price_mean, stddev_pop(price) AS price_std, min(price) AS price_min, max(price) AS price_max FROM ticks JOIN b USING (slot_ts) WHERE {_UP} OR nu = 0 GROUP BY 1),
    k AS (SELECT slot_ts, arg_min(open, ts) AS spot_price_start, arg_max(close, ts) AS spot_price_end, avg(close) AS spot_price_mean, stddev_pop(close) AS sd FROM b JOIN candles ON ts * 1000 BETWEEN t0 AND t1 + 60000 GROUP BY 1),
    a AS (SELECT slot_ts, l[1] AS first_price, l[len(l)] AS last_price, price_mean, price_std, price_min, price_max, l[len(l)] - l[1] AS price_momentum, CAST(len(l) AS DOUBLE) AS n_ticks, {", ".join(map(quarter, (25, 50, 75)))},
        2 * pi() * (slot_ts % 86400 // 60 / 60.0) / 24 AS h, 2 * pi() * ((slot_ts // 86400 + 3) % 7) / 7 AS w, bv + sv AS total_volume_usdc, bv AS buy_volume_usdc, sv AS sell_volume_usdc, coalesce((bv - sv) / nullif(bv + sv, 0), 0) AS buy_sell_imbalance,
        uv AS up_volume_usdc, dv AS down_volume_usdc, coalesce(uv / nullif(uv + dv, 0), 0.5) AS up_down_volume_ratio, CAST(n AS DOUBLE) AS n_trades, CAST(nb AS DOUBLE) AS n_buy_trades, CAST(ns AS DOUBLE) AS n_sell_trades, (bv + sv) / n AS avg_trade_size,
        spot_price_start, spot_price_end, (spot_price_end - spot_price_start) / nullif(spot_price_start, 0) AS spot_return, coalesce(sd, 0) AS spot_volatility, spot_price_mean, pu / nullif(uv, 0) AS vwap_up, pd / nullif(dv, 0) AS vwap_down
        FROM slots JOIN b USING (slot_ts) JOIN p USING (slot_ts) LEFT JOIN k USING (slot_ts)),
    z AS (SELECT *, sin(h) AS hour_of_day_sin, cos(h) AS hour_of_day_cos, sin(w) AS day_of_week_sin, cos(w) AS day_of_week_cos FROM a)
    SELECT slot_ts, {r6(*_SERVED, places=5)} FROM z"""


@query(_served_sql())
def a_serving_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole serving row of each slot."""
    row = flow.serving_row(X.ticks(spark, sf_dir), X.slots(spark, sf_dir), X.candles(spark, sf_dir), X.SLOT)
    return rounded(row.select("slot_ts", *_SERVED), 5)


_LOW, _HIGH = X.SLOT * 170 // 300, X.SLOT * 240 // 300


@query(f"""SELECT epoch_us(ts) // {X.SLOT}000000 * {X.SLOT} AS slot, count(*) FILTER (epoch_us(ts) // 1000000 % {X.SLOT} BETWEEN {_LOW} AND {_HIGH}) AS n_open, count(*) AS n FROM events GROUP BY 1""")
def p_entry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of each slot inside the entry window, the window being the same share of a slot as live."""
    t = X.ticks(spark, sf_dir).select(F.expr("timestamp_ms div 1000").alias("s"))
    slot = flow.slot_floor(F.col("s"), X.SLOT)
    return t.groupBy(slot.alias("slot")).agg(F.count_if(flow.entry_window(F.col("s") - slot, _LOW, _HIGH)).alias("n_open"), F.count("*").alias("n"))


_PLUGIN_DEFAULTS = {"up_ratio": 0.5, "momentum": 0.0, "n_ticks": 0.0, "vwap_up": 0.5, "ob_mid": 0.5}


def _plugin_markets(ticks: DataFrame) -> DataFrame:
    """Ticks with their market's slot: what the plugin's other steps start from."""
    return ticks.where("timestamp_ms > 0 AND market_id IS NOT NULL")


def _plugin_features(ticks: DataFrame) -> DataFrame:
    seen = ticks.where((F.col("t_sec") >= 0) & (F.col("t_sec") < X.OBS)).groupBy("market_id").agg(*flow.flow_sums(X.OBS, X.WINDOWS, X.DECAY)).select("market_id", *flow.flow_features(X.WINDOWS))
    return ticks.select("market_id").distinct().join(seen, "market_id", "left")


def _plugin_truth(ticks: DataFrame) -> DataFrame:
    """Up won if the last size is above the first; every seventh market isn't resolved."""
    order = F.struct("t_sec", "event_id")
    g = ticks.groupBy("market_id").agg((F.max_by("size_usdc", order) > F.min_by("size_usdc", order)).cast("int").alias("up"), F.min("slot_ts").alias("s"))
    return g.select("market_id", F.when(F.expr(f"s div {X.SLOT} % 7 <> 0"), F.col("up")).alias("target"))


plugins.register(plugins.Plugin("six_hour_updown", "market_id", _plugin_markets, _plugin_features, _plugin_truth, _PLUGIN_DEFAULTS))


@query(f"""{FLOW} SELECT market_id, target, round(up_ratio, 6) AS up_ratio, round(momentum, 6) AS momentum, CAST(n_ticks AS DOUBLE) AS n_ticks, round(vwap_up, 6) AS vwap_up, 0.5::DOUBLE AS ob_mid FROM flow WHERE slot_ts // {X.SLOT} % 7 <> 0""")
def x_plugin_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of a registered plugin, from landed ticks; a feature it doesn't have is served at its default."""
    return rounded(plugins.training_rows("six_hour_updown", X.ticks(spark, sf_dir)))


@query(f"""{X.ctes("ticks")}, s AS (SELECT *, CASE WHEN event_id % 4 <> 0 AND slot_ts // {X.SLOT} % 9 <> 0 THEN size_usdc + 1 END AS spot FROM ticks)
    SELECT market_id, round(arg_min(spot, (t_sec, event_id)) FILTER (spot IS NOT NULL), 6) AS spot_first, round(arg_max(spot, (t_sec, event_id)) FILTER (spot IS NOT NULL), 6) AS spot_last, round(stddev_samp(spot), 6) AS spot_volatility, round(avg(spot), 6) AS spot_mean,
    round(arg_max(spot, (t_sec, event_id)) FILTER (spot IS NOT NULL) / arg_min(spot, (t_sec, event_id)) FILTER (spot IS NOT NULL) - 1, 6) AS spot_return FROM s GROUP BY 1""")
def a_spot_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot prices that three of four trades carry, and those of every ninth slot don't."""
    t = X.ticks(spark, sf_dir)
    return rounded(flow.spot_pack(t.withColumn("spot_price_usdt", F.when((F.col("event_id") % 4 != 0) & F.expr(f"slot_ts div {X.SLOT} % 9 <> 0"), F.col("size_usdc") + 1))))


_LIVE = {"early": f"t_sec < {_P1}", "mid": f"t_sec >= {_P1} AND t_sec < {_P2}", "late": f"t_sec >= {_P2} AND t_sec <= {X.SLOT}"}


@query(f"""{X.ctes("ticks")} SELECT market_id, {", ".join(f"round(quantile_cont(price, {q / 100}), 6) AS price_p{q}" for q in (25, 50, 75))}, CASE WHEN {_b("NOT " + _UP)} > 0 THEN round({_b(_UP)} / ({_b("NOT " + _UP)} + 1e-8), 4) ELSE -1 END AS up_down_ratio, count(*) FILTER (side <> 'BUY') AS n_sells,
    {", ".join(f"round({_b(c)}, 4) AS {p}_vol, count(*) FILTER ({c}) AS {p}_n_ticks, round(CASE WHEN {_b(f'{c} AND NOT {_UP}')} > 0 THEN {_b(f'{c} AND {_UP}')} / ({_b(f'{c} AND NOT {_UP}')} + 1e-8) ELSE -1 END, 4) AS {p}_up_down_ratio" for p, c in _LIVE.items())} FROM ticks GROUP BY 1""")
def a_scan_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan pack with its phases; a ratio without Down volume is shown as -1, as it has no bound."""
    s = flow.scan_pack(X.ticks(spark, sf_dir), _P1, _P2, X.SLOT)
    r = lambda n: F.round(F.when(F.col(n) < 1e6, F.col(n)).otherwise(-1.0), 4) if n.endswith("up_down_ratio") else F.round(n, 4)
    ratio = lambda p: F.when((F.col(f"{p}_vol") == 0) | (F.col(f"{p}_up_down_ratio") > 1e6), -1.0).otherwise(F.round(f"{p}_up_down_ratio", 4)).alias(f"{p}_up_down_ratio")
    return s.select("market_id", *(F.round(f"price_p{q}", 6).alias(f"price_p{q}") for q in (25, 50, 75)), r("up_down_ratio").alias("up_down_ratio"), "n_sells", *(c for p in flow.PHASES for c in (F.round(f"{p}_vol", 4).alias(f"{p}_vol"), F.col(f"{p}_n_ticks"), ratio(p))))


@query(f"""{X.ctes("ticks", "slots")}, p AS (SELECT market_id, count(*) AS n, {_b(f"{_BINS['late']} AND {_UP}")} AS lu FROM ticks WHERE slot_ts // {X.SLOT} % 5 <> 0 GROUP BY 1)
    SELECT market_id, target, coalesce(n, 0) AS total_temporal_n_ticks, round(coalesce(lu, 0), 6) AS late_vol_up FROM slots LEFT JOIN p USING (market_id)""")
def j_phase_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase features joined onto all slots; every fifth slot has none and gets zeros."""
    phases = flow.phase_pack(X.ticks(spark, sf_dir).where(F.expr(f"slot_ts div {X.SLOT} % 5 <> 0")), _P1, _P2)
    return rounded(flow.with_phases(X.slots(spark, sf_dir).select("market_id", "target"), phases).select("market_id", "target", "total_temporal_n_ticks", "late_vol_up"))
