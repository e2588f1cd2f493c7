"""Order-flow aggregates of a slot, shared by batch and streaming, and the tick packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-9


def _of(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def flow_sums(obs: float, windows: int = 6, decay: float = 0.02) -> list[Column]:
    """Plain sums over ticks with 0 <= t_sec < obs: all that the flow features need, partially aggregable."""
    up, size, t = F.col("outcome") == "Up", F.col("size_usdc"), F.col("t_sec")
    weight = F.exp(-F.lit(decay) * (F.lit(obs) - t))
    index = F.floor(t / (obs / windows))
    each = [c for k in range(windows) for c in (F.coalesce(_of(up & (index == k), size), F.lit(0.0)).alias(f"_up{k}"), F.coalesce(_of(index == k, size), F.lit(0.0)).alias(f"_all{k}"))]
    return [
        F.count("*").alias("n_ticks"),
        F.coalesce(_of(up, size), F.lit(0.0)).alias("vol_up"),
        F.coalesce(_of(~up, size), F.lit(0.0)).alias("vol_dn"),
        _of(up, F.col("price") * size).alias("_pv_up"),
        _of(~up, F.col("price") * size).alias("_pv_dn"),
        _of(F.col("side") == "BUY", size).alias("_buy"),
        F.sum(F.when(up, weight * size).otherwise(0.0)).alias("_wu"),
        F.sum(weight * size).alias("_ws"),
        F.sum(weight).alias("_w"),
        F.avg(F.when(up, size)).alias("_mean_up"),
        F.avg(F.when(~up, size)).alias("_mean_dn"),
        *each,
    ]


def flow_features(windows: int = 6) -> list[Column]:
    """Feature columns from ``flow_sums``. A slot with Down ticks only has up_ratio 0."""
    total = F.col("vol_up") + F.col("vol_dn")
    ratio = F.col("vol_up") / F.greatest(total, F.lit(EPS))
    vwap = lambda side: F.when(F.col(f"vol_{side}") > 0, F.col(f"_pv_{side}") / F.col(f"vol_{side}")).otherwise(0.5)
    w = [F.when(F.col(f"_all{k}") > 0, F.col(f"_up{k}") / F.col(f"_all{k}")).otherwise(0.5) for k in range(windows)]
    half = windows // 2
    mean = lambda cols: sum(cols[1:], cols[0]) / len(cols)
    momentum = mean(w[half:]) - mean(w[:half])
    m = mean(w)
    stability = F.sqrt(mean([(x - m) * (x - m) for x in w]))
    decayed = F.when(F.col("n_ticks") > 1, (F.col("_wu") / F.col("_w")) / (F.col("_ws") / F.col("_w") + EPS)).otherwise(ratio)
    return [
        F.col("n_ticks"),
        F.col("vol_up"),
        F.col("vol_dn"),
        total.alias("vol_tot"),
        ratio.alias("up_ratio"),
        vwap("up").alias("vwap_up"),
        vwap("dn").alias("vwap_dn"),
        (vwap("up") - vwap("dn")).alias("vwap_spread"),
        (vwap("up") - 0.5).alias("vwap_trend"),
        decayed.alias("decayed_up_ratio"),
        F.when(total > 0, F.coalesce("_buy", F.lit(0.0)) / total).otherwise(0.5).alias("buy_ratio"),
        *(x.alias(f"up_w{k}") for k, x in enumerate(w)),
        momentum.alias("momentum"),
        stability.alias("stability"),
        (ratio * (1 - stability)).alias("conviction"),
        (F.coalesce("_mean_up", F.lit(0.0)) - F.coalesce("_mean_dn", F.lit(0.0))).alias("size_disparity"),
    ]


#: What a slot without ticks gets: ratios and prices 0.5, all else 0.
NEUTRAL_HALF = ("up_ratio", "vwap_up", "vwap_dn", "decayed_up_ratio", "buy_ratio")


def slot_flow(ticks: DataFrame, slots: DataFrame, obs: float, windows: int = 6, decay: float = 0.02) -> DataFrame:
    """One row a slot, neutral where it has no tick in the observation window."""
    seen = ticks.where((F.col("timestamp_ms") > 0) & (F.col("t_sec") >= 0) & (F.col("t_sec") < obs))
    grouped = seen.groupBy("slot_ts").agg(*flow_sums(obs, windows, decay)).select("slot_ts", *flow_features(windows))
    names = [c for c in grouped.columns if c != "slot_ts"]
    joined = slots.join(grouped, "slot_ts", "left")
    fill = {c: (0.5 if c in NEUTRAL_HALF else 0) for c in names}
    return joined.fillna(fill, subset=names)


def tick_pack(ticks: DataFrame) -> DataFrame:
    """Volumes, imbalance, counts, first/last/return/std (sample)/mean of the trade price and VWAPs of each market."""
    up, buy, size = F.col("outcome") == "Up", F.col("side") == "BUY", F.col("size_usdc")
    order = F.struct("t_sec", "event_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    packed = ticks.groupBy("market_id").agg(
        zero(_of(buy, size)).alias("buy_volume"),
        zero(_of(~buy, size)).alias("sell_volume"),
        zero(_of(up, size)).alias("up_volume"),
        zero(_of(~up, size)).alias("down_volume"),
        F.count("*").alias("n_trades"),
        F.count_if(buy).alias("n_buys"),
        F.count_if(~buy).alias("n_sells"),
        F.avg(size).alias("avg_size"),
        F.max(size).alias("max_size"),
        F.min_by("price", order).alias("price_first"),
        F.max_by("price", order).alias("price_last"),
        F.stddev_samp("price").alias("price_std"),
        F.avg("price").alias("price_mean"),
        _of(up, F.col("price") * size).alias("_pu"),
        _of(~up, F.col("price") * size).alias("_pd"),
    )
    both = F.col("buy_volume") + F.col("sell_volume")
    return packed.select(
        *(c for c in packed.columns if not c.startswith("_")),
        F.when(both > 0, (F.col("buy_volume") - F.col("sell_volume")) / both).otherwise(0.0).alias("imbalance"),
        F.when(F.col("sell_volume") > 0, F.col("buy_volume") / F.col("sell_volume")).alias("buy_sell_ratio"),
        F.when(F.col("price_first") > 0, F.col("price_last") / F.col("price_first") - 1).alias("price_return"),
        F.when(F.col("up_volume") > 0, F.col("_pu") / F.col("up_volume")).alias("vwap_up"),
        F.when(F.col("down_volume") > 0, F.col("_pd") / F.col("down_volume")).alias("vwap_down"),
    )


def spot_pack(ticks: DataFrame, spot: str = "spot_price_usdt") -> DataFrame:
    """market_id and first, last, return, std (sample) and mean of the spot price that trades carry, nulls left out; all
    null for a market without one."""
    known, x = F.col(spot).isNotNull(), F.col(spot)
    order = F.when(known, F.struct("t_sec", "event_id"))
    g = ticks.groupBy("market_id").agg(F.min_by(x, order).alias("spot_first"), F.max_by(x, order).alias("spot_last"), F.stddev_samp(x).alias("spot_volatility"), F.avg(x).alias("spot_mean"))
    return g.withColumn("spot_return", F.when(F.col("spot_first") > 0, F.col("spot_last") / F.col("spot_first") - 1))


def with_phases(base: DataFrame, phases: DataFrame, key: str = "market_id") -> DataFrame:
    """The base set with its phase features; rows without one get 0 in all of them."""
    return base.join(phases, key, "left").fillna(0, subset=[c for c in phases.columns if c != key])


def market_packs(ticks: DataFrame) -> DataFrame:
    """The price pack with the tick pack of each market; the tick pack's own prices give way."""
    own = tick_pack(ticks).drop("price_first", "price_last", "price_std", "price_mean")
    return price_pack(ticks).join(own, "market_id")


def price_pack(ticks: DataFrame) -> DataFrame:
    """First, last, mean, spread and the price nearest to 25, 50 and 75 % of the elapsed time of each market.

    The nearest price is found by a second aggregation against the market's own bounds; ties go to the earliest.
    """
    order = F.struct("t_sec", "event_id")
    base = ticks.groupBy("market_id").agg(
        F.count("*").alias("n"),
        F.min_by("price", order).alias("price_first"),
        F.max_by("price", order).alias("price_last"),
        F.avg("price").alias("price_mean"),
        F.stddev_pop("price").alias("price_std"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        F.min("t_sec").alias("_t0"),
        F.max("t_sec").alias("_t1"),
        F.min("timestamp_ms").alias("_ms"),
    )
    at = ticks.join(base.select("market_id", "_t0", "_t1"), "market_id")
    near = lambda q: F.min_by("price", F.struct(F.abs(F.round(F.col("t_sec") - (F.col("_t0") + F.lit(q) * (F.col("_t1") - F.col("_t0"))), 6)), F.col("t_sec"), F.col("event_id")))
    quarters = at.groupBy("market_id").agg(near(0.25).alias("price_q25"), near(0.5).alias("price_q50"), near(0.75).alias("price_q75"))
    hour = F.expr("_ms div 60000 % 1440") / 60.0
    day = F.expr("(_ms div 86400000 + 3) % 7")  # Monday is 0
    return base.join(quarters, "market_id").select(
        *(c for c in base.columns if not c.startswith("_")),
        "price_q25", "price_q50", "price_q75",
        (F.col("price_last") - F.col("price_first")).alias("price_momentum"),
        *(c for name, x, period in (("hour", hour, 24), ("weekday", day, 7)) for c in cyclical(x, period, name)),
    )


def cyclical(value: Column, period: float, name: str) -> list[Column]:
    angle = value * F.lit(2.0 / period) * F.lit(3.141592653589793)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


PHASES = ("early", "mid", "late")


def phase_of(t: Column, first: float, second: float, end: float | None = None, left_closed: bool = False) -> Column:
    """Bins closed on the right (batch form) or on the left (live form); with ``end`` rows outside [0, end] have none."""
    a, b = (t < first, t < second) if left_closed else (t <= first, t <= second)
    phase = F.when(a, "early").when(b, "mid").otherwise("late")
    return phase if end is None else F.when((t >= 0) & (t <= end), phase)


PHASE_FIELDS = ("vol_up", "vol_down", "up_ratio", "n_ticks", "n_up", "n_down", "total_vol", "vwap_up", "vwap_down")


def phase_pack(ticks: DataFrame, first: float, second: float) -> DataFrame:
    """Nine aggregates for each of three phases, the number of all ticks, and contrasts between phases."""
    t = ticks.withColumn("phase", phase_of(F.col("t_sec"), first, second))
    up, size, eps = F.col("outcome") == "Up", F.col("size_usdc"), 1e-8
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = []
    for p in PHASES:
        here = F.col("phase") == p
        for side, of in (("up", here & up), ("down", here & ~up)):
            sums += [zero(_of(of, size)).alias(f"{p}_vol_{side}"), F.count_if(of).alias(f"{p}_n_{side}"), zero(_of(of, F.col("price") * size)).alias(f"_{p}_pv_{side}")]
    c = lambda p, n: F.col(f"{p}_{n}")
    both = {p: c(p, "vol_up") + c(p, "vol_down") for p in PHASES}
    packed = t.groupBy("market_id").agg(*sums).withColumns({
        k: v for p in PHASES for k, v in {
            f"{p}_total_vol": both[p], f"{p}_n_ticks": c(p, "n_up") + c(p, "n_down"), f"{p}_up_ratio": c(p, "vol_up") / (both[p] + eps),
            **{f"{p}_vwap_{s}": F.col(f"_{p}_pv_{s}") / (c(p, f"vol_{s}") + eps) for s in ("up", "down")},
        }.items()
    })
    n = sum((c(p, "n_ticks") for p in PHASES[1:]), c(PHASES[0], "n_ticks"))
    return packed.select(
        "market_id", *(c(p, f) for p in PHASES for f in PHASE_FIELDS), n.alias("total_temporal_n_ticks"),
        (c("early", "up_ratio") / (c("late", "up_ratio") + eps)).alias("momentum_vol_ratio"), (c("late", "n_ticks") / (n + eps)).alias("late_surge"),
        (c("early", "up_ratio") - c("mid", "up_ratio")).alias("early_mid_vol_diff"), (c("mid", "up_ratio") - c("late", "up_ratio")).alias("mid_late_vol_diff"),
        (c("late", "total_vol") / (c("early", "total_vol") + eps)).alias("vol_trend"),
    )


def documented_features(ticks: DataFrame, obs: float, windows: int = 6) -> DataFrame:
    """Features that only the documents of the domain describe: accelerations of volume and of ticks, and momentum
    weighted by the volume of the sub-windows. 1 and 0 where there is nothing to compare with."""
    up, size, t = F.col("outcome") == "Up", F.col("size_usdc"), F.col("t_sec")
    index, half = F.floor(t / (obs / windows)), windows // 2
    g = ticks.where((t >= 0) & (t < obs)).groupBy("slot_ts").agg(
        *(c for k in range(windows) for c in (F.coalesce(_of(index == k, size), F.lit(0.0)).alias(f"v{k}"), F.coalesce(_of((index == k) & up, size), F.lit(0.0)).alias(f"u{k}"))),
        F.count_if(index == 0).alias("first"), F.count_if(index == windows - 1).alias("last"),
    )
    v = [F.col(f"v{k}") for k in range(windows)]
    w = [F.when(v[k] > 0, F.col(f"u{k}") / v[k]).otherwise(0.5) for k in range(windows)]
    add = lambda cols: sum(cols[1:], cols[0])
    accel = F.when(add(v[:half]) > 0, add(v[half:]) / add(v[:half])).otherwise(1.0)
    momentum = add(w[half:]) / (windows - half) - add(w[:half]) / half
    return g.select(
        "slot_ts", accel.alias("vol_accel"), F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.col("first")).otherwise(0.0).alias("tick_accel"),
        F.when(add(v) > 0, add([v[k] / add(v) * (w[k] - 0.5) for k in range(windows)])).otherwise(0.0).alias("vwmom"), (momentum * accel).alias("momentum_vol_sync"),
    )


def serving_pack(ticks: DataFrame) -> DataFrame:
    """Prices at index round_half_even(q * (n - 1)) of a market's ordered trades, and population deviations.

    The index is compared with a rank inside the market, so that no row holds a market's trades."""
    rank = F.row_number().over(Window.partitionBy("market_id").orderBy("t_sec", "event_id")) - 1
    base = ticks.groupBy("market_id").agg(F.count("*").alias("n"), F.avg("price").alias("price_mean"), F.stddev_pop("price").alias("price_std"), F.sum("size_usdc").alias("volume"))
    ranked = ticks.select("market_id", "price", rank.alias("_r")).join(base.select("market_id", "n"), "market_id")
    at = lambda q: F.max(F.when(F.col("_r") == F.bround(F.lit(q) * (F.col("n") - 1), 0), F.col("price"))).alias(f"price_i{int(q * 100)}")
    prices = ranked.groupBy("market_id").agg(*map(at, (0.0, 0.25, 0.5, 0.75, 1.0)))
    return base.join(prices, "market_id").select("market_id", "n", *prices.columns[1:], "price_mean", "price_std", "volume")


#: What a market without trades gets in the serving row; all other columns but the calendar are null.
UNTRADED = {n: 0.0 for n in ("n_ticks", "n_trades", "n_buy_trades", "n_sell_trades", "avg_trade_size", "buy_sell_imbalance", "total_volume_usdc", "buy_volume_usdc", "sell_volume_usdc", "up_volume_usdc", "down_volume_usdc")} | {"up_down_volume_ratio": 0.5}


def serving_row(ticks: DataFrame, slots: DataFrame, candles: DataFrame, slot_seconds: int, after: int = 60) -> DataFrame:
    """All 33 serving columns of each market: the price series (Up trades, or all where none is Up), volumes, VWAPs,
    spot of the candles that open between the first trade and ``after`` seconds past the last, and the calendar of the
    slot's start. Other sides than BUY and SELL count as trades only. Rank and aggregates share one shuffle.
    """
    up, down = F.lower("outcome").isin("yes", "up", "0"), F.lower("outcome").isin("no", "down", "1")
    size, side = F.coalesce("size_usdc", F.lit(0.0)), F.upper("side")
    series = Window.partitionBy("slot_ts", "_up")
    order = ("t_sec", "event_id")
    t = ticks.withColumn("_up", F.coalesce(up, F.lit(False))).withColumns({"_r": F.row_number().over(series.orderBy(*order)) - 1, "_n": F.count("*").over(series)})
    at = lambda q: F.max(F.when(F.col("_r") == F.bround(F.lit(q) * (F.col("_n") - 1), 0), F.col("price")))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    halves = t.groupBy("slot_ts", "_up").agg(
        F.struct(
            at(0.0).alias("first_price"), at(1.0).alias("last_price"), F.avg("price").alias("price_mean"), F.stddev_pop("price").alias("price_std"), F.min("price").alias("price_min"), F.max("price").alias("price_max"),
            F.count("*").cast("double").alias("n_ticks"), *(at(q).alias(f"price_at_{int(q * 100)}pct") for q in (0.25, 0.5, 0.75)),
        ).alias("s"),
        F.count("*").alias("n"), F.count_if(side == "BUY").alias("nb"), F.count_if(side == "SELL").alias("ns"), none(_of(side == "BUY", size)).alias("b"), none(_of(side == "SELL", size)).alias("l"),
        none(_of(up, size)).alias("u"), none(_of(down, size)).alias("d"), none(_of(up, F.col("price") * size)).alias("pu"), none(_of(down, F.col("price") * size)).alias("pd"), F.min("timestamp_ms").alias("t0"), F.max("timestamp_ms").alias("t1"),
    )
    g = halves.groupBy("slot_ts").agg(F.max_by("s", "_up").alias("s"), *(F.sum(c).alias(c) for c in ("n", "nb", "ns", "b", "l", "u", "d", "pu", "pd")), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    place = lambda ts: F.floor(ts / slot_seconds) * slot_seconds
    bars = candles.select("ts", "open", "close", F.explode(F.array_distinct(F.array(place(F.col("ts")), place(F.col("ts") - after)))).alias("slot_ts"))
    inside = bars.join(g.where("t0 > 0").select("slot_ts", "t0", "t1"), "slot_ts").where((F.col("ts") * 1000 >= F.col("t0")) & (F.col("ts") * 1000 <= F.col("t1") + after * 1000))
    start, end = F.min_by("open", "ts"), F.max_by("close", "ts")
    spot = inside.groupBy("slot_ts").agg(
        start.alias("spot_price_start"), end.alias("spot_price_end"), F.when(start != 0, (end - start) / start).alias("spot_return"), F.avg("close").alias("spot_price_mean"), F.stddev_pop("close").alias("_vol")
    )
    both = F.col("b") + F.col("l")
    traded = g.select(
        "slot_ts", "s.*", both.alias("total_volume_usdc"), F.col("b").alias("buy_volume_usdc"), F.col("l").alias("sell_volume_usdc"), F.when(both > 0, (F.col("b") - F.col("l")) / both).otherwise(0.0).alias("buy_sell_imbalance"),
        F.col("u").alias("up_volume_usdc"), F.col("d").alias("down_volume_usdc"), F.when(F.col("u") + F.col("d") > 0, F.col("u") / (F.col("u") + F.col("d"))).otherwise(0.5).alias("up_down_volume_ratio"),
        *(F.col(c).cast("double").alias(f"n_{name}trades") for c, name in (("n", ""), ("nb", "buy_"), ("ns", "sell_"))), (both / F.col("n")).alias("avg_trade_size"),
        F.when(F.col("u") > 0, F.col("pu") / F.col("u")).alias("vwap_up"), F.when(F.col("d") > 0, F.col("pd") / F.col("d")).alias("vwap_down"),
    )
    traded = traded.withColumn("price_momentum", F.col("last_price") - F.col("first_price"))
    whole = slots.select("slot_ts").join(traded, "slot_ts", "left").join(spot, "slot_ts", "left")
    whole = whole.withColumn("spot_volatility", F.when(F.col("n_trades") > 0, F.coalesce("_vol", F.lit(0.0)))).drop("_vol").fillna(UNTRADED)
    hour, day = F.floor(F.pmod("slot_ts", F.lit(86_400)) / 60) / 60.0, F.pmod(F.floor(F.col("slot_ts") / 86_400) + 3, F.lit(7))
    return whole.select("*", *cyclical(hour, 24, "hour_of_day"), *cyclical(day, 7, "day_of_week"))


def slot_floor(ts: Column, slot_seconds: int = 300) -> Column:
    """The slot that an epoch second falls into."""
    return (F.floor(ts / slot_seconds) * slot_seconds).cast("long")


def entry_window(t_sec: Column, low: float = 170, high: float = 240) -> Column:
    """Whether orders may be placed this long after the slot's start, both ends included."""
    return t_sec.between(low, high)


def scan_pack(ticks: DataFrame, first: float | None = None, second: float | None = None, end: float | None = None) -> DataFrame:
    """Linear value percentiles of price and up/(down+eps), sells being all that isn't BUY; with bounds of the phases also
    what each phase of the live form (closed on the left, up to ``end``) has of volume, trades and up/(down+eps)."""
    up, size = F.col("outcome") == "Up", F.col("size_usdc")
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    packed = ticks.groupBy("market_id").agg(q.alias("_q"), F.coalesce(_of(up, size), F.lit(0.0)).alias("_u"), F.coalesce(_of(~up, size), F.lit(0.0)).alias("_d"), F.count_if(F.col("side") != "BUY").alias("n_sells"), *_scan_phases(first, second, end))
    phased = [c for p in PHASES for c in ((F.col(f"_{p}_u") + F.col(f"_{p}_d")).alias(f"{p}_vol"), F.col(f"_{p}_n").alias(f"{p}_n_ticks"), (F.col(f"_{p}_u") / (F.col(f"_{p}_d") + 1e-8)).alias(f"{p}_up_down_ratio"))] if first is not None else []
    return packed.select("market_id", *(F.col("_q")[k].alias(f"price_p{p}") for k, p in enumerate((25, 50, 75))), (F.col("_u") / (F.col("_d") + 1e-8)).alias("up_down_ratio"), "n_sells", *phased)


def _scan_phases(first: float | None, second: float | None, end: float | None) -> list[Column]:
    if first is None:
        return []
    phase, up, size = phase_of(F.col("t_sec"), first, second, end, left_closed=True), F.col("outcome") == "Up", F.col("size_usdc")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [c for p in PHASES for c in (zero(_of((phase == p) & up, size)).alias(f"_{p}_u"), zero(_of((phase == p) & ~up, size)).alias(f"_{p}_d"), F.count_if(phase == p).alias(f"_{p}_n"))]
