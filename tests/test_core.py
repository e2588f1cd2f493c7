"""Hand-made cases of the operators: empty, one-sided, boundary, latch, leak."""

import math

import pytest
from pyspark.sql import functions as F

from slotforge.functions import features
from slotforge.operators import book, decisions, evaluate, flow, gates, ledger, ordering, timejoins
from slotforge.sources import landed
from slotforge.storage import new_path

TICK = "slot_ts long, timestamp_ms long, t_sec double, outcome string, side string, price double, size_usdc double, event_id long"


def ticks(spark, rows):
    return spark.createDataFrame([(0, 1, float(t), o, s, p, float(z), k) for k, (t, o, s, p, z) in enumerate(rows)], TICK)


def one(spark, rows, obs=180):
    slots = spark.createDataFrame([(0, 1)], "slot_ts long, target int")
    return flow.slot_flow(ticks(spark, rows), slots, obs).first()


def test_all_up(spark):
    r = one(spark, [(k * 6, "Up", "BUY", 0.6, 10) for k in range(30)])
    assert r.up_ratio == 1 and r.vwap_up == pytest.approx(0.6) and r.vwap_dn == 0.5 and r.buy_ratio == 1 and r.momentum == 0 and r.stability == 0


def test_down_only_is_zero(spark):
    r = one(spark, [(5, "Down", "SELL", 0.4, 10)])
    assert r.up_ratio == 0 and r.decayed_up_ratio == 0 and r.vwap_dn == pytest.approx(0.4)


def test_no_ticks_is_neutral(spark):
    r = one(spark, [])
    assert (r.up_ratio, r.vwap_up, r.n_ticks, r.up_w0, r.momentum) == (0.5, 0.5, 0, 0, 0)


def test_six_windows(spark):
    r = one(spark, [(k * 30 + 1, "Up" if k < 3 else "Down", "BUY", 0.5, 10) for k in range(6)])
    assert [r[f"up_w{k}"] for k in range(6)] == [1, 1, 1, 0, 0, 0] and r.momentum == -1


def test_rows_after_the_window_change_nothing(spark):
    rows = [(k * 10, "Up" if k % 2 else "Down", "BUY", 0.5, 5 + k) for k in range(18)]
    assert one(spark, rows) == one(spark, [*rows, (180, "Up", "BUY", 0.9, 999), (-1, "Up", "BUY", 0.9, 999)])


def ranked(spark, rows, schema):
    return ordering.global_rank(spark.createDataFrame(rows, schema), "slot_ts")


def test_global_rank(spark):
    r = ranked(spark, [((k * 7919) % 1000,) for k in range(1000)], "slot_ts long").collect()
    assert all(x.rank == x.slot_ts for x in r)


def test_lags_across_blocks_and_gaps(spark):
    rows = [(k * 300 + (100_000 if k > 6 else 0), k % 2, float(k), 1, 1.0) for k in range(12)]
    r = ranked(spark, rows, "slot_ts long, target int, up_ratio double, n_ticks int, vol_tot double")
    small = ordering.blocks(r, 5, size=4)
    assert small.where("_halo").count() > 0
    out = {x.rank: x for x in ordering.lag_features(r, 300).collect()}
    assert out[0].lag1_up_ratio == 0 and out[3].lag2_up_ratio == 1.0
    assert out[7].lag1_up_ratio == 0.5 and out[7].lag_streak == 0  # the gap makes it stale
    assert out[5].lag_streak == 3 and out[5].true_streak == 1  # matches, not a run


def test_running_and_peak(spark):
    r = ranked(spark, [(k, float(v)) for k, v in enumerate([1, -3, 2, 5, -1])], "slot_ts long, pnl_share double")
    e = decisions.equity(r).orderBy("rank").collect()
    assert [x.cum_pnl for x in e] == [1, -2, 0, 5, 4] and [x.peak for x in e] == [1, 1, 1, 5, 5]
    assert decisions.risk(decisions.equity(r)).first().max_drawdown == 3


def test_as_of_and_gap(spark):
    c = spark.createDataFrame([(0, 1.0), (60, 2.0), (300, 5.0)], "ts long, close double")
    p = spark.createDataFrame([(-10,), (0,), (59,), (61,), (299,), (300,), (9999,)], "t long")
    got = {r.t: r.px for r in timejoins.as_of(p, F.col("t"), c, 60, "px").collect()}
    assert got == {-10: 1.0, 0: 1.0, 59: 1.0, 61: 2.0, 299: 2.0, 300: 5.0, 9999: 5.0}
    known = {r.t: r.px for r in timejoins.as_of(p, F.col("t"), c, 60, "px", close_known=True).collect()}
    assert known[61] == 1.0 and known[120 - 59] == 1.0


def test_one_sided_book(spark):
    level = "array<struct<price:double,size:double>>"
    b = spark.createDataFrame([([], [(0.5, 1.0)]), ([(0.6, 2.0), (0.97, 1.0)], [(0.4, 2.0)])], f"asks {level}, bids {level}")
    r = b.select(*book.snapshot_metrics(), book.best_ask(F.col("asks"), 0.6).alias("below")).collect()
    assert r[0].mid is None and r[1].mid == pytest.approx(0.5) and r[1].imbalance == pytest.approx(0) and r[1].below is None


def test_microstructure_of_one_time(spark):
    e = spark.createDataFrame([("a", 1.0, k, 0.5, 0.02, 0.51, 0.1, 10.0) for k in range(3)], "k string, t double, id int, mid double, spread double, sell_price double, imbalance double, depth double")
    r = book.microstructure(e, "k", 60.0, least_events=3).first()
    assert r.mid_velocity == 0 and r.ask_pressure == 0 and r.activity_rate == pytest.approx(0.05)
    assert book.microstructure(e, "k", 60.0).first().activity_rate == 0  # fewer than five events


def test_gates(spark):
    g = spark.createDataFrame([(50, 2, 300, 10), (49, 1, None, 3)], "n_ticks int, n_windows int, feed_age int, n_bars int").select(gates.completeness().alias("g")).collect()
    assert g[0].g == "" and g[1].g == "few_ticks; no_feed; few_bars; empty_windows"
    v = spark.createDataFrame([(0.5, 0.01), (1.5, math.nan), (None, 0.06)], "up_ratio double, ret_1h double").select(gates.violations(["up_ratio", "ret_1h"]).alias("v")).collect()
    assert [r.v for r in v] == [[], ["up_ratio", "ret_1h"], ["up_ratio", "ret_1h"]]


def test_latch_stays(spark):
    wins = [True] * 5 + [False] * 15 + [True] * 40
    r = ranked(spark, [(k, w) for k, w in enumerate(wins)], "slot_ts long, won boolean")
    out = {x.rank: x for x in gates.win_rate_latch(r).collect()}
    assert not out[18].paused and out[19].paused and out[59].paused and out[59].win_rate == 1


def test_position_size(spark):
    rows = spark.createDataFrame([(20.0, 0.5), (700.0, 0.5), (0.0, 0.5), (-5.0, 0.5), (360.0, 0.5), (100.0, 0.0)], "b double, a double")
    assert [r.s for r in rows.select(decisions.position_size(F.col("b"), F.col("a")).alias("s")).collect()] == [5, 40, 5, 5, 22, 9]


def test_half_is_zero_for_accuracy(spark):
    m = spark.createDataFrame([(0.5, 1, 0), (0.5, 0, 0), (0.9, 1, 0)], "p double, target int, fold int")
    r = evaluate.metrics(m).first()
    assert r.accuracy == pytest.approx(2 / 3) and r.auc == pytest.approx(0.75)


def test_walk_forward_gap(spark):
    r = ranked(spark, [(k,) for k in range(60)], "slot_ts long")
    f = evaluate.walk_forward(r, 60, folds=5, gap=5).groupBy("fold", "role").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).collect()
    got = {(x.fold, x.role): (x.a, x.b) for x in f}
    assert got[0, "test"] == (10, 19) and got[0, "train"] == (0, 4) and got[4, "test"] == (50, 59) and got[4, "train"] == (0, 44)


def test_promotion():
    a = {"auc": 0.9, "brier": 0.13, "accuracy": 0.81, "n_features": 30}
    assert evaluate.promotion(a, a | {"auc": 0.91, "brier": 0.12}) and not evaluate.promotion(a, a | {"auc": 0.91})
    assert evaluate.promotion(a, a | {"n_features": 25})


def test_directional_probe(spark):
    rows = [(float(k % 100) / 100, int(k % 100 > 50)) for k in range(400)]
    model = evaluate.logistic(["up_ratio"]).fit(spark.createDataFrame(rows, "up_ratio double, target int"))
    p = [r.p for r in evaluate.predict(model, spark.createDataFrame([(0.1, 0), (0.5, 0), (0.9, 0)], "up_ratio double, target int")).collect()]
    assert p[0] < p[1] < p[2] and p[2] > 0.4


def test_settlement_waits(spark):
    led = spark.createDataFrame([(0, "UP", 10.0, 5.0, "open", None, None), (600, "UP", 10.0, 5.0, "open", None, None)], "slot_ts long, direction string, shares double, actual_cost double, status string, pnl_usdc double, result string")
    res = spark.createDataFrame([(0, 1), (600, 0)], "slot_ts long, target int")
    r = {x.slot_ts: x for x in ledger.settle(led, res, 700, 300, 60).collect()}
    assert r[0].status == "settled" and r[0].pnl_usdc == pytest.approx(4.8) and r[600].status == "open"


def test_names_and_defaults(spark):
    assert features.neutral_value("ob_depth_ratio") == 0 and features.neutral_value("ob_spread") == 0.02 and features.neutral_value("ob_mid_drift") == 0
    assert features.serving_default("ob_depth_ratio") == 1 and features.serving_default("anything") == 0
    assert features.prefixed(spark.range(1).selectExpr("1 AS mid", "2 AS clob_x"), ["mid", "clob_x"]).columns == ["ob_mid", "clob_x"]


def test_epoch_units(spark):
    got = spark.createDataFrame([("1704067200",), ("1704067200000",), ("x",), (None,)], "t string").select(features.epoch_seconds(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [1704067200, 1704067200, 0, 0]


def test_outcome_zero_is_kept(spark):
    got = spark.createDataFrame([("0",), ("NO",), ("maybe",), (None,)], "o string").select(landed.normal_outcome(F.col("o")).alias("n")).collect()
    assert [r.n for r in got] == ["Up", "Down", None, None]


def test_compaction(spark):
    a, b = new_path(spark, "many"), new_path(spark, "few")
    spark.range(100).repartition(8).write.parquet(a)
    landed.compact(spark, a, b, 2)
    assert spark.read.parquet(b).count() == 100 and spark.read.parquet(b).rdd.getNumPartitions() <= 2


LEVEL = "array<struct<price:double,size:double>>"


def test_snapshot_by_hand(spark):
    """mid 0.5; of the bids 10 of 40 lie within 5 cents, of the asks 30 of 40."""
    b = spark.createDataFrame([([(0.51, 30.0), (0.61, 10.0)], [(0.49, 10.0), (0.39, 30.0)])], f"asks {LEVEL}, bids {LEVEL}")
    r = b.select(*book.snapshot_metrics()).first()
    near, far = math.exp(-0.1), math.exp(-1.1)
    assert (r.mid, r.spread, r.imbalance) == pytest.approx((0.5, 0.02, -0.5)) and (r.bid_depth_5c, r.ask_depth_5c, r.depth_ratio, r.total_depth) == pytest.approx((0.25, 0.75, 1 / 3, 80))
    assert r.weighted_imb == pytest.approx((10 * near + 30 * far - 30 * near - 10 * far) / (40 * near + 40 * far))


def test_open_close_by_hand(spark):
    names = "m string, t double, id int, mid double, spread double, imbalance double, bid_depth_5c double, ask_depth_5c double, depth_ratio double, total_depth double, weighted_imb double"
    row = lambda m, t, k, mid, imb, depth: (m, float(t), k, mid, 0.02, imb, 0.5, 0.5, 1.0, depth, 0.0)
    rows = [row("a", 5, 1, 0.5, 0.1, 100.0), row("a", 59, 2, 0.5, 0.3, 100.0), row("a", 60, 3, 0.5, 0.5, 100.0), row("a", 155, 4, 0.6, -0.2, 150.0), row("a", 168, 5, 0.9, 0.9, 900.0), row("b", 40, 6, 0.4, 0.2, 70.0)]
    got = {r.m: r for r in book.open_close(spark.createDataFrame(rows, names), "m").collect()}
    a, b = got["a"], got["b"]
    assert (a.mid, a.mid_drift, a.depth_change, a.imb_momentum, a.imbalance_end) == pytest.approx((0.6, 0.1, 50, -0.3, -0.2)) and (a.imb_w0, a.imb_w1, a.imb_w2) == pytest.approx((0.2, 0.5, -0.2))
    assert (b.mid, b.mid_drift, b.depth_change, b.imb_momentum, b.imbalance_end, b.imb_w1) == pytest.approx((0.4, 0, 0, 0, 0.2, 0))


def test_price_changes_by_hand(spark):
    rows = [("a", 1.0, 1, 0.5, "BUY", 10.0), ("a", 2.0, 2, None, "sell", 4.0), ("a", 3.0, 3, 0.6, None, 50.0), ("a", 4.0, 4, 0.6, "SELL", 2.0), ("a", 5.0, 5, 0.4, "odd", 9.0), ("b", 1.0, 6, 0.5, "BUY", 1.0), ("b", 2.0, 7, 0.5, "BUY", 1.0)]
    got = {r.k: r for r in book.price_changes(spark.createDataFrame(rows, "k string, t double, id int, price double, side string, size double"), "k").collect()}
    a, b = got["a"], got["b"]  # moves of a: +0.1, 0, -0.2
    assert (a.pc_up_ratio, a.pc_count, a.fill_imbalance) == pytest.approx((0.5, 2, 0.25)) and a.pc_volatility == pytest.approx(math.sqrt(((0.1 + 1 / 30) ** 2 + (1 / 30) ** 2 + (0.2 - 1 / 30) ** 2) / 3))
    assert (b.pc_up_ratio, b.pc_count, b.pc_volatility, b.fill_imbalance) == pytest.approx((0, 0, 0, 1))


def test_microstructure_by_hand(spark):
    """Three books and three price changes; one change has no valid prices, sells go 0.6, 0.5, 0.55."""
    rows = [("a", 0.0, 1, 0.50, 0.02, None, 0.2, 100.0), ("a", 10.0, 2, 0.52, 0.04, 0.6, None, None), ("a", 20.0, 3, None, None, 0.5, None, None), ("a", 30.0, 4, 0.56, 0.08, 0.55, None, None), ("a", 40.0, 5, 0.58, 0.10, None, -0.4, 180.0)]
    r = book.microstructure(spark.createDataFrame(rows, "k string, t double, id int, mid double, spread double, sell_price double, imbalance double, depth double"), "k", 60.0).first()
    assert (r.imb_mean, r.imb_std, r.imb_drift) == pytest.approx((-0.1, 0.3, -0.6)) and (r.mid_velocity, r.spread_trend, r.depth_trend) == pytest.approx((0.002, 0.002, 2.0))
    assert r.spread_mean == pytest.approx(0.06) and r.activity_rate == pytest.approx(5 / 60) and r.ask_pressure == 0.5 and r.mid_volatility == pytest.approx(math.sqrt(2 / 9) * 0.02)


def test_phases_by_hand(spark):
    t = spark.createDataFrame([("m", 90.0, "Up", "BUY", 0.6, 30.0), ("m", 91.0, "Down", "BUY", 0.4, 20.0), ("m", 200.0, "Up", "BUY", 0.5, 60.0), ("m", 300.0, "Down", "SELL", 0.2, 45.0), ("m", 301.0, "Up", "SELL", 0.8, 15.0)], "market_id string, t_sec double, outcome string, side string, price double, size_usdc double")
    r = flow.phase_pack(t, 90, 210).first()
    assert (r.early_up_ratio, r.mid_up_ratio, r.late_up_ratio) == pytest.approx((1, 0.75, 0.25)) and (r.early_n_ticks, r.mid_n_up, r.late_n_down, r.total_temporal_n_ticks) == (1, 1, 1, 5)
    assert (r.momentum_vol_ratio, r.late_surge, r.early_mid_vol_diff, r.mid_late_vol_diff, r.vol_trend) == pytest.approx((4, 0.4, 0.25, 0.5, 2)) and (r.mid_vwap_down, r.late_vwap_up) == pytest.approx((0.4, 0.8))


def test_documented_features_by_hand(spark):
    rows = [(5, "Up", "BUY", 0.5, 10), (35, "Down", "BUY", 0.5, 10), (160, "Up", "BUY", 0.5, 30), (170, "Down", "BUY", 0.5, 10)]
    r = flow.documented_features(ticks(spark, rows), 180).first()
    assert (r.vol_accel, r.tick_accel) == pytest.approx((2, 1)) and r.vwmom == pytest.approx((10 * 0.5 - 10 * 0.5 + 40 * 0.25) / 60)
    assert r.momentum_vol_sync == pytest.approx(2 * ((0.5 + 0.5 + 0.75) / 3 - (1 + 0 + 0.5) / 3))


def test_lagged_score_ignores_the_current_slot(spark):
    ups = [0.2, 0.4, 0.6, 0.9]
    rows = [(k * 300, u, 1, 0.5) for k, u in enumerate(ups)]
    schema = "slot_ts long, up_ratio double, n_ticks int, up_w5 double"
    score = lambda rs: {x.rank: x for x in ordering.zscores(ranked(spark, rs, schema), "up_ratio", F.col("n_ticks") > 0, 300, late="up_w5").collect()}
    a, b = score(rows)[3], score([*rows[:3], (900, 0.1, 1, 0.5)])[3]
    std = math.sqrt(0.08 / 3)
    assert a.lag_ur_z20 == b.lag_ur_z20 == pytest.approx(0.2 / std) and a.up_ratio_z20 == pytest.approx(0.5 / (std + 1e-6)) and a.up_w5_z20 == pytest.approx(0.1 / (std + 1e-6))


def test_ratio_of_changes(spark):
    rows = spark.createDataFrame([(105.0, 104.0, 100.0), (105.0, 104.0, 104.5), (105.0, 0.0, 100.0)], "a double, b double, c double")
    assert [r.x for r in rows.select(timejoins.guarded_ratio(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == pytest.approx([0.2, 0, 0])


def test_book_names_and_markets(spark):
    assert features.neutral_value("ob_total_depth") == 0 and features.neutral_value("ob_bid_depth_5c") == 0.5 and features.neutral_value("ob_mid") == 0.5
    assert features.serving_default("ob_spread_end") == 0 and features.serving_default("ob_total_depth") == 1000 and features.serving_default("clob_mid_velocity") == 0
    assert gates.range_of("volume_ratio") == gates.WIDEST and gates.range_of("up_w3").high < 1.01 and gates.range_of("up_ratio_z5").high == 5
    rows = [("Bitcoin Up or Down - May 1", "", 2), ("Price of gold", "gold", 2), ("?", "x-btc-updown-5m-1", 2), ("BTC up or down", "", 3), (None, None, 2)]
    got = spark.createDataFrame(rows, "q string, s string, n int").select(landed.is_short_market(F.col("q"), F.col("s"), F.array_repeat(F.lit("o"), F.col("n"))).alias("x")).collect()
    assert [r.x for r in got] == [True, False, True, False, False]


def test_running_totals_over_runs_of_blocks(spark):
    r = ranked(spark, [(k,) for k in range(40)], "slot_ts long")
    out = ordering.running_max(ordering.running(r, {"total": F.col("rank").cast("double")}, size=3), "slot_ts", "top", size=3).orderBy("rank").collect()
    assert [x.total for x in out] == [k * (k + 1) / 2 for k in range(40)] and [x.top for x in out] == list(range(40))


def test_auc_over_ranges(spark):
    rows = [((k * 37 % 101) / 101, int((k * 53) % 7 < 3), k % 2) for k in range(300)]
    got = {r.g: r.auc for r in evaluate.auc(spark.createDataFrame(rows, "p double, y int, g int"), "p", "y", "g").collect()}
    for g in (0, 1):
        pos, neg = ([p for p, y, h in rows if h == g and y == want] for want in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def test_serving_row_of_traded_and_untraded_markets(spark):
    t = ticks(spark, [(10, "Down", "SELL", 0.2, 5), (20, "Up", "BUY", 0.5, 10), (30, "Up", "SELL", 0.6, 10), (40, "Up", "BUY", 0.8, 20)]).withColumn("timestamp_ms", (F.col("t_sec") * 1000 + 1).cast("long"))
    slots = spark.createDataFrame([(0,), (300,)], "slot_ts long")
    bars = spark.createDataFrame([(0, 9.0, 9.0), (60, 100.0, 110.0), (100, 105.0, 120.0), (120, 1.0, 1.0)], "ts long, open double, close double")
    a, b = flow.serving_row(t, slots, bars, 300).orderBy("slot_ts").collect()
    assert (a.first_price, a.last_price, a.n_ticks, a.n_trades, a.price_at_25pct, a.price_at_50pct) == (0.5, 0.8, 3, 4, 0.5, 0.6)
    assert a.price_momentum == pytest.approx(0.3) and a.buy_sell_imbalance == pytest.approx(15 / 45) and a.up_down_volume_ratio == pytest.approx(40 / 45)
    assert a.vwap_up == pytest.approx((5 + 6 + 16) / 40) and a.vwap_down == pytest.approx(0.2) and a.avg_trade_size == 45 / 4
    assert (a.spot_price_start, a.spot_price_end, a.spot_price_mean, a.spot_volatility) == (100, 120, 115, 5) and a.spot_return == pytest.approx(0.2)
    assert (b.n_trades, b.n_ticks, b.up_down_volume_ratio, b.first_price, b.vwap_up, b.spot_volatility) == (0, 0, 0.5, None, None, None)
    assert b.hour_of_day_cos == pytest.approx(math.cos(2 * math.pi * (5 / 60) / 24))


def test_serving_row_takes_all_trades_without_an_up_trade(spark):
    t = ticks(spark, [(10, "Down", "SELL", 0.2, 5), (20, "Down", "SELL", 0.4, 5)])
    r = flow.serving_row(t, spark.createDataFrame([(0,)], "slot_ts long"), spark.createDataFrame([], "ts long, open double, close double"), 300).first()
    assert (r.first_price, r.last_price, r.n_ticks, r.vwap_up, r.spot_return, r.spot_volatility) == (0.2, 0.4, 2, None, None, 0)


def test_entry_window_and_price(spark):
    r = spark.range(1).select(*(flow.entry_window(F.lit(t)).alias(f"t{t}") for t in (169, 170, 240, 241)), flow.slot_floor(F.lit(899)).alias("slot"),
                              decisions.entry_price(F.lit(0.9), F.lit(0.2), F.lit("UP")).alias("up"), decisions.entry_price(F.lit(0.6), F.lit(0.1), F.lit("DOWN")).alias("down")).first()
    assert (r.t169, r.t170, r.t240, r.t241, r.slot) == (False, True, True, False, 600) and r.up == 0.95 and r.down == pytest.approx(0.3)


def test_overfit_checks(spark):
    schema = "adversarial_auc double, noise_rank double, auc_drop double, fold_std double, n_trades long, pnl double"
    verdicts = lambda *row: [r.verdict for r in evaluate.overfit_checks(spark.createDataFrame([row], schema), 4).collect()]
    assert verdicts(0.65, 5.0, 0.03, 0.05, 3, 1.0) == ["PASS"] * 5
    assert verdicts(0.66, 4.0, 0.04, 0.06, 3, 0.0) == ["WARN", "FAIL", "WARN", "WARN", "FAIL"]
    assert verdicts(None, None, None, None, 0, None) == ["SKIP"] * 5


def test_directional_probes_see_an_inverted_model(spark):
    rows = spark.createDataFrame([(k / 100, int(k >= 50)) for k in range(100)], "up_ratio double, target int")
    probe = lambda d: {r.probe: (r.p, r.passes) for r in evaluate.directional_probes(spark, evaluate.logistic(["up_ratio"]).fit(d), ["up_ratio"], {"up_ratio": 0.5}, {"up_ratio": 0.75}, {"up_ratio": 0.25}).collect()}
    good, bad = probe(rows), probe(rows.withColumn("target", 1 - F.col("target")))
    assert good["up"][0] > good["neutral"][0] > good["down"][0] and good["up"][1] and not bad["up"][1]


def test_live_lags_before_the_first_slot(spark):
    r = spark.createDataFrame([(0, 0, 1, 0.9, 7, 3.0), (1, 300, 0, 0.4, 5, 2.0)], "rank long, slot_ts long, target int, up_ratio double, n_ticks long, vol_tot double")
    first, second = ordering.lag_features(r, 300, lags=2, unknown=ordering.LAGS).orderBy("rank").collect()
    assert (first.lag1_up_ratio, first.lag1_n_ticks, second.lag1_up_ratio, second.lag2_up_ratio) == (0.5, 0, 0.9, 0.5)


def test_ranked_list():
    assert len(features.RANKED) == 30 and len(features.PRUNED) == 10 and not {n for n, _ in features.RANKED} & features.PRUNED.keys()
    assert [features.column_of(n) for n in ("btc_up_w1", "prev_slot_up_ratio_2", "ob_mid", "btc_pre_30m_ret")] == ["up_w1", "lag2_up_ratio", "ob_mid", "ret_3h"]


def test_event_rate_by_plain_code(spark):
    rows = [(k % 3, k * k * 7919 % 5_000 - 1_000) for k in range(300)] + [(3, 50), (3, 50), (4, 9), (5, None), (5, None), (5, 7), (6, 0), (6, 100), (6, 201), (None, 1), (None, 1)]
    got = {r.m: tuple(r)[1:] for r in ordering.event_rate(spark.createDataFrame(rows, "m int, at long"), "m", "at", 100, 0.05).collect()}
    for m in {m for m, _ in rows}:
        at = sorted(t for k, t in rows if k == m and t is not None)
        gaps = [(b - a) / 1000 for a, b in zip(at, at[1:], strict=False)]
        peak = max([sum(t - 100 <= x <= t for x in at) for t in at] + [sum(k == m and t is None for k, t in rows)])
        assert got[m] == (peak, max(gaps, default=None), sum(g > 0.05 for g in gaps)), m


def test_event_rate_has_no_group_that_grows_with_a_key(spark):
    """Half a million rows of one market in 1,000 milliseconds: no partition of a sliding frame holds them."""
    df = spark.range(500_000).selectExpr("1 AS m", "id % 1000 AS at")
    out = ordering.event_rate(df, "m", "at", 500, 0.05)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan
    assert tuple(out.first()) == (1, 501 * 500, 0.001, 0)
