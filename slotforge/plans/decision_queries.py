"""Decisions, profit and loss, ledgers, splits, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge import fixtures as X
from slotforge.functions import features
from slotforge.operators import decisions, evaluate, ledger, ordering
from slotforge.plans.book_queries import BOOK_SET, MARKET_OF_SLOT, slot_books
from slotforge.plans.flow_queries import FLOW, FLOW_DOUBLES, flow_cte, slot_flow
from slotforge.plans.gate_queries import PREDICTION, predictions
from slotforge.plans.registry import query, rounded, share

LIMITS = decisions.Limits(confidence=0.52, ask_low=0.3, ask_high=0.9, edge_ask=0.01, edge_mid=0.02)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("slot_ts", "target", F.round("up_ratio", 9).alias("up_ratio"), F.round("p", 9).alias("p"))
    d = decisions.decide(p, LIMITS)
    return d.select("*", *decisions.pnl(LIMITS))


_SKIP = f"""CASE WHEN confidence < {LIMITS.confidence} THEN 'low_conf' WHEN NOT ask BETWEEN {LIMITS.ask_low} AND {LIMITS.ask_high} THEN 'ask_range' WHEN confidence - ask < {LIMITS.edge_ask} THEN 'low_edge_ask'
    WHEN confidence - mid < {LIMITS.edge_mid} THEN 'low_edge_mid' WHEN abs(ask - mid) > {LIMITS.diverge} THEN 'ask_mid_diverge' END"""
DECIDED = f"""{FLOW}, d0 AS (SELECT slot_ts, target, round(up_ratio, 9) AS up_ratio, round({PREDICTION}, 9) AS p FROM flow),
    d1 AS (SELECT *, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction, greatest(p, 1 - p) AS confidence, CASE WHEN p >= 0.5 THEN up_ratio ELSE 1 - up_ratio END AS mid FROM d0),
    d2 AS (SELECT *, greatest(least(mid + {LIMITS.half_spread}, 0.99), 0.01) AS ask FROM d1), d3 AS (SELECT *, {_SKIP} AS skip_reason, (direction = 'UP') = (target = 1) AS hit FROM d2),
    decided AS (SELECT *, CASE WHEN skip_reason IS NULL THEN hit END AS won, CASE WHEN skip_reason IS NULL THEN CASE WHEN hit THEN {1 - LIMITS.fee} - ask ELSE -ask END END AS pnl_share,
        CASE WHEN skip_reason IS NULL THEN CASE WHEN hit THEN (10 / ask - 10) * {1 - LIMITS.fee} ELSE -10.0 END END AS pnl_stake FROM d3)"""


@query(f"{DECIDED} SELECT slot_ts, target, direction, skip_reason, won, {', '.join(f'round({n}, 6) AS {n}' for n in ('p', 'confidence', 'mid', 'ask', 'pnl_share', 'pnl_stake'))} FROM decided")
def d_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decided(spark, sf_dir).select("slot_ts", "target", "direction", "skip_reason", "won", "p", "confidence", "mid", "ask", "pnl_share", "pnl_stake"))


@query("""WITH b AS (SELECT c_custkey, c_acctbal / 10 AS balance, (c_custkey % 101) / 100.0 AS ask FROM customer), l AS (SELECT *, least(greatest(5 + (balance - 20) * (35.0 / 680), 5), 40) AS x FROM b)
    SELECT c_custkey, CAST(greatest(floor(CASE WHEN ask > 0 THEN least(x, balance * 0.10 / ask) ELSE x END), 5) AS BIGINT) AS shares, 5::BIGINT AS fixed_low, 12::BIGINT AS fixed FROM l""")
def d_position_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer")
    return c.select("c_custkey", decisions.position_size(F.col("c_acctbal") / 10, (F.col("c_custkey") % 101) / 100.0).alias("shares"), *(decisions.position_size(F.col("c_acctbal"), F.lit(0.5), fixed=n).alias(name) for name, n in (("fixed_low", 3), ("fixed", 12))))


_TRADED = f"{DECIDED}, traded AS (SELECT * FROM decided WHERE skip_reason IS NULL)"
_DIMS = {"direction": "direction", "confidence": "CAST(CAST(floor(confidence * 20 + 1e-9) AS BIGINT) AS VARCHAR)", "edge": "CAST(CAST(floor((confidence - mid) * 20 + 1e-9) AS BIGINT) AS VARCHAR)", "hour": "CAST(slot_ts % 86400 // 3600 AS VARCHAR)"}


@query(f"""{_TRADED}, l AS (SELECT 'all' AS dimension, 'all' AS value, won, pnl_share FROM traded {" ".join(f"UNION ALL SELECT '{k}', {v}, won, pnl_share FROM traded" for k, v in _DIMS.items())})
    SELECT dimension, value, count(*) AS n, count(*) FILTER (won) AS wins, round(count(*) FILTER (won) / count(*), 6) AS win_rate, round(sum(pnl_share), 6) AS pnl FROM l GROUP BY 1, 2""")
def d_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = decided(spark, sf_dir).where("skip_reason IS NULL")
    dims = {"direction": F.col("direction"), "confidence": F.floor(F.col("confidence") * 20 + 1e-9), "edge": F.floor((F.col("confidence") - F.col("mid")) * 20 + 1e-9), "hour": F.expr("slot_ts % 86400 div 3600")}
    return rounded(decisions.summaries(t, dims))


@query(f"{DECIDED} SELECT coalesce(skip_reason, 'traded') AS reason, count(*) AS n FROM decided GROUP BY 1 ORDER BY n DESC, reason")
def k_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).groupBy(F.coalesce("skip_reason", F.lit("traded")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


_SPREADS = [0.0, 0.01, 0.02, 0.04, 0.06, 0.1]


@query(f"""{DECIDED}, grid AS (SELECT confidence, mid, hit, s AS spread, greatest(least(mid + s / 2, 0.99), 0.01) AS ask FROM decided, (VALUES {", ".join(f"({s}::DOUBLE)" for s in _SPREADS)}) v(s)),
    priced AS (SELECT *, {_SKIP} AS why FROM grid) SELECT spread, count(*) AS n, count(*) FILTER (hit) AS wins, round(sum(CASE WHEN hit THEN {1 - LIMITS.fee} - ask ELSE -ask END), 6) AS pnl FROM priced WHERE why IS NULL GROUP BY 1""")
def d_spread_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.spread_sensitivity(decided(spark, sf_dir).select("confidence", "mid", "direction", "target"), _SPREADS, LIMITS))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = decided(spark, sf_dir).where("skip_reason IS NULL").select("slot_ts", "pnl_share", "won")
    return ordering.global_rank(t, "slot_ts")


_CURVE = f"""{_TRADED}, c AS (SELECT slot_ts, pnl_share, won, row_number() OVER (ORDER BY slot_ts) - 1 AS rank, sum(pnl_share) OVER (ORDER BY slot_ts) AS cum_pnl FROM traded),
    curve AS (SELECT *, greatest(max(cum_pnl) OVER (ORDER BY rank), 0) AS peak FROM c)"""


@query(f"{_CURVE} SELECT slot_ts, rank, round(cum_pnl, 6) AS cum_pnl, round(peak, 6) AS peak, round(peak - cum_pnl, 6) AS drawdown FROM curve")
def d_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.equity(_curve(spark, sf_dir)).select("slot_ts", "rank", "cum_pnl", "peak", "drawdown"))


@query(f"{_CURVE} SELECT count(*) AS n, round(sum(pnl_share), 6) AS total_pnl, round(max(peak - cum_pnl), 6) AS max_drawdown, round(max(peak), 6) AS peak, round(avg(pnl_share) / (stddev_pop(pnl_share) + 1e-8), 6) AS sharpe FROM curve")
def d_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.risk(decisions.equity(_curve(spark, sf_dir))))


@query(f"{_CURVE} SELECT CAST(rank // greatest(1, (SELECT count(*) FROM curve) // 5) AS INT) AS chunk, count(*) AS n, round(sum(pnl_share), 6) AS pnl FROM curve WHERE rank // greatest(1, (SELECT count(*) FROM curve) // 5) < 5 GROUP BY 1")
def d_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.chunks(_curve(spark, sf_dir)).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("pnl_share").alias("pnl")))


@query(f"{_TRADED} SELECT CAST(floor(ask / 0.05 + 1e-9) AS BIGINT) AS bucket, count(*) AS n, round(avg(CAST(won AS INT)), 6) AS win_rate, round(avg(ask), 6) AS break_even, round(sum(pnl_share), 6) AS pnl FROM traded GROUP BY 1")
def d_ask_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ledger.ask_buckets(decided(spark, sf_dir).where("skip_reason IS NULL")))


@query("""WITH a AS (SELECT o_custkey AS slug, CASE WHEN o_orderstatus = 'F' THEN 'REDEEM' ELSE 'BUY' END AS kind, o_totalprice / 1000 AS cost, epoch_us(o_orderdate) // 1000000 AS moment FROM orders),
    g AS (SELECT slug, sum(cost * 2) FILTER (kind = 'BUY') AS shares, sum(cost) FILTER (kind = 'BUY') AS actual_cost, min(moment) FILTER (kind = 'BUY') AS entered_at, sum(cost) FILTER (kind = 'REDEEM') AS paid,
        max(moment) FILTER (kind = 'REDEEM') AS settled_at FROM a GROUP BY 1)
    SELECT slug, round(shares, 6) AS shares, round(actual_cost, 6) AS actual_cost, entered_at, settled_at, CASE WHEN settled_at IS NULL THEN 'open' ELSE 'settled' END AS status,
    round(CASE WHEN settled_at IS NOT NULL THEN paid - actual_cost END, 6) AS pnl_usdc, CASE WHEN settled_at IS NOT NULL THEN CASE WHEN paid - actual_cost > 0 THEN 'WIN' ELSE 'LOSS' END END AS result
    FROM g WHERE entered_at IS NOT NULL""")
def d_ledger_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) div 1000000")
    cost = F.col("o_totalprice") / 1000
    a = o.select(F.col("o_custkey").alias("slug"), F.when(F.col("o_orderstatus") == "F", "REDEEM").otherwise("BUY").alias("kind"), cost.alias("cost"), (cost * 2).alias("shares"), at.alias("at"))
    return rounded(ledger.rebuild(a))


_NOW = 1_705_000_000


@query(f"""{DECIDED}, l AS (SELECT slot_ts, direction, round(ask, 4) * 10 AS cost, target, slot_ts + {X.SLOT + 60} <= {_NOW} AS due FROM decided)
    SELECT slot_ts, CASE WHEN due THEN 'settled' ELSE 'open' END AS status, CASE WHEN due THEN CASE WHEN (direction = 'UP') = (target = 1) THEN 'WIN' ELSE 'LOSS' END END AS result,
    round(CASE WHEN due THEN CASE WHEN (direction = 'UP') = (target = 1) THEN 10 * 0.98 - cost ELSE -cost END END, 4) AS pnl_usdc FROM l""")
def d_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    open_ = d.select("slot_ts", "direction", F.lit(10.0).alias("shares"), (F.round("ask", 4) * 10).alias("actual_cost"), F.lit("open").alias("status"), F.lit(None).cast("double").alias("pnl_usdc"), F.lit(None).cast("string").alias("result"))
    s = ledger.settle(open_, d.select("slot_ts", "target"), _NOW, X.SLOT, 60)
    return rounded(s.select("slot_ts", "status", "result", "pnl_usdc"), 4)


@query(f"""{X.ctes("slots")} SELECT count(*) AS total, count(CASE WHEN slot_ts // 21600 % 3 = 0 THEN target WHEN slot_ts // 21600 % 5 <> 0 THEN target END) AS resolved,
    count(*) - count(CASE WHEN slot_ts // 21600 % 3 = 0 THEN target WHEN slot_ts // 21600 % 5 <> 0 THEN target END) AS pending FROM slots""")
def d_label_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the log has its target; labels are known for four fifths of the slots."""
    s, k = X.slots(spark, sf_dir).select("slot_ts", "target"), F.expr("slot_ts div 21600")
    log = s.withColumn("target", F.when(k % 3 == 0, F.col("target")))
    return ledger.log_stats(ledger.backfill(log, s.where(k % 5 != 0), "slot_ts"))


@query(f"{_TRADED} SELECT count(*) AS settled, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, round(count(*) FILTER (won) / count(*), 6) AS win_rate, round(sum(pnl_share), 6) AS pnl, CAST(0 AS BIGINT) AS open FROM traded")
def d_ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = decided(spark, sf_dir).where("skip_reason IS NULL")
    l = t.select(F.lit("settled").alias("status"), F.when(F.col("won"), "WIN").otherwise("LOSS").alias("result"), F.col("pnl_share").alias("pnl_usdc"))
    return rounded(ledger.summary(l).withColumn("win_rate", share("win_rate")))


_RANKED = f"{FLOW}, r AS (SELECT slot_ts, target, round({PREDICTION}, 9) AS p, row_number() OVER (ORDER BY slot_ts) - 1 AS rank, (SELECT count(*) FROM flow) AS n FROM flow)"
_FOLDS = f"""{_RANKED}, folds AS (SELECT r.*, k AS fold, CASE WHEN rank >= n - (5 - k) * (n // 6) AND rank < n - (5 - k) * (n // 6) + n // 6 THEN 'test' WHEN rank < n - (5 - k) * (n // 6) - 5 THEN 'train' END AS role
    FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k))"""


def ranked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("slot_ts", "target", F.round("p", 9).alias("p"))
    return ordering.global_rank(p, "slot_ts")


@query(f"{_FOLDS} SELECT fold, role, count(*) AS n, min(rank) AS first, max(rank) AS last FROM folds WHERE role IS NOT NULL GROUP BY 1, 2")
def m_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked_predictions(spark, sf_dir)
    f = evaluate.walk_forward(r, r.count())
    return f.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))


@query(f"{_RANKED} SELECT slot_ts, rank, CASE WHEN rank >= n - CAST(floor(n * 0.1) AS BIGINT) THEN 'test' WHEN rank >= n - CAST(floor(n * 0.1) AS BIGINT) - 12 THEN 'embargo' ELSE 'train' END AS role FROM r")
def m_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked_predictions(spark, sf_dir)
    return evaluate.holdout(r, r.count()).select("slot_ts", "rank", "role")


@query(f"""{_FOLDS}, t AS (SELECT * FROM folds WHERE role = 'test'), k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk FROM t)
    SELECT fold, round((sum(rk) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * (count(*) - sum(target))), 6) AS auc, count(*) AS n, round(avg((p - target) ** 2), 6) AS brier,
    round(avg(CAST(CAST(p > 0.5 AS INT) = target AS INT)), 6) AS accuracy, round(avg(-(target * ln(p) + (1 - target) * ln(1 - p))), 6) AS log_loss FROM k GROUP BY 1""")
def m_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked_predictions(spark, sf_dir)
    return rounded(evaluate.metrics(evaluate.walk_forward(r, r.count()).where("role = 'test'")))


@query(f"""{_RANKED}, b AS (SELECT *, CASE WHEN p >= 0 AND p < 0.3 THEN 0 WHEN p >= 0.3 AND p < 0.5 THEN 1 WHEN p >= 0.5 AND p < 0.7 THEN 2 WHEN p >= 0.7 AND p < 0.85 THEN 3 WHEN p >= 0.85 AND p < 1 THEN 4 END AS bin FROM r)
    SELECT bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(target), 6) AS actual, round(abs(avg(p) - avg(target)), 6) AS delta FROM b WHERE bin IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def m_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration(predictions(spark, sf_dir).select("target", F.round("p", 9).alias("p"))))


_MODEL = ["up_ratio", "momentum", "stability", "buy_ratio", "vwap_spread", "size_disparity"]


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ordering.global_rank(slot_flow(spark, sf_dir), "slot_ts")
    return r.select("slot_ts", "rank", "target", *_MODEL)


@query()
def m_boosted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward boosted trees: screening, out-of-fold predictions, metrics by fold."""
    r = _model_rows(spark, sf_dir)
    folds = evaluate.walk_forward(r, r.count(), folds=2)
    top = [n for n, _ in evaluate.screen(folds, _MODEL, 4, 2)]
    return rounded(evaluate.metrics(evaluate.evaluate_folds(folds, top, 2, rounds=5)))


@query()
def m_calibrated_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic calibration over three parts, blended with a logistic model, on the holdout."""
    r = _model_rows(spark, sf_dir)
    h = evaluate.holdout(r, r.count(), 0.2)
    train, test = h.where("role = 'train'"), h.where("role = 'test'")
    boosted = evaluate.calibrated(train, test, _MODEL).withColumnRenamed("p", "p_gbm")
    both = evaluate.predict(evaluate.logistic(_MODEL).fit(train), boosted, "p_lr")
    return rounded(both.select("slot_ts", "target", "p_gbm", "p_lr", evaluate.blend("p_gbm", "p_lr").alias("p")))


@query()
def m_overfit_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adversarial validation, noise rank and permutation importance as verdicts."""
    r = _model_rows(spark, sf_dir)
    h = evaluate.with_noise(evaluate.holdout(r, r.count(), 0.3), 2)
    train, test = h.where("role = 'train'"), h.where("role = 'test'")
    names = [*_MODEL, "noise_0", "noise_1"]
    model = evaluate.gbt(names, rounds=5).fit(train)
    order = [n for n, _ in evaluate.importances(model, names)]
    drop = evaluate.permutation_importance(model, h, names).where("feature = 'up_ratio'").first().auc_drop
    return evaluate.scorecard(spark, {
        "adversarial_auc": (evaluate.adversarial_auc(train, test, _MODEL), 0.65, 0.8),
        "noise_rank": (float(len(names) - min(order.index("noise_0"), order.index("noise_1"))), 6.0, 8.0),
        "permutation": (-drop, 0.005, 0.05),
    }).select("check", "verdict")


@query(f"""{X.ctes("ticks", "slots")}, {BOOK_SET}, {flow_cte()}, e AS (SELECT slot_ts, target, CASE WHEN round({PREDICTION}, 9) > 0.5 THEN 'UP' ELSE 'DOWN' END AS direction, coalesce(ob_mid, 0.5) + coalesce(ob_mid_drift, 0) AS c
        FROM flow LEFT JOIN books ON m = slot_ts // 21600 % 211),
    f AS (SELECT slot_ts, target, direction, CASE WHEN direction = 'UP' THEN least(greatest(c, 0.05), 0.95) ELSE 1 - least(greatest(c, 0.05), 0.95) END AS ask FROM e)
    SELECT slot_ts, direction, round(ask, 6) AS ask, (direction = 'UP') = (target = 1) AS won, round(CASE WHEN (direction = 'UP') = (target = 1) THEN 0.98 - ask ELSE -ask END, 6) AS pnl_share FROM f""")
def d_entry_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry at the book's closing mid: direction, price and profit a share of each slot."""
    p = predictions(spark, sf_dir).select("slot_ts", "target", F.when(F.round("p", 9) > 0.5, "UP").otherwise("DOWN").alias("direction"), F.expr(MARKET_OF_SLOT).alias("market"))
    priced = features.with_books(p, slot_books(spark, sf_dir).select("market", "ob_mid", "ob_mid_drift"), "market").withColumn("skip_reason", F.lit(None).cast("string"))
    priced = priced.withColumn("ask", decisions.entry_price(F.col("ob_mid"), F.col("ob_mid_drift"), F.col("direction")))
    return rounded(priced.select("slot_ts", "direction", "ask", *decisions.pnl()[:2]))


_CHECKED_SQL = f"""{DECIDED}, rk AS (SELECT *, row_number() OVER (ORDER BY slot_ts) - 1 AS rank, (SELECT count(*) FROM decided) AS n FROM decided),
    f AS (SELECT rk.*, k AS fold FROM rk, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) WHERE CASE WHEN k < 5 THEN rank >= n - (5 - k) * (n // 6) AND rank < n - (5 - k) * (n // 6) + n // 6 ELSE rank >= n - CAST(floor(n * 0.2) AS BIGINT) END),
    o AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rr FROM f),
    a AS (SELECT fold, (sum(rr) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * (count(*) - sum(target))) AS auc FROM o GROUP BY 1),
    m AS (SELECT avg(auc) FILTER (fold < 5) - max(auc) FILTER (fold = 5) AS auc_drop, stddev_pop(auc) FILTER (fold < 5) AS fold_std FROM a),
    t AS (SELECT count(*) AS n_trades, sum(CASE WHEN (direction = 'UP') = (target = 1) THEN 0.98 - ask ELSE -ask END) AS pnl FROM decided WHERE skip_reason IS NULL)"""


@query(f"""{_CHECKED_SQL} SELECT 'adversarial_auc' AS "check", 'SKIP' AS verdict UNION ALL SELECT 'noise_rank', 'SKIP' UNION ALL SELECT 'auc_drop', CASE WHEN auc_drop <= 0.03 THEN 'PASS' ELSE 'WARN' END FROM m
    UNION ALL SELECT 'fold_stability', CASE WHEN fold_std <= 0.05 THEN 'PASS' ELSE 'WARN' END FROM m UNION ALL SELECT 'trading_pnl', CASE WHEN n_trades = 0 THEN 'SKIP' WHEN pnl > 0 THEN 'PASS' ELSE 'FAIL' END FROM t""")
def m_prediction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard's rows that predictions alone decide; those that need a model are skipped."""
    d = decided(spark, sf_dir)
    r = ordering.global_rank(d.select("slot_ts", "target", "p"), "slot_ts")
    n = r.count()
    folds = evaluate.fold_summary(evaluate.metrics(evaluate.walk_forward(r, n).where("role = 'test'")))
    last = evaluate.auc(evaluate.holdout(r, n, 0.2).where("role = 'test'"), "p", "target").select(F.col("auc").alias("holdout"))
    traded = d.where("skip_reason IS NULL").agg(F.count("*").alias("n_trades"), F.sum("pnl_share").alias("pnl"))
    measured = folds.crossJoin(last).crossJoin(traded)  # one row each
    none = F.lit(None).cast("double")
    return evaluate.overfit_checks(measured.select(none.alias("adversarial_auc"), none.alias("noise_rank"), (F.col("auc_mean") - F.col("holdout")).alias("auc_drop"), F.col("auc_std").alias("fold_std"), "n_trades", "pnl"), 4)


@query()
def m_directional_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up, neutral and Down rows through a model fitted on all slots."""
    model = evaluate.logistic(_MODEL).fit(_model_rows(spark, sf_dir))
    neutral = {"up_ratio": 0.5, "buy_ratio": 0.5}
    up = {"up_ratio": 0.75, "momentum": 0.05, "buy_ratio": 0.6, "vwap_spread": 0.10}
    down = {"up_ratio": 0.25, "momentum": -0.05, "buy_ratio": 0.4, "vwap_spread": -0.10}
    return rounded(evaluate.directional_probes(spark, model, _MODEL, neutral, up, down))


@query()
def m_feature_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fold AUC of the whole set, its first features, and the set less one feature; whether each meets the minimum bar."""
    r = _model_rows(spark, sf_dir)
    folds = evaluate.walk_forward(r, r.count(), folds=2).where("role IS NOT NULL").persist()
    sets = {"all": _MODEL, "first_3": _MODEL[:3], "less_momentum": [n for n in _MODEL if n != "momentum"]}
    tried = spark.createDataFrame(evaluate.sweep(folds, sets, 2, rounds=3), "name string, n_features long, auc double")
    folds.unpersist()
    bar = evaluate.usable(tried).select("name", F.lit(True).alias("usable"))
    return rounded(tried.join(bar, "name", "left").fillna(False, subset=["usable"]))


@query()
def m_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trials of the random search, best first."""
    r = _model_rows(spark, sf_dir)
    folds = evaluate.walk_forward(r, r.count(), folds=2).where("role IS NOT NULL").persist()
    rows = [(k, p["depth"], p["rounds"], p["step"], s) for k, (s, p) in enumerate(evaluate.search(folds, _MODEL[:4], 2, 2))]
    folds.unpersist()
    return rounded(spark.createDataFrame(rows, "place long, depth int, rounds int, step double, score double"))


@query()
def m_full_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five checks of one boosted model: adversarial AUC, noise rank, loss from folds to holdout, fold spread, profit."""
    r = evaluate.with_noise(_model_rows(spark, sf_dir), 2)
    n = r.count()
    h = evaluate.holdout(r, n, 0.2)
    train, test = h.where("role = 'train'"), h.where("role = 'test'")
    names = [*_MODEL, "noise_0", "noise_1"]
    model = evaluate.gbt(names, rounds=5).fit(train)
    order = [f for f, _ in evaluate.importances(model, names)]
    folds = evaluate.evaluate_folds(evaluate.walk_forward(r, n, folds=2), _MODEL, 2, rounds=5)
    summary = evaluate.fold_summary(evaluate.metrics(folds))
    held = evaluate.auc(evaluate.predict(model, test), "p", "target").select(F.col("auc").alias("holdout"))
    decided_ = decisions.decide(folds.select("slot_ts", "target", "up_ratio", "p"), LIMITS)
    traded = decided_.select("*", *decisions.pnl(LIMITS)).where("skip_reason IS NULL").agg(F.count("*").alias("n_trades"), F.sum("pnl_share").alias("pnl"))
    measured = summary.crossJoin(held).crossJoin(traded)  # one row each
    return evaluate.overfit_checks(measured.select(
        F.lit(evaluate.adversarial_auc(train, test, _MODEL)).alias("adversarial_auc"), F.lit(float(1 + min(order.index("noise_0"), order.index("noise_1")))).alias("noise_rank"),
        (F.col("auc_mean") - F.col("holdout")).alias("auc_drop"), F.col("auc_std").alias("fold_std"), "n_trades", "pnl",
    ), 4)


@query(f"""{FLOW}, r AS (SELECT slot_ts, target, row_number() OVER (PARTITION BY target ORDER BY md5(CAST(slot_ts AS VARCHAR) || '-42')) - 1 AS k FROM flow) SELECT slot_ts, target, CAST(k % 5 AS INT) AS fold FROM r""")
def m_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stratified_folds(_model_rows(spark, sf_dir), "target", F.col("slot_ts")).select("slot_ts", "target", "fold")


@query()
def m_stratified_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stratified folds with early stopping: metrics and rounds used of each."""
    p, used = evaluate.cross_validated(_model_rows(spark, sf_dir), _MODEL, "target", F.col("slot_ts"), 3, rounds=12)
    rounds = spark.createDataFrame(list(enumerate(used)), "fold int, rounds int")
    return rounded(evaluate.metrics(p).join(F.broadcast(rounds), "fold"))


@query()
def m_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC lost on the holdout by dealing each feature to other rows; features that hurt are flagged."""
    r = ordering.global_rank(slot_flow(spark, sf_dir), "slot_ts")
    names = [n for n in FLOW_DOUBLES if n not in ("vol_up", "vol_dn")]
    h = evaluate.holdout(r, r.count(), 0.3)
    model = evaluate.gbt(names, rounds=5).fit(h.where("role = 'train'"))
    return rounded(evaluate.permutation_importance(model, h.where("role = 'test'"), names))


_VARIANTS = {"flow": (2, "p"), "ratio": (1, "up_ratio"), "price": (1, "vwap_up"), "bought": (3, "buy_ratio")}


@query(f"""{FLOW}, v AS ({" UNION ALL ".join(f"SELECT '{k}' AS name, {n} AS n_features, target, round({PREDICTION if c == 'p' else c}, 9) AS p FROM flow" for k, (n, c) in _VARIANTS.items())}),
    k AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY p) + (count(*) OVER (PARTITION BY name, p) - 1) / 2.0 AS rk FROM v),
    m AS (SELECT name, max(n_features) AS n_features, (sum(rk) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * (count(*) - sum(target))) AS auc, avg((p - target) ** 2) AS brier, avg(CAST(CAST(p > 0.5 AS INT) = target AS INT)) AS accuracy FROM k GROUP BY 1),
    won AS (SELECT m.*, CAST(m.auc > c.auc AS INT) + CAST(m.brier < c.brier AS INT) + CAST(m.accuracy > c.accuracy AS INT) AS gains FROM m, (SELECT * FROM m WHERE name = 'flow') c WHERE m.name <> 'flow')
    SELECT name, n_features, round(auc, 6) AS auc, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy, gains, gains >= 2 AS passes, gains >= 2 AND row_number() OVER (ORDER BY gains >= 2 DESC, gains DESC, n_features, auc DESC) = 1 AS promoted FROM won""")
def m_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple predictors held against a champion: gains of three, and which is promoted."""
    f = predictions(spark, sf_dir)
    v = f.select("target", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(n).alias("n_features"), F.round(c, 9).alias("p")) for k, (n, c) in _VARIANTS.items()))).alias("v")).select("target", "v.*")
    sizes = v.groupBy("name").agg(F.max("n_features").alias("n_features"))
    return rounded(evaluate.promotion_table(evaluate.metrics(v, by="name").join(sizes, "name").select("name", "auc", "brier", "accuracy", "n_features"), "flow"))
