"""Quality gates over slots and predictions, event rates and log patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge import fixtures as X
from slotforge.operators import gates, ordering
from slotforge.plans.flow_queries import FLOW, slot_flow
from slotforge.plans.registry import query, rounded

PREDICTION = "1 / (1 + exp(-(4 * (up_ratio - 0.5) + 2 * momentum)))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed form of two flow features stands for the model."""
    return slot_flow(spark, sf_dir).withColumn("p", F.expr(PREDICTION))


_CHECKED = ["up_ratio", "buy_ratio", "momentum", "vol_tot", "size_disparity"]
_GATE = f"""{FLOW}, c AS (SELECT *, round({PREDICTION}, 9) AS p, {" + ".join(f"CAST(up_w{k} <> 0.5 AS INT)" for k in range(6))} AS n_windows, CASE WHEN slot_ts // 21600 % 7 = 0 THEN NULL ELSE slot_ts // 21600 % 400 END AS feed_age,
    slot_ts // 21600 % 13 AS n_bars FROM flow),
    gated AS (SELECT *, concat_ws('; ', CASE WHEN n_ticks < 50 THEN 'few_ticks' END, CASE WHEN feed_age IS NULL THEN 'no_feed' END, CASE WHEN feed_age > 300 THEN 'stale_feed' END, CASE WHEN n_bars < 10 THEN 'few_bars' END,
        CASE WHEN n_windows < 2 THEN 'empty_windows' END) AS completeness,
        list_filter([CASE WHEN NOT (up_ratio BETWEEN -0.001 AND 1.001) THEN 'up_ratio' END, CASE WHEN NOT (buy_ratio BETWEEN -0.001 AND 1.001) THEN 'buy_ratio' END, CASE WHEN abs(momentum) > 1e6 THEN 'momentum' END,
        CASE WHEN abs(vol_tot) > 1e6 THEN 'vol_tot' END, CASE WHEN abs(size_disparity) > 1e6 THEN 'size_disparity' END], lambda x: x IS NOT NULL) AS v FROM c)"""


@query(f"""{_GATE} SELECT slot_ts, completeness, len(v) AS n_violations, v[1] AS first_violation, CASE WHEN p < 0.25 OR p > 0.75 THEN 'p_range' ELSE '' END AS prediction,
    CASE WHEN completeness <> '' THEN 'completeness: ' || completeness WHEN len(v) > 0 THEN 'sanity: ' || array_to_string(v, '; ') WHEN p < 0.25 OR p > 0.75 THEN 'prediction: p_range' END AS verdict,
    (p >= 0.5 AND momentum < -0.3) OR (p < 0.5 AND momentum > 0.3) AS contradicts,
    CAST({" + ".join(f"CAST({n} = 0 AS INT)" for n in _CHECKED)} AS BIGINT) AS n_zero FROM gated""")
def g_row_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, feature sanity, prediction range, the first failure, contradiction with the flow, zero features."""
    step = F.expr("slot_ts div 21600")
    d = predictions(spark, sf_dir).withColumns({
        "p": F.round("p", 9),
        "n_windows": sum((F.col(f"up_w{k}") != 0.5).cast("int") for k in range(6)),
        "feed_age": F.when(step % 7 == 0, None).otherwise(step % 400),
        "n_bars": step % 13,
        "direction": F.when(F.col("p") >= 0.5, "UP").otherwise("DOWN"),
    })
    d = d.withColumns({"completeness": gates.completeness(), "_v": gates.violations(_CHECKED), "prediction": gates.prediction(0.25, 0.75)})
    return d.select(
        "slot_ts", "completeness", F.size("_v").cast("long").alias("n_violations"), F.get("_v", F.lit(0)).alias("first_violation"), "prediction",
        gates.first_failure(completeness=F.col("completeness"), sanity=F.concat_ws(gates.SEPARATOR, "_v"), prediction=F.col("prediction")).alias("verdict"),
        gates.contradiction(F.col("momentum")).alias("contradicts"), sum((F.col(n) == 0).cast("long") for n in _CHECKED).alias("n_zero"),
    )


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("slot_ts", "target", F.round("p", 9).alias("p"), F.round("up_ratio", 1).alias("coarse"))
    return p.withColumn("won", (F.col("p") >= 0.5) == (F.col("target") == 1))


_SETTLED = f"{FLOW}, st AS (SELECT slot_ts, (round({PREDICTION}, 9) >= 0.5) = (target = 1) AS won, round(up_ratio, 1) AS coarse, row_number() OVER (ORDER BY slot_ts) - 1 AS rank FROM flow)"


@query(f"""{_SETTLED}, w AS (SELECT *, avg(CAST(won AS INT)) OVER a AS wr, count(*) OVER a AS n, count(DISTINCT coarse) OVER b AS kinds, count(*) OVER b AS m FROM st
    WINDOW a AS (ORDER BY rank ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (ORDER BY rank ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT slot_ts, rank, won, round(wr, 6) AS win_rate, max(CAST(n = 20 AND wr < 0.45 AS INT)) OVER (ORDER BY rank) = 1 AS paused, kinds = 1 AND m = 3 AS stale, rank < 3 AS warming FROM w""")
def g_stateful_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win-rate latch over 20 settled rows, stale signatures over 3, warm-up of 3 slots."""
    ranked = ordering.global_rank(settled(spark, sf_dir), "slot_ts")
    latched = gates.win_rate_latch(gates.stale_signature(ranked, ["coarse"], run=3), 20, 0.45)
    return latched.select("slot_ts", "rank", "won", F.round("win_rate", 6).alias("win_rate"), "paused", "stale", gates.warm_up(F.col("rank")).alias("warming"))


@query(f"""{_GATE}, r AS (SELECT *, row_number() OVER (ORDER BY slot_ts) - 1 AS rank, (p >= 0.5) = (target = 1) AS won, round(vwap_up * 1.6, 6) AS ask, abs(p - 0.5) > 0.2 AS placed FROM gated),
    w AS (SELECT *, avg(CAST(won AS INT)) OVER a AS wr, count(*) OVER a AS m, max(CASE WHEN placed THEN slot_ts END) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
        FROM r WINDOW a AS (ORDER BY rank ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    x AS (SELECT *, max(CAST(m = 20 AND wr < 0.45 AS INT)) OVER (ORDER BY rank) = 1 AS paused FROM w)
    SELECT slot_ts, CASE WHEN rank < 3 THEN 'warm_up: warming' WHEN completeness <> '' THEN 'completeness: ' || completeness WHEN len(v) > 0 THEN 'sanity: ' || array_to_string(v, '; ') END AS before,
    CASE WHEN p < 0.25 OR p > 0.75 THEN 'prediction: p_range' WHEN paused THEN 'execution: paused' WHEN ask <= 0 THEN 'execution: no_ask' WHEN ask NOT BETWEEN 0.1 AND 0.95 THEN 'execution: ask_range' END AS after,
    coalesce(slot_ts - last > 43200, TRUE) AS quiet FROM x""")
def g_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both composite gates of each slot in their fixed order, with the execution gate and the warning of no trades."""
    step = F.expr("slot_ts div 21600")
    d = predictions(spark, sf_dir).withColumns({
        "p": F.round("p", 9), "n_windows": sum((F.col(f"up_w{k}") != 0.5).cast("int") for k in range(6)), "feed_age": F.when(step % 7 == 0, None).otherwise(step % 400), "n_bars": step % 13,
        "ask": F.round(F.col("vwap_up") * 1.6, 6),
    })
    d = d.withColumns({"won": (F.col("p") >= 0.5) == (F.col("target") == 1), "complete": gates.completeness(), "sane": F.concat_ws(gates.SEPARATOR, gates.violations(_CHECKED)), "likely": gates.prediction(0.25, 0.75)})
    ranked = ordering.global_rank(d.select("slot_ts", "p", "won", "ask", "complete", "sane", "likely"), "slot_ts")
    latched = gates.quiet(gates.win_rate_latch(ranked, 20, 0.45), F.abs(F.col("p") - 0.5) > 0.2, "slot_ts", 43_200)
    return latched.select(
        "slot_ts", gates.before_prediction(gates.warm_up(F.col("rank")), F.col("complete"), F.col("sane")).alias("before"),
        gates.after_prediction(F.col("likely"), gates.execution(F.col("ask"), F.col("paused"))).alias("after"), "quiet",
    )


@query(f"""{X.ctes("ticks")} SELECT market_id, max(c) AS peak_rate, round(max(gap), 6) AS longest_gap, count(*) FILTER (gap > 900) AS silences FROM (
    SELECT market_id, count(*) OVER (PARTITION BY market_id ORDER BY timestamp_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS c,
    (timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY market_id ORDER BY timestamp_ms, event_id)) / 1000.0 AS gap FROM ticks) GROUP BY 1""")
def w_event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing event rate and silences of each market."""
    return rounded(ordering.event_rate(X.ticks(spark, sf_dir), "market_id", "timestamp_ms", 3_600_000, 900))


@query(f"""{X.ctes("ticks")} SELECT market_id, timestamp_ms, event_id, price FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_ms DESC, event_id DESC) AS k FROM ticks) WHERE k <= 25""")
def w_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.keep_last(X.ticks(spark, sf_dir).select("market_id", "timestamp_ms", "event_id", "price"), "market_id", 25, "timestamp_ms", "event_id")


_PATTERNS = {"license": "[Ll]icen[sc]e", "secret": "token *=", "address": "@[a-z]+", "digits": "[0-9]{4,}"}


@query(f"""SELECT pattern, count(*) AS n_lines, max(doc_id) AS last_doc FROM documents, (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _PATTERNS.items())}) p(pattern, rx)
    WHERE regexp_matches(text, rx) GROUP BY 1""")
def a_log_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a landed text table that match each pattern, and the last that does, in one pass."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike(v), k) for k, v in _PATTERNS.items())))
    return d.select("doc_id", F.explode(hit).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n_lines"), F.max("doc_id").alias("last_doc"))
