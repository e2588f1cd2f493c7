"""Predictions to decisions: funnel, profit and loss, size, summaries, risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotforge.operators.ordering import running, running_max


@dataclass(frozen=True)
class Limits:
    """Thresholds of the funnel; scripts differ, so all are parameters."""

    confidence: float = 0.55
    ask_low: float = 0.38
    ask_high: float = 0.90
    edge_ask: float = 0.02
    edge_mid: float = 0.03
    diverge: float = 0.35
    fee: float = 0.02
    half_spread: float = 0.01


def decide(predictions: DataFrame, limits: Limits = Limits(), strict_half: bool = False) -> DataFrame:
    """Adds direction, confidence, mid, ask, edges and skip_reason (null: traded) to p and up_ratio."""
    p = F.col("p")
    up = p > 0.5 if strict_half else p >= 0.5
    d = predictions.withColumns({"direction": F.when(up, "UP").otherwise("DOWN"), "confidence": F.greatest(p, 1 - p)})
    d = d.withColumn("mid", F.when(F.col("direction") == "UP", F.col("up_ratio")).otherwise(1 - F.col("up_ratio")))
    d = d.withColumn("ask", F.greatest(F.least(F.col("mid") + limits.half_spread, F.lit(0.99)), F.lit(0.01)))
    d = d.withColumns({"edge_ask": F.col("confidence") - F.col("ask"), "edge_mid": F.col("confidence") - F.col("mid")})
    return d.withColumn("skip_reason", skip_reason(limits))


def entry_price(mid: Column, drift: Column, direction: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """What the bought side costs at the close of the window: the Up mid with its drift within [low, high], or the rest to 1."""
    close = F.greatest(F.least(mid + drift, F.lit(high)), F.lit(low))
    return F.when(direction == "UP", close).otherwise(1 - close)


def skip_reason(limits: Limits) -> Column:
    """The first rule that a row breaks."""
    return (
        F.when(F.col("confidence") < limits.confidence, "low_conf")
        .when(~F.col("ask").between(limits.ask_low, limits.ask_high), "ask_range")
        .when(F.col("edge_ask") < limits.edge_ask, "low_edge_ask")
        .when(F.col("edge_mid") < limits.edge_mid, "low_edge_mid")
        .when(F.abs(F.col("ask") - F.col("mid")) > limits.diverge, "ask_mid_diverge")
    )


def pnl(limits: Limits = Limits(), stake: float = 10.0) -> list[Column]:
    """won, profit per share and profit of a stake, for traded rows."""
    won = (F.col("direction") == "UP") == (F.col("target") == 1)
    share = F.when(won, (1 - limits.fee) - F.col("ask")).otherwise(-F.col("ask"))
    staked = F.when(won, (F.lit(stake) / F.col("ask") - stake) * (1 - limits.fee)).otherwise(F.lit(-stake))
    traded = F.col("skip_reason").isNull()
    return [F.when(traded, won).alias("won"), F.when(traded, share).alias("pnl_share"), F.when(traded, staked).alias("pnl_stake")]


def position_size(balance: Column, ask: Column, low: tuple[float, float] = (20.0, 5.0), high: tuple[float, float] = (700.0, 40.0), cap: float = 0.10, fixed: float | None = None) -> Column:
    """Shares between the two (balance, shares) points, at most ``cap`` of the balance in cost, at least the lower.

    ``fixed`` shares don't follow balance or cost; they too are at least the lower."""
    if fixed is not None:
        return F.lit(int(max(fixed, low[1]))).cast("long")
    slope = (high[1] - low[1]) / (high[0] - low[0])
    linear = F.least(F.greatest(low[1] + (balance - low[0]) * slope, F.lit(low[1])), F.lit(high[1]))
    capped = F.when(ask > 0, F.least(linear, balance * cap / ask)).otherwise(linear)
    return F.greatest(F.floor(capped), F.lit(int(low[1]))).cast("long")


def summaries(traded: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """dimension, value, n, wins, win_rate, pnl for each dimension and overall, in one pass by grouping sets."""
    d = traded.select("won", "pnl_share", *(c.cast("string").alias(k) for k, c in dimensions.items()))
    pairs = F.array(F.struct(F.lit("all").alias("d"), F.lit("all").alias("v")), *(F.struct(F.lit(k).alias("d"), F.col(k).alias("v")) for k in dimensions))
    long = d.select("won", "pnl_share", F.explode(pairs).alias("x"))
    return long.groupBy(F.col("x.d").alias("dimension"), F.col("x.v").alias("value")).agg(
        F.count("*").alias("n"), F.count_if("won").alias("wins"), (F.count_if("won") / F.count("*")).alias("win_rate"), F.sum("pnl_share").alias("pnl")
    )


def spread_sensitivity(decided: DataFrame, spreads: list[float], limits: Limits = Limits()) -> DataFrame:
    """Every decision priced again at each spread, filtered again, and summed: rows times a fixed short list."""
    grid = decided.select("confidence", "mid", "direction", "target", F.explode(F.array(*map(F.lit, spreads))).alias("spread"))
    grid = grid.withColumn("ask", F.greatest(F.least(F.col("mid") + F.col("spread") / 2, F.lit(0.99)), F.lit(0.01)))
    grid = grid.withColumns({"edge_ask": F.col("confidence") - F.col("ask"), "edge_mid": F.col("confidence") - F.col("mid")}).withColumn("skip_reason", skip_reason(limits))
    kept = grid.where(F.col("skip_reason").isNull()).select("spread", *pnl(limits))
    return kept.groupBy("spread").agg(F.count("*").alias("n"), F.count_if("won").alias("wins"), F.sum("pnl_share").alias("pnl"))


def equity(ranked: DataFrame, value: str = "pnl_share", floor: float | None = 0.0) -> DataFrame:
    """Adds cumulative profit, its running peak (from ``floor``; none: from the first trade) and the drawdown."""
    c = running(ranked, {"cum_pnl": F.col(value)})
    return running_max(c, "cum_pnl", "peak", floor=floor).withColumn("drawdown", F.col("peak") - F.col("cum_pnl"))


def risk(curve: DataFrame, value: str = "pnl_share") -> DataFrame:
    return curve.agg(
        F.count("*").alias("n"), F.sum(value).alias("total_pnl"), F.max("drawdown").alias("max_drawdown"), F.max("peak").alias("peak"),
        (F.avg(value) / (F.stddev_pop(value) + 1e-8)).alias("sharpe"),
    )


def chunks(ranked: DataFrame, parts: int = 5, rank: str = "rank") -> DataFrame:
    """Equal blocks of max(1, n // parts) rows; the remainder is dropped."""
    n = ranked.count()
    size = max(1, n // parts)
    return ranked.withColumn("chunk", F.floor(F.col(rank) / size).cast("int")).where(F.col("chunk") < parts)
