"""Data-quality gates: each adds a pass flag and its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotforge.operators.ordering import blocks, in_blocks, running, running_max

SEPARATOR = "; "


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that are broken (true), joined; empty where none is. A rule that is unknown is broken."""
    return F.concat_ws(SEPARATOR, F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), name) for name, c in rules.items()))))


def completeness(min_ticks: int = 50, max_age: int = 300, min_bars: int = 10, min_windows: int = 2) -> Column:
    """Columns n_ticks, n_windows (sub-windows with ticks), feed_age (null: no feed), n_bars."""
    return reasons({
        "few_ticks": F.col("n_ticks") < min_ticks,
        "no_feed": F.col("feed_age").isNull(),
        "stale_feed": F.coalesce(F.col("feed_age") > max_age, F.lit(False)),
        "few_bars": F.col("n_bars") < min_bars,
        "empty_windows": F.col("n_windows") < min_windows,
    })


@dataclass(frozen=True)
class Range:
    low: float
    high: float


# Which features are returns, shares and z-scores; all values stay within a million.
RETURNS = frozenset(("ret_0h", "ret_1h", "ret_2h", "ret_3h", "ret_6h", "ret_24h"))
RATIOS = frozenset(("up_ratio", "buy_ratio", "decayed_up_ratio", "up_w0", "up_w1", "up_w2", "up_w3", "up_w4", "up_w5", "ob_bid_depth_5c", "ob_ask_depth_5c"))
ZSCORES = frozenset(("up_ratio_z5", "up_ratio_z20", "up_w5_z20"))
WIDEST = Range(-1e6, 1e6)


def range_of(name: str) -> Range:
    if name in RETURNS:
        return Range(-0.05, 0.05)
    if name in RATIOS:
        return Range(-0.001, 1.001)  # a thousandth for rounding
    return Range(-5, 5) if name in ZSCORES else WIDEST


def violations(names: list[str]) -> Column:
    """Names of features that are missing, not finite or out of range."""
    broken = []
    for n in names:
        r, c = range_of(n), F.col(n).cast("double")
        bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | ~c.between(r.low, r.high)
        broken.append(F.when(F.coalesce(bad, F.lit(True)), n))
    return F.array_compact(F.array(*broken))


def prediction(low: float = 0.01, high: float = 0.99) -> Column:
    return reasons({"p_range": ~F.col("p").between(low, high)})


def contradiction(imbalance: Column, limit: float = 0.3) -> Column:
    """The book leans against the direction; an imbalance of 0 or null is no evidence."""
    return F.coalesce(((F.col("direction") == "UP") & (imbalance < -limit)) | ((F.col("direction") == "DOWN") & (imbalance > limit)), F.lit(False))


def stale_signature(ranked: DataFrame, names: list[str], run: int = 10, places: int = 6) -> DataFrame:
    """Adds ``stale``: the last ``run`` signatures of the named features are the same."""
    signed = ranked.withColumn("_sig", F.concat_ws("|", *(F.coalesce(F.round(n, places).cast("string"), F.lit("?")) for n in names)))
    w = in_blocks().rowsBetween(-(run - 1), 0)
    b = blocks(signed, run - 1)
    same = (F.size(F.collect_set("_sig").over(w)) == 1) & (F.count("*").over(w) == run)
    return b.withColumn("stale", same).where("NOT _halo").drop("_sig", "_halo", "_block")


def win_rate_latch(ranked: DataFrame, last: int = 20, least: float = 0.4) -> DataFrame:
    """Adds ``win_rate`` of the last settled rows and ``paused``: once it has been below ``least``, until the end."""
    w = in_blocks().rowsBetween(-(last - 1), 0)
    b = blocks(ranked, last - 1)
    rate = b.withColumns({"win_rate": F.avg(F.col("won").cast("int")).over(w), "_n": F.count("*").over(w)}).where("NOT _halo").drop("_halo", "_block")
    tripped = rate.withColumn("_trip", F.when((F.col("_n") == last) & (F.col("win_rate") < least), 1.0).otherwise(0.0)).drop("_n")
    trips = running(tripped, {"_trips": F.col("_trip")})
    return trips.withColumn("paused", F.col("_trips") > 0).drop("_trips", "_trip")


def warm_up(rank: Column, slots: int = 3) -> Column:
    return rank < slots


def execution(ask: Column, paused: Column, low: float = 0.10, high: float = 0.95) -> Column:
    """Paused by the latch, or an ask that is unknown, not positive or out of range; the first that holds."""
    return F.when(F.coalesce(paused, F.lit(False)), "paused").when(F.coalesce(ask <= 0, F.lit(True)), "no_ask").when(~ask.between(low, high), "ask_range").otherwise("")


def quiet(ranked: DataFrame, placed: Column, time: str, limit: int) -> DataFrame:
    """Adds ``quiet``, a warning that stops nothing: no trade was placed before a row within ``limit``."""
    last = running_max(ranked.withColumn("_placed", F.when(placed, F.col(time))), "_placed", "_last")
    b = blocks(last, 1)
    before = F.lag("_last", 1).over(in_blocks())
    out = b.withColumn("quiet", F.coalesce(F.col(time) - before > limit, F.lit(True)))
    return out.where("NOT _halo").drop("_placed", "_last", "_halo", "_block")


def before_prediction(warming: Column, complete: Column, sane: Column) -> Column:
    """Warm-up, completeness, sanity: the first that fails."""
    return first_failure(warm_up=F.when(warming, "warming").otherwise(""), completeness=complete, sanity=sane)


def after_prediction(prediction: Column, execution: Column) -> Column:
    """Prediction, execution: the first that fails."""
    return first_failure(prediction=prediction, execution=execution)


def first_failure(**gates: Column) -> Column:
    """The first gate, in the given order, that has a reason: its name and reason."""
    return F.coalesce(*(F.when(c != "", F.concat(F.lit(n + ": "), c)) for n, c in gates.items()))
