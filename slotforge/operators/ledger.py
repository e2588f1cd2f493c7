"""Ledger rebuild, settlement, label back-fill and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuild(activity: DataFrame) -> DataFrame:
    """Buys and redeems by slug to ledger rows: settled where a redeem exists, else open.

    activity: slug, kind (BUY/REDEEM), shares, cost, at.
    """
    buy, redeem = F.col("kind") == "BUY", F.col("kind") == "REDEEM"
    g = activity.groupBy("slug").agg(
        F.sum(F.when(buy, F.col("shares"))).alias("shares"), F.sum(F.when(buy, F.col("cost"))).alias("actual_cost"), F.min(F.when(buy, F.col("at"))).alias("entered_at"),
        F.sum(F.when(redeem, F.col("cost"))).alias("paid"), F.max(F.when(redeem, F.col("at"))).alias("settled_at"),
    )
    done = F.col("settled_at").isNotNull()
    pnl = F.col("paid") - F.col("actual_cost")
    return g.where("entered_at IS NOT NULL").select("slug", "shares", "actual_cost", "entered_at", "settled_at", F.when(done, "settled").otherwise("open").alias("status"), F.when(done, pnl).alias("pnl_usdc"), F.when(done, F.when(pnl > 0, "WIN").otherwise("LOSS")).alias("result"))


def settle(ledger: DataFrame, resolutions: DataFrame, now: int, slot: int, grace: int, fee: float = 0.02) -> DataFrame:
    """Open rows whose slot ended more than ``grace`` ago take their resolution; others stay as they are."""
    due = (F.col("status") == "open") & (F.col("slot_ts") + slot + grace <= now)
    j = ledger.join(resolutions.select("slot_ts", F.col("target").alias("_t")), "slot_ts", "left")
    hit = due & F.col("_t").isNotNull()
    won = (F.col("direction") == "UP") == (F.col("_t") == 1)
    pnl = F.when(won, F.col("shares") * (1 - fee) - F.col("actual_cost")).otherwise(-F.col("actual_cost"))
    return j.withColumns({
        "pnl_usdc": F.when(hit, pnl).otherwise(F.col("pnl_usdc")),
        "result": F.when(hit, F.when(won, "WIN").otherwise("LOSS")).otherwise(F.col("result")),
        "status": F.when(hit, "settled").otherwise(F.col("status")),
    }).drop("_t")


def backfill(log: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows without a target take the label of their key."""
    known = labels.select(key, F.col("target").alias("_label"))
    return log.join(known, key, "left").withColumn("target", F.coalesce("target", "_label")).drop("_label")


def reconcile(derived: DataFrame, label: str, known: str, least: float | None = None) -> DataFrame:
    """n_match, n_mismatch, n_missing, agreement of derived labels with known ones; ``least`` makes too low an agreement an
    error when the row is made."""
    same, told = F.count_if(F.col(label) == F.col(known)), F.count_if(F.col(label).isNotNull() & F.col(known).isNotNull())
    g = derived.agg(same.alias("n_match"), F.count_if(F.col(label) != F.col(known)).alias("n_mismatch"), F.count_if(F.col(label).isNull() & F.col(known).isNotNull()).alias("n_missing"), F.try_divide(same, told).alias("agreement"))
    if least is None:
        return g
    low = F.coalesce(F.col("agreement"), F.lit(0.0)) < least
    return g.withColumn("agreement", F.when(low, F.raise_error(F.format_string(f"labels agree on %.4f of rows, less than {least}", "agreement")).cast("double")).otherwise(F.col("agreement")))


def log_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count("target").alias("resolved"), (F.count("*") - F.count("target")).alias("pending"))


def summary(ledger: DataFrame) -> DataFrame:
    """Counts of a ledger; without a settled row the win rate is null."""
    won = F.count_if(F.col("result") == "WIN")
    settled = F.count_if(F.col("status") == "settled")
    return ledger.agg(settled.alias("settled"), won.alias("wins"), F.count_if(F.col("result") == "LOSS").alias("losses"), F.try_divide(won, settled).alias("win_rate"), F.sum("pnl_usdc").alias("pnl"), F.count_if(F.col("status") == "open").alias("open"))


def ask_buckets(settled: DataFrame, width: float = 0.05) -> DataFrame:
    """Win rate against break-even and profit by bucket of the entry price."""
    b = F.floor(F.col("ask") / width + 1e-9)
    return settled.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("won").cast("int")).alias("win_rate"), F.avg("ask").alias("break_even"), F.sum("pnl_share").alias("pnl"))
