"""Domain tables derived from the given ones: ticks, candles, slots, books, predictions.

Each has a Spark form and, in ``SQL``, the same formula as a common table expression.
A slot lasts six hours and is observed for the first 60 % of it, in six sub-windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT, OBS, WINDOWS, HOUR = 21_600, 12_960, 6, 3_600
STEP = OBS // WINDOWS
DECAY = 0.02 / 72

EPOCH_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade ticks from events, all of a slot's (t_sec is not cut at OBS)."""
    e = table(spark, sf_dir, "events").withColumn("us", F.expr(EPOCH_US))
    e = e.withColumn("slot_ts", F.expr(f"us div {SLOT}000000 * {SLOT}"))
    up = F.col("event_type").isin("purchase", "signup")
    return e.select(
        "event_id",
        F.concat(F.lit("m"), F.col("slot_ts").cast("string")).alias("market_id"),
        "slot_ts",
        F.expr("us div 1000").alias("timestamp_ms"),
        (F.col("us") / 1e6 - F.col("slot_ts")).alias("t_sec"),
        F.when(up, "Up").otherwise("Down").alias("outcome"),
        F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        ((F.get_json_object("props", "$.k").cast("int") + 1) / 101.0).alias("price"),
        F.col("value").alias("size_usdc"),
    )


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values; hours without an event have none."""
    e = table(spark, sf_dir, "events").withColumn("us", F.expr(EPOCH_US))
    order = F.struct("us", "event_id")
    return e.groupBy(F.expr(f"us div {HOUR}000000 * {HOUR}").alias("ts")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").alias("volume"),
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a slot: target 1 if its last value is above its first."""
    e = table(spark, sf_dir, "events").withColumn("us", F.expr(EPOCH_US))
    order = F.struct("us", "event_id")
    up = F.max_by("value", order) > F.min_by("value", order)
    return e.groupBy(F.expr(f"us div {SLOT}000000 * {SLOT}").alias("slot_ts")).agg(F.when(up, 1).otherwise(0).alias("target")).select(
        F.concat(F.lit("m"), F.col("slot_ts").cast("string")).alias("market_id"),
        F.concat(F.lit("btc-updown-6h-"), F.col("slot_ts").cast("string")).alias("slug"),
        "slot_ts",
        "target",
    )


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order books from line items: asks ascending, bids descending, as arrays of (price, size); prices of 1 to 99 cents."""
    line = table(spark, sf_dir, "lineitem").withColumn("level", F.struct(((F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) % 99 + 1) / 100.0).alias("price"), F.col("l_quantity").alias("size")))
    side = lambda s: F.collect_list(F.when(F.col("l_linestatus") == s, F.col("level")))
    return line.groupBy(F.col("l_orderkey").alias("book_id")).agg(F.sort_array(side("F")).alias("asks"), F.sort_array(side("O"), asc=False).alias("bids"))


def round6(col: Column | str, places: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, places)


SQL = {
    "ticks": f"""ticks AS (
        SELECT event_id, 'm' || (epoch_us(ts) // {SLOT}000000 * {SLOT}) AS market_id,
               epoch_us(ts) // {SLOT}000000 * {SLOT} AS slot_ts, epoch_us(ts) // 1000 AS timestamp_ms,
               epoch_us(ts) / 1e6 - (epoch_us(ts) // {SLOT}000000 * {SLOT}) AS t_sec,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'Up' ELSE 'Down' END AS outcome,
               CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
               (CAST(json_extract_string(props, '$.k') AS INT) + 1) / 101.0 AS price, value AS size_usdc
        FROM events)""",
    "candles": f"""candles AS (
        SELECT epoch_us(ts) // {HOUR}000000 * {HOUR} AS ts, arg_min(value, (epoch_us(ts), event_id)) AS open, max(value) AS high,
               min(value) AS low, arg_max(value, (epoch_us(ts), event_id)) AS close, count(*) AS volume
        FROM events GROUP BY 1)""",
    "slots": f"""slots AS (
        SELECT 'm' || s AS market_id, 'btc-updown-6h-' || s AS slug, s AS slot_ts, target FROM (
            SELECT epoch_us(ts) // {SLOT}000000 * {SLOT} AS s,
                   CASE WHEN arg_max(value, (epoch_us(ts), event_id)) > arg_min(value, (epoch_us(ts), event_id)) THEN 1 ELSE 0 END AS target
            FROM events GROUP BY 1))""",
    "ladders": """levels AS (
        SELECT l_orderkey AS book_id, l_linestatus AS s, (CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) % 99 + 1) / 100.0 AS price, l_quantity AS size FROM lineitem),
        ladders AS (
        SELECT book_id, coalesce(list({'price': price, 'size': size} ORDER BY price, size) FILTER (s = 'F'), []) AS asks,
               coalesce(list({'price': price, 'size': size} ORDER BY price DESC, size DESC) FILTER (s = 'O'), []) AS bids
        FROM levels GROUP BY 1)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
