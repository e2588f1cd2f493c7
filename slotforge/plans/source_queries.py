"""Landed feeds, joins by id, unions and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slotforge import fixtures as X
from slotforge.functions.features import epoch_near, epoch_seconds, iso_seconds, time_parts
from slotforge.operators import book
from slotforge.plans.registry import query, rounded, share
from slotforge.sources import landed, versioned
from slotforge.storage import new_path


@query(f"""{X.ctes("ticks", "slots")} SELECT market_id, count(*) AS n, round(sum(size_usdc), 4) AS volume FROM ticks WHERE market_id IN (SELECT market_id FROM slots WHERE target = 1) GROUP BY 1""")
def s_semi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of chosen markets written, read back with pruned columns and a semi join on ids."""
    path = new_path(spark, "ticks")
    landed.write(X.ticks(spark, sf_dir), path)
    t = landed.read_ticks(spark, path, X.slots(spark, sf_dir).where("target = 1"))
    return t.groupBy("market_id").agg(F.count("*").alias("n"), F.round(F.sum("size_usdc"), 4).alias("volume"))


@query(f"{X.ctes('slots')} SELECT market_id, slug, slot_ts, target FROM slots")
def s_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "slots")
    landed.write(X.slots(spark, sf_dir), path, "csv")
    return landed.read_slots(spark, path)


@query(f"{X.ctes('ticks')} SELECT event_id, side, outcome, round(price, 6) AS price FROM ticks WHERE side = 'BUY' AND outcome = 'Up'")
def s_partitioned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hive-style partitions written by side and outcome, read back pruned to one."""
    path = new_path(spark, "partitioned")
    landed.write(X.ticks(spark, sf_dir).select("event_id", "price", "side", "outcome"), path, "parquet", "side", "outcome")
    return rounded(landed.read_partition(spark, path, side="BUY", outcome="Up").select("event_id", "side", "outcome", "price"))


@query(f"{X.ctes('candles')} SELECT ts * 1000 AS timestamp_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CAST(volume AS DOUBLE) AS volume FROM candles")
def s_kline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar landed as an array of twelve fields, every third one twice."""
    c = X.candles(spark, sf_dir)
    fields = [F.col("ts") * 1000, "open", "high", "low", "close", "volume", *[F.lit("0")] * 6]
    row = F.to_json(F.array(*((F.col(x) if isinstance(x, str) else x).cast("string") for x in fields)))
    twice = F.when(F.expr("ts div 3600 % 3") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rounded(landed.kline_rows(c.select(row.alias("row"), F.explode(twice).alias("seq")), "row"))


_MARKETS = f"""{X.ctes("slots")}, m AS (SELECT *, slot_ts // 21600 AS k FROM slots), q AS (SELECT *, k % 100 / 100.0 AS p FROM m)"""


@query(f"""{_MARKETS} SELECT market_id, slug, slot_ts, CASE WHEN k % 11 = 0 THEN 0.5 ELSE round(p, 2) END AS price, k % 5 <> 0 OR k % 2 = 0 AS is_short,
    CASE WHEN k % 13 = 0 THEN 1 WHEN k % 3 = 0 THEN CASE WHEN k % 11 = 0 OR p >= 0.5 THEN 1 ELSE 0 END END AS target,
    CASE WHEN k % 13 = 0 THEN 1 WHEN k % 11 = 0 THEN CASE WHEN 1 - p >= 0.99 THEN 0 END WHEN p >= 0.99 THEN 1 WHEN 1 - p >= 0.99 THEN 0 END AS strict_target FROM q""")
def s_market_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed market payloads: lists as JSON or as a string that holds JSON, bad prices, three ways to a label."""
    m = X.slots(spark, sf_dir).withColumn("k", F.expr("slot_ts div 21600"))
    p = F.col("k") % 100 / 100.0
    first = F.when(F.col("k") % 11 == 0, F.lit("n/a")).otherwise(F.round(p, 2).cast("string"))
    prices = F.to_json(F.array(first, F.round(1 - p, 2).cast("string")))
    names = F.to_json(F.array(F.when(F.col("k") % 2 == 0, "Yes").otherwise("Up"), F.lit("Down")))
    quoted = F.concat(F.lit('"'), F.regexp_replace(names, '"', r'\\"'), F.lit('"'))
    body = m.select(
        "market_id", F.when(F.col("k") % 5 == 0, "Will it rain?").otherwise("Bitcoin Up or Down today?").alias("question"),
        F.when((F.col("k") % 5 == 0) & (F.col("k") % 2 == 1), F.concat(F.lit("asset-rain-"), F.col("slot_ts").cast("string"))).otherwise(F.col("slug")).alias("slug"), F.col("slug").alias("own"),
        F.when(F.col("k") % 7 == 0, quoted).otherwise(names).alias("outcomes"), prices.alias("outcomePrices"),
        F.when(F.col("k") % 3 == 0, "true").otherwise("false").alias("closed"), F.when(F.col("k") % 13 == 0, "1").alias("resolution"),
    )
    rows = landed.market_rows(body).join(body.select("market_id", "own"), "market_id")
    return rows.withColumn("slug", F.col("own")).drop("own")


@query(f"""{X.ctes("ticks")} SELECT event_id AS id, slot_ts, outcome, side, round(price, 6) AS price, round(size_usdc, 6) AS size_usdc FROM ticks WHERE event_id % 17 <> 0 AND event_id % 19 <> 0 AND t_sec < {X.OBS}""")
def s_trade_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed trades with aliased fields and three kinds of time; broken rows and other markets' rows are dropped."""
    t = X.ticks(spark, sf_dir)
    text = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    time = F.when(F.col("event_id") % 3 == 0, text).when(F.col("event_id") % 3 == 1, F.col("timestamp_ms").cast("string")).otherwise((F.col("timestamp_ms") / 1000.0).cast("decimal(18,3)").cast("string"))
    alias = F.col("event_id") % 2 == 0
    body = F.to_json(F.struct(
        F.when(F.col("event_id") % 19 == 0, "another-0").when(F.col("event_id") % 5 == 0, "").otherwise(F.col("market_id")).alias("slug"),
        F.when(alias, time).alias("timestamp"), F.when(~alias, time).alias("createdAt"),
        F.when(F.col("outcome") == "Up", F.when(alias, "yes").otherwise("0")).otherwise(F.when(alias, "Down").otherwise("1")).alias("outcome"),
        F.when(alias, F.lower("side")).alias("type"), F.when(~alias, F.col("side")).alias("side"),
        F.when(F.col("event_id") % 17 == 0, "bad").otherwise(F.col("price").cast("string")).alias("price"), F.when(alias, F.col("size_usdc")).alias("usdcSize"), F.when(~alias, F.col("size_usdc")).alias("size"),
    ))
    trades = landed.trade_rows(t.select(F.col("event_id").alias("id"), body.alias("body"))).join(t.select(F.col("event_id").alias("id"), "market_id", "slot_ts"), "id")
    kept = landed.uncontaminated(trades, F.col("market_id"), F.col("slot_ts"), X.OBS)
    return rounded(kept.select("id", "slot_ts", "outcome", "side", "price", "size_usdc"))


@query("""SELECT event_id, round(CASE WHEN event_id % 4 = 3 THEN 0 ELSE epoch_us(ts) / 1e6 END, 3) AS seconds FROM events""")
def s_epoch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that came as seconds, milliseconds, microseconds, or not as numbers."""
    e = X.table(spark, sf_dir, "events").withColumn("us", F.expr(X.EPOCH_US))
    k = F.col("event_id") % 4
    came = F.when(k == 0, (F.col("us") / 1e6).cast("decimal(20,6)").cast("string")).when(k == 1, (F.col("us") / 1e3).cast("decimal(20,3)").cast("string")).when(k == 2, F.col("us").cast("string")).otherwise("soon")
    return e.select("event_id", F.round(epoch_seconds(came), 3).alias("seconds"))


@query(f"""{X.ctes("candles")}, g AS (SELECT unnest(range((SELECT min(ts) FROM candles), (SELECT max(ts) + 3600 FROM candles), 3600)) AS slot_ts)
    SELECT slot_ts FROM g WHERE slot_ts NOT IN (SELECT ts FROM candles) AND slot_ts // 3600 % 10 <> 0""")
def s_missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar less what exists, less what a progress table already names."""
    c = X.candles(spark, sf_dir)
    a, b = c.agg(F.min("ts"), F.max("ts")).first()
    calendar = landed.slot_calendar(spark, a, b + 3600, 3600)
    progress = calendar.where(F.expr("slot_ts div 3600 % 10 = 0"))
    missing = landed.pending(calendar, c.select(F.col("ts").alias("slot_ts")), "slot_ts")
    return landed.pending(missing, progress, "slot_ts")


@query(f"""{X.ctes("candles")}, g AS (SELECT unnest(range((SELECT min(ts) FROM candles), (SELECT max(ts) + 3600 FROM candles), 3600)) AS slot_ts)
    SELECT slot_ts FROM g WHERE slot_ts // 3600 % 10 <> 0 ORDER BY 1 LIMIT 25""")
def k_next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of slots that a progress table doesn't name; the limit is the operator."""
    a, b = X.candles(spark, sf_dir).agg(F.min("ts"), F.max("ts")).first()
    calendar = landed.slot_calendar(spark, a, b + 3600, 3600)
    return landed.next_pending(calendar, calendar.where(F.expr("slot_ts div 3600 % 10 = 0")), "slot_ts", 25)


@query(f"""{X.ctes("candles")}, a AS (SELECT ts, round(close, 6) AS close, 'a' AS feed FROM candles WHERE ts // 3600 % 3 <> 0), b AS (SELECT ts, round(close * 2, 6) AS close, 'b' AS feed FROM candles WHERE ts // 3600 % 2 = 0)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE ts NOT IN (SELECT ts FROM a)""")
def u_union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping candle files; the first one's bar stays."""
    c = X.candles(spark, sf_dir)
    a = c.where("ts div 3600 % 3 <> 0").select("ts", F.round("close", 6).alias("close"), F.lit("a").alias("feed"))
    b = c.where("ts div 3600 % 2 = 0").select("ts", F.round(F.col("close") * 2, 6).alias("close"), F.lit("b").alias("feed"))
    return landed.first_of(a, b, key="ts")


@query(f"""{X.ctes("ticks")}, t AS (SELECT market_id, timestamp_ms // 600000 * 600000 AS timestamp_ms, outcome, side FROM ticks) SELECT count(*) AS n_all, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n_distinct,
    (SELECT count(*) FROM ticks WHERE event_id % 2 = 0) AS with_spot FROM t""")
def u_dedup_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two sources with different columns, then duplicates on a chosen key."""
    t = X.ticks(spark, sf_dir).withColumn("timestamp_ms", F.expr("timestamp_ms div 600000 * 600000"))
    a = t.where("event_id % 2 = 0").select("market_id", "timestamp_ms", "outcome", "side", F.lit(1.0).alias("spot_price_usdt"))
    b = t.where("event_id % 2 <> 0").select("market_id", "timestamp_ms", "outcome", "side")
    both = landed.aligned_union(a, b)
    key = F.struct("market_id", "timestamp_ms", "outcome", "side")
    return both.agg(F.count("*").alias("n_all"), F.countDistinct(key).alias("n_distinct"), F.count_if(F.col("spot_price_usdt") > 0).alias("with_spot"))


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'
    UNION ALL SELECT o_orderpriority, 1.0 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0) GROUP BY 1""")
def u_replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    fresh = o.where("o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(1.0))
    r = landed.replace_partition(o, fresh, o_orderpriority="1-URGENT")
    return r.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS n_broken, round((SELECT sum(o_totalprice) FROM orders WHERE o_orderkey % 10 <> 0), 2) AS total")
def s_tolerant_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, every tenth one cut short; broken lines are kept apart and counted."""
    o = X.table(spark, sf_dir, "orders")
    line = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    path = new_path(spark, "lines")
    o.select(F.when(F.col("o_orderkey") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    r = landed.read_jsonl(spark, path, StructType.fromDDL("o_orderkey long, o_totalprice double"))
    broken = F.col("_corrupt").isNotNull()
    return r.agg(F.count("*").alias("n_rows"), F.count_if(broken).alias("n_broken"), F.round(F.sum(F.when(~broken, F.col("o_totalprice"))), 2).alias("total"))


@query("""SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""")
def p_resolved_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue filter by joined dimensions."""
    c, n, r = (X.table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r.where("r_name = 'EUROPE'"), n.n_regionkey == r.r_regionkey).agg(F.count("*").alias("n"))


@query(f"""{X.ctes("slots")} SELECT s.market_id, coalesce(k.o_orderstatus, c.c_mktsegment, 'unknown') AS source, CAST(s.slot_ts - 300 AS BIGINT) AS start_ts, CAST(s.slot_ts + 300 AS BIGINT) AS end_ts,
    CAST(s.slot_ts + CASE WHEN k.o_orderkey IS NOT NULL THEN 300 ELSE 310 END AS BIGINT) AS closed_ts FROM slots s
    LEFT JOIN orders k ON k.o_orderkey = s.slot_ts // 21600 - 78888 LEFT JOIN customer c ON c.c_custkey = s.slot_ts // 21600 - 78888""")
def p_synthesised_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known row's fields, else the catalogue's, else defaults."""
    s = X.slots(spark, sf_dir).withColumn("k", F.expr("slot_ts div 21600 - 78888"))
    known = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("source"))
    cat = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("source"))
    return landed.synthesised(s, known, cat, "k", "source", "unknown").select("market_id", "source", "start_ts", "end_ts", "closed_ts")


_CATALOGUE = f"""{X.ctes("slots")}, cat AS (SELECT market_id, slot_ts // 21600 AS k, target FROM slots), c AS (SELECT market_id, CASE WHEN k % 3 = 0 THEN 'ETH' ELSE 'BTC' END AS crypto,
    CASE WHEN k % 4 = 0 THEN '1-hour' WHEN k % 4 = 1 THEN '5-min' ELSE '5-minute' END AS timeframe, CASE WHEN k % 7 = 0 THEN -1 ELSE target END AS resolution, k FROM cat)"""


@query(f"{_CATALOGUE} SELECT market_id, CAST(k * 21600 AS BIGINT) AS slot_ts, resolution FROM c WHERE crypto = 'BTC' AND timeframe IN ('5-minute', '5-min') AND resolution IN (0, 1) AND k % 11 <> 0")
def p_resolved_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved markets of one asset and timeframe; slugs without a time at their end are left out."""
    k = F.expr("slot_ts div 21600")
    s = X.slots(spark, sf_dir).select(
        "market_id", F.when(k % 11 == 0, F.lit("btc-updown-soon")).otherwise(F.col("slug")).alias("slug"), F.when(k % 3 == 0, "ETH").otherwise("BTC").alias("crypto"),
        F.when(k % 4 == 0, "1-hour").when(k % 4 == 1, "5-min").otherwise("5-minute").alias("timeframe"), F.when(k % 7 == 0, -1).otherwise(F.col("target")).alias("resolution"),
    )
    return landed.resolved_markets(s, "BTC", strict=True).select("market_id", "slot_ts", "resolution")


@query(f"""{X.ctes("slots", "candles")}, book AS (SELECT DISTINCT ts // 21600 * 21600 AS slot_ts FROM candles WHERE volume > 20)
    SELECT (SELECT count(*) FROM (SELECT slot_ts FROM slots INTERSECT SELECT slot_ts FROM book)) AS n_both, (SELECT count(*) FROM (SELECT slot_ts FROM slots EXCEPT SELECT slot_ts FROM book)) AS n_without,
    round((SELECT count(*) FROM (SELECT slot_ts FROM slots INTERSECT SELECT slot_ts FROM book)) / (SELECT count(*) FROM slots), 6) AS coverage""")
def u_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of two id sets in one full join of distinct ids."""
    a = X.slots(spark, sf_dir).select("slot_ts").distinct().withColumn("a", F.lit(True))
    b = X.candles(spark, sf_dir).where("volume > 20").select(F.expr("ts div 21600 * 21600").alias("slot_ts")).distinct().withColumn("b", F.lit(True))
    j = a.join(b, "slot_ts", "full")
    both, alone = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") & F.col("b").isNull())
    return j.agg(both.alias("n_both"), alone.alias("n_without"), F.round(share(both, F.count("a")), 6).alias("coverage"))


@query("""WITH e AS (SELECT 'm' || (l_suppkey % 20) AS market_id, CAST(l_orderkey % 200 AS DOUBLE) AS t, (floor(l_extendedprice / l_quantity * 100) % 99 + 1) / 100 AS p, l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side
        FROM lineitem WHERE l_linestatus = 'F')
    SELECT market_id, CASE WHEN p >= 0.5 THEN 'Up' ELSE 'Down' END AS outcome, side, count(*) AS n, round(sum(p * q), 4) AS size_usdc FROM e WHERE t < 180 GROUP BY ALL""")
def s_event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade events of an order-book feed as ticks, summed by market, outcome and side; line items stand for the events."""
    l = X.table(spark, sf_dir, "lineitem")
    events = l.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 20).cast("string")).alias("market_id"), (F.col("l_orderkey") % 200).cast("double").alias("t"), F.when(F.col("l_linestatus") == "F", "last_trade_price").otherwise("book").alias("event_type"),
        ((F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) % 99 + 1) / 100).alias("trade_price"), F.col("l_quantity").cast("double").alias("trade_size"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("trade_side"),
    )
    return rounded(landed.event_ticks(events, 180).groupBy("market_id", "outcome", "side").agg(F.count("*").alias("n"), F.sum("size_usdc").alias("size_usdc")), 4)


@query(f"""{X.ctes("ticks")}, t AS (SELECT event_id, market_id, timestamp_ms // 600000 * 600000 AS timestamp_ms, outcome, side, price, size_usdc FROM ticks),
    r AS (SELECT *, row_number() OVER (PARTITION BY market_id, timestamp_ms, outcome, side ORDER BY price, size_usdc, event_id) AS k FROM t)
    SELECT event_id, market_id, timestamp_ms, outcome, side, round(price, 6) AS price, round(size_usdc, 6) AS size_usdc FROM r WHERE k = 1""")
def u_distinct_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.ticks(spark, sf_dir).withColumn("timestamp_ms", F.expr("timestamp_ms div 600000 * 600000"))
    return rounded(landed.distinct_ticks(t.select("event_id", "market_id", "timestamp_ms", "outcome", "side", "price", "size_usdc")))


@query(f"""{X.ctes("ticks")}, d AS (SELECT min(slot_ts) AS a FROM ticks) SELECT event_id, market_id, round(price, 6) AS price FROM ticks, d WHERE slot_ts < a + 86400""")
def s_pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the markets of the first day, which the scan itself filters."""
    path = new_path(spark, "ticks")
    X.ticks(spark, sf_dir).repartitionByRange(4, "market_id").sortWithinPartitions("market_id").write.parquet(path)
    slots = X.slots(spark, sf_dir)
    ids = [r.market_id for r in slots.join(F.broadcast(slots.agg(F.min("slot_ts").alias("a"))), F.col("slot_ts") < F.col("a") + 86_400).select("market_id").collect()]  # a day's slots
    return rounded(landed.read_markets(spark, path, ids).select("event_id", "market_id", "price"))


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ticks-by-day")
    X.ticks(spark, sf_dir).withColumn("day", F.expr("slot_ts div 86400")).write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


@query(f"""{X.ctes("ticks", "slots")} SELECT t.market_id, count(*) AS n, round(sum(size_usdc), 4) AS volume FROM ticks t JOIN slots s USING (market_id) WHERE target = 1 AND s.slot_ts // 86400 % 5 = 0 GROUP BY 1""")
def s_dynamic_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks partitioned by day joined with chosen slots: days without one aren't read."""
    slots = X.slots(spark, sf_dir).withColumn("day", F.expr("slot_ts div 86400")).where("target = 1 AND day % 5 = 0").select("market_id", "day")
    t = _by_day(spark, sf_dir).join(slots, ["market_id", "day"])
    return t.groupBy("market_id").agg(F.count("*").alias("n"), F.round(F.sum("size_usdc"), 4).alias("volume"))


@query("""WITH l AS (SELECT l_orderkey AS book_id, (CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) % 99 + 1) / 100.0 AS price, CAST(sum(l_quantity) AS DOUBLE) AS size FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
    SELECT book_id, CASE WHEN book_id % 11 <> 0 THEN count(*) END AS n_levels, CASE WHEN book_id % 11 <> 0 THEN round(min(price), 6) END AS best, CASE WHEN book_id % 11 <> 0 THEN round(sum(size), 4) END AS depth FROM l GROUP BY 1""")
def f_ladder_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask ladders landed as JSON in five shapes, and broken for every eleventh book."""
    li = X.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) % 99 + 1) / 100.0
    levels = li.groupBy(F.col("l_orderkey").alias("book_id"), price.alias("price")).agg(F.sum("l_quantity").cast("double").alias("size"))
    books = levels.groupBy("book_id").agg(F.collect_list(F.struct("price", "size")).alias("l"))
    objects = F.to_json("l")
    short = F.to_json(F.transform("l", lambda x: F.struct(x["price"].cast("string").alias("p"), x["size"].cast("string").alias("s"))))
    pairs = F.to_json(F.transform("l", lambda x: F.array(x["price"], x["size"])))
    by_price = F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["price"].cast("string").alias("key"), x["size"].alias("value")))))
    held = F.concat(F.lit('"'), F.replace(objects, F.lit('"'), F.lit('\\"')), F.lit('"'))
    k = F.col("book_id") % 5
    text = F.when(F.col("book_id") % 11 == 0, F.lit("[{broken")).when(k == 0, objects).when(k == 1, short).when(k == 2, pairs).when(k == 3, by_price).otherwise(held)
    parsed = books.select("book_id", landed.ladder(text).alias("asks"))
    return parsed.select(
        "book_id", F.when(F.col("asks").isNotNull(), F.size("asks")).cast("long").alias("n_levels"), F.round(book.best_ask(F.col("asks")), 6).alias("best"),
        F.when(F.col("asks").isNotNull(), F.round(book.total(F.col("asks")), 4)).alias("depth"),
    )


@query(f"""{X.ctes("slots")} SELECT slot_ts, CASE WHEN slot_ts // 86400 % 4 = 0 THEN 1 - target ELSE target END AS target FROM slots WHERE slot_ts // 86400 % 9 <> 1""")
def s_partition_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by day of which some days are rewritten and some end, all compacted and swapped in by its manifest."""
    root, day = new_path(spark, "versioned"), F.expr("slot_ts div 86400")
    slots = X.slots(spark, sf_dir).select("slot_ts", "target")
    versioned.replace(slots, root, day)
    gone = [k for k in versioned.manifest(spark, root)["parts"] if int(k) % 9 == 1]
    versioned.replace(slots.where((day % 4 == 0) & (day % 9 != 1)).withColumn("target", 1 - F.col("target")), root, day, gone=gone)
    versioned.compact(spark, root, day)
    return versioned.read(spark, root)


@query(f"""WITH b AS (SELECT event_id, ts FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, ts FROM events WHERE event_id % 3 = 0) SELECT event_id % 10 AS digit, count(*) AS n, max(epoch_us(ts)) AS newest_us FROM b GROUP BY 1""")
def s_jsonl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one log of JSON lines and read back."""
    path = new_path(spark, "log")
    e = X.table(spark, sf_dir, "events").select("event_id", F.expr(X.EPOCH_US).alias("us"))
    for n in (2, 3):
        landed.write(e.where(F.col("event_id") % n == 0), path, "json")
    back = landed.read_jsonl(spark, path, e.schema)
    return back.groupBy((F.col("event_id") % 10).alias("digit")).agg(F.count("*").alias("n"), F.max("us").alias("newest_us"))


@query("""SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS seconds, strftime(ts, '%Y-%m-%d %H:%M') AS label, CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute, CAST(isodow(ts) - 1 AS BIGINT) AS weekday,
    CASE WHEN event_id % 5 <> 0 THEN round(epoch_us(date_trunc('second', ts)) / 1e6, 3) END AS parsed FROM events""")
def f_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of times that came as seconds or milliseconds, their label and parts, and ISO texts read back, some broken."""
    e = X.table(spark, sf_dir, "events").withColumn("us", F.expr(X.EPOCH_US))
    came = F.when(F.col("event_id") % 2 == 0, (F.col("us") / 1e6).cast("decimal(20,6)").cast("string")).otherwise((F.col("us") / 1e3).cast("decimal(20,3)").cast("string"))
    iso = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    seconds = epoch_near(came, F.lit(1.72e9))
    return e.select("event_id", F.round(seconds, 3).alias("seconds"), *time_parts(F.expr("us div 1000000")), F.round(iso_seconds(iso), 3).alias("parsed"))
