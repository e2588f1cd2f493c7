"""Readers and normalisers of landed feeds, resume and compaction, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from slotforge.functions.features import epoch_seconds

TICKS = StructType([StructField("market_id", StringType()), StructField("timestamp_ms", LongType()), StructField("outcome", StringType()), StructField("side", StringType()), StructField("price", DoubleType()), StructField("size_usdc", DoubleType())])
SLOTS = StructType([StructField("market_id", StringType()), StructField("slug", StringType()), StructField("slot_ts", LongType()), StructField("target", IntegerType())])
CANDLES = StructType([StructField("timestamp_ms", LongType()), *(StructField(n, DoubleType()) for n in ("open", "high", "low", "close", "volume"))])


def read_slots(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; the id stays a string whatever it looks like."""
    return spark.read.schema(SLOTS).option("header", True).option("mode", "FAILFAST").csv(path)


def read_ticks(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Only the tick columns, and only markets in ``ids`` where it is given."""
    t = spark.read.parquet(path).select(*(f.name for f in TICKS.fields))
    return t.join(ids.select("market_id"), "market_id", "left_semi") if ids is not None else t


def read_markets(spark: SparkSession, path: str, ids: list[str] | DataFrame, most: int = 1_000) -> DataFrame:
    """Ticks of the markets named. A list of up to ``most`` ids is pushed into the scan as a literal filter, which skips row
    groups by their statistics; more ids, or a table of them, become a semi join that the optimiser prunes by.
    """
    spark_ids = spark.createDataFrame([(i,) for i in ids], "market_id string") if isinstance(ids, list) and len(ids) > most else ids
    t = spark.read.parquet(path)
    if isinstance(spark_ids, list):
        return t.where(F.col("market_id").isin(spark_ids))
    return t.join(spark_ids.select("market_id").distinct(), "market_id", "left_semi")


def ladder(text: Column) -> Column:
    """One side of a book, as JSON of any of its shapes, to an array of (price, size).

    An array of objects (price/size or p/s), an array of pairs, an object of size by price, or a string that holds one of
    these; numbers may be strings. Levels without a price or size, and those that aren't numbers, are left out. What is
    neither array nor object, broken text too, is null.
    """
    v = F.try_parse_json(text)
    inner = F.try_variant_get(v, "$", "string")
    v = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(inner)).otherwise(v)
    number = lambda e, *paths: F.coalesce(*(F.try_variant_get(e, p, "double") for p in paths))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.struct(number(e, "$.price", "$.p", "$[0]").alias("price"), number(e, "$.size", "$.s", "$[1]").alias("size")))
    pairs = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].try_cast("double").alias("price"), number(e["value"], "$").alias("size")))
    return F.filter(F.coalesce(items, pairs), lambda x: x["price"].isNotNull() & x["size"].isNotNull())


def read_partition(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """A partitioned table pruned to the named partition."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines of JSON; a broken line is kept in ``_corrupt`` with all else null."""
    wide = StructType([*schema.fields, StructField("_corrupt", StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def aligned_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks are 0 there."""
    added = sorted((set(a.columns) ^ set(b.columns)))
    return a.unionByName(b, allowMissingColumns=True).fillna(0, subset=added) if added else a.unionByName(b)


def kline_rows(rows: DataFrame, column: str) -> DataFrame:
    """A JSON array of at least six positional fields to a typed bar, one for each open time (the first in file order)."""
    a = F.from_json(column, "array<string>")
    bars = rows.select("seq", a.alias("a")).where(F.size("a") >= 6)
    typed = bars.select("seq", F.col("a")[0].try_cast("long").alias("timestamp_ms"), *(F.col("a")[k].try_cast("double").alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)))
    typed = typed.where("timestamp_ms IS NOT NULL")
    return typed.groupBy("timestamp_ms").agg(F.min_by(F.struct("open", "high", "low", "close", "volume"), "seq").alias("b")).select("timestamp_ms", "b.*")


def json_list(col: Column) -> Column:
    """A JSON array whose items are strings or numbers, or a string that holds such an array."""
    text = F.when(F.substring(F.trim(col), 1, 1) == '"', F.from_json(F.concat(F.lit('{"x":'), col, F.lit("}")), "x string")["x"]).otherwise(col)
    return F.from_json(text, "array<string>")


def resolved_markets(catalogue: DataFrame, asset: str, timeframes: tuple[str, ...] = ("5-minute", "5-min"), strict: bool = False) -> DataFrame:
    """Resolved markets of an asset and timeframe with a slot time in their slug; ``strict`` wants a result of 0 or 1."""
    done = F.col("resolution").isin(0, 1) if strict else F.col("resolution") != -1
    kept = catalogue.where((F.col("crypto") == asset) & F.col("timeframe").isin(*timeframes) & done)
    return kept.withColumn("slot_ts", slug_time(F.col("slug"))).where("slot_ts > 0")


def slug_time(slug: Column) -> Column:
    """The last part of a slug where it is all digits, else 0."""
    last = F.element_at(F.split(slug, "-"), -1)
    return F.when(last.rlike("^[0-9]+$"), last.try_cast("long")).otherwise(F.lit(0).cast("long"))


# Phrases that mark a question, hints that mark a slug.
PHRASES = ("bitcoin up or down", "btc up or down", "will btc be up", "will bitcoin be up", "will btc be higher", "will bitcoin be higher")
HINTS = ("bitcoin-up-or-down", "btc-up-or-down", "btc-updown", "bitcoin-updown")


def is_short_market(question: Column, slug: Column, outcomes: Column) -> Column:
    """A short-horizon market: a phrase or a hint, and exactly two outcomes."""
    said = F.lower(F.coalesce(question, F.lit(""))).rlike("|".join(PHRASES)) | F.lower(F.coalesce(slug, F.lit(""))).rlike("|".join(HINTS))
    return said & (F.coalesce(F.size(outcomes), F.lit(0)) == 2)


def normal_outcome(col: Column) -> Column:
    """yes, up and 0 are Up; no, down and 1 are Down; a null stays unknown."""
    low = F.lower(F.trim(col.cast("string")))
    return F.when(low.isin("yes", "up", "0"), "Up").when(low.isin("no", "down", "1"), "Down")


def market_rows(payload: DataFrame) -> DataFrame:
    """market_id, question, slug, outcomes, outcomePrices, closed (strings) to typed markets with a label.

    A price that isn't a number counts as 0.5. The market's price is that of ``Yes``, else of the first outcome. Label:
    first price at least 0.5 on closed markets; ``strict_target`` needs 0.99 on one side; a ``resolution`` wins.
    """
    p = payload.withColumns({"labels": json_list(F.col("outcomes")), "_p": json_list(F.col("outcomePrices"))})
    p = p.withColumn("prices", F.transform("_p", lambda x: F.coalesce(x.try_cast("double"), F.lit(0.5))))
    p = p.withColumn("by_label", F.map_from_entries(F.arrays_zip(F.col("labels"), F.col("prices"))))
    first, second = F.get("prices", F.lit(0)), F.get("prices", F.lit(1))
    price = F.coalesce(F.try_element_at("by_label", F.lit("Yes")), first)
    known = F.col("resolution").try_cast("int")
    loose = F.when(F.col("closed") == "true", F.when(first >= 0.5, 1).otherwise(0))
    strict = F.when(first >= 0.99, 1).when(second >= 0.99, 0)
    return p.select(
        "market_id", "slug", slug_time(F.col("slug")).alias("slot_ts"), price.alias("price"), is_short_market(F.col("question"), F.col("slug"), F.col("labels")).alias("is_short"),
        F.coalesce(known, loose).alias("target"), F.coalesce(known, strict).alias("strict_target"),
    )


def trade_rows(payload: DataFrame) -> DataFrame:
    """A JSON object in ``body`` with aliased fields to a tick; rows without a price, time or outcome are dropped."""
    get = lambda *names: F.coalesce(*(F.get_json_object("body", f"$.{n}") for n in names))
    time = get("timestamp", "createdAt")
    seconds = F.coalesce(F.when(time.try_cast("double").isNotNull(), epoch_seconds(time)), F.unix_micros(F.try_to_timestamp(time)) / 1e6)
    t = payload.select(
        "id", get("slug").alias("slug"), seconds.alias("ts"), F.coalesce(normal_outcome(get("outcome", "outcomeIndex")), F.lit(None)).alias("outcome"),
        F.upper(F.coalesce(get("type", "side"), F.lit("BUY"))).alias("side"), get("price").try_cast("double").alias("price"), get("usdcSize", "size").try_cast("double").alias("size_usdc"),
    )
    return t.where("price IS NOT NULL AND ts IS NOT NULL AND outcome IS NOT NULL")


def uncontaminated(trades: DataFrame, expected: Column, slot: Column, obs: float) -> DataFrame:
    """Trades of the expected slug (or without one) inside the observation window."""
    own = F.col("slug").isNull() | (F.col("slug") == "") | (F.col("slug") == expected)
    t = F.col("ts") - slot
    return trades.where(own & (t >= 0) & (t < obs))


def event_ticks(events: DataFrame, obs: float) -> DataFrame:
    """last_trade_price events to ticks: size is price times size, the outcome follows the price."""
    e = events.where((F.col("event_type") == "last_trade_price") & (F.col("t") >= 0) & (F.col("t") < obs))
    return e.select("market_id", "t", F.when(F.col("trade_price") >= 0.5, "Up").otherwise("Down").alias("outcome"), F.col("trade_side").alias("side"), F.col("trade_price").alias("price"), (F.col("trade_price") * F.col("trade_size")).alias("size_usdc"))


def pending(wanted: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """What the progress table doesn't name; failures count as done."""
    return wanted.join(progress.select(key), key, "left_anti")


def next_pending(wanted: DataFrame, progress: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` of what is pending, in order of the key: one batch of work."""
    return pending(wanted, progress, key).orderBy(key).limit(most)


def synthesised(slots: DataFrame, known: DataFrame, catalogue: DataFrame, key: str, field: str, default: str, before: int = 300, after: int = 300, unknown: int = 310) -> DataFrame:
    """Slots with a row's ``field`` from the known rows, else from the catalogue, else a default, and made-up bounds: start
    and end around the slot, closed ``after`` it for known rows and ``unknown`` for others. Both sides have a row a key."""
    k = known.select(key, F.col(field).alias("_known"), F.lit(True).alias("_is"))
    j = slots.join(k, key, "left").join(catalogue.select(key, F.col(field).alias("_listed")), key, "left")
    at = F.col("slot_ts")
    return j.select(*slots.columns, F.coalesce("_known", "_listed", F.lit(default)).alias(field), (at - before).alias("start_ts"), (at + after).alias("end_ts"), (at + F.when(F.col("_is"), after).otherwise(unknown)).alias("closed_ts"))


def slot_calendar(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    return spark.range(start, end, step).withColumnRenamed("id", "slot_ts")


def distinct_ticks(ticks: DataFrame, key: tuple[str, ...] = ("market_id", "timestamp_ms", "outcome", "side"), order: tuple[str, ...] = ("price", "size_usdc")) -> DataFrame:
    """One row of those with an equal key, the first in ``order`` (nulls first), with all its columns.

    The default key loses trades of one moment at other prices; a longer one keeps them.
    """
    rest = [c for c in ticks.columns if c not in key]
    first = F.struct(*order, *(c for c in rest if c not in order))
    return ticks.groupBy(*key).agg(F.min(first).alias("r")).select(*(c if c in key else F.col(f"r.{c}") for c in ticks.columns))


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Many files of a batch job to a few, in a new folder."""
    spark.read.parquet(source).repartition(files).write.mode("errorifexists").parquet(target)


def first_of(*tables: DataFrame, key: str) -> DataFrame:
    """Union in order of priority, one row a key: the earliest table's."""
    ranked = None
    for k, t in enumerate(tables):
        t = t.withColumn("_k", F.lit(k))
        ranked = t if ranked is None else ranked.unionByName(t)
    names = [c for c in ranked.columns if c not in (key, "_k")]
    return ranked.groupBy(key).agg(F.min_by(F.struct(*names), F.struct("_k", *names)).alias("r")).select(key, "r.*")


def replace_partition(table: DataFrame, fresh: DataFrame, **keys: str) -> DataFrame:
    """The table with one partition's rows replaced."""
    same = F.lit(True)
    for k, v in keys.items():
        same = same & (F.col(k) == v)
    return table.where(~F.coalesce(same, F.lit(False))).unionByName(fresh)


def write(df: DataFrame, path: str, kind: str = "parquet", *partitions: str) -> None:
    """Parquet, CSV or lines of JSON; appends to what is there only as new files."""
    w = df.write.mode("append" if kind == "json" else "errorifexists").partitionBy(*partitions)
    {"parquet": w.parquet, "csv": w.option("header", True).csv, "json": w.json}[kind](path)
