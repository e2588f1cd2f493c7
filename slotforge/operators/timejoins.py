"""Time joins on a candle grid: as-of values, interval aggregates, endpoints, spot features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filled_grid(candles: DataFrame, step: int, value: str = "close", day: int = 86_400) -> DataFrame:
    """Every grid time between the first and last candle with the last value at or before it.

    The grid is filled day by day; a day starts with what the day before carried in, so no task holds the whole series.
    """
    first, last_ts = candles.agg(F.min("ts"), F.max("ts")).first()
    grid = candles.sparkSession.range(first or 0, (last_ts + 1) if last_ts is not None else 0, step).toDF("ts")
    dayed = candles.withColumn("d", F.floor(F.col("ts") / day))
    last = dayed.groupBy("d").agg(F.max_by(value, "ts").alias("last"))
    days = grid.select(F.floor(F.col("ts") / day).alias("d")).distinct().join(last, "d", "left")
    carried = days.select("d", F.last("last", True).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))  # one row a day
    rows = grid.join(candles.select("ts", F.col(value).alias("v")), "ts", "left").withColumn("d", F.floor(F.col("ts") / day)).join(carried, "d", "left")
    upto = Window.partitionBy("d").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("ts", F.coalesce(F.last("v", True).over(upto), F.col("carry")).alias(value))


def as_of(points: DataFrame, time: Column, candles: DataFrame, step: int, name: str, value: str = "close", close_known: bool = False) -> DataFrame:
    """Add the value of the last candle with ts <= time, clamped to the first and last candle: an equi-join on the grid.

    ``close_known`` uses only candles that have closed by then (the candle's time is its open time).
    """
    ends = candles.agg(F.min("ts"), F.max("ts")).first()
    t = time - step if close_known else time
    grid = filled_grid(candles, step, value).select(F.col("ts").alias("_g"), F.col(value).alias(name))
    if ends[0] is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    key = F.least(F.greatest((F.floor((t - ends[0]) / step) * step + ends[0]).cast("long"), F.lit(ends[0])), F.lit(ends[1]))
    return points.withColumn("_k", key).join(grid, F.col("_k") == F.col("_g"), "left").drop("_k", "_g")


def as_of_all(points: DataFrame, key: str, times: dict[str, Column], candles: DataFrame, step: int, value: str = "close") -> DataFrame:
    """``as_of`` for several times of each point (``key`` is unique) with one fill of the grid and one join."""
    ends = candles.agg(F.min("ts"), F.max("ts")).first()
    if ends[0] is None:
        return points.select("*", *(F.lit(None).cast("double").alias(n) for n in times))
    place = lambda t: F.least(F.greatest((F.floor((t - ends[0]) / step) * step + ends[0]).cast("long"), F.lit(ends[0])), F.lit(ends[1]))
    wanted = points.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), place(t).alias("g")) for n, t in times.items()))).alias("_x")).select(key, "_x.n", "_x.g")
    found = wanted.join(filled_grid(candles, step, value), F.col("g") == F.col("ts")).groupBy(key).agg(*(F.max(F.when(F.col("n") == n, F.col(value))).alias(n) for n in times))
    return points.join(found, key, "left")


def as_of_join(points: DataFrame, series: DataFrame, by: list[str], at: str, ts: str, values: list[str], bucket: float, inclusive: bool = True, clamp: bool = False, tie: str | None = None) -> DataFrame:
    """Points with the ``values`` (and ``ts`` as ``as_of_ts``) of the last row of their series at or before ``at``.

    Series are keyed by ``by`` and need no grid. Both sides meet in buckets of time, each bucket starting with what its
    series carried in, so a task holds one bucket of one series and a busy series is spread. ``inclusive`` false asks for
    rows strictly before; ``clamp`` gives points before a series its first row; of rows with one time that with the
    largest ``tie`` counts. Points with a null key or time, and points of unknown series, get nulls. Rows of a series
    without key or time are left out. Other columns of points stay; those named like a value are not allowed.
    """
    held = F.struct(F.col(ts).alias("as_of_ts"), *(F.col(v).alias(v) for v in values))
    order = F.struct(ts, *([tie] if tie else []))
    known = series.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, ts)))
    number = lambda c: F.col(c).cast("double") if dict(points.dtypes).get(c, dict(series.dtypes).get(c)) != "timestamp" else F.unix_micros(c) / 1e6
    keep = F.struct(*points.columns)
    rank, last_tie = (0, 1) if inclusive else (1, 0), F.col(tie).cast("double") if tie else F.lit(0.0)
    rows = known.select(*by, number(ts).alias("_t"), F.lit(rank[0]).alias("_k"), last_tie.alias("_o"), held.alias("_s")).unionByName(
        points.select(*by, number(at).alias("_t"), F.lit(rank[1]).alias("_k"), F.lit(0.0).alias("_o"), keep.alias("_p")), allowMissingColumns=True
    ).withColumn("_b", F.floor(F.col("_t") / bucket))
    lasts = known.withColumn("_b", F.floor(number(ts) / bucket)).groupBy(*by, "_b").agg(F.max_by(held, order).alias("_last"))
    asked = points.select(*by, F.floor(number(at) / bucket).alias("_b")).where("_b IS NOT NULL").distinct()
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    carried = lasts.join(asked, [*by, "_b"], "full").select(*by, "_b", F.last("_last", True).over(before).alias("_carry")).where("_carry IS NOT NULL")
    inside = F.last("_s", True).over(Window.partitionBy(*by, "_b").orderBy("_t", "_k", "_o").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_in", inside).where("_p IS NOT NULL").join(carried, [*by, "_b"], "left").withColumn("_hit", F.when(F.col("_t").isNotNull(), F.coalesce("_in", "_carry")))
    if clamp:
        earliest = F.struct(-number(ts), *([tie] if tie else []))
        firsts = known.groupBy(*by).agg(F.max_by(held, earliest).alias("_first"))
        found = found.join(firsts, by, "left").withColumn("_hit", F.coalesce("_hit", F.when(F.col("_t").isNotNull(), F.col("_first"))))
    return found.select("_p.*", "_hit.*")


def running_sums(series: DataFrame, by: list[str], ts: str, sums: dict[str, Column], bucket: float) -> DataFrame:
    """by, ts and the running totals of each series up to and with each time: sums in buckets plus what lies before them."""
    known = series.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, ts)))
    each = known.groupBy(*by, ts).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).cast("double").alias(n) for n, c in sums.items())).withColumn("_b", F.floor(F.col(ts) / bucket))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    whole = each.groupBy(*by, "_b").agg(*(F.sum(n).alias(f"_{n}") for n in sums)).select(*by, "_b", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0.0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return each.join(whole, [*by, "_b"]).select(*by, ts, *((F.col(f"_{n}") + F.sum(n).over(inside)).alias(n) for n in sums))


def interval_sums(points: DataFrame, series: DataFrame, by: list[str], start: str, end: str, ts: str, sums: dict[str, Column], bucket: float, closed: bool = False) -> DataFrame:
    """Points with the sums of their series over start <= ts < end (``closed``: <= end): two as-of joins on running totals,
    so the cost doesn't grow with the length of the interval. Intervals without a row have sums of 0."""
    totals = running_sums(series, by, ts, sums, bucket)
    ends = as_of_join(points, totals.withColumnsRenamed({n: f"_e_{n}" for n in sums}), by, end, ts, [f"_e_{n}" for n in sums], bucket, inclusive=closed).drop("as_of_ts")
    both = as_of_join(ends, totals.withColumnsRenamed({n: f"_a_{n}" for n in sums}), by, start, ts, [f"_a_{n}" for n in sums], bucket, inclusive=False).drop("as_of_ts")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    empty = F.col(end) < F.col(start)
    return both.select(*points.columns, *(F.when(empty, 0.0).otherwise(zero(F.col(f"_e_{n}")) - zero(F.col(f"_a_{n}"))).alias(n) for n in sums))


def interval_aggregate(points: DataFrame, start: Column, end: Column, candles: DataFrame, step: int, key: str, *aggs: Column) -> DataFrame:
    """Aggregate candles with start <= ts < end of each point: grid keys are exploded, at most (end-start)/step each."""
    first = F.ceil(start / step) * step
    last = F.ceil(end / step) * step - step
    keyed = points.select(key, F.explode(F.when(last >= first, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("_g"))
    return keyed.join(candles, F.col("_g") == F.col("ts")).groupBy(key).agg(*aggs)


def endpoints(points: DataFrame, start: Column, end: Column, candles: DataFrame, step: int, key: str) -> DataFrame:
    """First open with ts >= start and last close with ts <= end (both bounds included)."""
    return interval_aggregate(points, start, end + 1, candles, step, key, F.min_by("open", "ts").alias("first_open"), F.max_by("close", "ts").alias("last_close"))


def ratio_return(now: Column, then: Column) -> Column:
    """now / then - 1, 0 where the base isn't positive."""
    return F.when(then > 0, now / then - 1).otherwise(0.0)


def guarded_ratio(px: Column, px1: Column, px4: Column) -> Column:
    """The short change against the long one, 0 unless all prices are positive and the long change is above 1."""
    known = (px > 0) & (px1 > 0) & (px4 > 0) & (F.abs(px - px4) > 1)
    return F.when(known, (px - px1) / (px - px4 + 1e-9)).otherwise(0.0)


def round_distance(px: Column, unit: float) -> tuple[Column, Column]:
    """Distance to the nearest multiple, and the position inside the unit."""
    x = px / unit
    return F.least(x - F.floor(x), F.ceil(x) - x), F.pmod(px, F.lit(unit)) / unit
