"""Global order without a single partition: ranks, blocks with a halo, lags, z-scores, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotforge.storage import pin

BLOCK = 4_096


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Rank 0..n-1 in the order of ``order``: range partitions are written sorted, counted, and offset.

    Only one number for each partition reaches the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = pin(spread.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, rows in counts:
        offsets += [F.lit(p), F.lit(total).cast("long")]
        total += rows
    start = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0).cast("long")
    return placed.withColumn(name, (start + inside)).drop("_at")


def rank_within(df: DataFrame, key: str, *order: str, name: str = "rank") -> DataFrame:
    """Rank 0..n-1 inside each key (not null), whatever its size: range partitions over key and order, counted and offset.

    The joined counts have a row for each partition and key in it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    placed = pin(spread.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_p", F.shiftright("_at", 33))
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(key, "_p").agg(F.min("_at").alias("_f"), F.count("*").alias("_n"))
    pieces = pieces.select(key, "_p", "_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return placed.join(pieces, [key, "_p"]).select(*df.columns, (F.col("_at") - F.col("_f") + F.col("_o")).alias(name))


def blocks(ranked: DataFrame, halo: int, rank: str = "rank", size: int = BLOCK) -> DataFrame:
    """Rows with their block, and the last ``halo`` rows of each block again in the next one, marked ``_halo``."""
    own = F.floor(F.col(rank) / size)
    tail = F.col(rank) % size >= size - halo
    copies = F.when(tail, F.array(F.struct(own.alias("b"), F.lit(False).alias("h")), F.struct((own + 1).alias("b"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("h"))))
    return ranked.select("*", F.explode(copies).alias("_c")).select(*ranked.columns, F.col("_c.b").alias("_block"), F.col("_c.h").alias("_halo"))


def in_blocks(rank: str = "rank", by: tuple[str, ...] = ()):
    return Window.partitionBy(*by, "_block").orderBy(rank)


def _ahead(each: DataFrame, aggs: dict[str, tuple], size: int) -> DataFrame:
    """For each block ``_b`` what lies before it: inside its run of blocks, and in the runs before that. The last window
    has a row for each ``size`` blocks."""
    runs = each.withColumn("_r", F.floor(F.col("_b") / size))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = runs.groupBy("_r").agg(*(f(n).alias(n) for n, (f, _) in aggs.items())).select("_r", *(f(n).over(before).alias(f"_w{n}") for n, (f, _) in aggs.items()))
    return runs.join(whole, "_r").select("_b", *(join(F.col(f"_w{n}"), f(n).over(inside)).alias(f"_a{n}") for n, (f, join) in aggs.items()))


def running(ranked: DataFrame, sums: dict[str, Column], rank: str = "rank", size: int = BLOCK) -> DataFrame:
    """Running totals over the whole order: inside blocks, plus what lies before the block."""
    own = ranked.withColumn("_b", F.floor(F.col(rank) / size))
    each = own.groupBy("_b").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    plus = lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    inside = Window.partitionBy("_b").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    joined = own.join(_ahead(each, {f"_{k}": (F.sum, plus) for k in sums}, size), "_b")
    return joined.select(*ranked.columns, *((F.col(f"_a_{k}") + F.sum(c).over(inside)).alias(k) for k, c in sums.items()))


def running_max(ranked: DataFrame, value: str, name: str, rank: str = "rank", size: int = BLOCK, floor: float | None = None) -> DataFrame:
    """Largest value so far over the whole order; with ``floor`` it starts there."""
    own = ranked.withColumn("_b", F.floor(F.col(rank) / size))
    each = own.groupBy("_b").agg(F.max(value).alias("_m"))
    inside = Window.partitionBy("_b").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    best = F.greatest(F.max(value).over(inside), F.col("_a_m"), F.lit(floor))
    return own.join(_ahead(each, {"_m": (F.max, F.greatest)}, size), "_b").select(*ranked.columns, best.alias(name))


#: Lagged columns and what a stale or unknown lag gets.
LAGS = {"target": 0.5, "up_ratio": 0.5, "n_ticks": 0.0, "vol_tot": 0.0}


def lag_features(ranked: DataFrame, slot_seconds: int, lags: int = 5, stale: int = 3, fill: dict[str, float] | None = None, unknown: dict[str, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Lags 1..n of each column with a stale guard, matches of lag 1 among the others, and the true run; with ``by``, whose
    keys have ranks of their own, inside each key.

    A lag whose slot lies more than n * slot_seconds * stale back counts as stale; before the first slot it is 0, or
    what ``unknown`` says (the live form: the same as a stale one).
    """
    fill, unknown = fill or LAGS, unknown or {}
    w = in_blocks(by=by)
    b = blocks(ranked, lags)
    out = []
    fresh, known = {}, {}
    for k in range(1, lags + 1):
        then = F.lag("slot_ts", k).over(w)
        known[k] = then.isNotNull()
        fresh[k] = F.coalesce(F.col("slot_ts") - then <= k * slot_seconds * stale, F.lit(False))
        for c, value in fill.items():
            out.append(F.when(~known[k], unknown.get(c, 0.0)).when(fresh[k], F.lag(c, k).over(w).cast("double")).otherwise(value).alias(f"lag{k}_{c}"))
    first = F.lag("target", 1).over(w)
    same = {k: fresh[k] & (F.lag("target", k).over(w) == first) for k in range(2, lags + 1)}
    matches = sum((F.when(F.coalesce(same[k], F.lit(False)), 1).otherwise(0) for k in same), F.lit(1))
    run, unbroken = F.lit(1), F.lit(True)
    for k in same:
        unbroken = unbroken & F.coalesce(same[k], F.lit(False))
        run = run + F.when(unbroken, 1).otherwise(0)
    streak = F.when(fresh[1], matches).otherwise(0)
    true_streak = F.when(fresh[1], run).otherwise(0)
    return b.select(*ranked.columns, "_halo", *out, streak.alias("lag_streak"), true_streak.alias("true_streak")).where("NOT _halo").drop("_halo")


def zscores(ranked: DataFrame, value: str, live: Column, slot_seconds: int, late: str | None = None, long: int = 20, short: int = 5, stale: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """z against the previous ``long`` slots and the ``short`` most recent available ones, the current one excluded.

    Slots where ``live`` is false are skipped. Plain: (x - mean) / (std_pop + 1e-6), needs 3 (short: 2) values; ``late``
    is another column that is held against the long mean of ``value``. The lagged form scores the slot before, never the
    current one: std of at least 0.01, result within -5..5, one half where that slot is stale.
    """
    b = blocks(ranked.withColumn("_v", F.when(live, F.col(value))), long)
    back = in_blocks(by=by).rowsBetween(-long, -1)
    past = F.collect_list("_v").over(back)  # nulls are left out; at most ``long`` values
    fresh = F.coalesce(F.col("slot_ts") - F.lag("slot_ts", 1).over(in_blocks(by=by)) <= slot_seconds * stale, F.lit(False))
    b = b.withColumns({"_past": past, "_lag": F.when(fresh, F.lag(value, 1).over(in_blocks(by=by))).otherwise(0.5)})
    recent = F.slice("_past", F.greatest(F.size("_past") - short + 1, F.lit(1)), short)

    def moments(a: Column) -> tuple[Column, Column]:
        n = F.size(a)
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
        return mean, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)

    m20, s20 = moments(F.col("_past"))
    m5, s5 = moments(recent)
    x, lag = F.col(value), F.col("_lag")
    clip = lambda z: F.greatest(F.least(z, F.lit(5.0)), F.lit(-5.0))
    enough, some = F.size("_past") >= 3, F.size(recent) >= 2
    return b.where("NOT _halo").select(
        *ranked.columns,
        F.when(enough, (x - m20) / (s20 + 1e-6)).otherwise(0.0).alias(f"{value}_z{long}"),
        F.when(some, (x - m5) / (s5 + 1e-6)).otherwise(0.0).alias(f"{value}_z{short}"),
        *([F.when(enough, (F.col(late) - m20) / (s20 + 1e-6)).otherwise(0.0).alias(f"{late}_z{long}")] if late else []),
        F.when(enough, clip((lag - m20) / F.greatest(s20, F.lit(0.01)))).otherwise(0.0).alias(f"lag_ur_z{long}"),
        F.when(some, clip((lag - m5) / F.greatest(s5, F.lit(0.01)))).otherwise(0.0).alias(f"lag_ur_z{short}"),
    )


def keep_last(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows of each key in ``order``; a task gives up all but ``n`` rows of a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def event_rate(df: DataFrame, key: str, time_ms: str, width_ms: int, quiet_s: float) -> DataFrame:
    """key, peak_rate (most rows in any trailing ``width_ms``, both ends included; rows without a time are one such set),
    longest_gap and silences (gaps above ``quiet_s``, which isn't negative), in seconds.

    Rows are counted by time. Those of one time come in at it and go out ``width_ms`` later, which is in the next bucket
    of that width: a running sum gives the rate, and a bucket has at most two rows for each of its milliseconds,
    however many rows a key has. The second window has one row for each bucket of a key.
    """
    t, width = F.col(time_ms), F.lit(width_ms)
    each = df.groupBy(key, time_ms).agg(F.count("*").alias("_n")).withColumn("_b", t - F.pmod(t, width))
    row = lambda b, at, gone: F.struct(b.alias("_b"), at.alias("_t"), F.lit(gone).alias("_gone"), "_n")
    come, go = row(F.col("_b"), t, False), row(F.col("_b") + width, t + width, True)
    moved = each.select(key, F.inline(F.when(t.isNull(), F.array(come)).otherwise(F.array(come, go))))
    bucket = Window.partitionBy(key, "_b")
    at = bucket.orderBy("_t", "_gone")  # what goes out at a time still counts at it
    gone, n, here = F.col("_gone"), F.col("_n"), F.when(~F.col("_gone"), F.col("_t"))
    carried, change = F.sum(F.when(gone, n).otherwise(0)).over(bucket), F.sum(F.when(gone, -n).otherwise(n)).over(at.rowsBetween(Window.unboundedPreceding, 0))
    gap = (here - F.last(here, True).over(at.rowsBetween(Window.unboundedPreceding, -1))) / 1000.0
    rated = moved.select("*", (carried + change).alias("_c"), F.coalesce(gap, F.when(here.isNotNull() & (n > 1), 0.0)).alias("_gap"), here.alias("_here"))
    inside = rated.where("NOT _gone").groupBy(key, "_b").agg(F.max("_c").alias("_c"), F.max("_gap").alias("_gap"), F.count_if(F.col("_gap") > quiet_s).alias("_q"), F.min("_here").alias("_from"), F.max("_here").alias("_to"))
    between = (F.col("_from") - F.lag("_to").over(Window.partitionBy(key).orderBy("_b"))) / 1000.0
    d = inside.withColumn("_step", between)
    return d.groupBy(key).agg(F.max("_c").alias("peak_rate"), F.max(F.greatest("_gap", "_step")).alias("longest_gap"), (F.sum("_q") + F.count_if(F.col("_step") > quiet_s)).alias("silences"))


def window_scores(ranked: DataFrame, values: list[str], live: Column, long: int, suffix: str, least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(x - mean) / (std_pop + 1e-6) of each value against its own last ``long`` slots, the current one excluded and those
    that aren't ``live`` skipped; 0 with fewer than ``least`` of them. All values in one pass over the blocks."""
    back = in_blocks(by=by).rowsBetween(-long, -1)
    b = blocks(ranked, long)
    past = lambda f, v: f(F.when(live, F.col(v))).over(back)
    z = [F.when(past(F.count, v) >= least, (F.col(v) - past(F.avg, v)) / (past(F.stddev_pop, v) + 1e-6)).otherwise(0.0).alias(f"{v}{suffix}") for v in values]
    return b.select(*ranked.columns, "_halo", *z).where("NOT _halo").drop("_halo")
