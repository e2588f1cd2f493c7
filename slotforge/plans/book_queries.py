"""Order-book snapshots, open/close features, price changes and microstructure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge import fixtures as X
from slotforge.functions import features
from slotforge.operators import book
from slotforge.plans.flow_queries import r6
from slotforge.plans.registry import query, rounded
from slotforge.storage import pin

_METRICS = list(book.STATIC)


def _sum(ladder: str, when: str = "true", weight: str = "1") -> str:
    return f"coalesce(list_sum(list_transform(list_filter({ladder}, lambda x: {when}), lambda x: x.size * {weight})), 0)"


_BOOKS = f"""{X.SQL["ladders"]}, two AS (SELECT book_id, asks, bids, asks[1].price AS ap, bids[1].price AS bp, asks[1].size AS asz, bids[1].size AS bsz, (asks[1].price + bids[1].price) / 2 AS mid FROM ladders
        WHERE len(asks) > 0 AND len(bids) > 0),
    sums AS (SELECT *, {_sum("asks")} AS sa, {_sum("bids")} AS sb, {_sum("asks", "x.price <= mid + 0.05")} AS na, {_sum("bids", "x.price >= mid - 0.05")} AS nb,
        {_sum("asks", weight="exp(-10 * abs(x.price - mid))")} AS wa, {_sum("bids", weight="exp(-10 * abs(x.price - mid))")} AS wb FROM two),
    metrics AS (SELECT book_id, mid, ap - bp AS spread, (bsz - asz) / (bsz + asz + 1e-8) AS imbalance, nb / (sb + 1e-8) AS bid_depth_5c, na / (sa + 1e-8) AS ask_depth_5c,
        (nb / (sb + 1e-8)) / (na / (sa + 1e-8) + 1e-8) AS depth_ratio, sa + sb AS total_depth, (wb - wa) / (wb + wa + 1e-8) AS weighted_imb, ap FROM sums)"""
_SNAP = "WITH " + _BOOKS


@query(f"{_SNAP} SELECT book_id, {r6(*_METRICS)} FROM metrics")
def b_snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = X.ladders(spark, sf_dir).where((F.size("asks") > 0) & (F.size("bids") > 0))
    return rounded(l.select("book_id", *book.snapshot_metrics()))


@query(f"""{X.ctes("ladders")} SELECT book_id, list_min(list_transform(list_filter(asks, lambda x: x.price < 0.97), lambda x: x.price)) AS best_ask,
    list_max(list_transform(bids, lambda x: x.price)) AS best_bid, len(asks) AS n_asks, len(bids) AS n_bids FROM ladders""")
def b_best_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = X.ladders(spark, sf_dir)
    return l.select("book_id", book.best_ask(F.col("asks"), 0.97).alias("best_ask"), book.best_bid(F.col("bids")).alias("best_bid"), F.size("asks").cast("long").alias("n_asks"), F.size("bids").cast("long").alias("n_bids"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a customer's orders as one book over time: t runs over 0..179 s within a group."""
    o = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), (F.col("o_custkey") % 200).alias("market"), (F.col("o_orderkey") % 180).cast("double").alias("t"))
    l = X.ladders(spark, sf_dir).where((F.size("asks") > 0) & (F.size("bids") > 0))
    m = l.select("book_id", *book.snapshot_metrics(), book.best_ask(F.col("asks")).alias("ask"))
    return m.join(o, "book_id").withColumnRenamed("book_id", "id")


_SNAPS = f"{_BOOKS}, snaps AS (SELECT m.*, book_id AS id, o_custkey % 200 AS market, CAST(o_orderkey % 180 AS DOUBLE) AS t FROM metrics m JOIN orders o ON o_orderkey = book_id)"
_OC = [*book.STATIC, "mid_drift", "imbalance_end", "spread_end", "depth_change", "imb_momentum", "imb_w0", "imb_w1", "imb_w2"]
_FIELDS = "{" + ", ".join(f"'{n}': {n}" for n in book.STATIC) + "}"
_OPEN_CLOSE = f"""oc0 AS (SELECT market, count(*) AS n_snapshots, coalesce(arg_min({_FIELDS}, (t, id)) FILTER (t <= 30), arg_min({_FIELDS}, (t, id))) AS o, arg_max({_FIELDS}, (t, id)) FILTER (t >= 150 AND t < 168) AS c,
    {", ".join(f"coalesce(avg(imbalance) FILTER (t >= {a} AND t < {z}), 0) AS imb_w{k}" for k, (a, z) in enumerate(((0, 60), (60, 120), (120, 168))))} FROM snaps GROUP BY 1),
    oc AS (SELECT market, n_snapshots, {", ".join(f"CASE WHEN c IS NULL THEN o.{n} ELSE c.{n} END AS {n}" for n in book.STATIC)}, CASE WHEN c IS NULL THEN 0 ELSE c.mid - o.mid END AS mid_drift,
        CASE WHEN c IS NULL THEN o.imbalance ELSE c.imbalance END AS imbalance_end, CASE WHEN c IS NULL THEN o.spread ELSE c.spread END AS spread_end,
        CASE WHEN c IS NULL THEN 0 ELSE c.total_depth - o.total_depth END AS depth_change, CASE WHEN c IS NULL THEN 0 ELSE c.imbalance - o.imbalance END AS imb_momentum, imb_w0, imb_w1, imb_w2 FROM oc0)"""


@query(f"WITH {_SNAPS}, {_OPEN_CLOSE} SELECT market, n_snapshots, {r6(*_OC)} FROM oc")
def b_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.open_close(snapshots(spark, sf_dir), "market"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price changes of a market before the cutoff; some have no price, some no side."""
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("market"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    side = F.when(F.col("l_returnflag") == "R", "SELL").when(F.col("l_returnflag") == "A", "buy")
    li = X.table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 180 < 168).select(
        F.col("l_orderkey").alias("o_orderkey"), key.alias("id"), (F.col("l_orderkey") % 180).cast("double").alias("t"),
        F.when(key % 13 != 0, F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6)).alias("price"), F.col("l_quantity").alias("size"), side.alias("side"),
    )
    return li.join(o, "o_orderkey")


_PC = ["pc_up_ratio", "pc_volatility", "pc_count", "fill_imbalance"]
_CHANGES = """pc0 AS (SELECT o_custkey % 200 AS market, l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey % 180 AS DOUBLE) AS t, CASE WHEN (l_orderkey * 10 + l_linenumber) % 13 <> 0 THEN round(l_extendedprice / l_quantity, 6) END AS price,
        l_quantity AS size, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 180 < 168),
    pc1 AS (SELECT market, price - lag(price) OVER (PARTITION BY market ORDER BY t, id, price) AS d FROM pc0 WHERE price IS NOT NULL),
    pc2 AS (SELECT market, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(d) AS n, stddev_pop(d) AS sd FROM pc1 GROUP BY 1),
    pc3 AS (SELECT market, coalesce(sum(size) FILTER (flag = 'A'), 0) AS b, coalesce(sum(size) FILTER (flag = 'R'), 0) AS s FROM pc0 GROUP BY 1),
    pc AS (SELECT market, coalesce(up, 0) / (coalesce(up + down, 0) + 1e-8) AS pc_up_ratio, CASE WHEN n > 1 THEN sd ELSE 0 END AS pc_volatility, CAST(coalesce(up + down, 0) AS DOUBLE) AS pc_count, (b - s) / (b + s + 1e-8) AS fill_imbalance
        FROM pc3 LEFT JOIN pc2 USING (market))"""


@query(f"WITH {_CHANGES} SELECT market, {r6(*_PC)} FROM pc")
def b_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.price_changes(moves(spark, sf_dir), "market"))


def book_events(taken: DataFrame) -> DataFrame:
    """Events of the last minute before the cutoff; every fourth is a price change with mid and spread only, and every
    second of those is on the selling side."""
    s = taken.where((F.col("t") >= 108) & (F.col("t") < 168))
    whole = F.col("id") % 4 != 0
    return s.select("market", "t", "id", "mid", "spread", F.when(F.col("id") % 8 == 0, F.col("ask")).alias("sell_price"), F.when(whole, F.col("imbalance")).alias("imbalance"), F.when(whole, F.col("total_depth")).alias("depth"))


_MS = ["imb_mean", "imb_std", "imb_drift", "spread_mean", "spread_trend", "mid_velocity", "mid_volatility", "activity_rate", "depth_trend", "ask_pressure"]
_MICRO = f"""ev AS (SELECT market, t, id, mid, spread, CASE WHEN id % 8 = 0 THEN ap END AS sell_price, CASE WHEN id % 4 <> 0 THEN imbalance END AS imbalance, CASE WHEN id % 4 <> 0 THEN total_depth END AS depth FROM snaps WHERE t >= 108 AND t < 168),
    ev1 AS (SELECT *, mid - lag(mid) OVER (PARTITION BY market ORDER BY t, id) AS dm FROM ev),
    ev2 AS (SELECT market, count(*) FILTER (da < 0) / nullif(count(*) FILTER (da <> 0), 0) AS pressure FROM (SELECT market, sell_price - lag(sell_price) OVER (PARTITION BY market ORDER BY t, id) AS da FROM ev WHERE sell_price IS NOT NULL) GROUP BY 1),
    ev3 AS (SELECT market, count(*) AS n, avg(imbalance) AS imb_mean, stddev_pop(imbalance) AS imb_std, arg_max(imbalance, (t, id)) FILTER (imbalance IS NOT NULL) - arg_min(imbalance, (t, id)) FILTER (imbalance IS NOT NULL) AS imb_drift,
        avg(spread) AS spread_mean, CASE WHEN var_pop(t) > 0 THEN regr_slope(spread, t) END AS spread_trend, CASE WHEN var_pop(t) > 0 THEN regr_slope(mid, t) END AS mid_velocity, stddev_pop(dm) AS mid_volatility,
        count(*) / 60.0 AS activity_rate, CASE WHEN var_pop(t) FILTER (depth IS NOT NULL) > 0 THEN regr_slope(depth, t) END AS depth_trend FROM ev1 GROUP BY 1),
    micro AS (SELECT market, {", ".join(f"CASE WHEN n >= 5 THEN coalesce({n}, 0) ELSE 0 END AS {n}" for n in _MS[:-1])}, CASE WHEN n >= 5 THEN coalesce(pressure, 0) ELSE 0 END AS ask_pressure FROM ev3 LEFT JOIN ev2 USING (market))"""


@query(f"""WITH {_SNAPS}, {_MICRO} SELECT market, {", ".join(f"round({n} + 1e-9, 5) AS {n}" for n in _MS)} FROM micro""")
def b_microstructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = book.microstructure(book_events(snapshots(spark, sf_dir)), "market", 60.0)
    return m.select("market", *(F.round(F.col(n) + 1e-9, 5).alias(n) for n in _MS))  # means of few decimals fall on ties


def _variant_sql(variant: str) -> str:
    mid = "CASE WHEN imbalance IS NOT NULL THEN {} END" if variant == "books" else "{}"
    by_books = "CASE WHEN n_mids >= 2 AND book_span >= 5 THEN book_span"
    length = f"{by_books} END" if variant == "books" else f"{by_books} WHEN n_changes >= CASE WHEN n_mids >= 2 THEN 2 ELSE 5 END AND change_span >= 5 THEN change_span END"
    return f"""{variant}1 AS (SELECT market, t, id, {mid.format("mid")} AS mid, {mid.format("spread")} AS spread, sell_price, imbalance, depth FROM changed),
    {variant}2 AS (SELECT *, mid - last_value(mid IGNORE NULLS) OVER w AS dm, sell_price - last_value(sell_price IGNORE NULLS) OVER w AS da FROM {variant}1 WINDOW w AS (PARTITION BY market ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {variant}3 AS (SELECT market, count(*) AS n, count(mid) AS n_mids, count(*) FILTER (imbalance IS NULL) AS n_changes, max(t) FILTER (mid IS NOT NULL) - min(t) FILTER (mid IS NOT NULL) AS book_span, max(t) FILTER (imbalance IS NULL) - min(t) FILTER (imbalance IS NULL) AS change_span,
        avg(imbalance) AS imb_mean, stddev_pop(imbalance) AS imb_std, arg_max(imbalance, (t, id)) FILTER (imbalance IS NOT NULL) - arg_min(imbalance, (t, id)) FILTER (imbalance IS NOT NULL) AS imb_drift, avg(spread) AS spread_mean,
        CASE WHEN var_pop(t) FILTER (spread IS NOT NULL) > 0 THEN regr_slope(spread, t) END AS spread_trend, CASE WHEN var_pop(t) FILTER (mid IS NOT NULL) > 0 THEN regr_slope(mid, t) END AS mid_velocity, stddev_pop(dm) AS mid_volatility,
        CASE WHEN var_pop(t) FILTER (depth IS NOT NULL) > 0 THEN regr_slope(depth, t) END AS depth_trend, count(*) FILTER (da < 0) / nullif(count(*) FILTER (da <> 0), 0) AS ask_pressure FROM {variant}2 GROUP BY 1),
    {variant}4 AS (SELECT *, {length} AS length FROM {variant}3), {variant}5 AS (SELECT *, n / length AS activity_rate, length IS NOT NULL AND {"n >= 5" if variant == "live" else "true"} AS enough FROM {variant}4)"""


_CHANGED = """changed AS (SELECT market, t, id, CASE WHEN id % 4 <> 0 THEN mid WHEN ap > bid AND bid > 0 THEN (ap + bid) / 2 END AS mid, CASE WHEN id % 4 <> 0 THEN spread WHEN ap > bid AND bid > 0 THEN ap - bid END AS spread,
    CASE WHEN id % 8 = 0 THEN ap END AS sell_price, CASE WHEN id % 4 <> 0 THEN imbalance END AS imbalance, CASE WHEN id % 4 <> 0 THEN total_depth END AS depth
    FROM (SELECT *, CASE WHEN id % 20 = 0 THEN ap ELSE ap - spread END AS bid FROM snaps WHERE t >= 108 AND t < 168))"""


@query(f"""WITH {_SNAPS}, {_CHANGED}, {_variant_sql("books")}, {_variant_sql("live")}
    {" UNION ALL ".join(f"SELECT market, '{v}' AS variant, {', '.join(f'round(CASE WHEN enough THEN coalesce({n}, 0) ELSE 0 END + 1e-9, 5) AS {n}' for n in _MS)} FROM {v}5" for v in ("books", "live"))}""")
def b_microstructure_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form over whole books and the live form, in which price changes with a sound best bid and ask lend mid and spread."""
    s = snapshots(spark, sf_dir).where((F.col("t") >= 108) & (F.col("t") < 168))
    whole = F.col("id") % 4 != 0
    mid, spread = book.synthetic(F.when(F.col("id") % 20 == 0, F.col("ask")).otherwise(F.col("ask") - F.col("spread")), F.col("ask"))
    e = s.select(
        "market", "t", "id", F.when(whole, F.col("mid")).otherwise(mid).alias("mid"), F.when(whole, F.col("spread")).otherwise(spread).alias("spread"), F.when(F.col("id") % 8 == 0, F.col("ask")).alias("sell_price"),
        F.when(whole, F.col("imbalance")).alias("imbalance"), F.when(whole, F.col("total_depth")).alias("depth"),
    )
    out = [book.microstructure(e, "market", 60.0, variant=v).select("market", F.lit(v).alias("variant"), *(F.round(F.col(n) + 1e-9, 5).alias(n) for n in _MS)) for v in ("books", "live")]
    return out[0].unionByName(out[1])


def slot_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All book features of a market: ob_ (open, close and price changes) and clob_ (last minute). Ladders are built once."""
    taken = pin(snapshots(spark, sf_dir), "snapshots")
    oc = features.prefixed(book.open_close(taken, "market").drop("n_snapshots"), _OC)
    pc = features.prefixed(book.price_changes(moves(spark, sf_dir), "market"), _PC)
    micro = features.prefixed(book.microstructure(book_events(taken), "market", 60.0), _MS, "clob_")
    joined = oc.join(pc, "market", "left").join(micro, "market", "left")
    return joined.fillna({"ob_pc_up_ratio": 0.5, "ob_pc_volatility": 0.0, "ob_pc_count": 0.0, "ob_fill_imbalance": 0.0}).fillna(0.0, subset=["clob_" + n for n in _MS])


#: Slots take the book of one of 211 markets, of which the last never have one.
MARKET_OF_SLOT = "slot_ts div 21600 % 211"
BOOK_SET = f"""{_SNAPS}, {_OPEN_CLOSE}, {_CHANGES}, {_MICRO}, books AS (SELECT market AS m, {", ".join(f"oc.{n} AS ob_{n}" for n in _OC)}, coalesce(pc.pc_up_ratio, 0.5) AS ob_pc_up_ratio,
    {", ".join(f"coalesce(pc.{n}, 0) AS ob_{n}" for n in _PC[1:])}, {", ".join(f"coalesce(micro.{n}, 0) AS clob_{n}" for n in _MS)} FROM oc LEFT JOIN pc USING (market) LEFT JOIN micro USING (market))"""


_FILL = ["mid", "mid_drift", "spread", "depth_ratio", "imbalance", "total_depth", "bid_depth_5c"]


def _books_of_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows with the features of their book, unknown where the book is one-sided."""
    m = X.ladders(spark, sf_dir).where((F.size("asks") > 0) & (F.size("bids") > 0)).select("book_id", *book.snapshot_metrics()).withColumn("mid_drift", F.lit(None).cast("double"))
    o = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"))
    return o.join(m.select("book_id", *_FILL), "book_id", "left")


@query(f"""{_SNAP} SELECT o_orderkey AS book_id, {", ".join(f"round(coalesce({'NULL' if n == 'mid_drift' else n}, {features.neutral_value('ob_' + n)}), 6) AS ob_{n}" for n in _FILL)}
    FROM orders LEFT JOIN metrics ON book_id = o_orderkey""")
def p_neutral_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = features.prefixed(_books_of_slots(spark, sf_dir), _FILL)
    return rounded(features.fill_by_name(b, ["ob_" + n for n in _FILL], features.neutral_value))


_SERVED = ["ob_mid", "ob_spread", "ob_depth_ratio", "ob_total_depth", "ob_ask_depth_5c", "ob_spread_end", "ob_mid_drift"]


@query(f"""{_SNAP} SELECT {", ".join(f"round(coalesce({'NULL' if n in ('ob_ask_depth_5c', 'ob_spread_end', 'ob_mid_drift') else n[3:]}, {features.serving_default(n)}), 6) AS {n}" for n in _SERVED)}
    FROM orders LEFT JOIN metrics ON book_id = o_orderkey""")
def p_serving_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.serve(features.prefixed(_books_of_slots(spark, sf_dir), _FILL), _SERVED))


@query(f"""{_SNAP} SELECT count(*) AS n_orders, count(m.book_id) AS n_covered, round(count(m.book_id) / count(*), 6) AS coverage FROM orders LEFT JOIN metrics m ON book_id = o_orderkey""")
def j_book_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books_of_slots(spark, sf_dir)
    return b.agg(F.count("*").alias("n_orders"), F.count("mid").alias("n_covered"), F.round(F.avg(F.col("mid").isNotNull().cast("int")), 6).alias("coverage"))


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 - (o_orderkey % 97) / 97.0 END AS dn, (o_orderkey % 89) / 89.0 AS up, o_orderkey FROM orders)
    SELECT o_orderkey, round(coalesce(dn, 1 - up), 6) AS dn_mid, CAST(floor(up * 100) AS BIGINT) AS cents, round(greatest(least(up * 2 - 0.5, 1), 0), 6) AS clipped, round_even(up * 10, 0) AS half_even,
    CASE WHEN dn = 0 OR dn IS NULL THEN NULL ELSE round(up / dn, 6) END AS safe FROM s""")
def f_scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complement of a missing side, cent bins, clipping, half-even rounding and safe division."""
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 1 - (F.col("o_orderkey") % 97) / 97.0).alias("dn"), ((F.col("o_orderkey") % 89) / 89.0).alias("up"))
    return o.select(
        "o_orderkey", F.round(F.coalesce("dn", 1 - F.col("up")), 6).alias("dn_mid"), F.floor(F.col("up") * 100).alias("cents"),
        F.round(F.greatest(F.least(F.col("up") * 2 - 0.5, F.lit(1.0)), F.lit(0.0)), 6).alias("clipped"), F.bround(F.col("up") * 10, 0).alias("half_even"), F.round(F.try_divide("up", "dn"), 6).alias("safe"),
    )
