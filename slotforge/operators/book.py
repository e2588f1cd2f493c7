"""Order-book features on ladder arrays, and microstructure of book events. Ladders are never exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total(ladder: Column, when=None) -> Column:
    kept = F.filter(ladder, when) if when else ladder
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["size"])


def best_ask(asks: Column, below: float | None = None) -> Column:
    """The lowest ask price, of those under ``below``."""
    kept = F.filter(asks, lambda x: x["price"] < below) if below is not None else asks
    return F.array_min(F.transform(kept, lambda x: x["price"]))


def best_bid(bids: Column) -> Column:
    return F.array_max(F.transform(bids, lambda x: x["price"]))


#: Static features of a snapshot, in the order in which they are computed.
STATIC = ("mid", "spread", "imbalance", "bid_depth_5c", "ask_depth_5c", "depth_ratio", "total_depth", "weighted_imb")


def snapshot_metrics(band: float = 0.05, sharpness: float = 10.0) -> list[Column]:
    """Mid, spread, imbalances and depth of one snapshot with sorted ``asks`` and ``bids``; null with an empty side.

    Depth counts levels within ``band`` of the mid, as a share of the side; weights fall with the distance from the mid.
    """
    asks, bids = F.col("asks"), F.col("bids")
    ask, bid = F.element_at(asks, 1), F.element_at(bids, 1)
    both = (F.size(asks) > 0) & (F.size(bids) > 0)
    mid = (ask["price"] + bid["price"]) / 2
    sa, sb = total(asks), total(bids)
    near_a = total(asks, lambda x: x["price"] <= mid + band) / (sa + 1e-8)
    near_b = total(bids, lambda x: x["price"] >= mid - band) / (sb + 1e-8)
    pulled = lambda ladder: F.aggregate(ladder, F.lit(0.0), lambda s, x: s + x["size"] * F.exp(-F.lit(sharpness) * F.abs(x["price"] - mid)))
    wa, wb = pulled(asks), pulled(bids)
    values = (mid, ask["price"] - bid["price"], (bid["size"] - ask["size"]) / (bid["size"] + ask["size"] + 1e-8), near_b, near_a, near_b / (near_a + 1e-8), sa + sb, (wb - wa) / (wb + wa + 1e-8))
    return [F.when(both, c).alias(k) for k, c in zip(STATIC, values, strict=True)]


def open_close(snapshots: DataFrame, key: str | list[str], opened: float = 30, close_from: float = 150, cutoff: float = 168, window: float = 60) -> DataFrame:
    """Open: first snapshot with t <= opened, else the first; close: last with close_from <= t < cutoff.

    Static features are those of the close, or of the open where there is none; then all changes are 0. Mean imbalances
    are of the windows that begin at 0, ``window`` and twice that, the last one ends at ``cutoff``. Plain aggregates, so
    the same columns serve a stream, whose key includes the slot's window.
    """
    keys = [key] if isinstance(key, str) else key
    order, fields, t = F.struct("t", "id"), F.struct(*STATIC), F.col("t")
    early, late = t <= opened, (t >= close_from) & (t < cutoff)
    mean = lambda a, b: F.coalesce(F.avg(F.when((t >= a) & (t < b), F.col("imbalance"))), F.lit(0.0))
    g = snapshots.groupBy(*keys).agg(
        F.min_by(F.when(early, fields), F.when(early, order)).alias("_o"), F.min_by(fields, order).alias("_f"), F.max_by(F.when(late, fields), F.when(late, order)).alias("_c"),
        *(mean(a, b).alias(f"imb_w{k}") for k, (a, b) in enumerate(((0, window), (window, 2 * window), (2 * window, cutoff)))), F.count("*").alias("n_snapshots"),
    )
    o = F.coalesce("_o", "_f")
    c = F.coalesce(F.col("_c"), o)
    return g.select(
        *keys, "n_snapshots", *(c[n].alias(n) for n in STATIC), (c["mid"] - o["mid"]).alias("mid_drift"), c["imbalance"].alias("imbalance_end"), c["spread"].alias("spread_end"),
        (c["total_depth"] - o["total_depth"]).alias("depth_change"), (c["imbalance"] - o["imbalance"]).alias("imb_momentum"), "imb_w0", "imb_w1", "imb_w2",
    )


def _before(value: str, key: str, *order: str) -> Column:
    """The last known value in an earlier row of the key."""
    return F.last(value, True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def price_changes(moves: DataFrame, key: str) -> DataFrame:
    """Share of upward moves (0 without a move), std_pop of moves, number of moves and fill imbalance by size.

    Rows without a price make no move; sides other than BUY and SELL, null included, fill neither.
    """
    d = moves.withColumn("_d", F.col("price") - _before("price", key, "t", "id", "price"))
    side = F.upper("side")
    of = lambda s: F.coalesce(F.sum(F.when(side == s, F.col("size"))), F.lit(0.0))
    n = F.count_if(F.col("_d") != 0)
    return d.groupBy(key).agg(
        (F.count_if(F.col("_d") > 0) / (n + 1e-8)).alias("pc_up_ratio"), F.when(F.count("_d") > 1, F.stddev_pop("_d")).otherwise(0.0).alias("pc_volatility"),
        n.cast("double").alias("pc_count"), ((of("BUY") - of("SELL")) / (of("BUY") + of("SELL") + 1e-8)).alias("fill_imbalance"),
    )


def synthetic(best_bid: Column, best_ask: Column) -> tuple[Column, Column]:
    """Mid and spread that a price change tells of a book: null unless the best ask is above the best bid and that above 0."""
    sound = (best_ask > best_bid) & (best_bid > 0)
    return F.when(sound, (best_ask + best_bid) / 2), F.when(sound, best_ask - best_bid)


def microstructure(events: DataFrame, key: str, span: float, least_events: int = 5, least_mids: int = 2, variant: str = "window", least_span: float = 5.0) -> DataFrame:
    """Ten features of a window: columns t, id, mid, spread (null where unknown), imbalance and depth (null unless the
    event is a whole book), sell_price (null unless the event is a price change on the selling side).

    Slopes are least squares, 0 for one time; pressure is the share of downward moves among the moves of consecutive sell
    prices. All features are 0 where the variant finds too little:

    - ``window``: the rate is by ``span``; ``least_events`` events and ``least_mids`` mids are needed.
    - ``books``: only whole books have mid and spread; the rate is by the time between the first and the last of them,
      which must be ``least_span`` at least, between two books at least.
    - ``live``: price changes lend mid and spread too (``synthetic``); ``least_events`` events are needed, and
      ``least_span`` between the books, or else between the price changes (``least_events`` of them with fewer than two
      books, two otherwise).
    """
    real = F.col("imbalance").isNotNull()
    if variant == "books":
        events = events.withColumns({"mid": F.when(real, F.col("mid")), "spread": F.when(real, F.col("spread"))})
    e = events.withColumns({"_dm": F.col("mid") - _before("mid", key, "t", "id"), "_da": F.col("sell_price") - _before("sell_price", key, "t", "id")})
    order, seen = F.struct("t", "id"), F.col("mid").isNotNull()
    moved = F.count_if(F.col("_da") != 0)
    between = lambda c: F.max(F.when(c, F.col("t"))) - F.min(F.when(c, F.col("t")))
    mids, changes = F.count("mid"), F.count_if(~real)
    length = {
        "window": F.lit(span),
        "books": F.when((mids >= 2) & (between(seen) >= least_span), between(seen)),
        "live": F.when((mids >= 2) & (between(seen) >= least_span), between(seen)).when((changes >= F.when(mids >= 2, 2).otherwise(least_events)) & (between(~real) >= least_span), between(~real)),
    }[variant]
    enough = {"window": (F.count("*") >= least_events) & (mids >= least_mids), "books": length.isNotNull(), "live": (F.count("*") >= least_events) & length.isNotNull()}[variant]
    values = {
        "imb_mean": F.avg("imbalance"), "imb_std": F.stddev_pop("imbalance"), "imb_drift": F.max_by("imbalance", F.when(real, order)) - F.min_by("imbalance", F.when(real, order)),
        "spread_mean": F.avg("spread"), "spread_trend": F.regr_slope("spread", "t"), "mid_velocity": F.regr_slope("mid", "t"), "mid_volatility": F.stddev_pop("_dm"),
        "activity_rate": F.count("*") / length, "depth_trend": F.regr_slope("depth", "t"), "ask_pressure": F.when(moved > 0, F.count_if(F.col("_da") < 0) / moved),
    }
    return e.groupBy(key).agg(*(F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(n) for n, c in values.items()))
