"""Named feature sets, their registry, calendar and cross features, neutral fills and serving defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge.operators import book
from slotforge.operators.flow import cyclical

#: name: (category, text). Fixed lists of this domain's features; ``lag`` and sub-window names follow a rule.
REGISTRY: dict[str, tuple[str, str]] = {
    "up_ratio": ("flow", "share of volume on Up"),
    "n_ticks": ("flow", "trades in the observation window"),
    "vol_tot": ("flow", "volume in the observation window"),
    "vwap_up": ("flow", "volume-weighted Up price"),
    "vwap_dn": ("flow", "volume-weighted Down price"),
    "vwap_spread": ("flow", "difference of both prices"),
    "vwap_trend": ("flow", "Up price against one half"),
    "decayed_up_ratio": ("flow", "up ratio with late trades weighing more"),
    "buy_ratio": ("flow", "share of volume bought"),
    "momentum": ("flow", "late sub-windows against early ones"),
    "stability": ("flow", "spread of sub-window ratios"),
    "conviction": ("flow", "up ratio less its spread"),
    "size_disparity": ("flow", "mean Up size against mean Down size"),
    "up_ratio_z20": ("zscore", "up ratio against 20 slots"),
    "up_ratio_z5": ("zscore", "up ratio against 5 slots"),
    "up_w5_z20": ("zscore", "last sub-window against 20 slots"),
    "lag_ur_z20": ("lag", "up ratio of the slot before against 20 slots, clipped"),
    "lag_ur_z5": ("lag", "up ratio of the slot before against 5 slots, clipped"),
    "ret_0h": ("spot", "return inside the slot"),
    "ret_1h": ("spot", "return since an hour before"),
    "ret_2h": ("spot", "return since two hours before"),
    "ret_3h": ("spot", "return since three hours before"),
    "ret_6h": ("spot", "return since six hours before"),
    "ret_24h": ("spot", "return since a day before"),
    "ratio_1h_24h": ("spot", "short return against long"),
    "round_near": ("spot", "distance to a round price"),
    "ret_vol": ("spot", "spread of hourly returns"),
    "day_range": ("spot", "range of the last day"),
    "volume_ratio": ("spot", "recent volume against before"),
    "range_pos": ("spot", "place in the day's range"),
    "inslot_range": ("spot", "range of prices inside the slot"),
    "vol_inslot": ("spot", "spread of returns inside the slot"),
    "vol_6h": ("spot", "spread of returns in six hours"),
    "vol_24h": ("spot", "spread of returns in a day"),
    "spot_vol_ratio": ("spot", "last hour's volume against the five before"),
    "lag_streak": ("lag", "recent slots that ended like the last"),
    "hour_sin": ("calendar", "hour of day"),
    "hour_cos": ("calendar", "hour of day"),
    "weekday_sin": ("calendar", "day of week"),
    "weekday_cos": ("calendar", "day of week"),
} | {f"up_w{k}": ("flow", f"up ratio of sub-window {k}") for k in range(6)} | {
    f"lag{k}_{c}": ("lag", f"{c} {k} slots ago") for k in range(1, 6) for c in ("target", "up_ratio", "n_ticks", "vol_tot")
}

#: Order-book features of a slot (prefix ob_) and microstructure of its last minute (prefix clob_).
BOOK = tuple("ob_" + n for n in (*book.STATIC, "mid_drift", "imbalance_end", "spread_end", "depth_change", "imb_momentum", "imb_w0", "imb_w1", "imb_w2", "pc_up_ratio", "pc_volatility", "pc_count", "fill_imbalance"))
CLOB = tuple("clob_" + n for n in ("imb_mean", "imb_std", "imb_drift", "spread_mean", "spread_trend", "mid_velocity", "mid_volatility", "activity_rate", "depth_trend", "ask_pressure"))
REGISTRY |= {n: ("book", "order book at the close of the window") for n in BOOK} | {n: ("clob", "events of the last minute") for n in CLOB}

#: Products of two columns by set; those with a book column are 0 for a slot without a book. hour_share is hour / 24.
CROSS = {
    "v25": {
        "hour_x_up_ratio": ("up_ratio", "hour_share"), "hour_x_tw_ur": ("decayed_up_ratio", "hour_share"), "x_imb_x_ur": ("ob_imbalance", "up_ratio"), "x_depth_x_momentum": ("ob_depth_ratio", "momentum"),
        "x_spread_x_vol": ("ob_spread", "n_ticks"), "x_ob_drift_x_inslot": ("ob_mid_drift", "ret_0h"), "x_fill_imb_x_buy": ("ob_fill_imbalance", "buy_ratio"),
    },
    "v26": {
        "x_imb_x_inslot": ("ob_imbalance", "ret_0h"), "x_drift_x_ret5m": ("ob_mid_drift", "ret_1h"), "x_spread_x_vol": ("ob_spread", "vol_6h"), "x_imb_end_x_ret": ("ob_imbalance_end", "ret_0h"),
        "x_depth_x_vol": ("ob_depth_ratio", "vol_6h"),
    },
}

#: Spot columns of each set: returns over the horizons that stand for 5, 15 and 30 minutes, one hour and four, and in the slot.
SPOT = {
    "v25": ("ret_1h", "ret_3h", "ret_6h", "ret_24h", "ratio_1h_24h", "ret_0h", "round_near"),
    "v26": ("ret_1h", "ret_2h", "ret_3h", "ret_6h", "ret_24h", "ret_0h", "inslot_range", "vol_6h", "vol_24h", "vol_inslot", "ratio_1h_24h", "round_near", "spot_vol_ratio"),
}
_OF = lambda *categories: [n for n, (c, _) in REGISTRY.items() if c in categories]
SETS = {
    "v25": [*_OF("flow", "zscore"), *SPOT["v25"], *(n for n in _OF("lag", "calendar", "book", "clob") if not n.startswith("lag_ur"))],
    "v26": [*SPOT["v26"], *_OF("book", "clob", "lag", "calendar")],
}


#: The 30 features of the earlier champion by rank, with their category, and those it dropped with the reason.
RANKED = (
    ("btc_inslot_ret", "spot"), ("ob_mid_drift", "orderbook"), ("btc_pre_5m_ret", "spot"), ("btc_vwap_up", "clob_tick"), ("x_ob_drift_x_inslot", "cross"), ("btc_up_w1", "clob_tick"),
    ("btc_pre_30m_ret", "spot"), ("ob_weighted_imb", "orderbook"), ("btc_vwap_dn", "clob_tick"), ("ob_mid", "orderbook"), ("prev_slot_up_ratio_2", "lag"), ("btc_vwap_spread", "clob_tick"),
    ("prev_slot_up_ratio_1", "lag"), ("btc_momentum", "clob_tick"), ("btc_pre_4h_ret", "spot"), ("ob_imb_w0", "orderbook"), ("btc_up_ratio", "clob_tick"), ("btc_up_w2", "clob_tick"),
    ("prev_slot_up_ratio_3", "lag"), ("btc_pre_1h_ret", "spot"), ("ob_imb_w2", "orderbook"), ("hour_x_up_ratio", "temporal"), ("ob_imb_momentum", "orderbook"), ("x_depth_x_momentum", "cross"),
    ("btc_size_disparity", "clob_tick"), ("x_imb_x_ur", "cross"), ("btc_buy_ratio", "clob_tick"), ("ob_ask_depth_5c", "orderbook"), ("prev_slot_up_ratio_5", "lag"), ("btc_signal_conviction", "clob_tick"),
)
PRUNED = {
    "ob_total_depth": "0.7% importance, absolute value leak", "btc_up_ratio_zscore_5s": "Noisy short zscore, needs warm history", "btc_up_ratio_zscore_20s": "Noisy long zscore, needs warm history",
    "btc_pre_1h_4h_ratio": "Cold buffer issues in live", "btc_up_w0": "Earliest window = most noise", "prev_slot_up_ratio_4": "4 slots back, mostly noise", "btc_dist_1k": "Weak round-number signal",
    "hour_x_tw_ur": "Temporal overfit risk", "ob_imb_w1": "Interpolated in live (not measured)", "hour_cos": "Calendar overfit risk",
}
#: Columns here of listed names that no rule gives; slots of six hours look back 1, 3, 6 and 24 hours.
_COLUMN_OF = {"btc_inslot_ret": "ret_0h", "btc_pre_5m_ret": "ret_1h", "btc_pre_30m_ret": "ret_3h", "btc_pre_1h_ret": "ret_6h", "btc_pre_4h_ret": "ret_24h", "btc_signal_conviction": "conviction",
              "btc_up_ratio_zscore_5s": "up_ratio_z5", "btc_up_ratio_zscore_20s": "up_ratio_z20", "btc_pre_1h_4h_ratio": "ratio_1h_24h", "btc_dist_1k": "round_near"}


def column_of(name: str) -> str | None:
    """The column of this engine that a listed feature stands for."""
    if name in _COLUMN_OF:
        return _COLUMN_OF[name]
    lag = name.removeprefix("prev_slot_up_ratio_")
    return f"lag{lag}_up_ratio" if lag != name else name.removeprefix("btc_")


def ranked(spark: SparkSession) -> DataFrame:
    """rank (null: pruned), name, category, reason, column of every listed feature."""
    rows = [(k + 1, n, c, None, column_of(n)) for k, (n, c) in enumerate(RANKED)] + [(None, n, None, why, column_of(n)) for n, why in PRUNED.items()]
    return spark.createDataFrame(rows, "rank int, name string, category string, reason string, `column` string")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c, t) for n, (c, t) in REGISTRY.items()], "name string, category string, text string")


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Cyclical UTC hour and weekday (Monday 0) of an epoch second."""
    hour, day = F.pmod(F.col(ts), F.lit(86_400)) / 3600.0, F.pmod(F.expr(f"{ts} div 86400") + 3, F.lit(7))
    return df.select("*", *cyclical(hour, 24, "hour"), *cyclical(day, 7, "weekday"), (hour / 24).alias("hour_share"))


def with_books(wide: DataFrame, books: DataFrame, key: str) -> DataFrame:
    """Join book features; a slot without a book has neutral values and ``has_book`` false."""
    joined = wide.join(books.withColumn("has_book", F.lit(True)), key, "left")
    filled = fill_by_name(joined, [n for n in BOOK if n in books.columns], neutral_value)
    return filled.fillna(0.0, subset=[n for n in CLOB if n in books.columns]).withColumn("has_book", F.coalesce("has_book", F.lit(False)))


def select_set(wide: DataFrame, version: str) -> DataFrame:
    product = lambda a, b: F.col(a) * F.col(b)
    crosses = [(F.when(F.col("has_book"), product(a, b)).otherwise(0.0) if a in BOOK else product(a, b)).alias(n) for n, (a, b) in CROSS[version].items()]
    return wide.select("slot_ts", "target", *(F.col(n).cast("double").alias(n) for n in SETS[version]), *crosses)


def neutral_value(name: str) -> float:
    """What an unknown book feature gets, by its name; the first rule that fits counts."""
    if any(x in name for x in ("ratio", "imbalance", "imb")):
        return 0.0
    if "spread" in name:
        return 0.02
    if "depth" in name and "5c" in name:
        return 0.5
    return 0.5 if "mid" in name and "drift" not in name else 0.0


#: Serving defaults by exact name; all else is 0.
SERVING = {"ob_mid": 0.5, "ob_ask_depth_5c": 0.5, "ob_bid_depth_5c": 0.5, "ob_depth_ratio": 1.0, "ob_total_depth": 1000.0, "ob_spread": 0.02}


def serving_default(name: str) -> float:
    return SERVING.get(name, 0.0)


def fill_by_name(df: DataFrame, names: list[str], rule: Callable[[str], float]) -> DataFrame:
    return df.fillna({n: rule(n) for n in names})


def prefixed(df: DataFrame, names: list[str], prefix: str = "ob_") -> DataFrame:
    """Add the prefix unless it is there; microstructure columns keep their own."""
    return df.withColumnsRenamed({n: prefix + n for n in names if not n.startswith((prefix, "clob_"))})


def serve(df: DataFrame, ordered: list[str]) -> DataFrame:
    """The listed features in order, missing columns and values at their defaults."""
    return df.select(*(F.coalesce(F.col(n).cast("double"), F.lit(serving_default(n))).alias(n) if n in df.columns else F.lit(serving_default(n)).alias(n) for n in ordered))


def epoch_seconds(col: Column) -> Column:
    """Seconds from an epoch that may be in seconds, milliseconds or microseconds; what isn't a number is 0."""
    x = col.try_cast("double")
    return F.when(x.isNull(), 0.0).when(x > 1e14, x / 1e6).when(x > 1e10, x / 1e3).otherwise(x)


def epoch_near(col: Column, now: Column) -> Column:
    """Seconds from an epoch in seconds or milliseconds: seconds if it lies within a billion of ``now``."""
    x = col.try_cast("double")
    return F.when(F.abs(x - now) < 1e9, x).otherwise(x / 1e3)


def time_parts(ts: Column) -> list[Column]:
    """label (minutes, UTC), hour, minute and weekday (Monday 0) of an epoch second, whatever the session's zone."""
    day = F.floor(ts / 86_400)
    second = F.pmod(ts, F.lit(86_400))
    hour, minute = F.floor(second / 3_600), F.floor(second % 3_600 / 60)
    label = F.concat_ws(" ", F.date_from_unix_date(day.cast("int")).cast("string"), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.lpad(minute.cast("string"), 2, "0")))
    return [label.alias("label"), hour.alias("hour"), minute.alias("minute"), F.pmod(day + 3, F.lit(7)).alias("weekday")]


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO time, ``Z`` or an offset included; null where it isn't one."""
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6
