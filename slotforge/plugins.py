"""Registry of market plugins: named steps from one DataFrame to another, and the training rows they give together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Plugin:
    """What a kind of market supplies.

    discover: landed payloads to markets (key column and what features need); features: markets to one row a market;
    truth: markets to key and ``target``; ordered: feature names with the value that a missing one is served with.
    """

    name: str
    key: str
    discover: Step
    features: Callable[[DataFrame], DataFrame]
    truth: Step
    ordered: dict[str, float] = field(default_factory=dict)


_PLUGINS: dict[str, Plugin] = {}


def register(plugin: Plugin) -> Plugin:
    """Register under the plugin's name; a name is taken once."""
    if plugin.name in _PLUGINS and _PLUGINS[plugin.name] != plugin:
        raise ValueError(f"plugin {plugin.name} is registered already")
    _PLUGINS[plugin.name] = plugin
    return plugin


def get(name: str) -> Plugin:
    if name not in _PLUGINS:
        raise KeyError(f"no plugin {name}; there are {sorted(_PLUGINS)}")
    return _PLUGINS[name]


def names() -> list[str]:
    return sorted(_PLUGINS)


def to_frame(plugin: Plugin, features: DataFrame) -> DataFrame:
    """Key and the listed features in order, missing columns and values at their defaults."""
    have = set(features.columns)
    return features.select(plugin.key, *(F.coalesce(F.col(n).cast("double"), F.lit(d)).alias(n) if n in have else F.lit(d).alias(n) for n, d in plugin.ordered.items()))


def training_rows(name: str, landed: DataFrame) -> DataFrame:
    """Labelled rows of a plugin: its features joined with its truth; markets without a label have none."""
    p = get(name)
    markets = p.discover(landed)
    labels = p.truth(markets).where("target IS NOT NULL").select(p.key, F.col("target").cast("int").alias("target"))
    return to_frame(p, p.features(markets)).join(labels, p.key)


def serving_rows(name: str, landed: DataFrame) -> DataFrame:
    """The same features for markets whose truth isn't known yet."""
    p = get(name)
    markets = p.discover(landed)
    known = p.truth(markets).where("target IS NOT NULL").select(p.key)
    return to_frame(p, p.features(markets)).join(known, p.key, "left_anti")
