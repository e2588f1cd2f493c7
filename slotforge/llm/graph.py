"""Connected components of a distributed edge list, and of small ones inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm.common import materialize


def join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (the index of a root for each node) after joining ``left[i]`` with ``right[i]``."""
    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return labels
        a, b, left, right = a[differ], b[differ], left[differ], right[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jumped := labels[labels], labels):
            labels = jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns a, b (long) in; node, component (the smallest node reachable) out, for the nodes that have an edge.

    Alternating large-star and small-star rounds: the number of edges never grows and each node's edges are only summed
    (minimum) or joined, never gathered. Every round is written to the shared folder. Null ends and loops are ignored.
    """
    now = materialize(_distinct(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(_distinct(large), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(_distinct(hung.unionByName(low.select("u", F.col("m").alias("v")))), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def _state(pairs: DataFrame) -> tuple[int, int | None, int | None]:
    return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
