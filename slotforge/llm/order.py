"""Places of rows within keys of any size, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotforge.llm.common import materialize, shuffle_parts


def numbered(df: DataFrame, key: str, order: list[str], name: str, at: str = "at", n: str = "n") -> DataFrame:
    """``df`` with each row's place from 0 within its key (not null) in ascending order, nulls first, and the key's number of rows.

    Range partitions over (key, order) are written sorted, so that a hot key spans several; each key's rows in each
    partition are counted, and places are offset by the counts before. Rows tied on all of ``order`` come in any order,
    which the written table then fixes.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    sort = [F.col(key), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    dealt = spread.repartitionByRange(shuffle_parts(df.sparkSession), *sort).sortWithinPartitions(*sort).drop("_tie")
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    pieces = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    pieces = pieces.select(key, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(key)).alias(n))
    out = placed.join(pieces, [key, "_part"])
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(at), n)
