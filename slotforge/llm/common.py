"""Helpers shared by the corpus operators: shared storage, folds, bounded Arrow parts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 4 << 20
#: Bytes of a worker's cache of words, what an entry takes beside its text and value, and the longest word remembered.
CACHE_BYTES, ENTRY_BYTES, CACHE_LENGTH = 64 << 20, 190, 64

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a new one only where it is unset on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="slotforge-")
    return _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(batches: Iterable[pa.RecordBatch], column: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a part holds about ``limit`` bytes of ``column``, and one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a part, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


class Memo:
    """What a worker has worked out for words: two generations, so that words in use outlive a full cache.

    ``limit`` bounds the bytes of both together, apart from the words of one call and the ``fixed`` entries.
    """

    def __init__(self, fixed: dict[str, object] | None = None, limit: int = CACHE_BYTES):
        self.fixed, self.limit = fixed or {}, limit
        self.new, self.old = dict(self.fixed), {}
        self.size = 0
        self.long: list[str] = []

    def _add(self, words: list[str], values: Iterable) -> None:
        values = list(values)
        self.new.update(zip(words, values, strict=True))
        held = sum(map(len, words)) + (sum(map(len, values)) if values and isinstance(values[0], bytes) else 0)
        self.size += held + ENTRY_BYTES * len(words)

    def fill(self, words: set[str], make: Callable[[list[str]], Iterable]) -> dict[str, object]:
        """A dict that has all of ``words``; ``make`` works out those that aren't remembered. Valid until the next call."""
        for w in self.long:
            self.new.pop(w, None)
        if self.size > self.limit // 2:
            self.old, self.new, self.size = self.new, dict(self.fixed), 0
        new, old = self.new, self.old
        unknown = [w for w in words if w not in new]  # a set less the keys of a dict would go through all keys
        if old:
            known = [w for w in unknown if w in old]
            self._add(known, map(old.__getitem__, known))
            unknown = [w for w in unknown if w not in old]
        self._add(unknown, make(unknown))
        self.long = [w for w in unknown if len(w) > CACHE_LENGTH]
        return self.new
