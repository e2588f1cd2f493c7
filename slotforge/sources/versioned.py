"""Partitioned tables whose partitions are rewritten elsewhere and swapped in by a manifest that readers follow.

A manifest is a small text file, one line a partition with its folder; the newest one is the table. Writers put files
into new folders and then rename a finished manifest to the next number, so a reader sees the table before or after.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A column of this name is a partition's name as text; the table's own columns all stay in the files.
PART = "_part"


class Conflict(RuntimeError):
    """Another writer has published the version that this one is based on."""


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def latest(spark: SparkSession, root: str) -> int | None:
    """Number of the newest version."""
    fs, folder = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """batch (number of the stream's batch that wrote it, or none), schema, and the folder of each partition."""
    version = latest(spark, root) if version is None else version
    fs, path = _fs(spark, f"{root}/versions/{version}")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, number: int, content: dict) -> None:
    fs, staged = _fs(spark, f"{root}/staged/{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, final = _fs(spark, f"{root}/versions/{number}")
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(staged, final):
        raise Conflict(f"version {number} of {root} is there already")


def replace(df: DataFrame, root: str, part: Column, batch: int | None = None, gone: list[str] | None = None, based_on: int | None = None) -> int:
    """Publish a version in which the partitions that ``df`` has rows of are those rows; all others stay as they are.

    ``gone`` names partitions that end. ``batch`` makes a stream's batch safe to repeat: one not newer than the table's
    publishes nothing. Rows with a null partition are an error. Returns the version that readers now see.
    """
    spark = df.sparkSession
    before = latest(spark, root) if based_on is None else based_on
    old = manifest(spark, root, before) if before is not None else {"batch": None, "parts": {}}
    if batch is not None and old["batch"] is not None and batch <= old["batch"]:
        return before
    folder = f"{root}/data/{uuid.uuid4().hex}"
    named = df.withColumn(PART, F.coalesce(part.cast("string"), F.raise_error(F.lit("a row has no partition"))))
    named.write.partitionBy(PART).parquet(folder)
    fs, path = _fs(spark, folder)
    parts = {s.getPath().getName().removeprefix(f"{PART}="): str(s.getPath().toString()) for s in fs.listStatus(path) if s.isDirectory()}
    kept = {k: v for k, v in old["parts"].items() if k not in (gone or [])}
    number = 0 if before is None else before + 1
    _publish(spark, root, number, {"batch": old["batch"] if batch is None else batch, "schema": df.schema.json(), "parts": kept | parts})
    return number


def read(spark: SparkSession, root: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """The table as of its newest version (or an earlier one); ``parts`` lists only those partitions' folders."""
    from pyspark.sql.types import StructType

    m = manifest(spark, root, version)
    schema = StructType.fromJson(json.loads(m["schema"]))
    paths = [p for k, p in sorted(m["parts"].items()) if parts is None or k in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, root: str, part: Column, files: int = 1) -> int:
    """All partitions rewritten to ``files`` files each, swapped in at once; rows that come meanwhile make it fail, not get lost."""
    before = latest(spark, root)
    table = read(spark, root, before)
    spread = F.pmod(F.xxhash64(*table.columns), F.lit(files))
    return replace(table.repartition(part, spread), root, part, based_on=before)
