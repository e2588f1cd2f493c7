"""Token ids in fixed-width bit-packed blocks.

A file is a Parquet table of blocks, one file a shard, shards and blocks in ascending order of id. A block holds whole
documents: ``payload`` has their ids, ``bits`` bits each, lowest bit first, without gaps; ``offsets`` has where each
document begins in the block, counted in ids; ``before`` is the number of ids of the shard in front of the block.
Any id of a block can be read alone: id ``k`` begins at bit ``k * bits``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Container, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from slotforge.llm.common import Memo, parts, shuffle_parts, texts_of

#: A block is closed when it has so many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 16
END_ID = 0
#: Stands for a null id in the order.
NO_ID = -(2**63)
#: Unknown chunks that the library encodes in one text, and bytes of texts encoded at once: few enough that what is
#: looked up for them stays in the processor's caches.
TOGETHER, PART = 128, 1 << 20

#: Marks that make a pre-token of their own at the end of a word.
MARKS = ".,;:!?*%$&#()\"-"
#: Bytes of a worker's cache of chunks.
CHUNK_CACHE = 288 << 20

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_BLOCKS = "shard int, block int, before long, n_ids int, bits int, first_id long, last_id long, doc_ids array<long>, offsets array<int>, payload binary"


def _sound(chunk: str) -> bool:
    """No white space stands at either end of a chunk, apart from the line break that it may begin with."""
    bare = chunk[1:] if chunk[:1] == "\n" else chunk
    return bare != "" and bare == bare.strip()


def chunks_of(texts: list[str], known: Container[str] = ()) -> tuple[list[list[str]], set[str]]:
    """Stretches of each text that the library encodes independently: the first as it stands, others with the space
    before them left out, or with the line break that they begin with; and the set of all that aren't first.

    Chunks that are ``known`` aren't looked at."""
    split = [t.replace("\n", " \n").split(" ") for t in texts]
    heads = [x.pop(0) for x in split]
    distinct = set().union(*split)
    bad = {c for c in distinct if c not in known and not c.isalpha() and not _sound(c)}
    odd = [k for k, x in enumerate(split) if heads[k] != heads[k].rstrip() or (bad and not bad.isdisjoint(x))]
    distinct -= bad
    for k in odd:
        heads[k], *split[k] = _LONE_SPACE.split(texts[k])
        distinct.update(split[k])
    return [heads, *split], distinct


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of up to ``bits`` bits, lowest bit first, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flags.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the one at ``start``; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=count, offset=start * bits // 8).astype("<u4")
    first = start * bits
    raw = np.frombuffer(payload, dtype=np.uint8)[first // 8 : (first + count * bits + 7) // 8]
    flags = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class ChunkEncoder:
    """The library's ids of a text, chunk by chunk, as unsigned integers of ``unit`` bytes.

    A byte-level pre-token takes at most the one space before it, and a lone line break is one, so the library encodes
    what stands on either side of a lone space or break independently; the worker remembers the ids of chunks. Unknown
    chunks are encoded many in one text: each begins with its space, and no other token of it does.
    """

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (size - 1).bit_length())
        self.unit = self.bits // 8 if self.bits in (8, 16) else 4
        self.kind = np.dtype(f"<u{self.unit}")
        self.opens = np.array([(self.model.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.memo = Memo(limit=CHUNK_CACHE)
        self.marks: dict[str, bytes] = {}

    def _packed(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are one pre-token with its space, and others without one."""
        out = {}
        for at in range(0, len(chunks), TOGETHER):
            group = chunks[at : at + TOGETHER]
            ids = self._packed([" " + " ".join(group)])[0]
            ends = (np.flatnonzero(self.opens[ids]) * self.unit).tolist()
            raw = ids.tobytes()
            out.update((c, raw[a:b]) for c, a, b in zip(group, ends, [*ends[1:], len(raw)], strict=True))
        return out

    def _later(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks after the first, as they stand in a text. A word keeps its ids before marks that end it."""
        known, marks = self.memo.new, self.marks
        plain, odd, ended = set(), [], {}
        for c in chunks:
            if c.isalpha():
                plain.add(c)
                continue
            if " " in c or c[0] <= " " or c[-1].isspace():
                odd.append(c)
                continue
            word = c.rstrip(MARKS)
            if word != c and word.isalpha():
                ended[c] = word
                if word not in known:
                    plain.add(word)
                if (end := c[len(word) :]) not in marks:
                    marks[end] = self._packed([end])[0].tobytes()
            else:
                plain.add(c)
        made = self._together(list(plain))
        made.update(zip(odd, (x.tobytes() for x in self._packed([c if c[:1] == "\n" else " " + c for c in odd])), strict=True))
        for c, word in ended.items():
            made[c] = (made[word] if word in made else known[word]) + marks[c[len(word) :]]
        if len(marks) > TOGETHER:
            marks.clear()
        return list(map(made.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``unit`` bytes."""
        (heads, *tails), distinct = chunks_of(texts, self.memo.new.keys())
        get = self.memo.fill(distinct, self._later).__getitem__
        first = list(set(heads))
        opened = dict(zip(first, (x.tobytes() for x in self._packed(first)), strict=True))
        return [opened[head] + b"".join(map(get, tail)) for head, tail in zip(heads, tails, strict=True)]


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, shards: int | None = None) -> None:
    """Encode every text, end each document with ``end_id``, and write blocks to ``path`` in ascending order of id.

    Texts are encoded where they are read and only packed ids are shuffled, once. Shards are ranges of ids between
    splitters from the id column alone; an id, or null, that fills several shards is dealt to them by a checksum. Null text
    counts as empty; null ids come first; rows tied on the id are ordered by their ids' bytes inside a shard; an empty table
    writes no block; other columns are ignored.
    """
    spark = docs.sparkSession
    n, bits = shards or shuffle_parts(spark), chunk_encoder(vocabulary).bits
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    keyed = F.coalesce("id", F.lit(NO_ID))
    cuts = rows.agg(F.percentile_approx(keyed, [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    splitters = sorted(cuts) if n > 1 else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(vocabulary)
        unit, exact = encoder.unit, encoder.unit * 8 == encoder.bits
        end = b"" if end_id is None else np.array([end_id], dtype=encoder.kind).tobytes()
        for part in parts(batches, "text", PART):
            ids = [x + end for x in encoder.encode(texts_of(part, "text"))]
            keys = np.array([NO_ID if i is None else i for i in part.column("id").to_pylist()], dtype=np.int64)
            bounds = np.array(splitters, dtype=np.int64)
            shard = np.searchsorted(bounds, keys, "left").astype(np.int32)
            wide = np.searchsorted(bounds, keys, "right") - shard
            for k in np.flatnonzero(wide > 1).tolist():  # an id that fills several shards is dealt to them by checksum
                shard[k] += zlib.crc32(ids[k]) * int(wide[k]) >> 32
            packed = ids if exact else [pack(np.frombuffer(x, dtype=encoder.kind), encoder.bits) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(shard), part.column("id"), pa.array([len(x) // unit for x in ids], pa.int32()), pa.array(packed, pa.binary())], names=["shard", "id", "n", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held: list[tuple[int | None, int, bytes]] = []
        size, before, number = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, before, number
            starts = np.cumsum([0, *(n for _, n, _ in held)])[:-1].tolist()
            payload = b"".join(x for _, _, x in held) if bits % 8 == 0 else pack(np.concatenate([unpack(x, bits, 0, n) for _, n, x in held]), bits)
            ids = [i for i, _, _ in held]
            known = [i for i in ids if i is not None]
            row = (shard, number, before, size, bits, min(known, default=None), max(known, default=None), ids, starts, payload)
            held, size, before, number = [], 0, before + size, number + 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "block", "before", "n_ids", "bits", "first_id", "last_id", "doc_ids", "offsets", "payload"])

        for batch in batches:
            for i, n_ids, payload in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "payload")), strict=True):
                if held and size + n_ids > BLOCK_IDS:
                    yield close()
                held.append((i, n_ids, payload))
                size += n_ids
        if held:
            yield close()

    encoded = rows.mapInArrow(encode, "shard int, id long, n int, payload binary")
    placed = encoded.repartitionById(len(splitters) + 1, "shard").sortWithinPartitions(F.col("id").asc_nulls_first(), "payload")
    placed.select("id", "n", "payload").mapInArrow(blocks, _BLOCKS).write.option("compression", "lz4_raw").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Each document of a file with its ids: shard, start_in_shard, id, ids (array of long)."""
    return read_blocks(spark, path).mapInArrow(_documents, "shard int, start_in_shard long, id long, ids array<long>").withColumnRenamed("id", id_col)


def fetch(spark: SparkSession, path: str, wanted: int, id_col: str = "doc_id") -> DataFrame:
    """The documents with one id and their ids: only blocks whose range of ids holds it are read, and only its own bits."""
    near = read_blocks(spark, path).where((F.col("first_id") <= wanted) & (F.col("last_id") >= wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bits, n, ids, starts = (batch.column(c)[row].as_py() for c in ("bits", "n_ids", "doc_ids", "offsets"))
                ends, payload = [*starts[1:], n], batch.column("payload")[row].as_buffer()
                found = [unpack(payload, bits, a, b - a).astype(np.int64) for i, a, b in zip(ids, starts, ends, strict=True) if i == wanted]
                yield pa.RecordBatch.from_arrays([pa.array([wanted] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "ids"])

    return near.mapInArrow(run, "id long, ids array<long>").withColumnRenamed("id", id_col)


def token_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Read the files back; each document's id, start (ids of all documents before it), n_tokens and ids_crc32."""
    read = read_blocks(spark, path)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = read.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    index = read.mapInArrow(_checksums, "shard int, start_in_shard long, id long, n_tokens long, ids_crc32 long")
    return index.join(F.broadcast(shards), "shard").select(F.col("id").alias(id_col), (F.col("ahead") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[int | None], list[np.ndarray]]]:
    for batch in batches:
        for row in range(batch.num_rows):
            at = lambda c, row=row, batch=batch: batch.column(c)[row]
            offsets, n = at("offsets").as_py(), at("n_ids").as_py()
            ids = unpack(at("payload").as_buffer(), at("bits").as_py(), 0, n)
            yield at("shard").as_py(), [at("before").as_py() + o for o in offsets], at("doc_ids").as_py(), np.split(ids, offsets[1:])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, starts, docs, ids in _each(batches):
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array(starts, pa.int64()), pa.array(docs, pa.int64()), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], names=["shard", "start_in_shard", "id", "ids"])


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, starts, docs, ids in _each(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard] * len(docs), pa.int32()), pa.array(starts, pa.int64()), pa.array(docs, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
            names=["shard", "start_in_shard", "id", "n_tokens", "ids_crc32"],
        )
