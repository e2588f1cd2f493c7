"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm.common import CACHE_LENGTH, Memo, parts, texts_of

#: Entries of the broadcast table, frequent pre-tokens that a task names, and those it counts at a time.
TABLE, TOP, COUNTED = 1 << 16, 1 << 14, 1 << 19

_CHUNK = re.compile(" +[^ ]*")
#: Stands for a space mark on its own, at the end or before a line break: one token, as a line break is.
_MARK = "\n"


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if re.search("[^▁]▁|\n", p)]
    if inner:
        raise ValueError(f"pieces run across a space or line break, so pre-tokens aren't independent: {inner[:3]}")
    return model


def pre_tokens(text: str) -> list[str]:
    """The stretches that the model encodes independently, each without the one space before it.

    No piece goes from a character to a following space mark or holds a line break, so merges never cross those places.
    A stretch that follows a lone line break begins with it.
    """
    if not text:
        return []
    text = text.replace("▁", " ")
    if text[0] not in " \n" and text[-1] != " " and "  " not in text and " \n" not in text:
        return text.replace("\n", " \n").split(" ")
    found = [x[1:] for x in _CHUNK.findall(" " + text)]
    return [y for x in found for y in ((_MARK,) if not x else (_MARK, x) if x[0] == "\n" else (x,))]


def lengths_of(model: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[int]:
    """Tokens of each stretch; before one that begins with a line break the model puts a mark that isn't in the text."""
    return [len(ids) - (w[:1] == "\n") for w, ids in zip(words, model.encode(words, num_threads=1), strict=True)]


class Table:
    """Lengths of frequent pre-tokens in three arrays, by two 64-bit halves of a digest: no text is held."""

    def __init__(self, words: list[str], lengths: list[int]):
        self.key = uuid.uuid4().hex
        high, low = self._digests(words)
        order = np.argsort(high, kind="stable")
        self.high, self.low, self.lengths = high[order], low[order], np.array(lengths, np.int32)[order]

    @staticmethod
    def _digests(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), ">u8").reshape(-1, 2).astype(np.uint64)
        return raw[:, 0], raw[:, 1]

    def find(self, words: list[str]) -> np.ndarray:
        """The length of each word, -1 for those that aren't in the table."""
        if not words or not len(self.high):
            return np.full(len(words), -1, np.int32)
        high, low = self._digests(words)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), self.lengths[at], -1)


class Lengths:
    """The two tiers of a worker: the broadcast table, then what the worker has encoded itself, in a cache of bounded bytes."""

    def __init__(self, model_path: str, table: Table):
        self.model, self.table, self.memo = _model(model_path), table, Memo()
        self.hits = self.misses = 0

    def _make(self, words: list[str]) -> list[int]:
        found = self.table.find(words)
        missing = np.flatnonzero(found < 0)
        found[missing] = lengths_of(self.model, [words[k] for k in missing.tolist()])
        self.hits += len(words) - len(missing)
        self.misses += len(missing)
        return found.tolist()

    def of(self, words: set[str]) -> dict[str, int]:
        return self.memo.fill(words, self._make)


_worker: dict[tuple[str, str], Lengths] = {}


def worker_lengths(model_path: str, table: Table) -> Lengths:
    """This worker's tiers for a table, which outlive its tasks; those of an earlier table are given up."""
    key = (model_path, table.key)
    if key not in _worker:
        _worker.clear()
        _worker[key] = Lengths(model_path, table)
    return _worker[key]


def frequent(docs: DataFrame, model_path: str, text_col: str = "text", size: int = TABLE, each: int = TOP) -> Table:
    """The pre-tokens that are most frequent over all texts, with their token counts.

    A task counts the pre-tokens of all its texts and gives its ``each`` most frequent; a counter that grows past COUNTED
    gives up its rarest half. Only those short lists meet, never the pre-tokens themselves. What a list misses is looked
    up by encoding later: the table decides speed, never a count.
    """
    rows = docs.select(docs[text_col].alias("text"))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for part in parts(batches, "text"):
            for text in texts_of(part, "text"):
                counter.update(pre_tokens(text))
            if len(counter) > COUNTED:
                counter = Counter(dict(counter.most_common(COUNTED // 2)))
        kept = [(w, n) for w, n in counter.most_common(each) if n > 1 and len(w) <= CACHE_LENGTH]
        if kept:
            words, n = zip(*kept, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    lists = rows.mapInArrow(top, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r.word for r in lists.orderBy(F.desc("n"), "word").limit(size).collect()]
    return Table(words, lengths_of(_model(model_path), words))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    Counts equal the library's over the whole text, without begin or end tokens. A null text counts as empty (0, 0);
    ids are passed on as they are, null or repeated; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, model_path, text_col))  # TABLE entries of 20 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_lengths(model_path, table.value)
        for part in parts(batches, "text"):
            words = list(map(pre_tokens, texts_of(part, "text")))
            get = lengths.of(set(chain.from_iterable(words))).__getitem__
            n_bytes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), n_bytes, pa.array([sum(map(get, w)) for w in words], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
