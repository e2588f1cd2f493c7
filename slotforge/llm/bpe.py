"""BPE encoding and decoding with contiguous rank arrays (word-end vocabularies)."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm.common import Memo, parts, texts_of

NO_RANK = 1 << 30
#: Words of more parts than this use a heap, as scanning a rank array costs the square of its length.
SHORT_WORD = 256
#: Bytes of text that a worker encodes and decodes at once.
ROUND_BYTES = 1 << 20
#: Bytes of a worker's cache of words.
WORD_CACHE = 160 << 20

# The vocabulary file's own split pattern and the characters that count as white space in it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = "\t\n\v\f\r \u0085                 　"

_LONE = regex.compile(f"[^{SPACES}]+")
_SPLIT = regex.compile(SPLIT)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends: lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # the id that a merge makes, by its rank
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + self.end] for x in letters]
        names = self.vocab | self.special
        tokens = [""] * (max(names.values()) + 1)
        for token, i in names.items():
            tokens[i] = token
        self.tokens = pa.array(tokens)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo = Memo(limit=WORD_CACHE)

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, the leftmost of equals. A part is known by where it begins, so its neighbours by position."""
        if len(ids) > SHORT_WORD:
            return self._merge_long(ids)
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(p, NO_RANK) for p in zip(ids, ids[1:])]  # noqa: B905  of each part with its right neighbour
        while ranks and (best := min(ranks)) != NO_RANK:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank_of, made, n = self.ranks.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]), NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = made[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank_of((ids[k], ids[after[k]]), NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x, on in zip(ids, live, strict=True) if on]

    def word(self, word: str) -> list[int]:
        """Ids of a stretch without white space, already in lower case."""
        out: list[int] = []
        for piece in _SPLIT.findall(word):
            raw = piece.encode()
            out += self.merge([*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]])
        return out

    def words(self, text: str) -> list[str]:
        return _LONE.findall("".join(c.lower() for c in unicodedata.normalize("NFC", text)) if "Σ" in text else unicodedata.normalize("NFC", text).lower())

    def _packed(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.word, words))
        flat = np.fromiter(chain.from_iterable(ids), "<i4").tobytes()
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins (one more entry than texts)."""
        split = []
        for text in texts:
            if self.marks and "<|" in text and self.marks.search(text):
                split.append([x for k, t in enumerate(self.marks.split(text)) for x in ([t] if k % 2 else self.words(t))])
            else:
                split.append(self.words(text))
        plain = set(chain.from_iterable(split))
        specials = plain & self.special.keys()
        known = self.memo.fill(plain - specials, self._packed)
        get = known.__getitem__
        if specials:
            marks = {t: np.array([i], dtype="<i4").tobytes() for t, i in self.special.items()}
            get = lambda w: marks[w] if w in marks else known[w]  # noqa: E731  a mark inside a text is always the mark
        packed = [b"".join(map(get, w)) for w in split]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)))]) // 4
        return np.frombuffer(b"".join(packed), dtype="<i4"), ends.astype(np.int32)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The file names no decoder: tokens joined by one space."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))
        return pc.binary_join(tokens, " ")


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int). Null text counts as empty and gives an empty array.

    Ids of documents pass as they are, null or repeated; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for part in parts(batches, "text"):
            ids, at = bpe.encode(texts_of(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=["id", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, ids, decoded. A null array decodes as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = pa.array(part.column("ids"), pa.list_(pa.int32())) if part.column("ids").null_count == 0 else pa.array([x or [] for x in part.column("ids").to_pylist()], pa.list_(pa.int32()))
                ids = pa.concat_arrays([ids])
                flat = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), ids.flatten())
                yield pa.RecordBatch.from_arrays([part.column("id"), flat, bpe.decode(flat)], names=["id", "ids", "decoded"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids, decoded: ``decode`` of ``encode`` in one pass, so that a task has one worker and
    one vocabulary. The same cases are defined as in ``encode``; an empty text decodes as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for part in parts(batches, "text", ROUND_BYTES):
            flat, at = bpe.encode(texts_of(part, "text"))
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("id"), ids, bpe.decode(ids)], names=["id", "ids", "decoded"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and sha256 digests of ids and decoded texts."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
