"""Periodic runs of words: difference-cover extensions on a harmonic grid.

A run of period q and exponent 4 or more holds four neighbouring multiples of q, so one of the pairs (3jq, 3jq + q) lies
inside it. Those pairs are the grid; its size for all q is about n ln n / 3. Where the words of a pair and of two of its
neighbours agree, the run is the longest common extension of the pair to both sides.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm.common import parts

#: A run has this exponent and this many words at least.
EXPONENT, LEAST = 4, 6
#: Side of the difference cover for texts below so many words, and above.
SIDES = ((4, 4_096), (8, None))
#: Grid pairs looked at together.
PAIRS = 1 << 20

_OUT = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def cover(side: int) -> np.ndarray:
    """Residues modulo side**2 such that every difference occurs: 0..side-1 and the multiples of side."""
    return np.unique(np.concatenate([np.arange(side), np.arange(side) * side]))


@cache
def _shifts(side: int) -> np.ndarray:
    """For two residues the fewest words until both are sampled."""
    v = side * side
    sampled = np.isin(np.arange(v), cover(side))
    ahead = np.arange(v)[:, None] + np.arange(v)[None, :]
    both = sampled[ahead[:, None, :] % v] & sampled[ahead[None, :, :] % v]
    return both.argmax(axis=2)


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the pairs (a, b)."""
    o = np.lexsort((b, a))
    x, y = a[o], b[o]
    rank = np.empty(len(a), np.int64)
    rank[o] = np.concatenate([[0], np.cumsum((x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
    return rank


class Extensions:
    """Longest common extensions of suffixes of ``w`` (non-negative integers).

    Only suffixes that start at a cover residue are sorted, by doubling from their first v words: i + v is sampled where
    i is. Two any positions reach sampled ones after fewer than v words, which are compared; the rest is a range minimum
    over the neighbours' common prefixes, from a sparse table.
    """

    def __init__(self, w: np.ndarray, side: int):
        n, self.v = len(w), side * side
        v, residues = self.v, cover(side)
        self.w = np.concatenate([w.astype(np.int64), np.full(v + 1, -1)])
        pos = np.nonzero(np.isin(np.arange(v), residues))[0]
        pos = (pos[None, :] + np.arange(0, n + v, v)[:, None]).ravel()
        pos = pos[pos < n]
        m, slot = len(pos), np.full(n + 1, -1, np.int64)
        slot[pos] = np.arange(m)

        bits = int(w.max() + 2).bit_length()
        rank, each = np.zeros(m, np.int64), 62 // bits
        for a in range(0, v, each):  # as many words at once as a long holds
            key = np.zeros(m, np.int64)
            for j in range(a, min(v, a + each)):
                key = (key << bits) | (self.w[np.minimum(pos + j, n)] + 1)
            rank = _dense(rank, key)
        levels, step = [rank], v
        while m > 1 and rank.max() < m - 1:
            after = slot[np.minimum(pos + step, n)]
            rank = _dense(rank, np.where(after >= 0, rank[after] + 1, 0))
            levels.append(rank)
            step *= 2

        order = np.argsort(rank)
        common = np.zeros(max(0, m - 1), np.int64)
        a, b = pos[order[:-1]], pos[order[1:]]
        for k in range(len(levels) - 1, -1, -1):
            i, j = slot[np.minimum(a + common, n)], slot[np.minimum(b + common, n)]
            same = (i >= 0) & (j >= 0) & (levels[k][i] == levels[k][j])
            common[same] += v << k
        common += self._compare(a + common, b + common, np.full(len(a), v))
        self.rank = np.full(n + v, -1, np.int64)
        self.rank[pos] = rank
        self.table = [common.astype(np.int32)]
        while len(self.table[-1]) > (half := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

        self.shift = _shifts(side)

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, ``most`` at the most. Past the end no word is equal, as i and j differ."""
        out, alive, w = np.zeros(len(i), np.int64), np.arange(len(i)), self.w
        for k in range(self.v):
            alive = alive[most[alive] > k]
            alive = alive[w[np.minimum(i[alive] + k, len(w) - 1)] == w[np.minimum(j[alive] + k, len(w) - 1)]]
            if not len(alive):
                break
            out[alive] = k + 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions to the right of i and j, i < j <= len(w)."""
        ahead = self.shift[i % self.v, j % self.v]
        out = self._compare(i, j, ahead)
        far = np.nonzero((out == ahead) & (j + ahead < len(self.w) - self.v - 1))[0]
        a, b = self.rank[i[far] + ahead[far]], self.rank[j[far] + ahead[far]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[far[at]] += np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << int(k))])
        return out


def _pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid (i, q), some periods at a time."""
    q = np.arange(1, n // EXPONENT + 1)
    counts = (n - 1 - q) // (3 * q) + 1
    ends, at = np.cumsum(counts), 0
    while at < len(q):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        many = np.repeat(q[at:stop], counts[at:stop])
        first = np.repeat(ends[at:stop] - counts[at:stop] - (ends[at - 1] if at else 0), counts[at:stop])
        yield 3 * many * (np.arange(len(many)) - first), many
        at = stop


def runs(w: np.ndarray) -> np.ndarray:
    """(start, length, period) of all maximal runs of ``w``, by start and period."""
    n, found = len(w), []
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    x = np.concatenate([[-1], w, [-2]])

    def word(at: np.ndarray) -> np.ndarray:
        return x[np.clip(at + 1, 0, n + 1)]

    right = left = None
    for i, q in _pairs(n):
        here = np.nonzero(w[i] == w[i + q])[0]
        i, q = i[here], q[here]
        one, two = word(i), word(i + 2 * q)
        after, before = one == two, word(i - q) == one
        keep = (after & (before | (two == word(i + 3 * q)))) | (before & (word(i - 2 * q) == one))
        i, q = i[keep], q[keep]
        if not len(i):
            continue
        if right is None:
            side = next(s for s, below in SIDES if below is None or n < below)
            right, left = Extensions(w, side), Extensions(w[::-1], side)
        some = i > 0
        back = np.zeros(len(i), np.int64)
        back[some] = left(n - i[some] - q[some], n - i[some])
        start, length = i - back, q + right(i, i + q) + back
        long = length >= np.maximum(LEAST, EXPONENT * q)
        found.append(np.stack([start[long], length[long], q[long]], 1))
    if not found:
        return np.zeros((0, 3), np.int64)
    # a multiple of a run's period gives the same stretch: the smallest period of a stretch is its own
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(axis=1)]) if len(every) else np.zeros(0, bool)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """False for words that some run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def plant(w: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Repeat a stretch of every tenth text to its end, as crc32 of the id says; a null id counts as the empty text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([w[:a], w[a + np.arange(n - a) % p]])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: Callable[[np.ndarray, int | None], np.ndarray] | None = None) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period; in words), collapsed text.

    Words are separated by the six ASCII spaces. The collapsed text keeps, joined by one space, the words that no run
    contains after its first period. ``alter`` may change the words' numbers of a text before. Null and empty texts have
    no words, no runs and an empty collapsed text; null and repeated ids are rows like others; other columns are ignored.
    Rows stay where they are read; a text of n words takes n log n time and memory in its task, whatever its length.
    """
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            lists, counts, numbers = [], [], [0]
            texts: list[str] = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words, names = (text or "").encode().split(), {}
                w = np.fromiter((names.setdefault(x, len(names)) for x in words), np.int64, len(words))
                if alter is not None:
                    w = alter(w, i)
                found = runs(w)
                if alter is None and not len(found):
                    texts.append(b" ".join(words).decode())
                else:
                    known = list(names)
                    texts.append(b" ".join(map(known.__getitem__, w[kept_words(len(w), found)].tolist())).decode())
                lists.append(found)
                counts.append(len(words))
                numbers.append(numbers[-1] + len(found))
            flat = np.concatenate(lists)
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(numbers, pa.int32()), spans), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(work, _OUT).withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_runs, the greatest run (start, length, period, exponent_milli; nulls without a run) and digests of runs and text."""
    best = F.try_element_at(F.array_sort("runs", lambda a, b: F.coalesce(
        F.nullif(F.signum(b["length"] - a["length"]), F.lit(0.0)), F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(a["period"] - b["period"])).cast("int")), F.lit(1))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    rows = found.select(F.col(id_col), F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (F.col(f"_best.{x}") for x in ("start", "length", "period"))
    return rows.select(id_col, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
