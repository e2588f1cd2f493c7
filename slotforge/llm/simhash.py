"""SimHash near-deduplication: fingerprints and a self-join of their binary trie."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotforge.llm.common import materialize, parts, shuffle_parts
from slotforge.llm.graph import connected_components, join_labels

BITS = 64
HASH_SEED = 42
#: A subtree with more fingerprints than this is dealt out again by a second block of bits.
HOT_KEY = 50_000
#: Largest budget: more would leave blocks of one bit, which choose nothing.
MOST_BUDGET = 31
#: Node pairs that are held at once, and pairs of leaves compared directly.
FRONTIER, DIRECT = 1 << 20, 32

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit SimHash of word shingles; 0 where there is no word."""
    words = _WORD.findall(text.encode().translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts, stops = (ends - lengths)[: len(words) - size + 1].tolist(), (ends - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, **more: Column) -> DataFrame:
    """id, fp (the fingerprint as a signed long) of each row, and ``more`` columns of longs; null text counts as empty."""
    extra = list(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            prints = np.array([fingerprint(x or "", shingle) for x in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints.view(np.int64)), *(part.column(c) for c in extra)], names=["id", "fp", *extra])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *(c.cast("long").alias(n) for n, c in more.items()))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "fp", *extra)))


def _components(classes: DataFrame, budget: int) -> DataFrame:
    """fp, component of the distinct fingerprints in ``classes``."""
    linked = connected_components(trie_links(classes, budget)).withColumnRenamed("node", "fp")
    return classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id (the smallest id reachable by links, itself included).

    Equal fingerprints meet in one row before any comparison. Null and empty texts have fingerprint zero, which links
    like any other; a null id joins its group but never names it (a group of null ids has a null component_id);
    repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    grouped = _components(classes, budget)
    lowest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(grouped.join(lowest, "component").select("fp", "component_id"), "components")
    return prints.join(named, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: the one with the smallest id.

    A null id is the last choice; of rows tied on the id one text stays, and rows that are equal in id and text share
    its fate. Rows are told apart by id and two digests of the text, so the texts are shuffled once at most.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, h1=F.xxhash64(text, F.lit(1)), h2=F.xxhash64(text, F.lit(2))), "fingerprints")
    row = F.struct(F.col("id").isNull().alias("unknown"), "id", "h1", "h2")
    classes = materialize(prints.groupBy("fp").agg(F.min(row).alias("first")), "classes")
    grouped = materialize(_components(classes, budget), "grouped")
    best = grouped.groupBy("component").agg(F.min("first").alias("stays"))
    named = materialize(grouped.join(best, "component").select("fp", "stays"), "components")
    goes = prints.join(named, "fp").where(row != F.col("stays")).select(F.col("id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    goes = materialize(goes.distinct(), "goes")
    same = docs[id_col].cast("long").eqNullSafe(goes["_id"]) & (F.xxhash64(text, F.lit(1)) == goes["_h1"]) & (F.xxhash64(text, F.lit(2)) == goes["_h2"])
    return docs.join(goes, same, "left_anti")


def _blocks(width: int, n: int) -> list[tuple[int, int]]:
    """``n`` blocks of nearly equal width over ``width`` bits: (first bit, number of bits)."""
    cuts = [width * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(col: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(col, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _without(col: Column, at: int, n: int) -> Column:
    """The bits outside a block, moved together."""
    low = col.bitwiseAND(F.lit((1 << at) - 1).cast("long"))
    return low if at + n >= BITS else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(col, at + n), at))


def trie_links(classes: DataFrame, budget: int = 4, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) whose closure equals that of all links within ``budget``.

    Two fingerprints within the budget agree on one of budget+1 blocks of bits. For each block the trie with that
    block's bits first is cut below it, and each subtree is joined with itself in one task: node pairs go down
    together, differing bits add up, and a pair beyond the budget is pruned, as is one whose leaves are all joined
    already. A subtree with more than ``hot_key`` leaves is cut again by the same rule on its remaining bits, and a
    subtree of those once more. A task emits a spanning forest, at most one edge a leaf, never all pairs.
    """
    if not 0 <= budget <= MOST_BUDGET:
        raise ValueError(f"a budget is 0 to {MOST_BUDGET}")
    fp, blocks = F.col("fp"), budget + 1
    if not budget:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    cuts = _blocks(BITS, blocks)
    width = BITS - min(n for _, n in cuts)
    rows = classes.select("fp", F.explode(F.array(*(
        F.struct((_bits(fp, at, n) * blocks + k).alias("key"), _without(fp, at, n).alias("rest")) for k, (at, n) in enumerate(cuts)
    ))).alias("x")).select("fp", "x.key", F.lit(-1).cast("long").alias("sub"), "x.rest")
    left = F.col("rest")
    for _ in range(2):
        hot = materialize(rows.groupBy("key", "sub").count().where(F.col("count") > hot_key).select(F.col("key").alias("_k"), F.col("sub").alias("_s")), "hot")
        if not hot.head(1):
            break
        again = F.array(*(F.xxhash64("sub", _bits(left, at, n) * blocks + k) for k, (at, n) in enumerate(_blocks(width, blocks))))
        rows = rows.join(hot, (F.col("key") == F.col("_k")) & (F.col("sub") == F.col("_s")), "left")
        rows = rows.select("fp", "key", F.explode(F.when(F.col("_k").isNotNull(), again).otherwise(F.array("sub"))).alias("sub"), "rest")
        # The next cut takes other bits: the same blocks, each cut in its middle.
        left = F.shiftleft(F.col("rest"), width // (2 * blocks)).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else (1 << 63) - 1).cast("long")).bitwiseOR(F.shiftrightunsigned(F.col("rest"), width - width // (2 * blocks)))
    dealt = rows.repartition(shuffle_parts(classes.sparkSession), "key", "sub").sortWithinPartitions("key", "sub", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sub, fps, rests in _whole_groups(batches):
            a, b = forest(key, sub, rests, budget, width)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=["a", "b"])

    return dealt.select("key", "sub", "fp", "rest").mapInArrow(run, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], enough: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of a sorted partition, cut only where the group changes."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        held.append(tuple(np.asarray(c) for c in batch.columns))
        size += batch.num_rows
        if size >= enough:
            whole = tuple(map(np.concatenate, zip(*held, strict=True)))
            new = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1]))
            if len(new):
                cut = int(new[-1]) + 1
                yield tuple(c[:cut] for c in whole)
                whole = tuple(c[cut:] for c in whole)
            held, size = [whole], len(whole[0])
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def forest(key: np.ndarray, sub: np.ndarray, rest: np.ndarray, budget: int, width: int = 52) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) that join what is linked within each group of sorted rows; paths have ``width`` bits."""
    edge = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    out_a, out_b = [], []
    together = 1 << (BITS - width)  # groups that one call joins, by the bits above the path
    for at in range(0, len(lo), together):
        a, b = lo[at : at + together], hi[at : at + together]
        rows = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)])
        group = np.repeat(np.arange(len(a), dtype=np.uint64), b - a)
        labels = _join_trie((group << np.uint64(width)) | rest[rows].astype(np.uint64), budget, width)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        out_a.append(rows[moved])
        out_b.append(rows[labels[moved]])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _join_trie(codes: np.ndarray, budget: int, width: int) -> np.ndarray:
    """Labels of sorted, distinct codes: a path of ``width`` bits below the group. Deepest nodes join first."""
    n = len(codes)
    labels = np.arange(n)
    above = np.uint64(width)
    starts = np.concatenate([[0], np.flatnonzero(codes[1:] >> above != codes[:-1] >> above) + 1])
    lo, hi = starts, np.concatenate([starts[1:], [n]])
    forks = []  # (bit, lo, mid, hi) of nodes with two children
    for bit in range(width - 1, -1, -1):
        mid = _middle(codes, lo, bit)
        fork = (mid > lo) & (mid < hi)
        if fork.any():
            forks.append((bit, lo[fork], mid[fork], hi[fork]))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([np.minimum(mid, hi), hi])
        lo[len(mid) :] = np.maximum(lo[len(mid) :], lo[: len(mid)])
        many = hi - lo > 1
        lo, hi = lo[many], hi[many]
        if not len(lo):
            break
    for bit, a, mid, b in reversed(forks):
        stack = [(bit - 1, a, mid, mid, b, np.ones(len(a), dtype=np.int64))]
        while stack:
            at, alo, ahi, blo, bhi, diff = stack.pop()
            changes = np.concatenate([np.flatnonzero(labels[1:] != labels[:-1]) + 1, [n]])
            uniform = (changes[np.searchsorted(changes, alo, "right")] >= ahi) & (changes[np.searchsorted(changes, blo, "right")] >= bhi)
            open_ = ~(uniform & (labels[alo] == labels[blo]))
            alo, ahi, blo, bhi, diff = alo[open_], ahi[open_], blo[open_], bhi[open_], diff[open_]
            pairs = (ahi - alo) * (bhi - blo)
            small = (pairs <= DIRECT) | (at < 0)
            if small.any():
                i, j = _leaf_pairs(alo[small], ahi[small], blo[small], bhi[small])
                near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
                labels = join_labels(labels, i[near], j[near])
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                continue
            am, bm = np.clip(_middle(codes, alo, at), alo, ahi), np.clip(_middle(codes, blo, at), blo, bhi)
            child = [
                np.concatenate(x)
                for x in ((alo, am, alo, am), (am, ahi, am, ahi), (blo, bm, bm, blo), (bm, bhi, bhi, bm), (diff, diff, diff + 1, diff + 1))
            ]
            live = (child[1] > child[0]) & (child[3] > child[2]) & (child[4] <= budget)
            child = [x[live] for x in child]
            for k in range(0, len(child[0]), FRONTIER):
                stack.append((at - 1, *(x[k : k + FRONTIER] for x in child)))
    return labels


def _middle(codes: np.ndarray, lo: np.ndarray, bit: int) -> np.ndarray:
    """Where the leaves with ``bit`` set begin, for nodes that begin at ``lo`` and whose leaves agree above it."""
    up = np.uint64(bit + 1)
    return np.searchsorted(codes, ((codes[lo] >> up) << up) | np.uint64(1 << bit), "left")


def _leaf_pairs(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of leaves of each node pair."""
    na, nb = ahi - alo, bhi - blo
    pairs = na * nb
    which = np.repeat(np.arange(len(pairs)), pairs)
    k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    return alo[which] + k // nb[which], blo[which] + k % nb[which]
