"""Toxicity by a learned lexicon that is matched with Levenshtein automata and weighed in context windows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm.common import materialize, parts, texts_of

#: Bound of what is learned from, in labelled rows.
SAMPLE = 12_000
#: Words on either side of a hit that make its window.
WINDOW = 5
#: Stems are the first letters of words; a term must be in so many toxic texts (a hundredth of them, if that is more),
#: and its log odds against other texts must be so high.
STEMS, LEAST, MARKED = (4, 5, 6), 4, 2.5
#: A term of so many letters may be misspelled by one edit.
FUZZY = 5
#: Share of its weight that a hit keeps between quotation marks, and with words of report near it.
QUOTED, REPORTED = 0.3, 0.5

# Marks that open or close a quotation, and words that report what somebody said.
QUOTES = "\"“”„«»‘’"
REPORTS = frozenset("said says called quote quoted quoting wrote word term sagte nannte zitat wort dit appelé citation mot dijo llamó cita palabra".split())

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”„«»‘’]")
_WIDE = ("sum", "fuzzy", "most", "window", "density", "quoted")


class Automaton:
    """The intersection of one-edit Levenshtein automata with the trie of a lexicon, made deterministic as it runs.

    A state is the set of (trie node, edits so far) that a prefix can be in. Terms of fewer than FUZZY letters allow no
    edit. A stem accepts every word that goes on from it.
    """

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.allows: list[int] = [0]  # most edits of any term below a node
        for terms, ends in ((words, self.word_at), (stems, self.stem_at)):
            for term, number in terms.items():
                node, edits = 0, int(len(term) >= FUZZY)
                self.allows[0] = max(self.allows[0], edits)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        for table in (self.word_at, self.stem_at):
                            table.append(-1)
                        self.allows.append(0)
                    node = self.children[node][c]
                    self.allows[node] = max(self.allows[node], edits)
                ends[node] = number
        self.letters = frozenset(c for kids in self.children for c in kids)
        self.edits_of = {n: int(len(t) >= FUZZY) for terms in (words, stems) for t, n in terms.items()}
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []  # the best whole word, and the best stem, that a state accepts
        self.runs: list[tuple[int, int] | None] = []
        self.dead = self._number(frozenset())
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """Add what one left-out letter leads to; of a node only the fewest edits matter."""
        least: dict[int, int] = {}
        for node, e in state:
            least[node] = min(e, least.get(node, 9))
            if e == 0:
                for kid in self.children[node].values():
                    if self.allows[kid]:
                        least[kid] = min(1, least.get(kid, 9))
        return frozenset(least.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            for table, ends in ((self.ends, self.word_at), (self.runs, self.stem_at)):
                hits = [(e, ends[node]) for node, e in state if ends[node] >= 0 and e <= self.edits_of[ends[node]]]
                table.append(min(hits) if hits else None)
        return self.numbers[state]

    def _step(self, number: int, letter: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self.states[number]:
            kids = self.children[node]
            if letter in kids:
                after.add((kids[letter], e))
            if e == 0 and self.allows[node]:
                after.add((node, 1))  # a letter too many
                after.update((kid, 1) for kid in kids.values() if self.allows[kid])  # a wrong one
        return self._number(self._closed(after))

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best match, exact ones first."""
        at, stem = self.start, None
        for c in word:
            c = c if c in self.letters else ""
            step = self.steps[at].get(c)
            if step is None:
                step = self.steps[at][c] = self._step(at, c)
            at = step
            if at == self.dead:
                return stem
            run = self.runs[at]
            if run and (stem is None or run < stem):
                stem = run
        end = self.ends[at]
        return end if end and (stem is None or end <= stem) else stem


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    exact: list[float] = field(default_factory=list)  # weights of the terms as spelled, and with one edit
    fuzzy: list[float] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(_WIDE)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(_WIDE)))
    slope: np.ndarray = field(default_factory=lambda: np.zeros(len(_WIDE)))
    bias: float = 0.0

    def automaton(self) -> Automaton:
        if "_automaton" not in self.__dict__:
            self.__dict__["_automaton"] = Automaton(self.words, self.stems)
        return self.__dict__["_automaton"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, int, int]]]:
        """Words and quotation marks of a text; position, edits and term of each hit."""
        words = _TOKEN.findall(text.lower())
        match = self.automaton().match
        return words, [(k, *found) for k, w in enumerate(words) if (found := match(w))]

    def describe(self, text: str) -> np.ndarray:
        """Sums over the hits of a whole text, each weighed by its window."""
        words, hits = self.hits(text)
        out = np.zeros(len(_WIDE))
        if not hits:
            return out
        marks = [k for k, w in enumerate(words) if w in QUOTES]
        before, recent = 0.0, []
        for k, edits, term in hits:
            weight = (self.fuzzy if edits else self.exact)[term]
            near = words[max(0, k - WINDOW) : k + WINDOW + 1]
            at = np.searchsorted(marks, k)
            quoted = 0 < at < len(marks) and k - marks[at - 1] <= WINDOW and marks[at] - k <= WINDOW
            reported = not REPORTS.isdisjoint(near)
            kept = weight * (QUOTED if quoted else 1.0) * (REPORTED if reported else 1.0)
            recent = [(p, v) for p, v in recent if k - p <= 2 * WINDOW] + [(k, kept)]
            out[0 if not edits else 1] += kept
            out[2] = max(out[2], kept)
            before = max(before, sum(v for _, v in recent))
            out[5] += weight - kept
        out[3] = before
        out[4] = math.log1p(100 * (out[0] + out[1]) / max(20, len(words))) if out[0] + out[1] > 0 else 0.0
        out[[0, 1, 5]] = np.log1p(np.maximum(out[[0, 1, 5]], 0))
        return out

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(((self.describe(text) - self.mean) / self.scale) @ self.slope + self.bias))))))


def _logodds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled rows, half of each label where there are enough, drawn by a hash of the id.

    The sample is drawn from the labels alone, so only its ids meet the texts. Equal texts with equal labels teach once;
    an id with both labels counts as 1. Null ids and labels teach nothing, a null text counts as empty. With one label
    only, the score is near that label; with none it is one half.
    """
    spark = docs.sparkSession
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        one = marks.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(sample // 2)
        chosen = one if chosen is None else chosen.unionByName(one)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # ``sample`` ids at most
    drawn = materialize(rows.groupBy(F.xxhash64("text").alias("same"), "y").agg(F.first("text").alias("text")).select("text", "y"), "labelled")
    sizes = {r.y: r.n for r in drawn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(bias=0.0 if not n1 and not n0 else 4.0 if n1 else -4.0)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for part in parts(batches, "text"):
            for text, y in zip(texts_of(part, "text"), part.column("y").to_pylist(), strict=True):
                words = {w for w in _TOKEN.findall(text.lower()) if len(w) > 2}
                found[y].update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
        named = [(t, n, found[0][t]) for t, n in found[1].items()]
        if named:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*named, strict=True)], names=["term", "toxic", "clean"])
        rest = [(t, 0, n) for t, n in found[0].items() if t not in found[1]]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rest, strict=True)], names=["term", "toxic", "clean"])

    counted = drawn.mapInArrow(terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    # a term is in a hundredth of the toxic texts at least, so there are a hundred times the terms of a mean one at most
    best = counted.where((F.col("toxic") >= max(LEAST, n1 // 100)) & (odds >= MARKED)).withColumn("odds", odds).collect()
    best.sort(key=lambda r: (-r.odds, r.term))
    words, stems, exact = _lexicon([(r.term, r.odds) for r in best])
    model = Model(words, stems, exact, list(exact))
    model.fuzzy = _fuzzy_weights(drawn, spark.sparkContext.broadcast(model), len(exact), n1, n0)

    shared = spark.sparkContext.broadcast(model)  # bounded as ``best`` is

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            x = [shared.value.describe(t) for t in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column("y")], names=["x", "y"])

    table = drawn.mapInArrow(describe, "x array<double>, y int").toArrow()  # at most SAMPLE rows
    x, y = np.array(table.column("x").to_pylist()), np.array(table.column("y").to_pylist(), dtype=float)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.slope, model.bias = _logistic((x - model.mean) / model.scale, y)
    return model


def _lexicon(ranked: list[tuple[str, float]]) -> tuple[dict[str, int], dict[str, int], list[float]]:
    """Stems first, the shortest that mark as well as their longer forms; then words that no stem covers."""
    odds = dict(ranked)
    stems: dict[str, int] = {}
    words: dict[str, int] = {}
    weights: list[float] = []
    for n in STEMS:
        for term, value in ranked:
            if len(term) == n + 1 and term[-1] == "*" and not any(term[:k] in stems for k in STEMS if k < n):
                stems[term[:-1]] = len(weights)
                weights.append(value)
    for term, value in ranked:
        if term[-1] != "*" and not any(term[:k] in stems and odds[term[:k] + "*"] >= value - 0.7 for k in STEMS):
            words[term] = len(weights)
            weights.append(value)
    return words, stems, weights


def _fuzzy_weights(drawn: DataFrame, shared, size: int, n1: int, n0: int) -> list[float]:
    """What a hit with one edit says about each term, from the texts that have no exact hit of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            for text, y in zip(texts_of(part, "text"), part.column("y").to_pylist(), strict=True):
                near = {t for _, e, t in shared.value.hits(text)[1] if e}
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array(list(near), pa.int32()), pa.array([y] * len(near), pa.int32())], names=["term", "y"])

    seen = {r.term: (r.toxic, r.clean) for r in drawn.mapInArrow(count, "term int, y int").groupBy("term").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).collect()}
    out = []
    for k in range(size):
        toxic, clean = seen.get(k, (0, 0))
        if toxic + clean == 0:
            out.append(0.7 * shared.value.exact[k])  # never seen misspelled: trusted a little less
        else:
            out.append(max(0.0, _logodds(toxic, clean, n1, n0) - 1.0))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps with a ridge penalty."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.full(a.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row; a null text counts as empty, ids pass as they are, other columns are ignored.

    Whole texts count, whatever their length; equal texts get equal scores; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shared.value.score(x) for x in texts_of(part, "text")], pa.float64())], names=["id", "score"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
