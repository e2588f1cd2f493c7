"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from slotforge.llm.common import materialize, parts

UNKNOWN = "und"
#: Hashed n-gram features, the n-grams' lengths, and characters that are hashed at once.
FEATURES, ORDERS, STRETCH = 1 << 15, (1, 2, 3), 1 << 18
#: Bound of the training sample: rows of one language, rows in all, and n-grams of all rows (all in expectation). Where
#: the rows have more n-grams, fewer rows are taken; at most GRAMS * 6 bytes come to the driver.
PER_LANGUAGE, SAMPLE, GRAMS = 1_500, 12_000, 24 << 20
#: More languages than this are an error: their weights would no longer be a small table.
LANGUAGES = 1_200

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of a whole text and how often each occurs. What isn't a letter counts as one space."""
    points = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    counts = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(points), STRETCH):
        for n in ORDERS:
            piece = points[at : at + STRETCH + n - 1]
            width = len(piece) - n + 1
            if width <= 0:
                continue
            mixed = np.full(width, n, dtype=np.uint64)
            for k in range(n):
                mixed = (mixed ^ piece[k : k + width]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            counts += np.bincount((mixed >> np.uint64(13)).astype(np.int64) & (FEATURES - 1), minlength=FEATURES)
    index = np.flatnonzero(counts)
    return index, counts[index]


def weigh(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic term frequency, of length one."""
    value = (1 + np.log(counts)) * idf[index]
    return value / max(np.linalg.norm(value), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x languages
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        index, counts = features(text)
        p = _softmax((weigh(index, counts, self.idf) @ self.weights[index] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002, epochs: int = 3) -> Model:
    """Follow-the-regularised-leader with elastic-net penalties; every tenth row is kept for the temperature.

    ``rows``: n-grams, counts and language of each training document.
    """
    languages = sorted({r[2] for r in rows})
    code = {x: k for k, x in enumerate(languages)}
    order = np.random.default_rng(7).permutation(len(rows))
    held = [rows[k] for k in order[::10]] if len(rows) >= 50 else []
    used = [rows[k] for n, k in enumerate(order) if n % 10 or not held]
    df = np.zeros(FEATURES)
    for index, _, _ in used:
        df[index] += 1
    idf = np.log((1 + len(used)) / (1 + df)) + 1
    size = len(languages)
    z, n = np.zeros((FEATURES + 1, size)), np.zeros((FEATURES + 1, size))  # the last row is the bias
    penalty = np.full((FEATURES + 1, 1), l1)
    penalty[-1] = 0

    def leader(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for index, counts, language in used:
            at = np.append(index, FEATURES)
            x = np.append(weigh(index, counts, idf), 1.0)
            w = leader(at)
            slope = _softmax(x @ w)
            slope[code[language]] -= 1
            g = x[:, None] * slope
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = leader(np.arange(FEATURES + 1))
    model = Model(languages, idf, w[:-1].astype(np.float32), w[-1], 1.0)
    if not held:
        return model
    logits = np.array([weigh(i, c, idf) @ model.weights[i] + model.bias for i, c, _ in held])
    truth = np.array([code[x] for _, _, x in held])
    loss = lambda t: -np.mean(np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12))
    return Model(languages, idf, model.weights, model.bias, float(min(np.geomspace(0.05, 5, 60), key=loss)))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, grams: int = GRAMS) -> Model:
    """Fit on a bounded sample of labelled rows: about ``per_language`` of each language, drawn by a hash of id and text.

    The n-grams of whole texts are counted where the rows are read; only their numbers and counts come to the driver.

    Rows with a null language, a null text or no letter teach nothing; null and repeated ids are drawn like others, rows
    that are the same in id and text all or none. Without any row the model knows no language; more than LANGUAGES of
    them are an error.
    """
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if (known := sizes.count()) > LANGUAGES:
        raise ValueError(f"{known} languages, more than {LANGUAGES}")
    each = max(1, min(per_language, sample // max(1, known)))
    share = sizes.select("lang", (F.lit(float(each)) / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64(F.col("id"), F.col("text"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).select(F.xxhash64("id", "text", F.lit(13)).alias("at"), "text", "lang")  # LANGUAGES at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            found = [features(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("at"), pa.array([x[0].astype(np.int16) for x in found], pa.list_(pa.int16())), pa.array([x[1].astype(np.float32) for x in found], pa.list_(pa.float32())), part.column("lang")], names=["at", "index", "counts", "lang"])

    counted = materialize(drawn.mapInArrow(count, "at long, index array<short>, counts array<float>, lang string"), "grams")
    held = counted.agg(F.sum(F.size("index"))).first()[0] or 0
    if held > grams:
        counted = counted.where(F.pmod(F.xxhash64("at", F.lit(17)), F.lit(1 << 30)) / float(1 << 30) < grams / held)
    table = counted.toArrow().sort_by([("at", "ascending"), ("lang", "ascending")])
    index, counts = table.column("index"), table.column("counts")
    return fit([(np.asarray(i.values), np.asarray(c.values), x) for i, c, x in zip(index, counts, table.column("lang").to_pylist(), strict=True)])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """id, lang_pred and score of each row; with ``whole`` a struct ``row`` of all its columns instead of the id.

    lang_pred is ``und`` with score 0 where the text is null, empty or has no letter, or the model knows no language. Null
    and repeated ids are rows like others.
    Very long texts are read whole, in stretches; repeated rows get equal results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages, LANGUAGES at most
    kept = F.struct(*(docs[f"`{c}`"] for c in docs.columns)) if whole else F.struct(docs[id_col].alias("id"))
    rows = docs.select(kept.alias("row"), docs[text_col].alias("text"))
    kind = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            found = [shared.value.predict(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["row", "lang_pred", "score"])

    schema = StructType([StructField("row", kind), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out if whole else out.select(F.col("row.id").alias(id_col), "lang_pred", "score")
