"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotforge.llm.common import materialize

#: Rounds at most, and the largest relative error of a marginal at which rounds end.
ROUNDS, TOLERANCE = 40, 1e-6
#: With more values of language or topic than this, their factors are kept in tables too; sources always are.
LABELS = 2_000
#: Exponent that flattens observed shares into default targets, and the share of tokens to keep.
FLATTEN, KEEP = 0.7, 0.5
SEED = 20_240_607
OTHER = "(none)"


def token_count(text: Column) -> Column:
    """Words between white space; 0 for null or blank texts."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from surface marks of a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.rlike(r"licen[sc]e|copyright"), "legal")
        .when(low.rlike(r"https?://|www\.|[a-z0-9._]+@[a-z0-9.]+|token\s*=|api[_-]?key"), "web")
        .when(low.rlike(r"\d{4,}"), "figures")
        .when(low.contains(" | "), "lists")
        .otherwise("prose")
    )


def draw(id_col: Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) that depends on the id and the seed alone."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    keep: float = KEEP,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, source, lang, topic, n_tokens, weight, probability, sampled, marginal_error.

    Token totals of the cells (source, language, topic) are raked until each marginal meets its target shares; a
    document's weight is its cell's raked tokens per token, and it is sampled with probability min(1, k * weight), where
    k makes the expected tokens the share ``keep`` of all. ``targets`` has shares by value for ``source``, ``lang`` and
    ``topic``; a dimension without targets gets its observed shares to the power FLATTEN. Values that a given target
    leaves out get weight 0.

    Each document meets its cell's total before any shuffle, so a hot source is one row a task; the state of the fit is
    one factor for each language and topic, while source factors stay in a table; beyond LABELS languages or topics all
    factors do. ``marginal_error`` is the largest relative error of a marginal when the rounds ended (TOLERANCE or less
    if the fit converged; targets that contradict each other can't be met, and are warned of). Null labels count as ``(none)``; null or blank texts have no tokens and take their cell's probability; a null id is drawn like any
    other value; repeated ids get equal draws; an empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(_labelled(docs, id_col, text_col, source_col, lang_col, topic), "mix-rows")
    chances, error = _chances(rows, targets, keep)
    out = rows.join(chances, ["source", "lang", "topic"])
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", "n_tokens", "weight", "probability", (draw(F.col("id"), seed) < F.col("probability")).alias("sampled"), F.lit(error).alias("marginal_error"))


def sample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    keep: float = KEEP,
    seed: int = SEED,
) -> DataFrame:
    """The rows that ``mix`` samples, with all their columns: texts meet only the small table of cells."""
    chances, _ = _chances(_labelled(docs, id_col, text_col, source_col, lang_col, topic), targets, keep)
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = _labelled(docs, id_col, text_col, source_col, lang_col, topic, whole)
    kept = rows.join(chances, ["source", "lang", "topic"]).where(draw(F.col("id"), seed) < F.col("probability"))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _labelled(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, *more: Column) -> DataFrame:
    """id, source, lang, topic of each row, and its tokens or the given columns."""
    label = lambda c: F.coalesce(c.cast("string"), F.lit(OTHER))
    text = docs[text_col]
    return docs.select(
        docs[id_col].cast("long").alias("id"), label(docs[source_col]).alias("source"), label(docs[lang_col]).alias("lang"), label(topic if topic is not None else topic_of(text)).alias("topic"),
        *(more or [token_count(text).alias("n_tokens")]),
    )


def _chances(rows: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float) -> tuple[DataFrame, float]:
    """source, lang, topic, weight, probability of each cell; and the error that the fit ended with."""
    cells = materialize(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted, error = _rake(cells, targets or {})
    if error > TOLERANCE:
        warnings.warn(f"the marginals are met to {error:.2g} only", stacklevel=3)
    k = _scale(fitted, keep)
    rate = F.col("raked") / F.greatest("tokens", F.lit(1))
    return materialize(fitted.select("source", "lang", "topic", rate.alias("weight"), F.least(F.lit(1.0), F.lit(k) * rate).alias("probability")), "chances"), error


def _shares(cells: DataFrame, name: str, given: dict[str, float] | None) -> DataFrame:
    """name, goal: target shares that add up to 1 over the values that have tokens."""
    seen = cells.groupBy(name).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given is None:
        goal = F.pow(F.col("t").cast("double"), F.lit(FLATTEN))
    else:
        pairs = [x for v, s in given.items() for x in (F.lit(v), F.lit(float(s)))]
        goal = F.coalesce(F.element_at(F.create_map(*pairs), F.col(name)), F.lit(0.0))
    raw = seen.select(name, goal.alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0]
    return raw.select(name, (F.col("raw") / F.lit(total or 1.0)).alias("goal"))


def _rake(cells: DataFrame, targets: dict[str, dict[str, float]]) -> tuple[DataFrame, float]:
    """source, lang, topic, tokens, raked: totals whose marginals meet the targets and that add up to all tokens."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {name: materialize(_shares(cells, name, targets.get(name)), "goals") for name in ("source", "lang", "topic")}
    base = materialize(cells.join(goals["source"], "source", "left").select("source", "lang", "topic", "tokens", (F.coalesce("goal", F.lit(0.0)) * total).alias("goal")), "raking")
    if not total:
        return _weighed(base, {}), 0.0
    if any(len(goals[name].take(LABELS + 1)) > LABELS for name in ("lang", "topic")):
        return _rake_tables(base, goals, total)
    small = {name: {r[name]: r.goal for r in goals[name].collect()} for name in ("lang", "topic")}  # LABELS rows at most
    factors = {name: dict.fromkeys(shares, 1.0) for name, shares in small.items()}
    for _ in range(ROUNDS):
        grid = {(r.lang, r.topic): r.t for r in _weighed(base, factors).groupBy("lang", "topic").agg(F.sum("raked").alias("t")).collect()}
        worst = 0.0
        for at, name in enumerate(("lang", "topic")):
            sums: dict[str, float] = {}
            for key, t in grid.items():
                sums[key[at]] = sums.get(key[at], 0.0) + t
            ratio = {v: (small[name].get(v, 0.0) * total / s if s > 0 else 0.0) for v, s in sums.items()}
            worst = max([worst, *(abs(r - 1) for v, r in ratio.items() if small[name].get(v, 0.0) > 0)])
            factors[name] = {v: f * ratio.get(v, 1.0) for v, f in factors[name].items()}
            grid = {key: t * ratio[key[at]] for key, t in grid.items()}
        if worst < TOLERANCE:
            break
    return _weighed(base, factors), worst


def _rake_tables(base: DataFrame, goals: dict[str, DataFrame], total: float) -> tuple[DataFrame, float]:
    """The same fit with all factors in tables; each round is written to the shared folder."""
    now = base.select("source", "lang", "topic", "tokens", F.col("tokens").cast("double").alias("raked"))
    for _ in range(ROUNDS):
        errors = []
        for name in ("lang", "topic", "source"):
            sums = now.groupBy(name).agg(F.sum("raked").alias("s")).join(goals[name], name, "left")
            ratio = F.when(F.col("s") > 0, F.coalesce("goal", F.lit(0.0)) * total / F.col("s")).otherwise(0.0)
            sums = materialize(sums.select(name, ratio.alias("ratio"), (F.coalesce("goal", F.lit(0.0)) > 0).alias("aimed")), "ratios")
            errors.append(sums.where("aimed").agg(F.max(F.abs(F.col("ratio") - 1))).first()[0] or 0.0)
            now = now.join(sums.drop("aimed"), name).select("source", "lang", "topic", "tokens", (F.col("raked") * F.col("ratio")).alias("raked"))
        now = materialize(now, "raking")
        if max(errors) < TOLERANCE:
            break
    return now, max(errors)


def _weighed(base: DataFrame, factors: dict[str, dict[str, float]]) -> DataFrame:
    """Cells under the language and topic factors, raked to the source goals."""
    value = F.col("tokens").cast("double")
    for name, table in factors.items():
        if table:
            pairs = [x for v, f in table.items() for x in (F.lit(v), F.lit(float(f)))]
            value = value * F.coalesce(F.element_at(F.create_map(*pairs), F.col(name)), F.lit(0.0))
    same = Window.partitionBy("source")
    scaled = base.withColumn("v", value).withColumn("s", F.sum("v").over(same))
    return scaled.select("source", "lang", "topic", "tokens", F.when(F.col("s") > 0, F.col("v") * F.col("goal") / F.col("s")).otherwise(0.0).alias("raked"))


def _scale(fitted: DataFrame, keep: float) -> float:
    """k for which sum(tokens * min(1, k * weight)) is the share ``keep`` of all tokens, or all that have weight."""
    held = materialize(fitted.select("tokens", "raked"), "fitted")
    total = held.agg(F.sum("tokens")).first()[0] or 0
    k = keep
    for _ in range(30 if total else 0):
        full = F.lit(k) * F.col("raked") >= F.col("tokens")
        whole, open_ = held.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("raked")))).first()
        if not open_ or open_ <= 0:
            break
        after = max(k, (keep * total - whole) / open_)
        if abs(after - k) <= 1e-12 * max(1.0, k):
            break
        k = after
    return float(k)
