"""Toxicity, language and token counts against plain Python: weights, windows, penalties, temperature, tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import frame, texts

from slotforge.llm import counts, langid, toxicity

# --- language


def plain_grams(text):
    letters = " " + re.sub(r"[^a-zà-ÿ]+", " ", text.lower()).strip() + " "
    return Counter(letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1))


def numbered_rows(docs):
    """Distinct numbers for n-grams: what hashing gives as long as nothing collides."""
    number = {}
    rows = []
    for text, lang in docs:
        grams = plain_grams(text)
        index = sorted(number.setdefault(g, len(number)) for g in grams)
        back = {v: k for k, v in number.items()}
        rows.append((np.array(index), np.array([grams[back[i]] for i in index], float), lang))
    return rows


def spoken(n, seed=1):
    rng = random.Random(seed)
    words = {"en": "the house and river walk under green light".split(), "de": "das haus und der fluss unter grünem licht".split(), "es": "la casa y el río bajo la luz verde".split()}
    return [(" ".join(rng.choice(words[x]) for _ in range(rng.randint(2, 9))), x) for x in (rng.choice(list(words)) for _ in range(n))]


def plain_ftrl(rows, alpha, beta, l1, l2, epochs):
    """One weight at a time, in dicts; the order of rows is the one that the operator draws."""
    langs = sorted({r[2] for r in rows})
    order = np.random.default_rng(7).permutation(len(rows))
    df = Counter(int(i) for index, _, _ in rows for i in index)
    idf = lambda i: math.log((1 + len(rows)) / (1 + df[i])) + 1
    z, n = Counter(), Counter()

    def weight(i, c):
        penalty = 0 if i == "bias" else l1
        if abs(z[i, c]) <= penalty:
            return 0.0
        return -(z[i, c] - math.copysign(penalty, z[i, c])) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    def vector(index, freq):
        x = {int(i): (1 + math.log(f)) * idf(int(i)) for i, f in zip(index, freq, strict=True)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {i: v / norm for i, v in x.items()} | {"bias": 1.0}

    for _ in range(epochs):
        for k in order:
            index, freq, lang = rows[k]
            x = vector(index, freq)
            w = {(i, c): weight(i, c) for i in x for c in langs}
            scores = {c: sum(x[i] * w[i, c] for i in x) for c in langs}
            top = max(scores.values())
            total = sum(math.exp(s - top) for s in scores.values())
            for c in langs:
                slope = math.exp(scores[c] - top) / total - (c == lang)
                for i in x:
                    g = slope * x[i]
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    return langs, weight


@pytest.mark.parametrize(("epochs", "l1", "l2"), [(1, 0.02, 0.002), (2, 0.3, 0.5), (1, 0.0, 0.0)])
def test_ftrl_steps(epochs, l1, l2):
    rows = numbered_rows(spoken(20))
    model = langid.fit(rows, alpha=0.5, beta=1.0, l1=l1, l2=l2, epochs=epochs)
    langs, weight = plain_ftrl(rows, 0.5, 1.0, l1, l2, epochs)
    assert model.languages == langs and model.temperature == 1.0
    for i in {int(i) for r in rows for i in r[0]}:
        assert model.weights[i] == pytest.approx([weight(i, c) for c in langs], abs=1e-6)
    assert model.bias == pytest.approx([weight("bias", c) for c in langs], abs=1e-9)
    zeros = np.mean([w == 0 for i in {int(i) for r in rows for i in r[0]} for w in model.weights[i]])
    assert (zeros > 0.3) if l1 == 0.3 else True  # the first penalty makes weights sparse


def test_temperature_is_the_best_of_its_grid():
    rows = numbered_rows(spoken(120, 2))
    model = langid.fit(rows)
    order = np.random.default_rng(7).permutation(len(rows))
    held = [rows[k] for k in order[::10]]

    def loss(t):
        out = 0.0
        for index, freq, lang in held:
            v = (1 + np.log(freq)) * model.idf[index]
            logits = ((v / np.linalg.norm(v)) @ model.weights[index] + model.bias) / t
            e = np.exp(logits - logits.max())
            out -= math.log(e[model.languages.index(lang)] / e.sum() + 1e-12)
        return out

    grid = np.geomspace(0.05, 5, 60)
    assert model.temperature == pytest.approx(min(grid, key=loss))


def test_hashed_grams_are_all_counted():
    index, freq = langid.features("Das Haus, das 12 Häuser!")
    want = Counter(plain_grams("Das Haus, das 12 Häuser!").values())
    assert freq.sum() == sum(k * v for k, v in want.items()) and len(index) <= sum(want.values())
    long = "wort über straße " * 40_000  # several stretches
    index, freq = langid.features(long)
    assert freq.sum() == sum(plain_grams(long).values())


def test_language_of_rows_with_null_ids_and_of_many_texts(spark):
    rows = [(None, t, x, None, 1) for t, x in spoken(400, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    model = langid.train(df, per_language=20, sample=100)
    assert model.languages == ["de", "en", "es"]
    fewer = langid.train(df, grams=600)  # the bound on n-grams takes fewer rows, not fewer n-grams of a row
    assert fewer.languages and set(fewer.languages) <= {"de", "en", "es"}
    more = [(1, "das haus und der fluss " * 30_000, "de", None, 1), (1, "das haus und der fluss", "de", None, 1), (None, "das haus und der fluss", None, None, 1), (2, None, None, None, 1), (3, "12 !", None, None, 1)]
    got = langid.identify(spark.createDataFrame(more, schema).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "row": F.lit(2)}), langid.train(df)).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "de"), ("1", "de"), ("2", "und"), ("3", "und"), ("None", "de")]
    assert len({r.score for r in got if r.doc_id == 1}) <= 2
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.range(1300).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang")))


# --- toxicity

TOXIC, CLEAN = ["gruntled", "snarkwit", "blockish"], "the river runs under a quiet bridge where people walk and talk about weather".split()


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        y = k % 2
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 25))]
        if y:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(TOXIC) + rng.choice(["", "", "s"]))
        elif rng.random() < 0.2:
            words[1:1] = ["said", '"', rng.choice(TOXIC), '"']
        out.append((k, " ".join(words), y))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = labelled(160, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, toxicity.learn(docs, labels)


def plain_terms(text):
    words = {w for w in re.findall(r"[^\W_]+(?:'[^\W_]+)*", text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}


def test_lexicon_weights(learned):
    rows, model = learned
    distinct = {(t, y) for _, t, y in rows}
    n = Counter(y for _, y in distinct)
    seen = Counter((w, y) for t, y in distinct for w in plain_terms(t))
    odds = lambda w: math.log((seen[w, 1] + 0.5) / (n[1] + 1)) - math.log((seen[w, 0] + 0.5) / (n[0] + 1))
    good = {w for w, _ in seen if seen[w, 1] >= max(4, n[1] // 100) and odds(w) >= 2.5}
    assert good and set(model.stems) <= {w[:-1] for w in good if w.endswith("*")} and set(model.words) <= good
    for w, k in model.words.items():
        assert model.exact[k] == pytest.approx(odds(w))
    for w, k in model.stems.items():
        assert model.exact[k] == pytest.approx(odds(w + "*"))
    covered = lambda w: w in model.words or any(w[:k] in model.stems for k in (4, 5, 6))
    assert all(covered(w.rstrip("*")) for w in good)  # no term that qualifies is left out


def test_windows_and_score(learned):
    _, model = learned
    for text in ["", "nothing here", "gruntled", 'he said "snarkwit" today', "x " * 30 + "blockish gruntled blockish", "grumtled snarkwitt people", "« gruntled » a b c d e f gruntled", "word snarkwit"]:
        words = re.findall(r"[^\W_]+(?:'[^\W_]+)*|[\"“”„«»‘’]", text.lower())
        hits = [(k, *m) for k, w in enumerate(words) if (m := model.automaton().match(w))]
        marks = [k for k, w in enumerate(words) if w in "\"“”„«»‘’"]
        kept = []
        for k, edits, term in hits:
            before, after = [m for m in marks if m < k], [m for m in marks if m >= k]
            quoted = bool(before and after) and k - before[-1] <= 5 and after[0] - k <= 5
            reported = any(w in toxicity.REPORTS for w in words[max(0, k - 5) : k + 6])
            full = (model.fuzzy if edits else model.exact)[term]
            kept.append((k, edits, full * (0.3 if quoted else 1) * (0.5 if reported else 1), full))
        exact, near = sum(v for _, e, v, _ in kept if not e), sum(v for _, e, v, _ in kept if e)
        window = max((sum(v for p, _, v, _ in kept if 0 <= k - p <= 10) for k, *_ in kept), default=0.0)
        log1p = lambda v: math.log1p(max(v, 0))
        want = [log1p(exact), log1p(near), max((v for _, _, v, _ in kept), default=0.0), window, math.log1p(100 * (exact + near) / max(20, len(words))) if exact + near > 0 else 0.0, log1p(sum(f - v for _, _, v, f in kept))]
        assert model.describe(text) == pytest.approx(want), text
        line = sum((x - m) / s * w for x, m, s, w in zip(want, model.mean, model.scale, model.slope, strict=True)) + model.bias
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, line)))))


def test_logistic_is_a_minimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4))
    y = (x @ [1, -2, 0, 0.5] + rng.normal(size=200) > 0).astype(float)
    slope, bias = toxicity._logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ slope + bias)))
    assert np.abs(x.T @ (y - p) - slope).max() < 1e-6 and abs((y - p).sum()) < 1e-4


def test_toxic_rows_long_repeated_and_empty(spark, learned):
    _, model = learned
    rows = [(1, "gruntled " * 60_000), (1, "gruntled"), (1, "gruntled"), (None, None), (2, ""), (3, "the river " * 60_000)]
    got = toxicity.score(frame(spark, rows), model).collect()
    by = sorted((str(r.doc_id), round(r.score, 9)) for r in got)
    assert len(by) == 6 and by[4:] == [(k, s) for k, s in by if k in ("3", "None")] and sum(k == "1" and s > 0.5 for k, s in by) == 3 and all(s < 0.5 for k, s in by if k != "1")


# --- token counts


def test_table_of_measured_lengths(spark):
    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(k, t) for k, t in enumerate(texts())] + [(99, "zxqv zxqv unbreakableword unbreakableword " * 50)]
    table = counts.frequent(frame(spark, rows), model)
    seen = Counter(w for _, t in rows for w in counts.pre_tokens(t or ""))
    often = [*(w for w, _ in seen.most_common(12)), "zxqv"]
    found = table.find([*often, "neverseenword"]).tolist()
    assert found == [*counts.lengths_of(sp, often), -1] and found[often.index("zxqv")] > 1 and (table.lengths > 1).sum() > 3
    small = counts.frequent(frame(spark, rows), model, size=3)
    assert len(small.lengths) == 3 and (small.find(often) > 0).sum() == 3
    lengths = counts.Lengths(model, small)
    words = set(seen)
    assert dict(lengths.of(words).items() & {w: n for w, n in zip(words, counts.lengths_of(sp, list(words)), strict=True)}.items()).keys() >= words and lengths.hits == 3 and lengths.misses == len(words) - 3
    assert counts.frequent(frame(spark, rows).where("doc_id < 0"), model).find(["a"]).tolist() == [-1]
