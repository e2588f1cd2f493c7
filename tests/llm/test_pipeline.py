"""The pipeline's stages keep what they must and drop what they decide on."""

import hashlib
import os
import random
import re

import public_tokenizers as P
from pyspark.sql import functions as F
from test_operators import brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from slotforge.llm import mixing, simhash
from slotforge.llm.common import materialize
from slotforge.storage import new_path


def test_near_copies_drop_rows_not_ids(spark):
    t = "the market value of the house and the end of the line"
    docs = spark.createDataFrame([(3, t, "en", "s", 1), (5, t + " ", "en", "s", 1), (5, "green stones roll by the old river", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == ["green stones roll by the old river", t]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    base = [f"the market value of the {w} and the end of the {w} line number {k}" for k, w in enumerate("house tree river stone cloud paper light field storm glass".split() * 6)]
    out = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    out += [(100, base[0], "en", "s0", 1), (101, base[1], "en", "s1", 1), (102, None, "en", "s0", 0), (103, "123 456", "en", "s0", 0), (None, "a line without an id but the words of the market", "en", "s0", 0)]
    return out


def test_stages(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.where("doc_id < -5")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialize(stage(spark, before, ""), name)
        if k < 4:
            assert after.columns == COLUMNS
        if name == "language":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {102, 103}
        if name == "exact_copies":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {100, 101}
            assert after.select("text").distinct().count() == after.count()
        if name == "near_copies":  # one of each component stays, the one with the smallest id
            found = simhash.near_duplicates(before).collect()
            assert sorted(str(r.doc_id) for r in after.collect()) == sorted({str(r.component_id) for r in found})
        if name == "mixture":  # those that the weights draw
            assert sorted(str(r.doc_id) for r in after.collect()) == sorted(str(r.doc_id) for r in mixing.mix(before).collect() if r.sampled)
        if name == "tokens":
            assert after.count() == before.count()
        assert stage(spark, empty, "").count() == 0
        before = after


def brute_topic(t):
    low = t.lower()
    if re.search(r"licen[sc]e|copyright", low):
        return "legal"
    if re.search(r"https?://|www\.|[a-z0-9._]+@[a-z0-9.]+|token\s*=|api[_-]?key", low):
        return "web"
    if re.search(r"\d{4,}", low):
        return "figures"
    return "lists" if " | " in low else "prose"


def brute_mixture(docs, draws):
    """docs: (id, text, lang, source) to the ids that are drawn; plain raking to flattened shares, then the scale by halving."""
    cells = {}
    for _, text, lang, source in docs:
        key = (source or "(none)", lang, brute_topic(text))
        cells[key] = cells.get(key, 0) + len(text.split())
    total = sum(cells.values())
    goals = []
    for at in range(3):
        seen = {}
        for key, n in cells.items():
            seen[key[at]] = seen.get(key[at], 0) + n
        flat = {v: n**0.7 for v, n in seen.items() if n}
        goals.append({v: x * total / sum(flat.values()) for v, x in flat.items()})
    raked = dict(cells)
    for _ in range(400):
        for at in range(3):
            sums = {}
            for key, n in raked.items():
                sums[key[at]] = sums.get(key[at], 0) + n
            raked = {key: n * goals[at][key[at]] / sums[key[at]] if n else 0.0 for key, n in raked.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        k = (low + high) / 2
        if sum(min(cells[c], k * raked[c]) for c in cells) < total / 2:
            low = k
        else:
            high = k
    chance = {c: min(1.0, high * raked[c] / max(1, cells[c])) for c in cells}
    return {i for i, text, lang, source in docs if draws[i] < chance[source or "(none)", lang, brute_topic(text)]}


def test_run_against_plain_code(spark):
    """Whole runs: the rows that plain code keeps at every stage, and the library's tokens for them."""
    rng = random.Random(21)
    words = {"en": "the house and river walk under green light with people who talk about weather".split(), "de": "das haus und der fluss unter grünem licht mit leuten die über das wetter reden".split()}
    rows = []
    for k in range(160):
        lang = rng.choice(["en", "en", "de"])
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(8, 40)))
        text += rng.choice(["", "", " 12345", " www.example.org", " a | b", " copyright"])
        rows.append((k, text, lang if k % 10 else None, rng.choice(["s0", "s0", "s1", None]), len(text)))
    rows += [(200 + k, rows[k][1], rows[k][2], "s2", 1) for k in range(0, 40, 3)]  # exact copies
    rows += [(300 + k, rows[k][1].replace(" ", "  "), rows[k][2], "s1", 1) for k in range(0, 60, 7)]  # near ones
    rows += [(400, "", "en", "s0", 0), (401, None, "en", "s0", 0), (402, "12 34 !", "de", "s0", 7), (403, "das haus und der fluss " * 4_000, "de", "s1", 1)]
    folder = new_path(spark, "pipeline-tables")
    os.makedirs(folder)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit("clash"), "weight": F.lit(1.5), "tokens": F.lit(2), "fp": F.lit(0)}).write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}

    spoken = [(i, t, "de" if re.search(r"\b(das|haus|und|der|fluss|unter|grünem|licht|mit|leuten|die|über|wetter|reden)\b", t) else "en", s) for i, t, _, s, _ in rows if t and re.search(r"[^\W\d_]", t)]
    first = {}
    for r in sorted(spoken):
        first.setdefault(r[1], r)
    kept = sorted(first.values())
    prints = {r[0]: brute_fingerprint(r[1]) for r in kept}
    root = {r[0]: r[0] for r in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [r for r in kept if find(r[0]) == r[0]]
    draws = {r.id: r.u for r in spark.createDataFrame([(r[0],) for r in kept], "id long").select("id", F.expr(f"pmod(xxhash64(id, {mixing.SEED}), 9007199254740992) / 9007199254740992D").alias("u")).collect()}
    chosen = brute_mixture(kept, draws)
    assert len(rows) > len(kept) > len(chosen) > 20
    tk, sha = Tokenizer.from_file(P.path("word_bpe_49k.json")), lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, text, _, _ in kept:
        if i in chosen:
            e = tk.encode(text, add_special_tokens=False).ids
            want[i] = (len(e), sha(" ".join(map(str, e))), sha(tk.decode(e, skip_special_tokens=False)))
    assert got == want
