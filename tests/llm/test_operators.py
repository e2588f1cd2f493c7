"""The corpus operators on small hand-made tables, against brute force: nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slotforge.llm import bpe, counts, embed, exact, langid, license, mixing, packing, simhash, toxicity
from slotforge.llm.common import Memo
from slotforge.llm.graph import connected_components, join_labels
from slotforge.storage import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, score double, text_sha256 string, part int, row string, n_tokens long, fp long, v double"
WORDS = "the of and value market über straße año niño don't it's 12 3,000 end. \"quoted\" x".split()


def texts():
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long = "\n".join(line(40) for _ in range(400))
    same = line(30)
    odd = ["", None, " ", "\n\n", "a  b", " lead", "trail ", "tab\tand space", "<|endoftext|> x<|endoftext|>y <s>", "▁ mark▁", "🙂 中文 text", "x" * 3000, "!!!", "Ünïcode İ ΣΣ"]
    return [long, same, same, same, same + " more", *odd, *(line(rng.randint(1, 60)) for _ in range(20))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, True, 0.5, "z", 1, "r", 1, 1, 0.0) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(k * 3, x) for k, x in enumerate(t)]
    return frame(spark, [*rows, rows[1], (None, t[1]), (None, "only here")]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(1, "x")]).where("doc_id < 0")


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_packing_any_width():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 8, 13, 16, 17, 24, 32):
        ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
        raw = packing.pack(ids, bits)
        assert len(raw) == (1000 * bits + 7) // 8 and np.array_equal(packing.unpack(raw, bits, 0, 1000), ids) and np.array_equal(packing.unpack(raw, bits, 333, 77), ids[333:410])


def test_token_files(spark, docs, local, empty):
    path, vocabulary = new_path(spark, "tokens"), P.path("byte_bpe_50k.json")
    packing.write_tokens(docs, path, vocabulary, shards=3)
    got = packing.token_index(spark, path).orderBy("start").collect()
    tk = Tokenizer.from_file(vocabulary)
    ids = lambda t: [*tk.encode(t, add_special_tokens=False).ids, 0]
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(ids(t), "<u4").tobytes()), len(ids(t))) for i, t in local)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == want
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in local if i is not None) and got[0].doc_id is None
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    one = packing.read_tokens(spark, path).where("doc_id = 0").first()
    assert one.ids == ids(dict(local)[0])
    assert [r.ids for r in packing.fetch(spark, path, 3).collect()] == [ids(t) for i, t in local if i == 3]
    none = new_path(spark, "tokens")
    packing.write_tokens(empty, none, vocabulary)
    assert packing.token_index(spark, none).count() == 0


def test_encoders_on_odd_text():
    rng = random.Random(5)
    letters = [*"ab  \n\n\t.,'s▁é1中 İΣσ\x1c​ñ", "<|endoftext|>", "<s>", "the ", "don't", " \n", "word", "🙂"]
    byte, word, piece = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json")), counts._model(P.path("piece_bpe_32k.model"))
    ours_byte, ours_word = packing.ChunkEncoder(P.path("byte_bpe_50k.json")), bpe.word_bpe(P.path("word_bpe_49k.json"))
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(ours_byte.encode([t])[0], ours_byte.kind).tolist() == byte.encode(t, add_special_tokens=False).ids
        assert ours_word.encode([t])[0].tolist() == word.encode(t, add_special_tokens=False).ids
        assert sum(counts.lengths_of(piece, counts.pre_tokens(t))) == len(piece.encode(t))


def test_long_words_merge_alike():
    w = bpe.word_bpe(P.path("word_bpe_49k.json"))
    rng = random.Random(2)
    for n in (300, 1200):
        ids = [w.inner[ord(rng.choice("aeinrst"))] for _ in range(n)]
        keep, bpe.SHORT_WORD = bpe.SHORT_WORD, 10_000
        try:
            short = w.merge(list(ids))
        finally:
            bpe.SHORT_WORD = keep
        assert w._merge_long(list(ids)) == short


def test_memo_generations():
    made = []
    m = Memo({"fixed": 0}, limit=20 * 200)
    for k in range(100):
        got = m.fill({"often", f"w{k}", "fixed"}, lambda ws: [made.append(w) or len(w) for w in ws])
        assert got["often"] == 5 and got["fixed"] == 0 and len(got) <= 15
    assert made.count("often") < 3


def test_bpe_round_trip(spark, docs, local, empty):
    vocabulary = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(vocabulary)
    got = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    want = sorted((str(i), tk.encode(t, add_special_tokens=False).ids) for i, t in local)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.decoded == tk.decode(r.ids, skip_special_tokens=False) for r in got)
    both = bpe.round_trip(docs, vocabulary).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both) == sorted((str(r.doc_id), r.ids, r.decoded) for r in got)
    assert bpe.digests(bpe.round_trip(empty, vocabulary)).count() == 0
    assert bpe.digests(bpe.decode(bpe.encode(empty, vocabulary), vocabulary)).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), vocabulary).where("decoded = ''").count() == 2


def test_token_counts(docs, local, empty):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counts.token_counts(docs, path, limit=50).collect())
    assert got == sorted((str(i), len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 50) for i, t in local)
    assert counts.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_exact_dedup(docs, local, empty, keep, partitions):
    got = exact.exact_dedup(docs, keep=keep, partitions=partitions).collect()
    groups = {}
    for i, t in local:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    pick = max if keep == "largest" else min
    assert len(got) == len(local)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (pick(known) if known else None)
    for sha in groups:
        stays = [r for r in got if r.text_sha256 == sha and r.kept]
        assert len(stays) == 1 and stays[0].doc_id == stays[0].keep_id
    assert exact.exact_dedup(empty, partitions=partitions).count() == 0
    rows = exact.keep_one(docs, keep=keep, partitions=partitions)
    assert rows.columns == docs.columns
    stays = sorted((str(r.doc_id), r.text_sha256) for r in got if r.kept)
    assert sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows.collect()) == stays
    assert exact.keep_one(empty, keep=keep, partitions=partitions).count() == 0


def test_exact_dedup_group_over_many_partitions(spark):
    d = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 900) END AS text")
    got = exact.exact_dedup(d, partitions=16)
    assert got.where("kept").count() == d.select("text").distinct().count()
    hot = got.where("text_sha256 = sha2('hot', 256)").agg(F.min("group_size"), F.max("group_size"), F.min("keep_id"), F.max("keep_id")).first()
    assert tuple(hot) == (1667, 1667, 0, 0)


def brute_fingerprint(t, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, local, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in local]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{p:016x}") for i, p in prints)
    distinct = sorted({p for _, p in prints})
    f = np.array(distinct, dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    labels = join_labels(np.arange(len(f)), a, b)
    root = dict(zip(distinct, labels.tolist(), strict=True))
    best = {}
    for i, p in prints:
        if i is not None:
            best[root[p]] = min(i, best.get(root[p], i))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(i), f"{p:016x}", best.get(root[p])) for i, p in prints)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("hot_key", "budget"), [(50_000, 4), (8, 4), (2, 4), (50_000, 1), (50_000, 5), (8, 6), (50_000, 9), (50_000, 0)])
def test_trie_join_equals_brute_force(spark, hot_key, budget):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) << np.uint64(1)
    near = [base]
    for _ in range(6):
        x = base.copy()
        for _ in range(int(rng.integers(1, budget + 2))):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
        near.append(x)
    dense = np.full(150, base[0])
    for _ in range(4):
        dense = dense ^ (np.uint64(1) << rng.integers(0, 64, len(dense)).astype(np.uint64))
    f = np.unique(np.concatenate([*near, dense]))
    edges = simhash.trie_links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), budget, hot_key=hot_key).collect()
    at = {int(x): k for k, x in enumerate(f.view(np.int64))}
    got = join_labels(np.arange(len(f)), np.array([at[e.a] for e in edges], dtype=int), np.array([at[e.b] for e in edges], dtype=int))
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= budget)
    assert np.array_equal(got, join_labels(np.arange(len(f)), a, b))
    assert all((int(np.uint64(e.a & (2**64 - 1))) ^ int(np.uint64(e.b & (2**64 - 1)))) for e in edges)
    with pytest.raises(ValueError, match="budget"):
        simhash.trie_links(spark.createDataFrame([(1,)], "fp long"), 40)


def test_keep_one_of_near_copies(spark, docs, local, empty):
    t = "the market value of the house and the end of the line"
    rows = frame(spark, [(3, t), (5, t + " "), (5, "green stones roll by the old river at night"), (None, t + "\n"), (9, None), (None, ""), (8, "   ")])
    stays = simhash.keep_one(rows)
    assert stays.columns == rows.columns and sorted((str(r.doc_id), r.text) for r in stays.collect()) == [("3", t), ("5", "green stones roll by the old river at night"), ("8", "   ")]
    found = simhash.near_duplicates(docs).collect()
    kept = simhash.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found}
    assert simhash.keep_one(empty).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    e = spark.createDataFrame([*chain, (100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected_components(e.where("a < 0")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(80, 32))
    rows = [v for b in base for v in (b, b + rng.normal(size=32) * 0.05)] + [base[0]] * 3 + [base[1] * 2]
    data = [(k, [float(x) for x in v], 1) for k, v in enumerate(rows)]
    bad = [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [1.0, None] * 16, 1), (None, data[0][1], 1), (1004, [1.0, 2.0], 1), (1005, [float("inf")] * 32, 1)]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embed.near_duplicates(df, pivots=24).collect()}
    x = np.array([v for v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    a, b = np.nonzero(link)
    labels = join_labels(np.arange(len(x)), a, b)
    found = sum(got[k].n_links for k in range(len(x)))
    assert found >= 0.9 * link.sum() and all(got[k].n_links <= link[k].sum() for k in range(len(x)))
    assert np.mean([got[k].component_id == labels[k] for k in range(len(x))]) > 0.95
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (1000, 1001, 1002, 1003, 1004, 1005)) and got[None].n_links == 0
    assert embed.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_embeddings_that_share_an_id_or_clash(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    near = [1.0, 2.0, 3.0, 4.01]
    rows = [(1, v, 0, 0, 0, 0), (1, near, 0, 0, 0, 0), (1, v, 0, 0, 0, 0), (7, [-5.0, 1.0, 0.0, 2.0], 0, 0, 0, 0), (7, None, 0, 0, 0, 0)]
    schema = "vec_id long, embedding array<float>, class long, v long, m long, id long"
    got = embed.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True)] * 3 + [(7, 0, 7, True)] * 2
    more = embed.near_duplicates(spark.createDataFrame([*rows, (2, near, 0, 0, 0, 0), (3, v, 0, 0, 0, 0)], schema)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in more} == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (7, 0, 7)}


def test_embedding_recall_at_production_parameters(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = embed.near_duplicates(table).toPandas().set_index("vec_id")
    data = table.select("vec_id", "embedding").toPandas()
    x = np.stack(data.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    ours = got.n_links.reindex(data.vec_id).to_numpy()
    assert (ours <= links).all() and ours.sum() >= 0.99 * links.sum()


def test_embedding_chunks_count_every_link(spark):
    keep, embed.CHUNK = embed.CHUNK, 16
    try:
        rng = np.random.default_rng(9)
        b = rng.normal(size=16)
        rows = [(k, [float(x) for x in b + rng.normal(size=16) * 0.02]) for k in range(100)]
        got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=16).collect()
    finally:
        embed.CHUNK = keep
    assert all(r.n_links <= 99 and r.component_id == 0 for r in got) and sum(r.n_links for r in got) >= 0.9 * 9900


def test_language(spark, empty):
    words = {"aa": "lorem ipsum dolor sit", "bb": "sveti kralj duša žena", "cc": "кот дом река лес"}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(words[c].split()) for _ in range(12)), c) for k, c in enumerate("aa bb cc".split() * 60)]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.train(d.where("doc_id % 3 <> 1 OR doc_id % 2 = 0"))
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    assert all(got[k].lang_pred == c and 0 <= got[k].score <= 1 for k, _, c in rows)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(d, langid.train(d.where("doc_id < 0"))).where("lang_pred <> 'und'").count() == 0
    whole = langid.identify(frame(spark, [(1, "lorem ipsum")]), model, whole=True).first()
    assert whole.row.score == 0.5 and whole.lang_pred == "aa"


def brute_match(words, stems, token):
    def near(a, b):
        if a == b:
            return 0
        edits = {a[:k] + a[k + 1 :] for k in range(len(a))} | {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in set(b)} | {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in set(b)}
        return 1 if b in edits else 9

    best = [(near(w, token), n) for w, n in words.items() if near(w, token) <= int(len(w) >= toxicity.FUZZY)]
    for s, n in stems.items():
        for k in range(len(token) + 1):
            d = near(s, token[:k])
            if d <= int(len(s) >= toxicity.FUZZY):
                best.append((d, n))
    return min(best)[0] if best else None


def test_automaton_equals_brute_force():
    words, stems = {"moron": 0, "scum": 1, "idiot": 2}, {"loweis": 3, "ach": 4}
    a = toxicity.Automaton(words, stems)
    rng = random.Random(6)
    pool = [*words, *stems]
    for _ in range(4000):
        t = list(rng.choice(pool) + "".join(rng.choice("aceimnorst") for _ in range(rng.randint(0, 2))))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = [rng.choice("aceimnorstx")] * rng.randint(0, 1)
        t = "".join(t)
        got = a.match(t)
        assert (got[0] if got else None) == brute_match(words, stems, t), t


def test_toxicity(spark, empty):
    rng = random.Random(2)
    plain = "green tree river stone house light paper cloud".split()
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = [rng.choice(plain) for _ in range(30)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["wretch", "vermin"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    d = spark.createDataFrame([*rows, (None, None), (700, ""), (701, "that wretchh and vermjn and wretxh in green")], "doc_id long, text string")
    l = spark.createDataFrame([*labels, (None, 1), (5000, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(d, l.where("doc_id % 5 <> 0 OR doc_id IS NULL"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, y in labels if k % 5 == 0]) > 0.95
    assert got[700] < 0.5 and got[None] < 0.5 and got[701] > got[700]
    quoted = model.describe('he said "wretch" in a report')
    assert quoted[0] < model.describe("he is wretch in a crowd here")[0] and quoted[5] > 0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(d, toxicity.learn(d, l.where("doc_id < 0"))).where("score = 0.5").count() == d.count()


def test_license(spark, empty):
    t = license.TEMPLATES
    mid = " ".join(f"w{k}" for k in range(300))
    rows = [(1, t["MIT"]), (2, mid + " " + t["MIT-notice"] + " " + mid), (3, "plain text only"), (4, None), (5, ""), (6, mid + "\n" + t["GPL-3.0"].upper() + "\n" + mid), (7, "Licensed under the Apache"), (None, t["CC-BY-NC-4.0"]), (1, t["MIT"])]
    got = license.scan(frame(spark, rows)).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT"), (2, "MIT-notice"), (6, "GPL-3.0"), (None, "CC-BY-NC-4.0")}
    assert all(r.containment == 1 for r in got)
    assert license.scan(empty).count() == 0


def test_license_of_any_length(spark):
    rng = random.Random(12)
    body = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(5000)) for _ in range(n))
    long, longest, noise = body(600), body(1500), body(3000)
    words = longest.split()
    damaged = " ".join(w if k % 40 else "other" for k, w in enumerate(words))  # four fifths of its shingles and more stay
    rows = [(1, noise + " " + long + " " + noise), (2, longest), (3, noise), (4, body(700) + " " + damaged), (5, " ".join(words[:700])), (2, longest)]
    table = spark.createDataFrame([("long", long), ("longest", longest), ("short", "a b"), (None, None)], "license string, body string")
    got = license.scan(frame(spark, rows), templates=table).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "long"), (2, "longest"), (4, "longest")}
    assert all(r.containment == 1 for r in got if r.doc_id != 4) and all(0.8 <= r.containment < 1 for r in got if r.doc_id == 4)
    keep, license.SMALL = license.SMALL, 10
    try:
        assert sorted(license.scan(frame(spark, [rows[1], rows[3]]), templates=table).select("doc_id", "license").collect()) == [(2, "longest"), (4, "longest")]
    finally:
        license.SMALL = keep
    assert license.scan(frame(spark, rows[2:3]), templates={"short": "a b"}).count() == 0


def brute_rake(cells, goals, rounds=200):
    w = dict(cells)
    for _ in range(rounds):
        for at in range(3):
            total = {}
            for k, v in w.items():
                total[k[at]] = total.get(k[at], 0) + v
            w = {k: v * goals[at].get(k[at], 0) / total[k[at]] if total[k[at]] else 0 for k, v in w.items()}
    return w


def test_mixing(spark, empty):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(1, 30)), rng.choice("ab") if k % 3 else "a", rng.choice(["x", "y", None]), rng.choice("pqr")) for k in range(600)]
    d = spark.createDataFrame([*rows, (None, None, None, None, None)], "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"a": 1, "b": 1}, "lang": {"x": 2, "y": 1, "(none)": 1}, "topic": {"p": 1, "q": 1, "r": 2}}
    out = mixing.mix(d, topic=F.col("topic"), targets=targets).collect()
    assert len(out) == 601
    cells = {}
    for _, t, s, l, c in rows:
        key = (s, l or "(none)", c)
        cells[key] = cells.get(key, 0) + len(t.split())
    total = sum(cells.values())
    shares = [{k: v / sum(x.values()) * total for k, v in x.items()} for x in (targets["source"], targets["lang"], targets["topic"])]
    want = brute_rake(cells, shares)
    got = {(r.source, r.lang, r.topic): r.weight for r in out}
    assert all(got[k] == pytest.approx(want[k] / cells[k], rel=1e-4) for k in cells)
    kept = sum(r.n_tokens * r.probability for r in out)
    assert kept == pytest.approx(total / 2, rel=1e-3)
    assert {r.doc_id for r in out if r.sampled} == {r.doc_id for r in mixing.mix(d, topic=F.col("topic"), targets=targets).collect() if r.sampled}
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0
    assert max(r.marginal_error for r in out) < 1e-5
    held, mixing.LABELS = mixing.LABELS, 2
    try:
        tables = {(r.source, r.lang, r.topic): r.weight for r in mixing.mix(d, topic=F.col("topic"), targets=targets).collect()}
    finally:
        mixing.LABELS = held
    assert all(tables[k] == pytest.approx(want[k] / cells[k], rel=1e-4) for k in cells)
    drawn = mixing.sample(d, topic=F.col("topic"), targets=targets)
    assert drawn.columns == d.columns and sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(r.doc_id) for r in out if r.sampled)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_order_is_of_content(spark, keep):
    """Long shared beginnings, a group of copies over many ranges, and ranges in the order of bytes."""
    rng = random.Random(12)
    start = "the same licence header before every text of this table " * 12
    rows = [(k, start + f"{rng.randrange(200)} é") for k in range(300)] + [(1000 + k, start + "copies") for k in range(400)] + [(k, "ü" if k % 2 else None) for k in range(50)] + [(None, "ü"), (None, None)]
    df = spark.createDataFrame([(i, t or "") for i, t in rows], "id long, text string").repartition(5)
    bounds = exact._splitters(df, 12, keep)
    assert len(bounds) >= 8 and bounds == sorted(bounds)
    copies = [b for b in bounds if b[0] == (start + "copies").encode()]
    assert len(copies) >= 3 and len({b[1] for b in copies}) == len(copies)  # copies are parted by id
    assert all(len(b[0]) < len(start) + 20 for b in bounds)
    placed = exact._sorted(df, 12, keep).withColumn("at", F.monotonically_increasing_id()).collect()
    order = [(r.text.encode(), exact._order(r.id, keep)) for r in sorted(placed, key=lambda r: r["at"])]
    assert order == sorted(order) and len({r._part for r in placed}) > 8
    got = exact.exact_dedup(df.withColumnRenamed("id", "doc_id"), keep=keep, partitions=12).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: (min if keep == "smallest" else max)(i for i in ids if i is not None) for t, ids in groups.items()}
    assert len(got) == len(rows) and {(r.keep_id, r.group_size, r.text_sha256) for r in got} == {(best[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}
    assert sum(r.kept for r in got) == len(groups) and all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_tokens_of_one_id_spread_over_shards(spark):
    rng = random.Random(14)
    for ids in ([7] * 300, [None] * 300, [*range(100), *[50] * 200, *[None] * 100]):
        rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))) for i in ids]
        path = new_path(spark, "test-tokens")
        packing.write_tokens(frame(spark, rows), path, P.path("byte_bpe_50k.json"), shards=8)
        index = packing.token_index(spark, path).collect()
        assert len(packing.read_blocks(spark, path).select("shard").distinct().collect()) >= 5
        order = sorted(index, key=lambda r: r.start)
        assert [(-1 if r.doc_id is None else r.doc_id) for r in order] == sorted(-1 if i is None else i for i in ids)
        ends = [0, *np.cumsum([r.n_tokens for r in order]).tolist()]
        assert [r.start for r in order] == ends[:-1]
        byte = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        want = sorted((str(i), zlib.crc32(np.array([*byte.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows)
        assert sorted((str(r.doc_id), r.ids_crc32) for r in index) == want
