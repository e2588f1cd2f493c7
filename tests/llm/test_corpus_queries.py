"""The registered corpus queries on the smallest given tables: against their SQL, the libraries, or brute force."""

import glob
import hashlib
import os
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from test_operators import brute_fingerprint
from tokenizers import Tokenizer

from slotforge.llm import queries
from slotforge.llm.graph import join_labels

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = [tuple(round(x, 9) if isinstance(x, float) else x for x in (r[n] for n in names)) for r in (x.asDict() for x in rows(spark, name))]
    assert sorted(map(str, got)) == sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in cursor.fetchall())


def test_token_output(spark, docs):
    tk, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in rows(spark, "op1_token_output")}
    for i in sorted(docs):
        ids = [*tk.encode(docs[i], add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_counts_and_round_trip(spark, docs):
    sp, tk = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op5_token_counts")} == {i: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in docs.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in docs.items():
        ids = tk.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op10_bpe")} == want


def test_simhash(spark, docs):
    ids = sorted(docs)
    f = np.array([brute_fingerprint(docs[i]) for i in ids], dtype=np.uint64)
    labels = join_labels(np.arange(len(f)), *np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op7_simhash_dedup")}
    assert got == {i: (f"{int(f[k]):016x}", ids[labels[k]]) for k, i in enumerate(ids)}


def test_classifiers(spark, docs):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    a, b = rows(spark, "op4_language_id"), rows(spark, "op2_toxicity")
    assert sorted(r.doc_id for r in a) == sorted(r.doc_id for r in b) == sorted(docs)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in a) and all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) for r in b)
    known = [r for r in a if r.held_out and lang[r.doc_id] and any(c.isalpha() for c in docs[r.doc_id])]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in known]) > 0.95
    clean = [r for r in b if r.held_out and toxic.get(r.doc_id) == 0]
    assert np.mean([r.predicted for r in clean]) < 0.2


def test_mixing_meets_its_marginals(spark, docs):
    got = rows(spark, "op9_mixing")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.n_tokens == len(docs[r.doc_id].split()) for r in got if docs[r.doc_id].isascii())
    total = sum(r.n_tokens for r in got)
    for name in ("source", "lang", "topic"):
        seen, aimed = {}, {}
        for r in got:
            seen[r[name]] = seen.get(r[name], 0) + r.n_tokens
            aimed[r[name]] = aimed.get(r[name], 0) + r.n_tokens * r.weight
        goal = {k: v**0.7 for k, v in seen.items()}
        assert all(aimed[k] == pytest.approx(total * goal[k] / sum(goal.values()), rel=1e-4) for k in seen if seen[k])
    assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(total / 2, rel=1e-3)
    assert all(a.probability <= b.probability for a, b in pairwise(sorted(got, key=lambda r: r.weight)))
