"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge.llm import bpe, counts, embed, exact, langid, license, merkle, mixing, packing, periodic, sharding, simhash, toxicity
from slotforge.llm.common import fold, shared_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    packing.write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.token_index(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir), keep="largest")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_documents(spark, sf_dir)).select("doc_id", "license", F.round("containment", 6).alias("containment"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(_documents(spark, sf_dir), vocabulary))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    merkle.build(_documents(spark, sf_dir), path, received={"text": F.when(fold(F.col("doc_id"), 3) == 0, lowered).otherwise(F.col("text"))})
    return merkle.proofs(spark, path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_rows(_documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(_documents(spark, sf_dir), alter=periodic.plant))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_toxicity, op3_exact_dedup, op4_language_id, op5_token_counts, op6_license_scan, op7_simhash_dedup, op8_embedding_dedup, op9_mixing, op10_bpe, op11_merkle_manifest, op12_sharding, op13_periodic_runs)}


def _license_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(license.TEMPLATES.items()))
    kinds = ", ".join(f"({w}, {s})" for w, s, _ in license.windows_for(max(len(x.split()) for x in license.TEMPLATES.values())))
    five = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))"
    words = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
        WITH kinds(width, step) AS (VALUES {kinds}),
        t AS (SELECT license, list_distinct({five}) AS wanted FROM (SELECT license, {words.format("body")} AS w FROM (VALUES {quoted}) v(license, body)) q),
        templates AS (SELECT license, wanted, width, step FROM t, kinds
                      WHERE width = (SELECT min(k.width) FROM kinds k WHERE k.width >= len(wanted))),
        d AS (SELECT doc_id, {five} AS s FROM (SELECT doc_id, {words.format("text")} AS w FROM documents) q WHERE len(w) >= 5),
        near AS (SELECT d.*, t.* FROM d, templates t WHERE list_has_any(s, wanted)),
        windows AS (SELECT *, unnest(range(1, greatest(2, len(s) - width + step + 1), step)) AS pos FROM near),
        scored AS (SELECT doc_id, license,
                   len(list_intersect(wanted, list_slice(s, greatest(1, pos - width), pos + 2 * width - 1))) / len(wanted) AS c FROM windows)
        SELECT doc_id, license, round(max(c), 6) AS containment FROM scored WHERE c >= {license.CONTAINED} GROUP BY ALL"""


def _merkle_sql() -> str:
    def digest(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    step = "lambda a, b: xor(a // 256, crc[xor(a % 256, b) + 1])"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
    fold = "CASE WHEN h % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    tree = """SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 7) // 8 FROM {0} WHERE n > 1 GROUP BY tree, level, pos // 8"""
    run = "(PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN {} AND {})"
    sides = f"coalesce(string_agg(node, '') OVER {run.format('7 PRECEDING', '1 PRECEDING')}, '') AS l, coalesce(string_agg(node, '') OVER {run.format('1 FOLLOWING', '7 FOLLOWING')}, '') AS r"
    return f"""
        WITH RECURSIVE bits(i, v, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
                SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
        bytes AS (SELECT list(v ORDER BY i) AS crc FROM bits WHERE k = 8),
        docs AS (SELECT documents.*, {crc} AS h FROM documents, bytes),
        leaves AS (SELECT coalesce('=' || lang, '') AS tree, doc_id, {digest("text")} AS leaf, {digest("lowered")} AS received,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
                   FROM (SELECT *, {fold} AS lowered FROM docs) q),
        nodes(tree, level, pos, node, n) AS (SELECT tree, 0, pos, leaf, n FROM leaves UNION ALL {tree.format("nodes")}),
        subroots AS (SELECT tree, level AS height, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops(tree, level, pos, node, n) AS (SELECT '', 0, pos, subroot, n FROM subroots UNION ALL {tree.format("tops")}),
        sibs AS (SELECT tree, level, pos, {sides} FROM nodes WHERE n > 1),
        topsibs AS (SELECT level, pos, {sides} FROM tops WHERE n > 1),
        steps AS (SELECT doc_id, received, s.level AS k, l, r FROM leaves JOIN subroots USING (tree) JOIN sibs s ON s.tree = leaves.tree AND s.pos = leaves.pos // (8 ** s.level)::BIGINT
                  UNION ALL SELECT doc_id, received, height + t.level, l, r FROM leaves JOIN subroots u USING (tree) JOIN topsibs t ON t.pos = u.pos // (8 ** t.level)::BIGINT),
        folded(doc_id, k, node) AS (SELECT doc_id, 0, received FROM leaves
                  UNION ALL SELECT f.doc_id, f.k + 1, sha256(l || node || r) FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k),
        last AS (SELECT doc_id, arg_max(node, k) AS folded_root FROM folded GROUP BY 1),
        proofs AS (SELECT doc_id, sha256(coalesce(string_agg(l || r, '' ORDER BY k), '')) AS proof FROM leaves LEFT JOIN (SELECT doc_id, k, l, r FROM steps) q USING (doc_id) GROUP BY 1),
        root AS (SELECT node AS root FROM tops WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, proof AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN subroots USING (tree) JOIN last USING (doc_id) JOIN proofs USING (doc_id), root"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_license_scan": _license_sql(),
        "op11_merkle_manifest": _merkle_sql(),
        "op8_embedding_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0),
            links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
                      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
            reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
            roots AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1),
            counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
            SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
            FROM embeddings JOIN roots ON id = vec_id LEFT JOIN counts ON a = vec_id""",
        "op3_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    }
