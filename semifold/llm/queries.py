"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from semifold.llm import exactdup, html_extract, licenses, merkle, mixing, packing, pii, quality, simhash, substrings, topk, urls, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackParams(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.UrlModel(urls.labelled_urls(spark)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op4_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_passes", "mix_epoch", "mix_order")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.verify(table(spark, sf_dir, "documents"), F.replace("text", F.lit("\n"), F.lit("")), F.coalesce(even, F.lit(False)))
    proof = F.sha2(F.concat_ws("", "siblings"), 256)
    return found.select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_personal_data, op3_repeated_passages, op4_source_mixture, op5_license_scan, op6_packing, op7_main_text, op8_url_filter, op9_quality_rules, op10_exact_top_k, op11_ranked_search, op12_merkle_manifest, op13_exact_dedup)}
QUERIES["pipeline"] = corpus_pipeline.run
#: The trees and the proofs in SQL; crc32 byte by byte from its table (polynomial 0xEDB88320).
MERKLE_SQL = """
    WITH RECURSIVE crc_steps AS (
        SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
    named AS (
        SELECT doc_id, source, text, doc_id::VARCHAR AS id,
               coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
        FROM documents),
    hashed AS (
        SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS cut,
               list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)),
                           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) & 1 AS odd_before
        FROM named, crc_table),
    leaves AS (
        SELECT *, CASE WHEN odd_before = 1 THEN cut ELSE leaf END AS shown,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
        FROM hashed),
    low AS (
        SELECT coalesce('+' || source, ' ') AS g, 0 AS level, idx, leaf AS h FROM leaves
        UNION ALL
        SELECT g, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
        FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM low) WHERE m > 1 GROUP BY g, level, idx // 3),
    subroots AS (
        SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx FROM (SELECT g, arg_max(h, level) AS h FROM low GROUP BY g)),
    top AS (
        SELECT 0 AS level, idx, h FROM subroots
        UNION ALL
        SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
        FROM (SELECT *, count(*) OVER () AS m FROM top) WHERE m > 1 GROUP BY level, idx // 3),
    root AS (SELECT arg_max(h, level) AS root FROM top),
    low_runs AS (SELECT g, level, idx // 3 AS parent, list(h ORDER BY idx) AS run FROM (SELECT *, count(*) OVER (PARTITION BY g, level) AS m FROM low) WHERE m > 1 GROUP BY ALL),
    top_runs AS (SELECT level, idx // 3 AS parent, list(h ORDER BY idx) AS run FROM (SELECT *, count(*) OVER (PARTITION BY level) AS m FROM top) WHERE m > 1 GROUP BY ALL),
    fold_low AS (
        SELECT coalesce('+' || source, ' ') AS g, idx AS leaf_idx, 0 AS level, idx, shown AS now, ''::VARCHAR AS beside FROM leaves
        UNION ALL
        SELECT f.g, leaf_idx, f.level + 1, idx // 3,
               sha256(array_to_string(run[:idx % 3], '') || now || array_to_string(run[idx % 3 + 2:], '')),
               beside || array_to_string(run[:idx % 3], '') || array_to_string(run[idx % 3 + 2:], '')
        FROM fold_low f JOIN low_runs r ON r.g = f.g AND r.level = f.level AND r.parent = f.idx // 3),
    at_subroot AS (SELECT g, leaf_idx, arg_max(now, level) AS now, arg_max(beside, level) AS beside FROM fold_low GROUP BY g, leaf_idx),
    fold_top AS (
        SELECT a.g, leaf_idx, 0 AS level, s.idx, now, beside FROM at_subroot a JOIN subroots s ON a.g = s.g
        UNION ALL
        SELECT g, leaf_idx, f.level + 1, idx // 3,
               sha256(array_to_string(run[:idx % 3], '') || now || array_to_string(run[idx % 3 + 2:], '')),
               beside || array_to_string(run[:idx % 3], '') || array_to_string(run[idx % 3 + 2:], '')
        FROM fold_top f JOIN top_runs r ON r.level = f.level AND r.parent = f.idx // 3),
    folded AS (SELECT g, leaf_idx, arg_max(now, level) AS folded_root, sha256(arg_max(beside, level)) AS proof_sha256 FROM fold_top GROUP BY g, leaf_idx)
    SELECT doc_id, leaf, s.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves l JOIN folded f ON f.g = coalesce('+' || l.source, ' ') AND f.leaf_idx = l.idx JOIN subroots s ON s.g = f.g, root"""

TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SQL = f"""
    WITH terms AS (
        SELECT doc_id, rid, unnest({TERMS}) AS term
        FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
    asked AS (
        SELECT item_id, term, count(*) AS qtf
        FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark)
        GROUP BY ALL),
    sizes AS (SELECT rid, count(*) AS n FROM terms GROUP BY rid),
    whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
    postings AS (SELECT doc_id, rid, term, count(*) AS tf FROM terms GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, big_n),
    scored AS (
        SELECT item_id, rid, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))))::BIGINT AS score
        FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (rid), whole GROUP BY item_id, rid, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10"""

ORACLES: dict[str, str] = {
    "op11_ranked_search": RANKED_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
    "op13_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
