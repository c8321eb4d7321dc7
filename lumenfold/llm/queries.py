"""The operators' queries for the driver contract, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, neighbours, packing, quality, records, secrets, sharding, simhash
from .common import fold_of, scratch, table

TOKENIZER = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, fold_of(F.col("doc_id"), 4) != 2)
    return language.predict(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return records.build_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op6_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id",
        "CAST(size(matches) AS LONG) AS n_matches",
        "array_join(array_sort(array_distinct(transform(matches, m -> m.license))), ',') AS licenses",
        "array_join(transform(matches, m -> concat_ws(':', m.license, m.start, m.end)), ',') AS spans",
        "coalesce(array_max(transform(matches, m -> round(m.coverage, 6))), 0D) AS coverage",
    )


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_binary_records": op3_binary_records,
        "op4_decontamination": op4_decontamination,
        "op5_secret_scan": op5_secret_scan,
        "op6_consistent_sharding": op6_consistent_sharding,
        "op7_quality": op7_quality,
        "op8_adaptive_ann": op8_adaptive_ann,
        "op9_simhash_dedup": op9_simhash_dedup,
        "op10_license_scan": op10_license_scan,
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(len(w), 8) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, w[p : p + n - 1] AS k FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, n, p, w[p : p + n - 1] AS k FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, item, n, p FROM places JOIN windows USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: a tokenizer, a fitted model, XXH64, a random rotation, a decoder or an alignment."""
    return {"op4_decontamination": DECONTAMINATION_SQL}
