"""A training corpus from raw documents, in five stages.

Each stage takes all that its predecessor kept and returns the columns of documents; the last returns the packed pieces.

* quality: documents whose model score is below one half go;
* near_dedup: of each group of near-duplicates (word five-shingles, similarity 0.8) the smallest doc_id stays;
* decontamination: documents that hold a whole window of any benchmark item go;
* secrets: every secret's span is replaced, n_chars follows;
* packing: the rest is cut and packed into sequences of 2048 tokens.

Cases: a null or empty text is scored, grouped, searched and packed as empty, and stays as it is; rows without an id can't be
told apart as copies and all stay; rows that repeat an id and its text leave one; of ties the smallest doc_id stays; columns
beyond those of documents pass through every stage but the last; an empty table gives no row in any stage.

``run`` writes each stage's rows below spark.checkpoint.dir and reads them back, so a lost executor costs a stage at most.
No SQL expresses the fitted model, the fingerprints' proofs or the packing, so ORACLE_SQL is None; tests/llm holds the
stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, packing, secrets, simhash
from lumenfold.llm import quality as quality_model
from lumenfold.llm.common import fold_of, save, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, quality_model.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 3) != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", redaction),
    ("packing", best_fit),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
