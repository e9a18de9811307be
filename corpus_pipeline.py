"""A corpus pipeline: quality, near duplicates, benchmark decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads as the next stage's docs. All
but the last return the columns of documents, and any others that the table has.

quality: rows whose score is below the threshold go; null and empty texts are scored by the bias alone, so all of them stay or all go.
near_duplicates: of each component one row stays, that of the smallest doc_id (null last), and of rows that repeat doc_id and text one; shingles
have five words. decontamination: rows that hold a window or a quote of a benchmark item go; null and empty texts stay. pii: spans are
replaced by their kind; no row goes. bpe: doc_id, n_tokens and digests of every row; a null text has no ids. An empty table gives an
empty result at every stage, equal rows are treated alike, and doc_id may be null.
"""

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontam, neardup, pii, quality
from lodestone.llm.common import drop_stored, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("pii", mask_personal_data), ("bpe", encode_tokens)]

# The stages hold a trained model, hashing and a tokenizer, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
