"""Documents to training tokens: language, toxicity, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), docs with doc_id, text, lang and source
and any other columns. Null and empty texts have no letter and go in the first
stage; very long ones are read whole. Rows that are alike are one document from
the third stage on. All stages but the last return the columns of documents; run() applies them one after another, and whoever drives STAGES
writes each result and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, langid, minhash, mixing, toxicity
from weftline.llm.queries_models import vocabulary_path
from weftline.llm.runtime import kept, small_batches


def _judged(docs: DataFrame, judgement, keep) -> DataFrame:
    """Rows of docs whose judgement is kept. docs' columns travel in a struct, so no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), judgement.alias("said")).where(keep(F.col("said"))).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no known language, go; profiles are learned from these documents. Where none has a lang, only the former go."""
    profiles = langid.learn(docs.select("doc_id", "text", "lang"))
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return _judged(docs, langid.predict(F.col("text"), profiles), lambda said: said.lang != langid.UNKNOWN)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.THRESHOLD or more go."""
    small_batches(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, toxicity.score(F.col("text"), model), lambda said: said.predicted == 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least doc_id. Decided row by row: ids may repeat or be null."""
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and the digests of ids and of the decoded text."""
    small_batches(spark)
    coded = docs.select("doc_id", "source", bpe.round_trip(F.col("text"), vocabulary_path(), with_ids=True).alias("bpe"))
    return coded.select("doc_id", "source", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256", "bpe.ids")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("bpe", encode),
]

#: Learned profiles and trees, and tokens, can't be expressed in SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
