"""Queries of the operators that learn something from the tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, htmltext, langid, minhash, toxicity, vectors
from weftline.llm.runtime import documents, held_out, small_batches


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("tox")).select("doc_id", "held_out", "tox.score", "tox.predicted")


def vocabulary_path() -> str:
    """The vocabulary file; WEFTLINE_VOCABULARY names another one."""
    if found := os.environ.get("WEFTLINE_VOCABULARY"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = documents(spark, sf_dir).select("doc_id", bpe.round_trip(F.col("text"), vocabulary_path()).alias("bpe"))
    return coded.select("doc_id", "bpe.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.learn(docs.select("doc_id", "text", "lang"))
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.predict(F.col("text"), profiles).alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), "told.score")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op4_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op5_html_extraction": op5_html_extraction, "op4_itq": op4_itq, "op3_minhash": op3_minhash, "op7_bpe": op7_bpe, "op8_language_id": op8_language_id, "op1_toxicity": op1_toxicity}
#: Brute force: all pairs that share a shingle, and labels carried along links.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id WHERE r.m < l.b)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept FROM r JOIN documents ON id = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP4_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS m FROM e UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id WHERE r.m < l.b),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(m) AS component_id, vec_id = min(m) AS kept FROM r JOIN e ON id = vec_id LEFT JOIN k ON a = vec_id GROUP BY vec_id
"""

ORACLES = {"op3_minhash": OP3_SQL, "op4_itq": OP4_SQL}
