"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.llm import bpe, centroids, knn, licences, line_dedup, media, mixing, packing, quality, sharding, simhash, token_files, vector_codes
from forgeline.llm.common import documents

TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Words that a worker of op1_bpe remembers: nothing else is in its memory, unlike in the pipeline.
OP1_WORDS = 600_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path(), OP1_WORDS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.resharded(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op9_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = knn.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return knn.top_k(data, F.col("vec_id") % 100 == 0)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), tokenizer_path())


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(documents(spark, sf_dir), tokenizer_path(WORD_TOKENIZER))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_mixing, op3_simhash, op4_media, op5_licences, op6_sharding, op7_quality, op8_line_dedup, op9_knn, op10_token_files, op11_packing, op12_centroids, op13_vector_codes, pipeline)}
SQL = {"op2_mixing": mixing.MIXED_SQL, "op8_line_dedup": line_dedup.REPORT_SQL, "op9_knn": knn.TOP_K_SQL, "op12_centroids": centroids.REPORT_SQL, "op13_vector_codes": vector_codes.REPORT_SQL}
