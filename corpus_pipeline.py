"""A corpus pipeline of training-data operators; each stage reads what the one before it has written.

In every stage null and empty texts are texts without words, very long ones are worked on as a whole, rows that repeat doc_id and text get
equal results, null doc_ids are kept apart from others, an empty table gives an empty one, and columns of any other name are
carried along whole; in the last stage they end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.llm import bpe, line_dedup, mixing, quality, simhash
from forgeline.llm.common import saved
from forgeline.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; labels and training texts are the table's own.

    A document without text has no evidence against it but the calibration's; without labels of both classes nothing is rejected unless good
    ones are under three in ten.
    """
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs.withColumn("_row", F.struct(*docs.columns)), model).filter("predicted = 1").select("_row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines and passages of 50 words or more that stand elsewhere go from the texts; all documents stay, copies too.

    The first occurrence by doc_id (null first) stays. A text all of which goes becomes empty, a null text stays null.
    """
    return line_dedup.without_repeats(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: 0.8 or more of the five-word shingles shared.

    SimHash fingerprints within 4 bits are searched first, MinHash keys add the pairs that so few bits do not reach, and shingles confirm all links.
    Texts without words are one group; of ties in doc_id the smaller hash of the text stays, of repeated rows one.
    """
    return simhash.near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; those that the mix leaves out go. A null source is a source."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row for each document of the mix; a null text has no tokens."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [("quality", good_quality), ("line_dedup", without_repeated_lines), ("simhash", one_of_near_copies), ("mixing", mixed), ("bpe", encoded)]
#: SQL has no BPE, compression or SimHash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
