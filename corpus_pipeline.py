"""The corpus pipeline: five stages over documents, each writing what the next one reads.

Every stage but the last returns the columns of documents. Stages that change a text
set n_chars to its new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import common, quality
from strandloom.llm.decontaminate import find_leaks
from strandloom.llm.jaccard import keep_first
from strandloom.llm.line_dedup import dedup_lines
from strandloom.llm.piece_fst import round_trips
from strandloom.llm.queries import table, tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of three-line windows that stand earlier; those left with no line go."""
    cut = dedup_lines(docs).where("n_lines = 0 OR n_removed < n_lines")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles at 0.8."""
    return keep_first(docs, n=5, percent=80)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents no word of which stands in a ten-word window of a benchmark item."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text, and whether they decode to it."""
    return round_trips(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "ids", "n_pieces", "ids_crc32", "round_trip")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_of_benchmarks),
    ("SentencePiece encoding and decoding", as_pieces),
]

#: None: a trained classifier and a tokenizer have no SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for j, (_, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"stage{j}")
    return docs
