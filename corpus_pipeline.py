"""The corpus pipeline: quality rules, language identification, near-duplicate
removal, mixing to target weights, packing.  Each stage works on all that its
predecessor kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import langid, minhash, mixing, packing, quality
from demandlens.llm.common import materialise, scratch
from demandlens.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and the likelihood ratio against trusted documents.

    Null and empty texts fail the base rules.  Rows are judged each for itself.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs.select(*COLUMNS), labels).filter("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, or without a letter); lang becomes the language of the text, whatever was declared."""
    docs = docs.select(*COLUMNS)
    samples = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    told = langid.identify(docs, samples, keep=tuple(COLUMNS)).filter("lang_pred <> 'und'")
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of texts linked by 0.8 of their five-word shingles: that of the smallest id.

    Rows are compared under numbers of their own, so those that share an id, or
    have none, are told apart; rows without an id come last in a class.
    """
    docs = materialise(docs.select(*COLUMNS).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(docs, id_col="uid", shingle=5, percent=80, age_col="doc_id").select(F.col("doc_id").alias("uid"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    kept = docs.select("uid", "doc_id").join(found, "uid").groupBy("component_id").agg(F.min(order).alias("first")).select("first.uid")
    return docs.join(kept, "uid", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them; texts without words go."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; an empty text is a piece of one token."""
    return packing.piece_digests(packing.pack(docs.select(*COLUMNS), tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Hashed likelihood ratios, automata and tokens have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
