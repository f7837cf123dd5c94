"""The corpus pipeline: stages over `documents`, each written and read again before the next.

A stage is a function of (spark, docs, sf_dir); docs is what its predecessor kept.  All but the
last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinograph.llm import ngram_join, packing, quality, suffix_dedup
from clinograph.llm.common import durable, read
from clinograph.llm.queries import tokenizer
from clinograph.session import ship

#: Words of the shortest repeated passage that is cut.
PASSAGE_WORDS = 51


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality trees score at least 0.5, all columns as they were.

    The trees learn from labelled documents of the input that are not held out.  Empty texts are
    scored like any other; without labels everything is kept.
    """
    ship(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, model)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word n-grams, similarity 0.8) the document of smallest id.

    Groups are what chains of links join.  Rows that repeat a kept id are kept once; documents
    without words or without an id are in no group and stay.
    """
    ship(spark)
    groups = ngram_join.link_components(docs.select("doc_id", "text"), n=5, percent=80)
    dropped = groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti")
    return kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every run of words that repeated strings of PASSAGE_WORDS words cover, with the white space inside it.

    Words are equal as bytes, whatever white space parts them.  Repeats that touch or overlap are one
    run.  n_chars follows the text.  A text that is cut to nothing stays as an empty row, and a null
    text stays null.
    """
    ship(spark)
    cut = suffix_dedup.with_repeats_removed(docs, PASSAGE_WORDS, "doc_id", "text", suffix_dedup.WORDS)
    return cut.withColumn("n_chars", F.when(F.col(cut.columns[-1]), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of at most 4096 ids; a null text is its end id alone."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", cut_passages),
    ("packing", pack_sequences),
]

#: Boosted trees and tokenizers are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
