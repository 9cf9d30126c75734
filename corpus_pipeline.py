"""Corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import decontaminate, jaccard_join, pieces, quality, suffix_dedup
from tickforge.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled documents of the input that aren't held out.

    A null or empty text gets the score of an empty one, a null id is scored like others, repeated rows stay or go
    together, and without labels the prior decides; an empty table stays empty. Only the columns of documents come out.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model, keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join, that with the smallest id; documents without words or id stay.

    Rows of one id are one document: the first in order of text and the other columns stays.
    """
    found = jaccard_join.link_components(docs)
    kept = found.where("component_id IS NULL OR component_id = doc_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id"))
    once = docs.join(kept.where("rows = 1 OR kept_id IS NULL"), same, "left_semi").select(*COLUMNS)
    again = docs.join(kept.where("rows > 1 AND kept_id IS NOT NULL"), same, "left_semi")
    again = again.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("d")).select("doc_id", "d.*")
    return once.unionByName(again.select(*COLUMNS))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents; a document of which nothing is left goes.

    A character that a cut splits goes as a whole; a null text comes out empty. Rows with a null id are left as they
    are, and rows of one id take nothing from each other.
    """
    out = suffix_dedup.remove_repeats(docs, keep=COLUMNS[:1] + COLUMNS[2:], whole=True)
    out = out.where("NOT (n_removed > 0 AND octet_length(kept) = 0)")
    text = F.expr("make_valid_utf8(cast(kept AS string))")
    out = out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
    return out.select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Null and empty texts hold none, null and repeated ids are judged by their texts; without items all stay.
    """
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of piece ids, and digests of the ids and of the text that they decode to: a row for each document, null as empty text."""
    return pieces.encode_pieces(docs, digests=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]
#: The classifier and the decontamination can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
