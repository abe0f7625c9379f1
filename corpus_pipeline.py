"""A cleaning pipeline over documents in five stages; each reads what the one before has kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, jaccard_join, line_dedup, quality_rules, sentencepiece_codec
from textloom.llm.common import drop, hold


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word counts or the compression bands reject go.

    Null, empty and blank texts have no words and go; repeated rows are judged alike; an empty table stays empty.
    """
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten sites or more leave the texts; n_chars follows the text.

    No row goes. Null texts stay null, with a null n_chars; a null source is a site of its own; repeated rows are treated
    alike; an empty table stays empty.
    """
    out = line_dedup.line_dedup(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share four fifths of their five-word shingles, the one with the smallest id stays,
    of different texts with that id the one with the least hash.

    Rows go by id and text together, so that another text with the same id stays. Documents without words, rows without
    an id, and repeats of the row that stays, stay; an empty table stays empty.
    """
    classes = jaccard_join.jaccard_classes(docs, width=5, percent=80)
    gone = classes.where("not stays and doc_id is not null").select(F.struct("doc_id", "text_hash").alias("_")).distinct()
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_hash"))
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return mine.join(gone, F.col("key") == F.col("_"), "left_anti").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a twentieth of whose words stand in benchmark windows go.

    Null and empty texts stay; repeated rows are judged alike; an empty table stays empty, and an empty benchmark changes
    nothing.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the SentencePiece ids of each text that is left; null and empty texts have none, repeated rows are
    encoded each, and an empty table stays empty."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]

#: SQL can express neither the compression bands nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row. What one stage has written is deleted when the next has read it; the last is left to the caller,
    who reads the one before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            now: list[str] = []
            docs = hold(docs, now)
            drop(spark, before)
            before = now
    return docs
