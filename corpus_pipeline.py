"""A training corpus in five stages: language ID, exact dedup, near-duplicate removal, repeated passages, packing.

Every stage reads documents, decides on each of them, and hands on documents with the same columns; the last one returns
the packed pieces. Further columns, whatever their names, are carried along by all stages but the last and never reach
Python. An empty table passes through every stage. Rows that share an id are kept or dropped together, except that of rows
equal in id and text all stay in exact dedup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.llm.exact_dedup import exact_dedup
from screenlake.llm.language_id import held_out, language_column
from screenlake.llm.ngram_join import ngram_join
from screenlake.llm.packing import pack_documents
from screenlake.llm.repeats import without_repeats
from screenlake.llm.staging import columns_of, free_name, stage
from screenlake.llm.tokens import tokenizer_path
from screenlake.shipping import ship

#: Near duplicates: word shingles and the percentage of Jaccard similarity from which documents are copies.
WORDS, PERCENT = 5, 80
#: Bytes of the shortest passage that is removed where it repeats.
PASSAGE = 100
WINDOW, END_ID = 2048, 1
#: Words that a worker remembers in the first and the last stage: here workers share an executor with what all stages leave.
REMEMBERED = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text reads as one of the learned languages; models learn from the labelled rows of three quarters.

    Rejected: null and empty texts, texts without letters, and texts far above the calibrated cross-entropy. A document
    without an id is judged like any other. Without labelled rows nothing is learned and every document is rejected.
    """
    ship(spark)
    train = docs.where(~held_out()).select("doc_id", "text", "lang")
    found = free_name(docs, "language")
    judged = docs.withColumn(found, language_column(train, max_words=REMEMBERED)(F.col("text")))
    return judged.where(~F.col(f"{found}.rejected")).select(*columns_of(docs))


def _without(docs: DataFrame, found: DataFrame, goes: Column) -> DataFrame:
    """docs less the ids of which every row of found goes; documents without an id stay.

    Fewer documents go than stay, so their ids are what meets the texts: while they are few Spark sends them to the texts,
    which then are not shuffled.
    """
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.min(goes).alias("goes")).where("goes").select("doc_id")
    return docs.join(stage(ids, "dropped"), "doc_id", "left_anti").select(*columns_of(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id.

    Null and empty texts are equal to each other, so one of them stays. Ties of id stay together.
    """
    ship(spark)
    return _without(docs, exact_dedup(docs.select("doc_id", "text")), ~F.col("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by near-duplicate links, the one with the smallest id.

    Null and empty texts have no shingles, link with nothing and stay. Very long texts count whole.
    """
    ship(spark)
    return _without(docs, ngram_join(docs.select("doc_id", "text"), WORDS, PERCENT), F.col("component_id") != F.col("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that come earlier in the corpus too; every document stays, if with an empty text.

    A null text stays null. Documents without an id come first in the corpus; rows equal in id and text are one place, so
    neither is cut for the other. n_chars, if there is such a column of integers, is counted anew.
    """
    ship(spark)
    return without_repeats(docs, PASSAGE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of ids; a null or empty text is its end id alone, repeated rows are packed each."""
    ship(spark)
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path(), WINDOW, END_ID, max_chunks=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packing),
]

#: Scoring by language models, similarity components and byte passages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
