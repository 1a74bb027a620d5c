"""A training corpus from raw documents: identify, dedup lines, join near copies, decontaminate, pack.

Every stage takes (spark, docs, sf_dir), with docs the whole result of the stage before, and returns a
DataFrame; all but the last keep the columns of documents, and any others, whatever their names. An empty
table gives an empty table. Rows with a null doc_id pass the first four stages, which judge them like others
where they can, and end before packing, whose pieces are told by their document's id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import Scratch
from sluiceway.llm.decontaminate import without_contaminated
from sluiceway.llm.language_id import keep_identified
from sluiceway.llm.line_dedup import dedup_lines
from sluiceway.llm.ngram_join import keep_one_of_each
from sluiceway.llm.packing import pack

#: Near copies: word n-grams of this size, and this similarity in per cent or more.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted, unchanged.

    A null or empty text, or one without letters, has no language and goes; very long texts are judged by
    all their words. Repeated rows are judged alike and all stay or go; nothing is left to a tie.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their texts less the lines that an earlier document has; n_chars follows.

    A null text becomes empty. A text that loses all its lines is empty and stays. Rows that repeat an id
    are one document for this: neither loses lines to the other.
    """
    kept = dedup_lines(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long"))
    return kept.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies.

    Documents without words and rows without an id are in no group and stay. Of rows with one id and
    other texts the text with the least hash stays, of equal rows one.
    """
    return keep_one_of_each(docs, SHINGLE, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty ones hold none, and an id of which any row holds one goes."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their token ids; an empty text is its end token, repeated rows are documents of their own."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.last(stage(spark, docs, sf_dir), name)
    return docs


#: Language models, packing and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
