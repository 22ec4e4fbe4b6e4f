"""A training corpus from raw documents: five stages, each on all that the one before kept.

Null text and text without letters go in the first stage; text of which no line is left goes in
the second. Very long texts are treated whole in every stage. Rows without an id take part in
the language stage, by their text, and pass the next three unchanged; packing, whose rows name
text by its id, leaves them out. Rows that repeat id and text have the same fate, those that
repeat an id with other text are told apart by it, up to decontamination, which drops all rows
of an id of which one leaks. Columns beyond those of documents stay up to the last stage. Of
equal texts the smallest id stays. Empty tables give an empty result; so does an empty stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, owned, table
from corvane.llm.decontaminate import decontaminate
from corvane.llm.language_id import explained
from corvane.llm.line_dedup import line_dedup
from corvane.llm.ngram_jaccard import keep_one
from corvane.llm.packing import pack

LEAST_FIT = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned languages selected for them explain for the most part, be it one or several; text without letters goes."""
    return explained(docs, LEAST_FIT)


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go, as a single line is a run too; so do documents of which nothing is left. n_chars follows the text."""
    out = line_dedup(docs, min_lines=1)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.trim("text", F.lit(" \t\r\n")) != "")


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies."""
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in sequences of 4096 tokens."""
    return pack(docs, with_ids=True)


STAGES = [
    ("language_id", identified),
    ("line_dedup", lines_deduplicated),
    ("ngram_jaccard", near_copies_removed),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Language inference and packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        with owned():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = (name,)
    return docs
