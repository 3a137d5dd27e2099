"""A corpus pipeline of five stages, each an operator of :mod:`keyloom.llm`.

A stage takes the session, the documents that its predecessor kept, and the folder
of the input tables.  All but the last return the columns of ``documents``.

Defined results, of all stages: a null text counts as empty, and stays null where it is
not changed; a null doc_id is an id of its own that sorts first; texts of any length are
read whole; ties go to the smaller doc_id, then to the lesser hash of the text; an empty
table gives no rows; columns beside those of ``documents`` are carried along, one that is
named like a figure of a stage's operator (``n_words``, ``kept``, ``copy``, ...) with that figure.
Repeated rows are judged alike by the first stage; of the second at most one of them is
left; rows that share an id get equal numbers of copies in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import mixing, packing, quality, simhash, substrings
from keyloom.llm.queries import END_ID, SEED, TOKENIZER, WEIGHTS
from keyloom.llm.shared import table, written


#: Words of a window of the substring stage, as in its operator's query.
PASSAGE_WORDS = 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without windows of words that start earlier elsewhere; n_chars follows the text, and a text that loses nothing stays as it is."""
    kept = substrings.remove(docs.withColumn("_whole", F.col("text")), width=PASSAGE_WORDS)
    kept = kept.withColumn("text", F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("_whole")))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global shuffle."""
    return mixing.mix(docs, WEIGHTS, seed=SEED).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(docs, TOKENIZER, END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", sequences),
]

#: Tokens and the quality model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read from there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
