"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark contamination, tokens.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.  What a stage decides takes effect: rejected documents are
gone, removed passages are out of the texts that later stages see.

For every stage: null and empty texts go with the first stage and, where a stage is given them alone, have no words, so they
have no copies, no passages and no hits, stay, and have no tokens.  Texts of any length are read whole.  Repeated rows are judged
alike (copies of a kept id all stay with the second stage, and lose what they share with each other in the third).  Of tied
documents the smallest id stays; a null id stays.  An empty table gives an empty table of the same columns.  Extra columns pass
through every stage, whatever their names; one named like a column of the last stage gets ``_in`` after its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, jaccard, language_id, substring_dedup
from tidemark.llm.common import Scratch, beside, gathered, table
from tidemark.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; texts that are null, have no letters, or no clear language go."""
    return language_id.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of every group of linked ones: sets of five words, Jaccard 0.8 or more."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of words that occur twice or more leave the texts; a document that loses every word goes."""
    return substring_dedup.drop_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents with n_tokens, ids, and whether the ids decode to the text."""
    added = ["n_tokens", "ids", "round_trip"]
    inner = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in inner.items()])
    coded = byte_bpe.round_trip(plain, *tokenizer(), text_col=inner["text"], keep=list(inner.values()))
    text = F.coalesce(F.col(inner["text"]), F.lit("")).cast("binary")
    own = [F.col(n).alias(c) for n, c in zip(inner.values(), beside(docs.columns, added), strict=True)]
    return coded.select(*own, F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontaminate", contamination),
    ("byte_bpe", tokens),
]

#: The first stage is a trained network, so SQL cannot express the result; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; once a stage is written, the one before it and the stage's own tables go."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with gathered() as own:
            docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        for done in own:
            done.close()
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
