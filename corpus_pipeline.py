"""Documents to training tokens: drop toxic texts, near copies and benchmark passages, mix the sources, encode.

Each stage takes (spark, docs, sf_dir), reads the whole of ``docs`` and returns a DataFrame;
all but the last return the columns of ``documents``. NULLs, empty and repeated texts, ties,
empty tables and further columns are treated as the operators' docstrings say: a text
that is NULL or empty is clean, alone in its group, free of passages, of size 0 (so the mix
takes none of it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starfold.llm import decontaminate, mixture, setjoin, tokens, toxicity
from starfold.llm.common import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8)."""
    return setjoin.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; those it takes twice are repeated."""
    return mixture.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, described by what they hold of each document."""
    return tokens.encode_corpus(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("token_files", to_tokens),
]

#: Learned scores and trained tokenizers cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
