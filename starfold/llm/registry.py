"""Registered queries of the operators in this subpackage, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starfold.llm import (
    chat, decontaminate, language, mixture, phrases, quality, secrets, setjoin, shards, tokens, toxicity, vectorgraph, whitening,
)
from starfold.llm.common import keep, table

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    PLANS[plan.__name__] = plan
    return plan


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Arrow stream files and described from them."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


@query
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, described from the written shards."""
    return shards.digest(shards.read_shards(spark, shards.write_shards(table(spark, sf_dir, "documents"), 24)))


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: fixed patterns and character models."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(secrets.samples(docs))))


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted with a loss mask, written, and read back."""
    messages = keep(chat.chains(chat.with_probe(table(spark, sf_dir, "conversations"))), "chat-messages")
    return chat.digest(keep(chat.conversations(messages), "chat-formatted"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


@query
def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of each document."""
    return mixture.digest(table(spark, sf_dir, "documents"))


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return phrases.top(phrases.collocations(table(spark, sf_dir, "documents")))


SQL |= {"op11_phrases": phrases.SQL}
SQL |= {"op5_chat": chat.SQL, "op6_decontaminate": decontaminate.SQL, "op7_mixture": mixture.SQL}


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by similar sets of three-word shingles."""
    return setjoin.groups(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


@query
def op9_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors linked by cosine."""
    return vectorgraph.near_duplicates(table(spark, sf_dir, "embeddings"))[0]


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened, with their first eight components."""
    return whitening.digest(table(spark, sf_dir, "embeddings"))


@query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
