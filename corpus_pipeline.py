"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated passages go, sources are mixed, and what
is left is encoded. Each stage reads what its predecessor wrote.

In all stages null and empty texts are texts like any other, null ids are ids, texts may be of any length, further columns come out as they
went in whatever their names, and an empty table gives an empty one. What happens to rows that repeat each other is said with each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skytrace.llm import bpe, chunks, mixing, simhash, toxicity
from skytrace.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; repeated rows are judged alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the least id; repeated rows are near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document has, or the same one before, are cut; rows that repeat an id and a text count once and are cut alike."""
    return chunks.cut_repeated_passages(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for; unlike rows are told apart, equal ones taken together."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with their number and the digests of both directions; a row for each row."""
    decoded = bpe.decode(bpe.encode(docs))
    return bpe.digests(decoded)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mixed), ("encode", encoded)]

#: The first stage learns a classifier, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
