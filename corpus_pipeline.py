"""A document pipeline of five operators: language ID, exact dedup, near dedup, mixing, encoding. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, exact, langid, mixing, near
from lexforge.llm.common import Tables
from lexforge.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: null text, empty text and text without a letter, and text of whose n-grams less than a fifth
    is of any learned language. Learned from rows with text, lang and doc_id; where there are none, no language is known and all rows go.
    A tie goes to the language first by code point, which doesn't change what stays. Repeated rows share one fate. Empty table: empty result."""
    return langid.reject(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space stays: that of most code points, then of smallest doc_id (null ids
    last), so of repeated rows one. Null text counts as empty, and empty and blank texts are one group. Empty table: empty result."""
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays, that of smallest (doc_id, text hash), null ids last, also where ids are
    null or shared. Texts without words are copies of nothing and stay; texts of fewer words are one shingle. Rows equal in doc_id and text stay or
    go together (the stage before leaves none). Empty table: empty result."""
    return near.deduplicate(docs, size=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for, no document more than three times. A null source is a source of its own;
    null, empty and blank texts have no words and are taken at their source's rate; a source without words is left out. Equal ids draw alike, repeated
    rows too; a null doc_id draws like one fixed id. Sources of equal caps share in order of their names. Empty table: empty result."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (ids), their number (n_tokens), and whether they decode to its text (decodes); columns of these names are
    replaced. Null and empty texts have no ids and decode to the empty text. Repeated rows get equal ids. Texts of any length are encoded whole.
    Empty table: empty result."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("encoding", encoding)]

#: SQL can't express the learned filters, the sketches or the merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs = Tables(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, tables.save(stage(spark, docs, sf_dir), name)
        tables.drop(before)
    return docs
