"""A corpus pipeline of stages over `documents`; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, sentencepiece_codec, simhash, substring_dedup, toxicity
from tidemark.llm.common import read, stored
from tidemark.llm.queries import digests, model_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the toxicity classifier, trained on labelled rows of this stage's input, doesn't predict toxic."""
    return toxicity.keep(docs.select(*COLUMNS), toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component, that of the smallest doc_id; of repeated rows one, and of rows without an
    id none where the component has an id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def cut_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of 13-word windows that a document of smaller id holds too. Texts with nothing to cut stay as they are; of a
    cut text the words left are joined by one space. Documents of which nothing is left go."""
    found = substring_dedup.dedup(docs.select(*COLUMNS), "lang", "source", "n_chars", "text")
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    kept = found.where(~cut | (F.col("n_removed") < F.col("n_words")))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap a benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes them again; returns the digests of both."""
    return digests(sentencepiece_codec.encode(docs, model_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_windows),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # SQL can't express the stages; the tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
