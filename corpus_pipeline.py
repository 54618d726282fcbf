"""The training-data pipeline: raw documents to packed sequences.

Each stage takes the documents its predecessor kept and returns documents with the columns it got; the
last returns the places of their pieces in sequences. Null texts go with the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themata.llm.common import table
from themata.llm.crf import keep_identified, learn
from themata.llm.line_spread import remove_widespread
from themata.llm.packing import pack
from themata.llm.probminhash import one_of_each_class
from themata.llm.queries import vocabulary_path
from themata.llm.weak_rules import judge
from themata.session import ship_package
from themata.storage import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Mean probability that the language of a document's words needs.
MIN_LANGUAGE_SCORE = 0.4


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose words agree on no language."""
    ship_package(spark)
    return keep_identified(docs, learn(docs), MIN_LANGUAGE_SCORE)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are probably bad."""
    return judge(docs).where("kept").select(*docs.columns)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that spread over many sources; drop documents of which nothing is left."""
    cleaned = remove_widespread(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return (
        cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
        .withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
        .select(*docs.columns)
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return one_of_each_class(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    ship_package(spark)
    return pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_languages),
    ("quality rules", judge_quality),
    ("line dedup", clean_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack_documents),
]

#: Most stages have no SQL form; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
