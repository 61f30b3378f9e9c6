"""Corpus pipeline: five stages from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` applies them in order, each on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import langid, mixing, near_dup, packing, secrets
from emberline.llm._store import shielded, staged, table
from emberline.llm.queries import tokenizer_path

#: Documents whose best language is less sure than this go, as do those without letters.
SURE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach."""
    model = langid.train(docs)

    def work(d: DataFrame) -> DataFrame:
        out = langid.identify(d, model, d.columns)
        return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(*d.columns)

    return shielded(docs, COLUMNS, work)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest id) of each group of near-duplicates at a similarity of 0.8."""
    return shielded(docs, COLUMNS, lambda d: near_dup.deduplicated(d, 80, 100))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay. n_chars follows the new text."""

    def work(d: DataFrame) -> DataFrame:
        out = secrets.redact(d, d.columns)
        size = F.when(F.col("text").isNotNull(), F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", size).select(*d.columns)

    return shielded(docs, COLUMNS, work)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until the sources' words meet their target weights."""
    return shielded(docs, COLUMNS, mixing.mixed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix), ("packing", pack)]

#: Language models, hashed signatures and tokenizers have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
