"""The opN_ queries and the pipeline: each callable takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embed_dup, grouping, html_text, infill, langid, lm, mixing, near_dup, packing, periodic, quality, secrets
from ._store import table


#: Name of the tokenizer file; the installed package knows its place on every executor.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_score(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill(table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_language_id,
    op2_mixing,
    op3_lm_scoring,
    op4_packing,
    op5_html_extraction,
    op6_chat_formatting,
    op7_quality_rules,
    op8_minhash_near_dup,
    op9_secret_scans,
    op10_embedding_near_dup,
    op11_periodic_runs,
    op12_best_fit_packing,
    op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": chat.ORACLE_SQL, "op8_minhash_near_dup": near_dup.ORACLE_SQL, "op10_embedding_near_dup": embed_dup.ORACLE_SQL, "op13_fill_in_middle": infill.ORACLE_SQL}
