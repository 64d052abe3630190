"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import UPPER, table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), bpe_path())


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).drop("locator")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), bpe_path())


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.telephony import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)  # the contract's two words


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("m_source").alias("source"), F.col("m_lang").alias("lang"), F.col("m_topic").alias("topic"), "tokens", F.round("probability", 6).alias("probability"), "kept")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm.ppm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from chronoweave.llm.chat import ROTATE_SQL
    from chronoweave.llm.mixing import RATE, ROUNDS, TEMPER, mix_sql

    return {
        "op3_chat_rotation": ROTATE_SQL,
        "op9_mixing": mix_sql(TEMPER, RATE, ROUNDS),
        "op4_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
            WINDOW w AS (PARTITION BY norm)""",
    }
