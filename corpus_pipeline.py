"""A training-corpus pipeline over the documents table, one operator a stage.

Every stage passes on whole rows: the columns an operator reads are given to it apart from the
row itself, so columns of ``docs`` may have any names. A table without rows stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import table, written
from chronoweave.llm.exact_dedup import drop_exact_duplicates
from chronoweave.llm.language import UNDETERMINED, identify
from chronoweave.llm.mixing import mix
from chronoweave.llm.near_dup import drop_near_duplicates
from chronoweave.llm.packing import pack
from chronoweave.llm.queries import bpe_path

#: A choice of languages less certain than this is a guess; 0.5 is a coin toss between the best two.
MIN_CERTAINTY = 0.6


def apart(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, and all of a row in one, so that no names clash."""
    return docs.select(*columns, F.struct("*").alias("_cw_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or whose language is a guess; mixtures of languages stay.

    Null and empty texts and those without a letter have no language. Rows with a null language
    or id are judged like any other, as are very long texts and repeated rows, each by itself.
    Where no row has a language nothing can be learned, and every document goes.
    """
    found = identify(apart(docs, "doc_id", "text", "lang"), keep=("_cw_row",))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("certainty") >= MIN_CERTAINTY)).select("_cw_row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (A-Z lower-cased) the row with the largest id; null texts equal empty ones.

    Of repeated rows the last by place in the files stays. Null ids come before all others.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id.

    Null and empty texts are in no group; rows without an id stay; rows with the same id and
    text stay or go together.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target mixture of sources, languages and topics.

    Null sources and languages are margins of their own. Texts without words, null ones too, have
    no tokens and go. Rows with the same id and cell stay or go together.
    """
    return mix(apart(docs, "doc_id", "text", "source", "lang")).where("kept").select("_cw_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row per piece. A null or empty text is its end id alone."""
    return pack(docs, bpe_path())


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Language models, near-duplicate components and BPE cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
