"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Every stage takes documents with a column ``text`` and returns all their columns, whatever others there are and however they are
named, but for the last, which returns pieces. In all of them a null text is one without words, a null id is an id like others that
comes last, equal rows are rows of their own unless stated, texts of any length count whole, and an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import decontamination, packing, quality, queries, secrets
from tallymill.llm.common import kept
from tallymill.llm.near_duplicates import one_of_each


def accepted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts. It is trained on those of them that ``labels`` rates.

    Without ratings of two grades all are accepted. Ratings of ids that are null or not among the documents do not count.
    """
    model = quality_model(spark, docs, sf_dir)
    names = [str(i) for i in range(len(docs.columns))]
    scored = quality.score(docs.toDF(*names), model, names, str(docs.columns.index("text")))
    return scored.where("accepted").select(*names).toDF(*docs.columns)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.OrdinalModel:
    return queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, a null one last.

    Of rows equal in id and text one stays. Documents without words are copies of none but such rows.
    """
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item. Those without text repeat none; an empty benchmark lets all pass."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` that of the masked text; where that is null, both stay."""
    masked = secrets.mask_secrets(docs)
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return masked.withColumn("n_chars", length)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their token ids. A document without text is its end id alone."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", accepted_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Models, tokens and graph components are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``, every stage written and read again before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
