"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioworks.llm import languages, lines, packing, secrets, shingle_dups
from folioworks.llm.common import table
from folioworks.llm.queries import language_fold
from folioworks.session import write_once

#: A document stays if its language holds at least this share of its letters.
LEAST_SCORE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those of no main language; learns from all rows but the held-out ones."""
    model = languages.learn(docs.where(language_fold() != 2))
    names = [f"c{i}" for i in range(len(docs.columns))]
    labelled = languages.label(docs.toDF(*names), model, names[docs.columns.index("text")])
    stay = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return labelled.where(stay).select(*names).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and the documents that are left without any text."""
    return _measured(lines.without_repeated_lines(docs, drop_emptied=True).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near copies: five-word shingles with a similarity of 0.8 or more.

    SimHash names pairs, exact sets verify them, and prefix keys find what the radius misses.
    """
    return shingle_dups.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts."""
    return _measured(secrets.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    packed = packing.packed_documents(docs)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Shingle sets, Viterbi and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
