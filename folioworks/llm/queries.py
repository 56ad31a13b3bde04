"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioworks.llm import (kneser_ney, languages, lines, packing, piece_sampling, secrets, simhash, token_links, toxicity, url_templates,
                            vector_dups, vector_tree, word_runs)
from folioworks.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_sampling.sampled(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "rank", "n_pieces", F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "log_inclusion")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(table(spark, sf_dir, "documents"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are documents that are labelled good and not toxic, and never otherwise; the other labelled ones are bad."""
    labels = table(spark, sf_dir, "labels")
    labelled = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    found = kneser_ney.judged(table(spark, sf_dir, "documents"), labelled.where("good").select("id"),
                              bad=labelled.where("NOT good").select("id"))
    return found.select(F.col("id").alias("doc_id"), "lang", "trusted", "perplexity", "threshold", "keep")


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.update_ledger(docs)
    found = F.coalesce("findings", F.array().cast("array<struct<kind: string, start: long, end: long>>"))
    by_path = secrets.findings_by_path(docs, ledger).select(F.col("id").alias("doc_id"), found.alias("findings"))
    return by_path.select(
        "doc_id", *[secrets.counts_of(F.col("findings"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.span_text(secrets.base_of(F.col("findings"))), 256).alias("base_sha256"),
        secrets.span_text(F.col("findings")).alias("spans"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.without_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled through the document whose number ends their path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("key"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    number = F.regexp_extract(url_templates.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    found = url_templates.judged_pages(pages, labels, label_key=F.when(number != "", number))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", "purity")


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_print().alias("fingerprint"), "component_id")


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dups.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def language_fold(id_col: str = "doc_id"):
    """The remainder of an id's checksum that parts learning rows from held-out ones; a null id is held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4, F.lit(2))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.learn(docs.where(language_fold() != 2))
    labelled = languages.label(docs.select("doc_id", "text"), model)
    return labelled.select("doc_id", (language_fold() == 2).alias("held_out"), "lang_pred", "score")


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3, F.lit(1))
    model = toxicity.learn(docs.where(fold != 1), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = F.col("toxicity")
    return toxicity.scored(docs, model).select("doc_id", (fold == 1).alias("held_out"), score.alias("score"),
                                               (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_links.linked(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("groups", "groups_sha256")


def with_planted_period(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of every tenth document with a periodic end, as the checksum of its id says; a null id changes nothing."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + (i - start) % period] for i in range(start, n)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.collapsed(table(spark, sf_dir, "documents"), changed=with_planted_period)
    spelt = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    # Runs come by start, then period, so the first of equal exponents is the one that is asked for.
    beats = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), beats)
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(spelt, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


#: SQL for the queries that it can express.
ORACLES: dict[str, str] = {
    "op6_line_dedup": r"""
        WITH cut AS (
            SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM cut),
        keyed AS (
            SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        repeated AS (
            SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        judged AS (
            SELECT k.doc_id, place, line, r.key IS NOT NULL AND k.doc_id <> r.holder AS gone
            FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, sum(gone::BIGINT)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
