"""Compositions keep every row and can be repeated."""

from pyspark.sql import functions as F

from folioworks.functions import urls
from folioworks.operators import catalog, maintenance
from folioworks.plans import pipelines
from folioworks.sources import library as lib


def test_crawl_twice_changes_nothing(spark, small):
    pages = lib.table(spark, small, "pages")
    first = pipelines.crawl_to_documents(pages)
    assert first.count() == pages.select(urls.canonical(F.col("url"))).distinct().count()
    stored = first.select("canonical_url", "content_hash", "version")
    again = pipelines.crawl_to_documents(pages, stored)
    assert {r.action for r in again.select("action").distinct().collect()} == {"unchanged"}


def test_hidden_documents_are_not_indexed(spark, small):
    docs = lib.documents(spark, small)
    decisions = docs.where("doc_id < 20").select(
        F.col("doc_id").alias("duplicate_id"), F.lit("confirmed").alias("review_status"), F.lit("exact_duplicate").alias("classification"))
    chunks, plan = pipelines.documents_to_index(docs, "low", decisions)
    assert chunks.where("doc_id < 20").count() == 0
    total = plan.agg(F.max("total_tokens"), F.sum("tokens")).first()
    assert total[0] == total[1] == chunks.agg(F.sum("token_count")).first()[0]


def test_repairs_happen_once(spark, small):
    docs = lib.documents(spark, small)
    empty = docs.limit(0).select("doc_id", F.lit("title").alias("field"))
    fresh, after = pipelines.repair_run(docs, empty)
    assert fresh.count() > 0
    again, _ = pipelines.repair_run(after, fresh)
    assert again.count() == 0
    assert after.count() == docs.count()


def test_cleanup_hides_english(spark, small):
    docs = lib.documents(spark, small)
    after = pipelines.cleanup_run(docs, F.current_timestamp())
    assert catalog.active(after).where("language = 'en'").count() == 0
    assert after.count() == docs.count()
    assert maintenance.hard_delete(docs, docs.where("language = 'en'")).where("language = 'en'").count() == 0
