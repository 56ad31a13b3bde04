"""Unions, differences and ordered de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioworks.functions.text import casefold, distinct_by, either, translate_tag
from folioworks.operators.catalog import active


def unique_tags(tags: Column, longest: int = 100) -> Column:
    """Translate, drop blanks and overlong ones, first spelling wins per folded tag."""
    named = F.filter(F.transform(tags, lambda x: translate_tag(F.trim(x))),
                     lambda x: (x != "") & (F.length(x) <= longest))
    return distinct_by(named, casefold)


def pending(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """Candidates without a stored decision."""
    return candidates.join(decided.select("duplicate_id"), "duplicate_id", "left_anti")


def toggled(clicks: DataFrame) -> DataFrame:
    """An item is a favourite after an odd number of toggles."""
    return clicks.groupBy("user_id", "item").agg(F.count("*").alias("toggles")).where(F.col("toggles") % 2 == 1)


def study_context(documents: DataFrame, notes: DataFrame, terms: Sequence[str], user_id: int) -> DataFrame:
    """Matching documents, private notes and earlier studies in one tagged list."""
    hit = either([F.ilike(c, F.lit(f"%{term}%")) for term in terms for c in ("title", "text")])
    library = (active(documents).where(hit).orderBy(F.desc("updated_at"), "doc_id").limit(6)
               .select(F.lit("library_document").alias("kind"), F.col("doc_id").alias("item_id"), "title",
                       F.left("text", F.lit(700)).alias("excerpt")))
    mine = notes.where(F.col("user_id") == user_id)
    private = (mine.orderBy(F.desc("updated_at"), "note_id").limit(4)
               .select(F.lit("user_private_note").alias("kind"), F.col("note_id").alias("item_id"),
                       F.left("content", F.lit(350)).alias("excerpt")))
    earlier = (mine.where("deleted_at IS NULL").groupBy("workspace_id").agg(F.max("updated_at").alias("u"))
               .orderBy(F.desc("u"), "workspace_id").limit(4)
               .select(F.lit("previous_study").alias("kind"), F.col("workspace_id").alias("item_id"), "workspace_id"))
    return library.unionByName(private, allowMissingColumns=True).unionByName(earlier, allowMissingColumns=True)
