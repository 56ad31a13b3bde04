"""Maintenance jobs over stored rows: cleanup, repair, normalisation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks import fixed_values as fv
from folioworks.functions import text as t, urls
from folioworks.operators.ranking import top_per_group


def cleanup_reasons() -> Column:
    """why a document should leave the Spanish library, in rule order."""
    meta = F.col("raw_metadata")
    fold = lambda c: t.casefold(F.coalesce(c, F.lit("")))
    body = t.casefold(F.concat_ws(
        "\n", F.coalesce("text", F.lit("")), F.coalesce(meta["summary"], F.lit("")),
        F.coalesce(meta["description"], F.lit(""))))
    labelled = [("source_url", F.col("source_url")), ("canonical_url", F.col("canonical_url")),
                ("metadata.source_url", meta["source_url"]), ("metadata.canonical_url", meta["canonical_url"])]
    rules = [F.when(fold(F.col("language")) == "en", "language=en")]
    rules += [F.when(F.contains(fold(c), F.lit("lang=eng")), f"{label} contiene lang=eng") for label, c in labelled]
    rules += [
        F.when(F.contains(fold(F.col("title")), F.lit("documento de prueba")), "título de documento de prueba"),
        F.when(F.contains(fold(F.col("source_url")), F.lit("prueba-n8n"))
               | F.contains(fold(F.col("canonical_url")), F.lit("prueba-n8n")), "URL de prueba n8n"),
        F.when(fold(meta["test_payload"]) == "true", "metadata.test_payload=true"),
        F.when(fold(F.col("source_key")) == "prueba n8n", "fuente Prueba n8n"),
    ]
    rules += [F.when(F.contains(body, F.lit(m)), f"texto placeholder: {m}") for m in fv.CLEANUP_PLACEHOLDERS]
    return F.array_distinct(F.array_compact(F.array(*rules)))


def soft_delete(documents: DataFrame, doomed: DataFrame, now: Column) -> DataFrame:
    """Mark and hide the listed documents, leave all others untouched."""
    marked = documents.join(doomed.select("doc_id", F.lit(True).alias("_hit")), "doc_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNull()
    extra = F.create_map(F.lit("cleanup_mode"), F.lit("soft_delete"),
                         F.lit("cleanup_reason"), F.lit("non_spanish_or_test_content"))
    return (marked.withColumn("raw_metadata", F.when(hit, _merged(F.col("raw_metadata"), extra))
                              .otherwise(F.col("raw_metadata")))
            .withColumn("status", F.when(hit, "HIDDEN").otherwise(F.col("status")))
            .withColumn("is_indexed", F.when(hit, False).otherwise(F.col("is_indexed")))
            .withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at")))
            .drop("_hit"))


def hard_delete(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    """I11, for tables without a deletion column."""
    return rows.join(doomed.select("doc_id"), "doc_id", "left_anti")


def _merged(base: Column, extra: Column) -> Column:
    """Right-hand keys win."""
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")),
                        lambda k, v: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)


merge_maps = _merged


def repair_candidates(documents: DataFrame) -> DataFrame:
    """Up to three repairs per document, one row each."""
    kind = F.coalesce(F.col("raw_metadata")["source_type"], urls.source_type(F.col("source_key"), F.col("canonical_url")))
    url = F.col("canonical_url")
    title = urls.title_from_url(url, kind)
    author = F.when(kind.isin("byu_speeches_en", "byu_speeches_es"), urls.author_from_url(url))
    published = urls.published_from_url(url, kind)
    proposal = lambda ok, name, old, new, why: F.when(ok, F.struct(
        F.lit(name).alias("field"), old.cast("string").alias("previous"), new.cast("string").alias("repaired"),
        F.lit(why).alias("repaired_from")))
    proposals = F.array_compact(F.array(
        proposal(t.title_needs_repair(F.col("title")) & title.isNotNull() & ~title.eqNullSafe(F.col("title")),
                 "title", F.col("title"), title, "canonical_url_slug"),
        proposal(author.isNotNull() & t.author_needs_repair(F.col("author")),
                 "author", F.col("author"), author, "byu_talk_author_slug"),
        proposal(F.col("published_on").isNull() & published.isNotNull(),
                 "published_at", F.lit(None), published, "general_conference_url")))
    return documents.select("doc_id", F.inline(proposals))


def new_audits(candidates: DataFrame, audit: DataFrame) -> DataFrame:
    """A (document, field) pair is repaired once."""
    return candidates.join(audit.select("doc_id", "field"), ["doc_id", "field"], "left_anti")


def apply_repairs(documents: DataFrame, repairs: DataFrame) -> DataFrame:
    """Overwrite the repaired fields and send the document back to indexing."""
    wide = repairs.groupBy("doc_id").agg(
        F.max(F.when(F.col("field") == "title", F.col("repaired"))).alias("_title"),
        F.max(F.when(F.col("field") == "author", F.col("repaired"))).alias("_author"),
        F.max(F.when(F.col("field") == "published_at", F.col("repaired"))).alias("_published"))
    touched = F.coalesce("_title", "_author", "_published").isNotNull()
    day = F.to_date(F.timestamp_seconds(F.col("_published").cast("bigint")))
    return (documents.join(wide, "doc_id", "left")
            .withColumn("title", F.coalesce("_title", "title"))
            .withColumn("author", F.coalesce("_author", "author"))
            .withColumn("published_on", F.coalesce(day, "published_on"))
            .withColumn("is_indexed", F.when(touched, False).otherwise(F.col("is_indexed")))
            .drop("_title", "_author", "_published"))


def change_report(rows: DataFrame, pairs: dict[str, tuple[Column, Column]], sample: int = 3) -> DataFrame:
    """Per column, how many values a normaliser changes, and a few examples.

    Examples are the smallest ids; each partition keeps at most ``sample`` of
    them, so the state stays small whatever the number of changed rows.
    """
    long = rows.select("doc_id", F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), before.alias("before"), after.alias("after"))
        for name, (before, after) in pairs.items()]))).where(~F.col("before").eqNullSafe(F.col("after")))
    counts = long.groupBy("column_name").agg(F.count("*").alias("detected"))
    ranked = long.withColumn("rn", F.row_number().over(Window.partitionBy("column_name").orderBy("doc_id")))
    examples = (ranked.where(F.col("rn") <= sample).groupBy("column_name")
                .agg(F.array_sort(F.collect_list(F.col("doc_id"))).alias("examples")))
    return counts.join(examples, "column_name")


def tag_updates(tags: DataFrame, slugify) -> tuple[DataFrame, DataFrame]:
    """Renames, plus slug changes whose target slug nobody else owns or wants."""
    wanted = tags.withColumn("new_name", t.translate_tag(F.col("name")))
    wanted = wanted.withColumn("desired", slugify(F.col("new_name")))
    moves = wanted.where((F.col("desired") != "") & ~F.col("slug").eqNullSafe(F.col("desired")))
    owners = wanted.where(F.col("slug") != "").groupBy(F.col("slug").alias("desired")).agg(
        F.min("tag_id").alias("owner"))
    # The two smallest claims are enough: a tag's rival is the smallest that is not its own.
    claims = top_per_group(wanted.where(F.col("desired") != "").select("desired", "tag_id").distinct(), ["desired"], [F.col("tag_id")], 2)
    claims = claims.groupBy("desired").agg(F.min("tag_id").alias("first_claim"), F.max("tag_id").alias("next_claim"))
    judged = moves.join(owners, "desired", "left").join(claims, "desired")
    rival = F.coalesce(
        F.col("owner"),
        F.when(F.col("first_claim") != F.col("tag_id"), F.col("first_claim"))
        .when(F.col("next_claim") != F.col("tag_id"), F.col("next_claim")))
    judged = judged.withColumn("rival", rival)
    conflicts = judged.where(F.col("rival").isNotNull()).select("tag_id", "slug", "desired", "rival")
    updates = judged.where(F.col("rival").isNull()).select("tag_id", "slug", "desired")
    return updates, conflicts
