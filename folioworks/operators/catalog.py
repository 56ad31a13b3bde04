"""Catalogue analytics: listings, summaries and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from folioworks import fixed_values as fv
from folioworks.functions.text import content_hash, normalize_title
from folioworks.functions.urls import normalize_source_type
from folioworks.operators.filters import resolve_column, seed_flag, source_match, source_type_of
from folioworks.operators.ranking import top_per_group
from folioworks.session import inline_table, spread


def display_status() -> Column:
    """P3."""
    return F.when(F.col("is_indexed"), "INDEXED").otherwise(F.upper(F.coalesce("status", F.lit("PENDING"))))


def source_url_of(df: DataFrame) -> Column:
    meta = resolve_column(df, ["raw_metadata", "metadata"])
    return F.coalesce(meta["source_url"], F.col("canonical_url"))


def description_of(df: DataFrame) -> Column:
    """Real columns first, then the metadata keys."""
    meta = resolve_column(df, ["raw_metadata", "metadata"])
    columns = [F.col(n) for n in ("summary", "description") if n in df.columns]
    return F.coalesce(*columns, meta["summary"], meta["description"])


def active(df: DataFrame) -> DataFrame:
    """Soft-deleted rows are skipped where the table knows about deletion."""
    return df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df


def without_exact_copies(documents: DataFrame) -> DataFrame:
    """J5 over exact copies: one document per (hash, language, title) survives.

    A live copy survives before a deleted one.  The survivor is an aggregate, so
    a group of any size is combined before the shuffle, and the way back is a
    semi-join on the unique id.
    """
    gone = F.col("deleted_at").isNotNull() if "deleted_at" in documents.columns else F.lit(False)
    hashed = spread(documents.select("doc_id", "language", "title", "text", gone.alias("gone")))
    kept = (
        hashed.groupBy(content_hash(F.col("text")).alias("h"), "language",
                          normalize_title(F.col("title")).alias("t"))
        .agg(F.min_by("doc_id", F.struct("gone", "doc_id")).alias("doc_id")).select("doc_id")
    )
    return documents.join(kept, "doc_id", "left_semi")


def without_confirmed_duplicates(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Hide what a confirmed decision marks as an exact or probable copy."""
    hidden = decisions.where(
        (F.col("review_status") == "confirmed") & F.col("classification").isin(*fv.HIDDEN_CLASSES)
    ).select(F.col("duplicate_id").alias("doc_id"))
    return documents.join(hidden, "doc_id", "left_anti")


def status_summary(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """A1: unknown states count as pending, absent states as zero."""
    status = display_status()
    folded = F.when(status.isin(*fv.DOCUMENT_STATUSES), status).otherwise("PENDING")
    counts = documents.groupBy(folded.alias("status")).agg(F.count("*").alias("n"))
    domain = inline_table(spark, ["status"], [(s,) for s in fv.DOCUMENT_STATUSES])
    return domain.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def sources_summary(spark: SparkSession, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """A2: count by raw type, fold to canonical types, keep the empty ones and the extras."""
    raw = (
        documents.select(source_type_of(documents).alias("source_type"), "source_key")
        .groupBy("source_type", "source_key").agg(F.count("*").alias("n"))
        .join(sources.select("source_key", "source_name"), "source_key")
    )
    folded = raw.groupBy(normalize_source_type(F.col("source_type")).alias("source_type")).agg(
        F.sum("n").alias("n"), F.min_by("source_name", F.struct(-F.col("n"), "source_type", "source_key"))
        .alias("first_name"))
    domain = inline_table(spark, ["source_type", "known"],
                          [(k, fv.SOURCE_LABELS[k]) for k in fv.CANONICAL_SOURCE_TYPES])
    return domain.join(folded, "source_type", "full_outer").select(
        "source_type", F.coalesce("known", "first_name").alias("label"),
        F.coalesce("n", F.lit(0)).alias("n"), F.col("known").isNotNull().alias("canonical"))


def author_counts(documents: DataFrame, limit: int) -> DataFrame:
    """A3."""
    return (documents.where(F.col("author").isNotNull() & (F.col("author") != ""))
            .groupBy("author").agg(F.count("*").alias("n")).orderBy("author").limit(limit))


def topic_counts(documents: DataFrame, limit: int) -> DataFrame:
    """Tags and categories in one list, partial counts summed."""
    tags = documents.select(F.explode("tags").alias("name"))
    categories = documents.where(F.col("category") != "").select(F.col("category").alias("name"))
    counted = [part.groupBy("name").agg(F.count("*").alias("n")) for part in (tags, categories)]
    return (counted[0].unionAll(counted[1]).groupBy("name").agg(F.sum("n").alias("n"))
            .orderBy("name").limit(limit))


def list_documents(documents: DataFrame, sources: DataFrame, *, limit: int = 30, offset: int = 0,
                   search: str | None = None, language: str | None = None, status: str | None = None,
                   cursor: int | None = None, include_seed: bool = True, source_type: str | None = None,
                   decisions: DataFrame | None = None) -> DataFrame:
    """One page with the total of the whole selection.

    The selection is read once, here: narrow keys go to a top-k, and the total
    is counted on their way there.  What the page shows is then fetched for its
    ids, at most 100, by a filter that reaches the scan.  Ids are unique.
    """
    limit, offset = max(1, min(limit, 100)), max(0, offset)
    rows = active(spread(documents) if search else documents)
    if decisions is not None:
        rows = without_confirmed_duplicates(rows, decisions)
    if source_type:
        rows = rows.where(source_match(rows, [source_type]))
    if search:
        like = F.lit(f"%{search}%")
        rows = rows.where(F.ilike("title", like) | F.ilike(F.coalesce("text", F.lit("")), like)
                          | F.ilike(F.coalesce("author", F.lit("")), like))
    if language:
        rows = rows.where(F.col("language") == language)
    if status:
        rows = rows.where(display_status() == status.upper())
    else:
        rows = rows.where(F.upper(F.coalesce("status", F.lit("PENDING"))) != "FAILED")
    if not include_seed:
        rows = rows.where(~seed_flag(F.col("raw_metadata")))
    if cursor is not None:
        rows = rows.where(F.col("doc_id") > cursor)
    keys = rows.select("doc_id", F.unix_seconds("updated_at").alias("updated_s"), seed_flag(F.col("raw_metadata")).alias("seed"))
    counted = Observation()
    page = (keys.observe(counted, F.count(F.lit(1)).alias("n"))
            .orderBy(F.when(F.col("seed"), 1).otherwise(0), F.desc("updated_s"), "doc_id").offset(offset).limit(limit).collect())
    shown = documents.where(F.col("doc_id").isin([row["doc_id"] for row in page])).select(
        "doc_id", "title", "author", "source_key", source_type_of(documents).alias("source_type"), "language",
        display_status().alias("display_status"), "canonical_url", source_url_of(documents).alias("source_url"),
        F.left(F.coalesce("text", F.lit("")), F.lit(360)).alias("excerpt"),
        F.unix_seconds("updated_at").alias("updated_s"), seed_flag(F.col("raw_metadata")).alias("seed"))
    named = shown.join(sources.select("source_key", "source_name"), "source_key")
    return named.withColumn("total", F.lit(counted.get["n"]).cast("long"))


def source_dashboard(documents: DataFrame, jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Both sides are aggregated to one row per source before they meet."""
    doc_stats = documents.groupBy("source_key").agg(
        F.count("doc_id").alias("documents"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))
    job_stats = jobs.where(F.col("source_key").isNotNull()).groupBy("source_key").agg(
        F.max("created_at").alias("latest_job_at"),
        F.count_if(F.lower("status").isin("failed", "error")).alias("errors"))
    config_int = lambda key: F.expr(f"try_cast(nullif(config['{key}'], '') AS INT)")
    return (
        sources.join(doc_stats, "source_key", "left").join(job_stats, "source_key", "left")
        .select(
            "source_key", "source_name", "enabled",
            F.coalesce(F.col("rate_limit"), config_int("rateLimit"), F.lit(30)).alias("rate_limit"),
            F.coalesce(config_int("maxPagesPerRun"), F.lit(25)).alias("max_pages"),
            F.col("config")["language"].alias("language"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("characters", F.lit(0)).alias("characters"),
            F.floor(F.coalesce("characters", F.lit(0)) / 4).alias("estimated_tokens"),
            F.unix_micros("latest_job_at").alias("latest_job_us"),
            F.coalesce("errors", F.lit(0)).alias("errors"))
    )


def counts_by_status(rows: DataFrame) -> DataFrame:
    """A5."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def activity_metrics(events: DataFrame, until: Column) -> DataFrame:
    """One row of counters, distinct users over the last 30 days."""
    recent = F.col("created_at") >= until - F.expr("INTERVAL 30 DAYS")
    return events.agg(
        F.count("*").alias("events"),
        F.countDistinct(F.when(recent, F.col("user_id"))).alias("active_users"),
        F.count_if(F.col("kind") == "embedding").alias("embeddings"),
        F.count_if(F.col("status") != "ok").alias("failures"))


def usage_dashboard(access: DataFrame, workspaces: DataFrame, citations: DataFrame, activity: DataFrame, feedback: DataFrame,
                    documents: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """The ten counters of the administration page in one row; every table is read once and reduced to one row."""
    live = F.col("deleted_at").isNull()
    recent = F.col("updated_at") >= now - F.expr("INTERVAL 30 DAYS")
    one_row = [
        access.agg(F.count("*").alias("beta_users"), F.count_if(F.col("status") == "approved").alias("approved_users")),
        workspaces.agg(F.countDistinct(F.when(recent, F.col("user_id"))).alias("active_users"),
                       F.count_if(live).alias("workspaces_created")),
        citations.agg(F.count_if(live & (F.col("kind") == "quote")).alias("saved_quotes"),
                      F.count_if(live & (F.col("kind") == "post_it")).alias("post_its_created")),
        activity.agg(F.count_if(F.col("kind") == "export").alias("exports")),
        feedback.agg(F.count("*").alias("feedback")),
        documents.agg(F.count_if("is_indexed").alias("documents_indexed")),
        jobs.agg(F.count_if(F.lower("status").isin("failed", "error")).alias("recent_errors"))]
    rows = one_row[0]
    for part in one_row[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def document_detail(documents: DataFrame, sources: DataFrame, passages: DataFrame, tags: DataFrame, most: int = 200) -> DataFrame:
    """Each document with its source, all its tags, the number of its passages and the first ``most`` of them.

    Passages are ranked before they are gathered, so a record holds ``most`` of
    them however long its document is; tags of a document are few.
    """
    counted = passages.groupBy("doc_id").agg(F.count("*").alias("chunks_available"))
    shown = (top_per_group(passages, ["doc_id"], [F.col("chunk_index")], most).groupBy("doc_id")
             .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("chunks")))
    related = tags.groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("_related"))
    rows = active(documents)
    own = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    added = F.coalesce(F.col("_related"), F.array().cast("array<string>"))
    joined = (rows.join(sources.select("source_key", "source_name"), "source_key").join(counted, "doc_id", "left")
              .join(shown, "doc_id", "left").join(related, "doc_id", "left"))
    return joined.select(
        "doc_id", "title", "author", "source_name", "language", "category", "canonical_url", display_status().alias("display_status"),
        F.year("published_on").alias("year"), F.array_distinct(F.concat(own, added)).alias("tags"), "text",
        F.coalesce("chunks_available", F.lit(0)).alias("chunks_available"), "chunks")
