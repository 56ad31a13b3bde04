"""The driver's tables seen as a document library.

The fixtures hold no titles, authors, URLs, states or tags, so those columns are
derived from each row by fixed expressions; nothing is invented apart from the
rows themselves, and every derived table grows with its base table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioworks.session import spread

LANG3 = {"es": "spa", "en": "eng", "fr": "fra", "de": "deu"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(selector: Column, values: list) -> Column:
    result = None
    for index, value in enumerate(values):
        condition = selector == index
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records: text plus the metadata a crawl would have produced."""
    d = table(spark, sf_dir, "documents")
    num = F.substr("source", F.lit(4)).cast("int")
    bucket = F.floor(F.col("doc_id") / 40).cast("bigint")
    b = bucket.cast("string")
    lang3 = _pick(F.array_position(F.array(*[F.lit(k) for k in LANG3]), F.col("lang")) - 1, list(LANG3.values()))
    slug = _pick(bucket % 4, ["ana-b-reyes", "luis-mora-jr", "speakers", "john-taylor"])
    media = F.when(bucket % 7 == 0, "&imageView=1").otherwise("")
    url = _pick(num % 6, [
        F.concat(F.lit("https://speeches.byu.edu/talks/"), slug, F.lit("/talk-number-"), b,
                 F.lit("/?lang="), lang3, F.lit("&utm_source=feed")),
        F.concat(F.lit("https://www.speeches.byu.edu/spa/talks/"), slug, F.lit("/discurso_"), b,
                 F.lit("/?lang="), lang3),
        F.concat(F.lit("http://DiscursoSUD.com//articulo-"), b, F.lit("?language="), F.col("lang"), F.lit("#top")),
        F.concat(F.lit("https://www.churchofjesuschrist.org/study/general-conference/"),
                 (bucket % 30 + 1990).cast("string"), F.lit("/"),
                 F.when(bucket % 2 == 0, "04").otherwise("10"), F.lit("/mensaje_"), b, F.lit("?lang="), lang3, media),
        F.concat(F.lit("https://www.josephsmithpapers.org/paper-summary/history-revised-edition-"), b),
        F.concat(F.lit("https://rsc.byu.edu:8080/book-"), num.cast("string"), F.lit("/chapter%20"), b,
                 F.lit("/?b=2&a=1")),
    ])
    alias = _pick(num % 6, ["byu", "speeches_byu_es", "discursosud", "Conferencia-General", "jsp", "custom src"])
    doc = F.col("doc_id")
    tags = F.array_compact(F.array(
        F.when(doc % 2 == 0, "Faith"), F.when(doc % 3 == 0, "temple"), F.when(doc % 7 == 0, F.col("source"))))
    first_line = F.substring_index("text", "\n", 1)
    title = (F.when(doc % 23 == 0, F.concat(F.lit("Part "), (doc % 9).cast("string")))
             .when(doc % 29 == 0, "").otherwise(F.left(first_line, F.lit(160))))
    return d.select(
        "doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("source_key"), "n_chars",
        title.alias("title"),
        _pick(doc % 7, ["Ana B. Reyes", "Luis Mora Jr.", "José Núñez", "maria lower", "Autor 12", "  ", None])
        .alias("author"),
        F.when(F.col("lang") == "es", "Discursos").when(F.col("lang") == "en", "Talks")
        .when(F.col("lang") == "fr", "Manuels").alias("category"),
        tags.alias("tags"),
        url.alias("canonical_url"),
        _pick(doc % 10, [None, "failed", "pending", "archived"] + ["ready"] * 6).alias("status"),
        (doc % 4 == 1).alias("is_indexed"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 3600).alias("created_at"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 3600 + (doc * 7919) % 100000).alias("updated_at"),
        F.when(doc % 6 != 0, F.date_add(F.lit("2000-01-01").cast("date"), (doc % 8000).cast("int")))
        .alias("published_on"),
        F.when(doc % 19 == 0, F.timestamp_seconds(F.lit(1735689600))).alias("deleted_at"),
        F.map_filter(
            F.create_map(
                F.lit("source_type"), F.when(doc % 3 == 0, alias),
                F.lit("source_url"), F.when(doc % 8 == 0, F.concat(F.lit("https://mirror.example.org/"), doc)),
                F.lit("summary"), F.when(doc % 4 == 0, F.left(first_line, F.lit(40))),
                F.lit("is_seed"), F.when(doc % 50 == 0, "true"),
                F.lit("error"), F.when(doc % 31 == 0, "HTTP 500"),
                F.lit("api_token"), F.when(doc % 5 == 0, "t0k3n"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("raw_metadata"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source dimension: one row per source seen in the documents."""
    num = F.substr("source_key", F.lit(4)).cast("int")
    config = F.map_filter(
        F.create_map(
            F.lit("rateLimit"), F.when(num % 3 == 0, "").when(num % 3 == 1, "15"),
            F.lit("maxPagesPerRun"), F.when(num % 4 == 0, "40"),
            F.lit("language"), F.when(num % 2 == 0, "es"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return (
        table(spark, sf_dir, "documents").select(F.col("source").alias("source_key")).distinct()
        .select("source_key", F.concat(F.lit("Source "), num.cast("string")).alias("source_name"),
                F.when(num % 5 == 0, 99).alias("rate_limit"), config.alias("config"),
                (num % 7 != 0).alias("enabled"))
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion jobs: the event log read as a job log."""
    e = table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "queued")
              .when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "done")
              .otherwise("Error"))
    return e.select(
        F.col("event_id").alias("job_id"),
        F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")))
        .alias("source_key"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 5 SECONDS"))
        .alias("started_at"),
        F.when(F.col("event_id") % 4 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 60 SECONDS"))
        .alias("finished_at"),
        F.when(F.col("event_id") % 11 == 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>"))
        .alias("errors"),
        F.get_json_object("props", "$.k").cast("int").alias("documents_found"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-usage events: kind, tokens, status and time."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id",
        F.when(F.col("event_type").isin("click", "view"), "embedding").when(F.col("event_type") == "signup", "chat")
        .otherwise("rerank").alias("kind"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.when(F.col("event_id") % 13 == 0, "error").otherwise("ok").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level passages; a chunk table that needs no Python worker."""
    return (
        spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text"))
        .where(F.col("chunk_text") != "")
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study notes: conversation turns with a scripture reference appended."""
    books = ["1 Nephi", "alma", "D&C", "DyC", "Mateo", "Juan", "Romanos", "2  nephi", "1Nephi"]
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 7 + F.col("turn")
    ref = F.concat(
        _pick(key % 9, books), F.lit(" "), (key % 40 + 1).cast("string"), F.lit(":"), (key % 25 + 1).cast("string"),
        F.when(key % 4 == 0, F.concat(F.lit("-"), (key % 25 + 3).cast("string"))).otherwise(""))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"),
        F.col("conv_id").alias("workspace_id"), F.col("turn"), F.col("role"),
        (F.col("conv_id") % 17).alias("user_id"),
        (F.col("conv_id") * 3 + F.col("turn")).alias("doc_id"),
        F.concat(F.col("text"), F.lit(" ("), ref, F.lit("; Alma 32:21)")).alias("content"),
        F.timestamp_seconds(F.lit(1706745600) + F.col("conv_id") * 86400 + F.col("turn") * 60).alias("updated_at"),
        (F.col("turn") % 3 == 1).alias("pinned"),
        F.when(F.col("conv_id") % 10 == 3, F.timestamp_seconds(F.lit(1735689600))).alias("deleted_at"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored duplicate decisions, as the labelled documents stand in for them."""
    label = table(spark, sf_dir, "labels")
    return label.select(
        F.col("doc_id").alias("duplicate_id"),
        F.when(F.col("toxic") == 1, "exact_duplicate").when(F.col("quality") == 0, "probable_duplicate").otherwise("translation")
        .alias("classification"),
        F.when(F.col("doc_id") % 4 == 0, "pending").otherwise("confirmed").alias("review_status"))
