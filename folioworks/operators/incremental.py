"""Upserts and other stateful steps, as pure functions from old and new rows to the next table.

Plain files have no MERGE, so each step returns the whole next state; the sinks
in ``sources.tables`` write it for the parts of the table that a batch touches.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioworks.operators.maintenance import merge_maps
from folioworks.operators.ranking import top_per_group


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the greatest ``order`` wins; combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(row, order).alias("_r")).select("_r.*")


def document_actions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Created, updated or unchanged, judged by the content hash of the same URL."""
    known = stored.select("canonical_url", F.col("content_hash").alias("_old"), F.col("version").alias("_version"))
    seen = F.col("_version").isNotNull()
    same = F.col("_old").eqNullSafe(F.col("content_hash"))
    return (incoming.join(known, "canonical_url", "left")
            .withColumn("action", F.when(~seen, "created").when(same, "unchanged").otherwise("updated"))
            .withColumn("version", F.when(~seen, F.lit(1)).when(same, F.col("_version")).otherwise(F.col("_version") + 1))
            .drop("_old", "_version"))


def upsert_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next document table; a changed text goes back to indexing."""
    new = incoming.select(*[F.col(c).alias(f"_n_{c}") for c in incoming.columns]).withColumn("_there", F.lit(True))
    both = stored.withColumn("_here", F.lit(True)).join(
        new, F.col("canonical_url") == F.col("_n_canonical_url"), "full_outer")
    here, there = F.coalesce("_here", F.lit(False)), F.coalesce("_there", F.lit(False))
    changed = there & ~(here & F.col("content_hash").eqNullSafe(F.col("_n_content_hash")))
    kept = {"version", "is_indexed", "raw_metadata", "canonical_url"}
    columns = []
    for name in stored.columns:
        if name in kept:
            continue
        fresh = F.col(f"_n_{name}") if name in incoming.columns else F.lit(None)
        columns.append(F.when(changed, fresh).otherwise(F.col(name)).alias(name))
    metadata = (F.when(changed, F.col("_n_raw_metadata"))
                .when(there, merge_maps(F.col("raw_metadata"), F.col("_n_raw_metadata")))
                .otherwise(F.col("raw_metadata")))
    version = F.when(~here, F.lit(1)).when(changed, F.col("version") + 1).otherwise(F.col("version"))
    return both.select(
        F.coalesce("canonical_url", "_n_canonical_url").alias("canonical_url"), *columns, metadata.alias("raw_metadata"),
        version.alias("version"), F.when(changed, False).otherwise(F.col("is_indexed")).alias("is_indexed"))


def prioritized(candidates: DataFrame, key: str, exact: Column, tie: str) -> DataFrame:
    """Of several stored rows that could answer a lookup, the exact one, else the first."""
    row = F.struct(*[F.col(c) for c in candidates.columns])
    return (candidates.groupBy(key).agg(F.min_by(row, F.struct(F.when(exact, 0).otherwise(1), F.col(tie))).alias("_r"))
            .select("_r.*"))


# States from which a known URL is queued again.
REQUEUED = ["failed", "discovered", "queued"]


def upsert_urls(stored: DataFrame, found: DataFrame) -> DataFrame:
    """New URLs enter, known ones are queued again only from a restartable state."""
    keys = ["source_key", "normalized_url"]
    new = found.select(*keys, F.col("url").alias("_url"), F.col("depth").alias("_depth"), F.col("status").alias("_status"))
    both = stored.join(new, keys, "full_outer")
    restart = F.col("_status").isNotNull() & (F.col("status").isNull() | F.col("status").isin(*REQUEUED))
    return both.select(
        *keys, F.coalesce("url", "_url").alias("url"), F.when(restart, F.col("_depth")).otherwise(F.col("depth")).alias("depth"),
        F.when(restart, F.col("_status")).otherwise(F.col("status")).alias("status"), restart.alias("requeued"))


def insert_absent(stored: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """First writer wins; also inside one batch, where ``order`` decides who was first."""
    if order is not None:
        row = F.struct(*[F.col(c) for c in rows.columns])
        rows = rows.groupBy(*keys).agg(F.min_by(row, order).alias("_r")).select("_r.*")
    fresh = rows.join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def upsert_sources(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """Names and URLs are replaced, optional settings only when the seed has them, configs merged."""
    optional = [c for c in ("source_type", "language", "crawl_strategy", "rate_limit", "max_pages", "notes")
                if c in seeds.columns]
    plain = [c for c in ("source_name", "base_url") if c in seeds.columns]
    new = seeds.select("source_key", *[F.col(c).alias(f"_n_{c}") for c in (*optional, *plain)],
                       F.col("config").alias("_n_config"))
    both = stored.join(new, "source_key", "full_outer")
    # Every seed value that is set replaces the stored one; the key names a source without a type.
    pick = lambda c: F.coalesce(f"_n_{c}", *([c] if c in stored.columns else []),
                                *(["source_key"] if c == "source_type" else []))
    empty = F.create_map().cast("map<string,string>")
    return both.select(
        "source_key", *[pick(c).alias(c) for c in (*plain, *optional)],
        merge_maps(F.coalesce("config", empty), F.coalesce("_n_config", empty)).alias("config"))


def upsert_excluded(stored: DataFrame, rows: DataFrame, key: str, replace: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """On conflict ``replace`` columns take the new value, ``fill`` columns only a non-null one."""
    new = rows.select(key, *[F.col(c).alias(f"_n_{c}") for c in (*replace, *fill)]).withColumn("_there", F.lit(True))
    both = stored.join(new, key, "full_outer")
    take = [F.when(F.col("_there"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in replace]
    keep = [F.coalesce(f"_n_{c}", c).alias(c) for c in fill]
    rest = [F.col(c) for c in stored.columns if c not in (key, *replace, *fill)]
    return both.select(key, *take, *keep, *rest)


def find_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The oldest stored document sharing any URL field or the content hash.

    An OR over four columns would force every pair to be tested; instead both
    sides are unfolded into (kind, value) rows and joined on equality.
    """
    value = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    meta = F.col("raw_metadata")
    held = (stored.select("doc_id", "created_at", F.inline(F.array(
        value("url", F.col("canonical_url")), value("url", meta["source_url"]), value("url", meta["normalized_url"]),
        value("hash", F.col("content_hash"))))).where(F.col("value").isNotNull()))
    # Only the oldest holder of a value can win, so a value shared by many documents stays one row.
    oldest = held.groupBy("kind", "value").agg(F.min(F.struct("created_at", "doc_id")).alias("o"))
    asked = incoming.select("item_id", F.inline(F.array(
        value("url", F.col("canonical_url")), value("url", F.col("source_url")), value("hash", F.col("content_hash"))
    ))).where(F.col("value").isNotNull()).distinct()
    return (asked.join(oldest, ["kind", "value"]).groupBy("item_id").agg(F.min("o").alias("o"))
            .select("item_id", F.col("o.doc_id").alias("existing_id")))


def ingest_first_wins(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """I8: verified_existing, created, or a repeat of an earlier item of the same batch."""
    known = find_existing(incoming, stored)
    fresh = incoming.join(known.select("item_id"), "item_id", "left_anti")
    rows = fresh.select(
        F.col("item_id").alias("doc_id"), F.col("item_id").alias("created_at"), "canonical_url", "content_hash",
        F.create_map(F.lit("source_url"), F.col("source_url")).alias("raw_metadata"))
    first = find_existing(fresh, rows)
    outcome = first.select("item_id", F.when(F.col("existing_id") == F.col("item_id"), "created")
                           .otherwise("verified_existing").alias("status"), "existing_id")
    return known.select("item_id", F.lit("verified_existing").alias("status"), "existing_id").unionByName(outcome)


def outdated_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose stored passages were cut from another text."""
    stale = chunks.where(F.col("document_content_hash").isNotNull()).select("doc_id", "document_content_hash").distinct()
    return (documents.select("doc_id", "content_hash").join(stale, "doc_id")
            .where(F.col("content_hash") != F.col("document_content_hash")).select("doc_id").distinct())


def index_work(documents: DataFrame, chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Per document: rebuild, embed what is missing, nothing, or cut for the first time."""
    stale = outdated_documents(documents, chunks).withColumn("_stale", F.lit(True))
    done = records.select("chunk_id", "text_hash").distinct().withColumn("_done", F.lit(True))
    state = (chunks.join(done, ["chunk_id", "text_hash"], "left").groupBy("doc_id")
             .agg(F.count("*").alias("chunks"), F.count_if(F.col("_done").isNull()).alias("missing")))
    work = (F.when(F.col("_stale"), "rebuild").when(F.col("chunks").isNull(), "create")
            .when(F.col("missing") > 0, "embed_missing").otherwise("none"))
    return (documents.select("doc_id").join(stale, "doc_id", "left").join(state, "doc_id", "left")
            .select("doc_id", work.alias("work"), F.coalesce("missing", F.lit(0)).alias("missing")))


def update_non_null(stored: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Only given fields change, and the row's revision counts up."""
    new = patch.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns]).withColumn("_hit", F.lit(True))
    both = stored.join(new, key, "left")
    rest = [F.col(c) for c in stored.columns if c not in (key, "server_rev", *columns)]
    return both.select(
        key, *[F.coalesce(f"_n_{c}", c).alias(c) for c in columns], *rest,
        (F.col("server_rev") + F.when(F.col("_hit"), 1).otherwise(0)).alias("server_rev"))


def sync_page(events: DataFrame, since: Column, limit: int = 1000) -> DataFrame:
    """The next page of changes after a cursor."""
    return events.where(F.col("created_at") > since).orderBy("created_at", "server_rev").limit(limit)


def job_runs(log: DataFrame) -> DataFrame:
    """A job's current row from its lifecycle events; a retry starts it over.

    ``log`` has (job_id, at, event, found, error).  All parts are commutative
    aggregates: the last retry bounds what counts.
    """
    latest_retry = log.where("event = 'retry'").groupBy("job_id").agg(F.max("at").alias("since"))
    live = log.join(latest_retry, "job_id", "left").where(F.col("since").isNull() | (F.col("at") >= F.col("since")))
    started, finished = F.col("event") == "start", F.col("event").isin("done", "failed")
    return live.groupBy("job_id").agg(
        F.max_by("event", "at").alias("last_event"), F.min(F.when(started, F.col("at"))).alias("started_at"),
        F.max(F.when(finished, F.col("at"))).alias("finished_at"), F.count_if(started).alias("attempts"),
        F.max_by("error", F.when(F.col("event") == "failed", F.col("at"))).alias("error"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"))


def rate_limited(requests: DataFrame, width: str, limit: int, keys: Sequence[str]) -> DataFrame:
    """Hits per fixed window, and how many were over the limit."""
    counted = requests.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.count("*").alias("hits"))
    return counted.select(*keys, F.col("w.start").alias("window_start"), "hits",
                          F.greatest(F.col("hits") - limit, F.lit(0)).alias("rejected"))


def accepted(requests: DataFrame, width: str, limit: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The requests that pass, i.e. the first ``limit`` of each window; a per-partition group limit."""
    tagged = requests.withColumn("window_start", F.window("ts", width)["start"])
    return top_per_group(tagged, [*keys, "window_start"], order, limit).drop("rn")


def cache_hits(lookups: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """Which lookups of a time-to-live cache miss.

    A miss stores the value for ``ttl_seconds``; hits do not extend it.  Lookups
    of one key in one second share their fate, so they are counted first; a key
    then has at most one row per second, and the sequential walk over a key
    streams through its sorted partition without ever holding the key.
    """
    per_second = (lookups.groupBy(key, F.floor(F.unix_seconds("ts")).alias("second"))
                  .agg(F.count("*").alias("lookups")))
    ordered = per_second.repartition(key).sortWithinPartitions(key, "second")

    def walk(batches):
        current, expires = None, None
        for batch in batches:
            missed = []
            for name, second in zip(batch[key], batch["second"]):
                if name != current:
                    current, expires = name, None
                miss = expires is None or second >= expires
                if miss:
                    expires = second + ttl_seconds
                missed.append(miss)
            yield pd.DataFrame({key: batch[key], "second": batch["second"], "lookups": batch["lookups"], "miss": missed})

    kind = lookups.schema[key].dataType.simpleString()
    return ordered.mapInPandas(walk, f"{key} {kind}, second long, lookups long, miss boolean")



def update_by_id_or_key(stored: DataFrame, patch: DataFrame, id_col: str, key_col: str, columns: Sequence[str]) -> DataFrame:
    """``patch`` rows name their target by its id or by its key; columns that are not null are taken.

    An OR in a join would test every pair, so ids and keys are joined one after
    the other; a target named both ways takes the id's values first.  Targets
    are unique within ``patch``.
    """
    def named(prefix: str, on: str) -> DataFrame:
        return patch.select(F.col("target").alias(f"{prefix}{on}"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])

    by_id, by_key = named("_i_", id_col), named("_k_", key_col)
    both = (stored.join(by_id, F.col(id_col).cast("string") == F.col(f"_i_{id_col}"), "left")
            .join(by_key, F.col(key_col) == F.col(f"_k_{key_col}"), "left"))
    changed = [F.coalesce(f"_i_{c}", f"_k_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns]
    return both.select(*changed)
