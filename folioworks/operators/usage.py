"""Token usage, budgets and indexing cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioworks import config
from folioworks.operators.skew import join_group_facts, overall_total
from folioworks.session import cut_lineage


def embedding_cost(tokens: Column) -> Column:
    """Price per thousand tokens, rounded half to even at six digits.

    Exact ties of the decimal value may land one unit apart from a rounding of
    the binary value; that is 1e-6 of a dollar on about 0.2 % of token counts.
    """
    return F.rint(tokens / 1000 * F.lit(config.PRICE_PER_1K_TOKENS) * 1e6) / 1e6


def month_start(now: Column) -> Column:
    """R37."""
    return F.date_trunc("month", now)


def day_start(now: Column) -> Column:
    return F.date_trunc("day", now)


def usage_by_kind(events: DataFrame, now: Column) -> DataFrame:
    """This month's tokens, events and cost per kind."""
    cost = F.when(F.col("kind") == "embedding", embedding_cost(F.col("input_tokens"))).otherwise(F.lit(0.0))
    return (events.where(F.col("created_at") >= month_start(now)).groupBy("kind")
            .agg(F.sum("input_tokens").alias("tokens"), F.count("*").alias("events"),
                 F.sum(cost).alias("cost")))


def budget_state(events: DataFrame, now: Column, limit: int = config.DAILY_TOKEN_LIMIT) -> DataFrame:
    """Tokens embedded today and what is left of the daily limit."""
    counted = (F.col("kind") == "embedding") & (F.col("status") == "ok")
    today = counted & (F.col("created_at") >= day_start(now))
    month = counted & (F.col("created_at") >= month_start(now))
    sums = events.agg(
        F.coalesce(F.sum(F.when(today, F.col("input_tokens"))), F.lit(0)).alias("used_today"),
        F.coalesce(F.sum(F.when(month, F.col("input_tokens"))), F.lit(0)).alias("used_month"))
    return sums.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used_today"), F.lit(0)))


def indexing_estimate(chunks: DataFrame, records: DataFrame, cache: DataFrame) -> DataFrame:
    """What an indexing run would embed, skip and take from the cache.

    ``records`` holds (chunk_id, text_hash) already embedded, ``cache`` holds
    text hashes with a stored vector; both are made unique before the joins so
    neither can fan out.
    """
    done = records.select("chunk_id", "text_hash").distinct().withColumn("_done", F.lit(True))
    # Passages that share a hash may be many; each hash is looked up once and joined back as a group.
    hashes = chunks.groupBy("text_hash").agg(F.count("*").alias("_size"))
    stored = hashes.join(cache.select("text_hash").distinct().withColumn("_stored", F.lit(True)), "text_hash", "left")
    judged = join_group_facts(chunks.where("text_hash IS NOT NULL"), stored, ["text_hash"], "_size").unionByName(
        chunks.where("text_hash IS NULL"), allowMissingColumns=True).join(done, ["chunk_id", "text_hash"], "left")
    skipped = F.coalesce("_done", F.lit(False))
    cached = ~skipped & F.coalesce("_stored", F.lit(False))
    fresh = ~skipped & ~F.coalesce("_stored", F.lit(False))
    tokens = F.coalesce(F.sum(F.when(fresh, F.col("token_count"))), F.lit(0))
    return judged.agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"),
        F.count_if(skipped).alias("skipped"), F.count_if(cached).alias("cached"),
        F.count_if(fresh).alias("to_embed"), tokens.alias("tokens"), embedding_cost(tokens).alias("cost"))


def embedding_plan(chunks: DataFrame, daily_limit: int, batch_size: int = config.EMBEDDING_BATCH,
                   cache: DataFrame | None = None, used_today: Column | int = 0, bucket_rows: int = 65_536) -> DataFrame:
    """Batches of ``batch_size`` per document and whether the day's budget still admits each.

    With a ``cache`` only passages without a stored vector cost tokens: those
    whose hash is neither there nor in an earlier batch, whose vectors the cache
    holds by then.  Without one every passage is paid for.  A batch runs while
    the tokens ``used_today`` and the running total up to it stay within the
    limit; the first one that does not pauses the rest.
    """
    own = F.concat_ws("-", F.lit("none"), "doc_id", "chunk_index")  # a passage without a hash shares it with nothing
    judged = chunks.select("doc_id", F.floor(F.col("chunk_index") / batch_size).alias("batch"),
                           F.coalesce("text_hash", own).alias("text_hash"), "token_count")
    fresh = F.lit(True)
    if cache is not None:
        placed = cut_lineage(judged)
        known = cache.select("text_hash").distinct().withColumn("_stored", F.lit(True))
        # One row for every hash, however many passages share it.
        first = (placed.groupBy("text_hash").agg(F.min(F.struct("doc_id", "batch")).alias("_first"), F.count("*").alias("_size"))
                 .join(known, "text_hash", "left"))
        judged = join_group_facts(placed, first, ["text_hash"], "_size")
        fresh = F.col("_stored").isNull() & (F.col("_first") == F.struct("doc_id", "batch"))
    batches = judged.groupBy("doc_id", "batch").agg(
        F.count("*").alias("chunks"), F.count_if(~fresh).alias("cached"),
        F.coalesce(F.sum(F.when(fresh, F.col("token_count"))), F.lit(0)).cast("bigint").alias("tokens"))
    ordered = overall_total(batches, ["doc_id", "batch"], F.col("tokens"), "total_tokens", bucket_rows)
    used = used_today if isinstance(used_today, Column) else F.lit(used_today)
    return ordered.withColumn("admitted", used + F.col("total_tokens") <= daily_limit)
