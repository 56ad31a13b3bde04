"""Top-k, budgets, diversification and score fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks import fixed_values as fv
from folioworks.operators.skew import running_total


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of every group.

    Spark turns the rank filter into a per-partition group limit, so at most
    ``k`` rows of a group leave any map task, however large the group is.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def fit_skipping(candidates: DataFrame, keys: Sequence[str], rank: str, tokens: str, budget: int,
                 most: int | None = None) -> DataFrame:
    """Walk the ranked items, skip those that no longer fit, keep going.

    Not a prefix sum: a later, smaller item may still fit.  Only the best
    ``most`` items of a group are walked, if it is given; without it a group has
    to be as bounded as one conversation or one query's candidates are.
    """
    top = candidates if most is None else candidates.where(F.col(rank) <= most)
    walk = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(rank, tokens))).alias("_items"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    fits = lambda acc, x: acc["used"] + x[tokens] <= budget
    folded = F.aggregate("_items", start, lambda acc, x: F.struct(
        F.when(fits(acc, x), acc["used"] + x[tokens]).otherwise(acc["used"]).alias("used"),
        F.when(fits(acc, x), F.concat(acc["kept"], F.array(x[rank].cast("bigint")))).otherwise(acc["kept"]).alias("kept")))
    kept = walk.select(*keys, F.explode(folded["kept"]).alias(rank))
    return top.join(kept, [*keys, rank], "left_semi")


def fit_prefix(candidates: DataFrame, keys: Sequence[str], rank: str, tokens: str, budget: int,
               bucket_rows: int = 65_536) -> DataFrame:
    """Keep the longest ranked prefix whose tokens stay within the budget."""
    summed = running_total(candidates, keys, [F.col(rank)], F.floor(F.col(rank) / bucket_rows), F.col(tokens),
                           "_used")
    return summed.where(F.col("_used") <= budget).drop("_used")


def diversify(candidates: DataFrame, query: Sequence[str], group: str, order: Sequence[Column],
              per_group: int = 3) -> DataFrame:
    """At most three passages of a document first, its others behind, order kept.

    Meant for one query's candidate list, which the leg limits bound.
    """
    inside = F.row_number().over(Window.partitionBy(*query, group).orderBy(*order))
    marked = candidates.withColumn("_overflow", inside > per_group)
    final = F.row_number().over(Window.partitionBy(*query).orderBy("_overflow", *order))
    return marked.withColumn("position", final).drop("_overflow")


def min_max(score: Column, window) -> Column:
    """Scale to 0..1 over the window; equal scores become 1 where positive."""
    value = F.coalesce(score, F.lit(0.0))
    low, high = F.min(value).over(window), F.max(value).over(window)
    flat = F.abs(low - high) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    return F.when(flat, F.when(value > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def score_merged(merged: DataFrame, query: Sequence[str]) -> DataFrame:
    """Scale each leg over the merged candidates of a query and add the boosts."""
    window = Window.partitionBy(*query)
    trusted = F.when(F.col("source_key").isin(*fv.TRUSTED_SOURCE_KEYS), 0.08).otherwise(0.0)
    spoken = F.when(F.coalesce("language", F.lit("")) != "", 0.03).otherwise(0.0)
    return merged.withColumn(
        "final_score",
        F.lit(0.52) * min_max(F.col("semantic_score"), window) + F.lit(0.36) * min_max(F.col("lexical_score"), window)
        + trusted + spoken)


def fuse(semantic: DataFrame, lexical: DataFrame, query: Sequence[str], item: str) -> DataFrame:
    """Merge two legs on the passage; a passage missing from a leg scores 0 there."""
    return score_merged(semantic.join(lexical, [*query, item], "full_outer"), query)


def rerank_blend(rerank: Column, final: Column) -> Column:
    """External relevance weighs 0.7, the fused score 0.3; unscored items count as 0."""
    return F.lit(0.7) * F.coalesce(rerank, F.lit(0.0)) + F.lit(0.3) * final
