"""Scored textual search and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folioworks import fixed_values as fv
from folioworks.config import MODES
from folioworks.functions.scripture import expand_query
from folioworks.functions.text import limit_text, search_patterns
from folioworks.functions.urls import normalize_source_type
from folioworks.operators import lexical, ranking, vectors
from folioworks.operators.catalog import active, description_of, source_url_of, without_confirmed_duplicates
from folioworks.operators.filters import (MetadataFilter, ilike_any, json_text_ilike, metadata_predicate,
                                          source_type_of)
from folioworks.session import spread, write_once

W = fv.MATCH_WEIGHTS
SNIPPET = 520


def textual_search(documents: DataFrame, sources: DataFrame, passages: DataFrame, query: str, limit: int,
                   filters: MetadataFilter | None = None) -> DataFrame:
    """Weighted field matches, the first matching passage as snippet.

    Title, author and source score on the whole query only; the other fields
    on the query or any of its terms.  ``passages`` has (doc_id, chunk_index,
    chunk_text).  The first passage per document is an aggregate, so it is
    combined before it is shuffled, and only passages that match take part.
    """
    query = query.strip()
    patterns = search_patterns(query)
    whole = patterns[:1]
    rows = active(documents)
    if filters is not None:
        rows = rows.where(metadata_predicate(rows, filters))
    if len(query) < 2:
        rows = rows.where(F.lit(False))
    rows = spread(rows)
    text = F.coalesce("text", F.lit(""))
    first = (passages.where(ilike_any(F.col("chunk_text"), patterns)).groupBy("doc_id")
             .agg(F.min(F.struct("chunk_index", "chunk_text")).alias("_passage")))
    named = sources.select("source_key", "source_name")
    flagged = rows.select(
        "doc_id", "title", "author", "source_key", "language", "canonical_url", "tags", "updated_at",
        source_url_of(rows).alias("source_url"), source_type_of(rows).alias("source_type"),
        description_of(rows).alias("_description"), F.left(text, F.lit(SNIPPET)).alias("_head"),
        ilike_any(F.col("title"), whole).alias("_title"),
        ilike_any(F.coalesce("author", F.lit("")), whole).alias("_author"),
        ilike_any(F.coalesce(description_of(rows), F.lit("")), patterns).alias("_about"),
        ilike_any(text, patterns).alias("_text"),
        json_text_ilike(F.col("tags"), patterns).alias("_tags"),
        (ilike_any(F.col("title"), patterns) | ilike_any(F.coalesce("author", F.lit("")), patterns)).alias("_any_head"))
    joined = flagged.join(named, "source_key").join(first, "doc_id", "left")
    in_passage = F.col("_passage").isNotNull()
    source_whole = ilike_any(F.col("source_name"), whole)
    points = lambda hit, field: F.when(hit, W[field]).otherwise(0)
    score = (points(F.col("_title"), "title") + points(F.col("_author"), "author") + points(source_whole, "source")
             + points(F.col("_about"), "description") + points(F.col("_text"), "text")
             + points(F.col("_tags"), "tags") + points(in_passage, "chunk"))
    matched = joined.where(F.col("_any_head") | ilike_any(F.col("source_name"), patterns) | F.col("_about")
                           | F.col("_text") | F.col("_tags") | in_passage)
    best = (matched.withColumn("match_score", score)
            .orderBy(F.desc("match_score"), F.desc("updated_at"), "doc_id").limit(limit))
    blank = F.lit("")
    snippet = F.coalesce(F.nullif(F.col("_passage.chunk_text"), blank), F.nullif("_description", blank),
                         F.nullif("_head", blank), F.col("title"))
    return best.select(
        "doc_id", "title", "author", "source_name", "language", "canonical_url", "source_url",
        F.coalesce(normalize_source_type(F.col("source_type")), "source_type").alias("source_key"),
        F.left(snippet, F.lit(SNIPPET)).alias("snippet"), F.col("_passage.chunk_index").alias("chunk_index"), "tags",
        F.least(F.col("match_score") / F.lit(float(sum(W.values()))), F.lit(1.0)).alias("score"),
        F.unix_seconds("updated_at").alias("updated_s"))


def local_answer(hits: DataFrame, most: int = 5) -> DataFrame:
    """Numbered citations of the best hits."""
    top = hits.orderBy(F.desc("score"), F.desc("updated_s"), "doc_id").limit(most)
    number = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("updated_s"), "doc_id"))
    return top.select(number.alias("citation_id"), "doc_id", "title", limit_text(F.col("snippet"), 380).alias("quote"))


def lexical_leg(passages: lexical.Index, documents: lexical.Index, library: DataFrame, queries: DataFrame, same_language: bool = False) -> DataFrame:
    """(query_id, route, doc_id, lexical_score), with a document fallback for the queries that find no passage.

    ``passages`` and ``documents`` are the two indexes, ``library`` has the
    documents' (doc_id, title, author, text, language), filtered as the search
    is; ``queries`` has (query_id, text) and language where documents have to
    share it.  A query without any passage is found by an anti-join and takes the
    documents one of whose fields holds its text, scored by cover density, which
    is zero where not all words occur.  A text without words finds nothing.
    """
    carry = ["language"] if "language" in queries.columns else []
    terms = lexical.query_terms(queries, "query_id", F.col("text"), carry)
    found = write_once(lexical.scored(passages, terms, same_language), "passage-leg")
    empty = write_once(queries.join(found.select("query_id").distinct(), "query_id", "left_anti"), "fallback-queries")
    fields = library.select("doc_id", *[F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("title", "author", "text")], F.col("language").alias("_language"))
    held = lexical.holding(documents, empty).join(empty.select("query_id", F.lower("text").alias("_asked"), *[F.col(c).alias("_spoken") for c in carry]), "query_id")
    held = held.join(fields, "doc_id").where(F.contains("_title", "_asked") | F.contains("_author", "_asked") | F.contains("_text", "_asked"))
    if same_language:
        held = held.where(F.col("_language") == F.col("_spoken"))
    scores = lexical.scored(documents, terms.join(empty.select("query_id"), "query_id", "left_semi"), same_language)
    fallback = held.select("query_id", "doc_id").join(scores, ["query_id", "doc_id"], "left")
    return found.select("query_id", F.lit("passage").alias("route"), "doc_id", "lexical_score").unionByName(
        fallback.select("query_id", F.lit("document").alias("route"), "doc_id", F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score")))


def fused_candidates(documents: DataFrame, points: DataFrame, queries: DataFrame, mode: str = "balanced",
                     decisions: DataFrame | None = None, filters: MetadataFilter | None = None,
                     index: lexical.Index | None = None) -> DataFrame:
    """Both retrieval legs of every query, merged and scored.

    ``documents`` are passages: (doc_id, parent_id, title, author, text,
    language, source_key, token_count) and what ``filters`` looks at; ``points``
    hold their vectors; ``queries`` are (query_id, text, language, embedding).
    Filtered passages (F2) and confirmed duplicates (J6) go before either leg
    ranks, so no over-fetch is needed, and a query's language is compared before
    anything is scored.
    """
    m = MODES[mode]
    if filters is not None:
        documents = documents.where(metadata_predicate(documents, filters))
    if decisions is not None:
        documents = without_confirmed_duplicates(documents, decisions)
    points = points.join(documents.select("doc_id", "language"), "doc_id")
    semantic = vectors.nearest_batch(points, queries.select("query_id", "embedding", "language"), m.leg_limit,
                                     match="language").drop("rn")
    spoken = lexical.query_terms(queries, "query_id", F.col("text"), ["language"])
    # The index is of all passages; what the filters hide goes before the leg ranks.
    scored = lexical.scored(index or lexical.build_index(documents), spoken, same_language=True)
    scored = scored.join(documents.select("doc_id"), "doc_id", "left_semi")
    leg = ranking.top_per_group(scored, ["query_id"], [F.desc("lexical_score"), F.col("doc_id")], m.leg_limit)
    # At most two legs of rows for each query, cut so that neither leg runs again below.
    both = write_once(semantic.join(leg.drop("rn"), ["query_id", "doc_id"], "full_outer"), "search-legs")
    return ranking.score_merged(both.join(documents, "doc_id"), ["query_id"]).withColumnRenamed("doc_id", "item")


def hybrid_search(documents: DataFrame, points: DataFrame, queries: DataFrame, mode: str = "balanced",
                  decisions: DataFrame | None = None, filters: MetadataFilter | None = None,
                  index: lexical.Index | None = None) -> DataFrame:
    """L3: fused candidates, diversified, cut and fitted to the context budget."""
    m = MODES[mode]
    fused = fused_candidates(documents, points, queries, mode, decisions, filters, index)
    ordered = ranking.diversify(fused, ["query_id"], "parent_id", [F.desc("final_score"), F.col("item")])
    # A few rows per query, read twice below; without the cut both legs would run twice.
    cut = write_once(ordered.where(F.col("position") <= m.final_limit), "search-best")
    return ranking.fit_skipping(cut, ["query_id"], "position", "token_count", m.context_token_budget, m.final_limit)


def rewritten(queries: DataFrame) -> DataFrame:
    """``queries`` with their text expanded by the references it names and those asked for in ``refs``."""
    refs = F.col("refs") if "refs" in queries.columns else F.lit(None).cast("array<string>")
    return queries.withColumn("text", expand_query(F.col("text"), refs)).drop("refs")


def passage_candidates(passages: DataFrame, vectors_of: DataFrame, queries: DataFrame, index: lexical.Index, mode: str = "balanced") -> DataFrame:
    """J14 on passages: both legs of every query, merged per passage and scored.

    ``passages`` are (passage_id, parent_id, language, source_key, token_count);
    ``index`` is over them under the same ids.  ``vectors_of`` has an embedding
    per ``passage_id``, or per ``parent_id`` where a passage is placed by its
    document's vector.  Then the nearest documents are searched, not one copy of
    a vector per passage: every document found has a passage, so the best
    passages are those of as many documents at most.
    """
    m = MODES[mode]
    own = "passage_id" in vectors_of.columns
    key = "passage_id" if own else "parent_id"
    placed = passages.select(key, "language").distinct().join(vectors_of.select(key, "embedding"), key)
    near = vectors.nearest_batch(placed.withColumnRenamed(key, "doc_id"), queries.select("query_id", "embedding", "language"), m.leg_limit,
                                 match="language").select("query_id", F.col("doc_id").alias(key), "semantic_score")
    if not own:
        spread_out = near.join(passages.select("parent_id", "passage_id"), "parent_id")
        near = ranking.top_per_group(spread_out, ["query_id"], [F.desc("semantic_score"), F.col("passage_id")], m.leg_limit)
    spoken = lexical.query_terms(queries, "query_id", F.col("text"), ["language"])
    scored = lexical.scored(index, spoken, same_language=True).withColumnRenamed("doc_id", "passage_id")
    scored = scored.join(passages.select("passage_id"), "passage_id", "left_semi")
    leg = ranking.top_per_group(scored, ["query_id"], [F.desc("lexical_score"), F.col("passage_id")], m.leg_limit)
    both = write_once(near.select("query_id", "passage_id", "semantic_score").join(leg.drop("rn"), ["query_id", "passage_id"], "full_outer"), "passage-legs")
    return ranking.score_merged(both.join(passages, "passage_id"), ["query_id"])


def passage_search(passages: DataFrame, vectors_of: DataFrame, queries: DataFrame, index: lexical.Index, mode: str = "balanced",
                   relevance: DataFrame | None = None) -> DataFrame:
    """L3/L5 on passages: rewritten queries, both legs, three passages of a document first, blend, context budget.

    ``queries`` are (query_id, text, language, embedding) and, where given,
    refs; columns of ``passages`` and ``vectors_of`` as for
    ``passage_candidates``.  ``relevance`` has ``rerank`` scores under any keys of
    the candidates (query_id, passage_id, parent_id).  Outside mode "low" it
    re-orders the candidates in front that fit the candidate budget; what is
    behind them is dropped, as nothing scored it.
    """
    m = MODES[mode]
    queries = rewritten(queries)
    order = [F.desc("final_score"), F.col("passage_id")]
    ordered = ranking.diversify(passage_candidates(passages, vectors_of, queries, index, mode), ["query_id"], "parent_id", order)
    if relevance is not None and mode != "low":
        # At most two legs of rows for each query, so a plain running sum is bounded.
        front = Window.partitionBy("query_id").orderBy("position")
        shown = ordered.withColumn("_used", F.sum("token_count").over(front)).where(F.col("_used") <= m.candidate_token_budget)
        judged = shown.join(relevance, [c for c in relevance.columns if c != "rerank"], "left")
        blended = judged.withColumn("final_score", ranking.rerank_blend(F.col("rerank"), F.col("final_score")))
        again = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "position")
        ordered = blended.withColumn("position", F.row_number().over(again)).drop("_used", "rerank")
    cut = write_once(ordered.where(F.col("position") <= m.final_limit), "passage-best")
    fitted = ranking.fit_skipping(cut, ["query_id"], "position", "token_count", m.context_token_budget, m.final_limit)
    return fitted.join(queries.select("query_id", F.col("text").alias("rewritten")), "query_id")


def documents_of(hits: DataFrame) -> DataFrame:
    """Found passages rolled up: of every document its best passage, how many were found, and its place."""
    best = hits.groupBy("query_id", "parent_id").agg(
        F.min("position").alias("first_position"), F.min_by("passage_id", "position").alias("best_passage"),
        F.max("final_score").alias("score"), F.count("*").alias("passages"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first_position")))


def context_block(hits: DataFrame, most: int) -> DataFrame:
    """The prompt context of each query; at most ``most`` hits of at most 2400 characters are joined."""
    named = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("Unknown")))
    block = F.concat_ws("\n", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("]")),
                        F.concat(F.lit("Title: "), "title"), named("Source", F.col("source_key")),
                        F.concat(F.lit("Language: "), F.coalesce("language", F.lit("unknown"))),
                        F.lit("Text:"), F.left("text", F.lit(2400)))
    listed = hits.where(F.col("position") <= most).select("query_id", "position", block.alias("block"))
    return listed.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "block"))), lambda s: s["block"]), "\n\n---\n\n").alias("context"))
