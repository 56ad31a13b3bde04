"""Passage-level hybrid search over packed passages, held against a plain model."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioworks.config import MODES
from folioworks.operators import chunking, lexical, search

WORDS = ["grace", "mercy", "temple", "river", "stone", "light", "garden", "bread", "winter", "song"]


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(4)
    body = lambda n: "\n\n".join(" ".join(rng.choices(WORDS, k=rng.randint(20, 300))) + "." for _ in range(n))
    texts = [(i, body(rng.randint(1, 14)), "en" if i % 4 else "es") for i in range(24)]
    chunks = chunking.smart_chunks(spark.createDataFrame(texts, "doc_id long, text string, language string")).select("doc_id", "chunk_index", "token_count", "text")
    rows = [(r.doc_id * 1000 + r.chunk_index, r.doc_id, "en" if r.doc_id % 4 else "es", "churchofjesuschrist" if r.doc_id % 3 == 0 else "other", r.token_count, r.text)
            for r in chunks.collect()]
    passages = spark.createDataFrame(rows, "passage_id long, parent_id long, language string, source_key string, token_count long, text string").cache()
    index = lexical.build_index(passages.select(F.col("passage_id").alias("doc_id"), "language", F.lit("").alias("title"), F.lit("").alias("author"), "text"))
    turn = lambda i: [math.cos(i * 0.37), math.sin(i * 0.37)]
    asked = [(i, " ".join(rng.sample(WORDS, 3)) + (" see Alma 32:21" if i == 3 else ""), "es" if i == 2 else "en", turn(i + 0.3)) for i in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, text string, language string, embedding array<double>").cache()
    return rows, passages.drop("text"), index, queries, asked, turn


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def scaled(values):
    low, high = min(values), max(values)
    return [float(v > 0) if high - low <= 1e-9 * max(abs(low), abs(high)) else (v - low) / (high - low) for v in values]


def model(rows, vector_of, asked, ranks, mode, relevance):
    m, out = MODES[mode], {}
    for q, _, spoken, vector in asked:
        mine = {p: (d, source, tokens) for p, d, language, source, tokens, _ in rows if language == spoken}
        near = sorted(((cosine(vector, vector_of(p, mine[p][0])), p) for p in mine), key=lambda x: (-x[0], x[1]))[:m.leg_limit]
        leg = sorted(((s, p) for (i, p), s in ranks.items() if i == q and p in mine), key=lambda x: (-x[0], x[1]))[:m.leg_limit]
        sem, lex = {p: s for s, p in near}, {p: s for s, p in leg}
        items = sorted(set(sem) | set(lex))
        final = {p: 0.52 * a + 0.36 * b + 0.08 * (mine[p][1] == "churchofjesuschrist") + 0.03
                 for p, a, b in zip(items, scaled([sem.get(p, 0) for p in items]), scaled([lex.get(p, 0) for p in items]))}
        order, seen, behind = [], {}, []
        for p in sorted(items, key=lambda p: (-final[p], p)):
            seen[mine[p][0]] = seen.get(mine[p][0], 0) + 1
            (order if seen[mine[p][0]] <= 3 else behind).append(p)
        order += behind
        if relevance and mode != "low":
            used, front = 0, []
            for p in order:
                used += mine[p][2]
                if used > m.candidate_token_budget:
                    break
                front.append(p)
            final = {p: 0.7 * relevance.get(mine[p][0], 0) + 0.3 * final[p] for p in front}
            order = sorted(front, key=lambda p: -final[p])
        used = 0
        for place, p in enumerate(order[:m.final_limit], 1):
            if used + mine[p][2] <= m.context_token_budget:
                used += mine[p][2]
                out[q, place] = (p, round(final[p], 9))
    return out


@pytest.mark.parametrize("mode,own,judged", [("low", False, True), ("balanced", False, True), ("low", True, False)])
def test_packed_passages_equal_the_model(spark, library, mode, own, judged):
    rows, passages, index, queries, asked, turn = library
    grown = search.rewritten(queries)
    assert {r.text.endswith("Alma 32:21 scripture reference doctrinal citation") for r in grown.where("query_id = 3").collect()} == {True}
    ranks = {(r.query_id, r.doc_id): r.lexical_score for r in
             lexical.scored(index, lexical.query_terms(grown, "query_id", F.col("text"), ["language"]), same_language=True).collect()}
    assert ranks
    relevance = {d: (d * 7 % 10) / 10 for d in range(0, 24, 2)} if judged else None
    vector_of = (lambda p, d: turn(p * 0.11)) if own else (lambda p, d: turn(d))
    key = "passage_id" if own else "parent_id"
    held = sorted({(p if own else d, tuple(vector_of(p, d))) for p, d, *_ in rows})
    points = spark.createDataFrame([(k, list(v)) for k, v in held], f"{key} long, embedding array<double>")
    scores = spark.createDataFrame(list(relevance.items()), "parent_id long, rerank double") if judged else None
    hits = search.passage_search(passages, points, queries, index, mode, scores).cache()
    got = {(r.query_id, r.position): (r.passage_id, round(r.final_score, 9)) for r in hits.collect()}
    assert got == model(rows, vector_of, asked, ranks, mode, relevance)
    up = {(r.query_id, r.parent_id): (r.best_passage, r.passages) for r in search.documents_of(hits).collect()}
    for (q, d), (best, n) in up.items():
        of = sorted((place, p) for (i, place), (p, _) in got.items() if i == q and p // 1000 == d)
        assert (best, n) == (of[0][1], len(of))
    assert sum(n for _, n in up.values()) == len(got)
