"""Exact vector search over tiles and over the stored table of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.operators import vectors

SCHEMA = "doc_id long, embedding array<double>, kind string"


def clustered(n, seed, hot=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(20, 16))
    rows = centres[rng.integers(0, 20, n)] + 0.05 * rng.normal(size=(n, 16))
    rows[:hot] = rows[0]  # one vector in many rows
    return rows


def brute(points, asked, k, kinds=None):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores, out = unit(asked) @ unit(points).T, {}
    for q, row in enumerate(scores):
        near = [i for i in np.lexsort((np.arange(len(row)), -np.round(row, 12))) if kinds is None or kinds[i]][:k]
        out[q] = [(int(i), round(float(row[i]), 9)) for i in near]
    return out


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, -round(r.semantic_score, 12), r.doc_id)):
        out.setdefault(r.query_id, []).append((r.doc_id, round(r.semantic_score, 9)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    points, asked = clustered(1500, 2, hot=500), clustered(40, 3)
    frame = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(points)]
                                  + [(9001, None, "a"), (9002, [0.0] * 16, "a"), (9003, [float("nan")] * 16, "a")], SCHEMA)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(77, None), (78, [0.0] * 16)], "query_id long, embedding array<double>")
    return points, asked, frame, queries


def test_tiles_equal_brute_force_and_points_are_shuffled_once(spark, data, monkeypatch):
    points, asked, frame, queries = data
    monkeypatch.setattr(vectors, "TILE_POINTS", 100)
    hits = vectors.nearest_batch(frame, queries, 7)
    scores = {q: [s for _, s in rows] for q, rows in found(hits).items()}
    assert scores == {q: [s for _, s in rows] for q, rows in brute(points, asked, 7).items()}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # the queries; no side of points is multiplied


def test_cells_equal_brute_force_and_prune(spark, data, tmp_path, monkeypatch):
    points, asked, frame, queries = data
    monkeypatch.setattr(vectors, "TILE_POINTS", 100)  # the hot vector's cell becomes several tiles
    table = vectors.store_vectors(frame, str(tmp_path), 20)
    assert table.rows.sum() == len(points) and table.points().count() == len(points)
    assert found(table.search(queries, 7)) == brute(points, asked, 7)
    assert found(table.search(queries, 5, F.col("kind") == "b")) == brute(points, asked, 5, [i % 2 == 1 for i in range(len(points))])
    one = queries.where("query_id = 3")
    bare = one.select(F.col("query_id").alias("id"), F.col("embedding").alias("vector"), F.lit(0.9).alias("least"))
    visited = {r.cell for r in table._visits(bare.drop("least"), None).collect()} | {r.cell for r in table._visits(bare, "least").collect()}
    assert table.rows[sorted(visited)].sum() <= len(points) * 0.5
    assert all(f"cell={c}/" not in f for f in table.points(sorted(visited)).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]
               for c in range(len(table.rows)) if c not in visited)
    assert found(vectors.open_vectors(spark, str(tmp_path)).search(one, 7)) == {3: brute(points, asked, 7)[3]}


def test_random_vectors_and_small_tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    points, asked = rng.normal(size=(300, 12)), rng.normal(size=(15, 12))
    frame = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(points)], SCHEMA)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    assert found(vectors.store_vectors(frame, str(tmp_path / "a")).search(queries, 400)) == brute(points, asked, 400)  # more than there are
    assert found(vectors.store_vectors(frame.limit(0), str(tmp_path / "b")).search(queries, 3)) == {}
