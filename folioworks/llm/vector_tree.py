"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``sample_rows``); every row is then
indexed in a leaf.  A query walks the tree with a priority queue of nodes by
their centre's nearness, and visits the leaves in the order in which they come
out.  How many it visits is calibrated: a bounded set of queries
(``calibration_queries``) is answered exactly, and visits are widened until the
share of true neighbours in the visited leaves reaches ``recall``.

Nearness is the inner product in double precision on the vectors as they are.

Defined cases: null and zero vectors, those with null or non-finite components,
those of another length than most and rows without an id take no part; repeated
rows are one candidate; ties go to the smaller id; with fewer candidates than
``k`` all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.common import vector_size
from folioworks.llm.vector_dups import distinct_vectors
from folioworks.session import write_once

K = 20
SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_SAMPLES = 64
ROUNDS = 8
CALIBRATION_QUERIES = 200
RECALL = 0.97
WIDEN = 1.25
TILE_ROWS = 2048
QUERY_ROWS = 512
CLOSE = 1e-9


@dataclass
class Tree:
    """Nodes in one list; node 0 is the root.  leaf is -1 for inner nodes."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1


def fit(sample: np.ndarray, branches: int = BRANCHES, leaf_samples: int = LEAF_SAMPLES, seed: int = 11) -> Tree:
    """Lloyd's rounds in each node, down to leaves of ``leaf_samples`` rows of the sample."""
    rng = np.random.default_rng(seed)
    tree = Tree(sample.mean(axis=0, keepdims=True), [[]], [-1])
    centres, todo, leaves = [tree.centres[0]], [(0, np.arange(len(sample)))], 0
    while todo:
        node, rows = todo.pop()
        parts = _split(sample[rows], branches, rng) if len(rows) > leaf_samples else None
        if parts is None:
            tree.leaf[node], leaves = leaves, leaves + 1
            continue
        for label in np.unique(parts):
            mine = rows[parts == label]
            tree.children[node].append(len(centres))
            centres.append(sample[mine].mean(axis=0))
            tree.children.append([])
            tree.leaf.append(-1)
            todo.append((len(centres) - 1, mine))
    tree.centres = np.array(centres)
    return tree


def _split(rows: np.ndarray, branches: int, rng: np.random.Generator) -> np.ndarray | None:
    centres = rows[rng.choice(len(rows), branches, replace=False)]
    labels = None
    for _ in range(ROUNDS):
        labels = _nearest(rows, centres)
        centres = np.array([rows[labels == j].mean(axis=0) if (labels == j).any() else centres[j] for j in range(branches)])
    labels = _nearest(rows, centres)
    return labels if len(np.unique(labels)) > 1 else None


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def assign(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row: down the tree to the nearest child centre."""
    leaf, todo = np.empty(len(rows), np.int64), [(0, np.arange(len(rows)))]
    while todo:
        node, mine = todo.pop()
        if tree.leaf[node] >= 0:
            leaf[mine] = tree.leaf[node]
        elif len(mine):
            kids = tree.children[node]
            chosen = _nearest(rows[mine], tree.centres[kids])
            todo += [(kid, mine[chosen == j]) for j, kid in enumerate(kids)]
    return leaf


def visit_order(tree: Tree, query: np.ndarray, near: np.ndarray | None = None) -> Iterator[int]:
    """Leaves, best bin first: a priority queue of nodes by the product of query and centre."""
    near = tree.centres @ query if near is None else near
    queue = [(-near[0], 0)]
    while queue:
        _, node = heapq.heappop(queue)
        if tree.leaf[node] >= 0:
            yield tree.leaf[node]
        for kid in tree.children[node]:
            heapq.heappush(queue, (-near[kid], kid))


def visits(tree: Tree, query: np.ndarray, least: int, rows_in: np.ndarray, need: int) -> list[int]:
    """The first ``least`` leaves, and more until they hold ``need`` rows."""
    chosen, rows = [], 0
    for leaf in visit_order(tree, query):
        if len(chosen) >= least and rows >= need:
            break
        chosen.append(leaf)
        rows += int(rows_in[leaf])
    return chosen


def best_rows(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, places of its nearest rows, scores), nearest first, ties to the smaller id."""
    rough = queries @ vectors.T
    for i in range(len(queries)):
        row = np.where(ids == query_ids[i], -np.inf, rough[i])
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            places = np.flatnonzero((row >= edge - CLOSE * max(1.0, abs(edge))) & (row > -np.inf))
        else:
            places = np.flatnonzero(row > -np.inf)
        scores = (vectors[places] * queries[i]).sum(axis=1)  # summed in one way wherever the row is
        order = np.lexsort((ids[places], -scores))[:k]
        yield i, places[order], scores[order]


def _matrix(vectors: pa.Array | list, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors if isinstance(vectors, list) else vectors.to_pylist()), np.float64).reshape(-1, size)


_BEST = pa.list_(pa.struct([("below", pa.float64()), ("vec_id", pa.int64()), ("leaf", pa.int64())]))
_FOUND = "query_id long, best array<struct<below: double, vec_id: long, leaf: long>>"


def _found(best: dict[int, list[tuple]]) -> pa.RecordBatch:
    """A row for each query with its best (score below zero, id, leaf), which sort as they should rank."""
    lists = [[{"below": s, "vec_id": i, "leaf": leaf} for s, i, leaf in held] for held in best.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(lists, _BEST)], ["query_id", "best"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, leaf): the lists of each query, k from a task at most, become one."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    merged = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("place", "x"))
    return merged.select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", (-F.col("x.below")).alias("score"), "x.leaf")


def exact(queries: list[tuple[int, bytes]], index: DataFrame, size: int, k: int) -> DataFrame:
    """The true neighbours of a bounded list of queries among all rows of the index, with their leaves."""
    ids, own = np.array([q[0] for q in queries], np.int64), _matrix([q[1] for q in queries], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, names, leaves = _matrix(batch.column(1), size), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            yield _found({int(ids[i]): [(-float(s), int(names[p]), int(leaves[p])) for p, s in zip(places, scores)]
                          for i, places, scores in best_rows(own, ids, vectors, names, k)})

    return _top(index.select("id", "vector", "leaf").mapInArrow(run, _FOUND), k)


def calibrated_visits(tree: Tree, queries: list[tuple[int, bytes]], truth: list, recall: float, size: int) -> int:
    """Leaves to visit: widened until the true neighbours' share in the visited leaves is ``recall``."""
    wanted: dict[int, list[int]] = {}
    for row in truth:
        wanted.setdefault(row["query_id"], []).append(row["leaf"])
    ranks = []
    for name, vector in queries:
        order = {leaf: i for i, leaf in enumerate(visit_order(tree, np.frombuffer(vector, np.float64)))}
        ranks += [order[leaf] for leaf in wanted.get(name, [])]
    count, ranks = 1, np.array(ranks)
    while count < tree.leaves and len(ranks) and (ranks < count).mean() < recall:
        count = min(tree.leaves, max(count + 1, int(count * WIDEN)))
    return count


def nearest(table: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL,
            sample_rows: int = SAMPLE_ROWS, calibration_queries: int = CALIBRATION_QUERIES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row for which ``is_query``, a condition on id, holds."""
    spark, size = table.sparkSession, vector_size(table, vector_col)
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = write_once(distinct_vectors(table, id_col, vector_col, size), "tree-rows")
    sample = own.orderBy(F.xxhash64("id"), "vector").limit(sample_rows).select("vector").toArrow().column(0).to_pylist()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit(_matrix(sample, size))

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = assign(tree, _matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int64())], ["id", "vector", "leaf"])

    index = write_once(own.mapInArrow(to_leaf, "id long, vector binary, leaf long"), "tree-index")
    # A proven bound: the tree has at most 2 * sample_rows nodes.
    counts = index.groupBy("leaf").agg(F.count("*").alias("n"))
    rows_in = np.zeros(tree.leaves, np.int64)
    for row in counts.collect():
        rows_in[row["leaf"]] = row["n"]
    asked = own.where(is_query)
    probe = [(r["id"], bytes(r["vector"])) for r in asked.orderBy(F.xxhash64("id", F.lit(1)), "vector").limit(calibration_queries).collect()]
    least = calibrated_visits(tree, probe, exact(probe, index, size, k).collect(), recall, size) if probe else 1

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_leaf: dict[int, list[int]] = {}
            for i, query in enumerate(_matrix(batch.column(1), size)):
                for leaf in visits(tree, query, least, rows_in, 2 * k + 2):
                    by_leaf.setdefault(leaf, []).append(i)
            names, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(leaf, [names[i] for i in part], b"".join(vectors[i] for i in part))
                    for leaf, places in by_leaf.items() for s in range(0, len(places), QUERY_ROWS) if (part := places[s:s + QUERY_ROWS])]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64())),
                                              pa.array(columns[2], pa.binary())], ["leaf", "query_ids", "queries"])

    visited = asked.select("id", "vector").mapInArrow(to_visits, "leaf long, query_ids array<long>, queries binary")
    sub = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / tile_rows)).cast("int")
    tiles = index.join(F.broadcast(counts), "leaf").groupBy("leaf", sub.alias("sub")).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    pairs = visited.join(tiles, "leaf").select("leaf", "query_ids", "queries", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}  # of the queries of this task; flushed before it grows large
        for batch in batches:
            for i in range(batch.num_rows):
                rows, ids = batch.column(3)[i].values, batch.column(1)[i].values.to_numpy()
                queries, names = _matrix([batch.column(2)[i].as_py()], size), rows.field(0).to_numpy()
                for q, places, scores in best_rows(queries, ids, _matrix(rows.field(1), size), names, k):
                    held = best.setdefault(int(ids[q]), [])
                    held += [(-float(s), int(names[p]), -1) for p, s in zip(places, scores)]
                    if len(held) > 8 * k:
                        held[:] = sorted(held)[:k]
            if len(best) > 20_000:
                yield _found({q: sorted(held)[:k] for q, held in best.items()})
                best = {}
        yield _found({q: sorted(held)[:k] for q, held in best.items()})

    ranked = _top(pairs.mapInArrow(run, _FOUND), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

