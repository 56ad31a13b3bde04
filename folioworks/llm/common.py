"""What several operators of this subpackage share: reading tables, counted partitions, connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioworks.session import cut_lineage

#: Rows in one Arrow batch handed to Python.  Texts can be long, so batches are small.
BATCH_ROWS = 1000
#: Characters of one text that are worked on at a time.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of long texts small; never raises a smaller setting of the caller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    current = int(spark.conf.get(key, "10000"))
    if current <= 0 or current > rows:
        spark.conf.set(key, str(rows))


def per_process(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker and kept for the tasks that it runs later."""
    store = sys.modules.setdefault("folioworks_worker_store", types.ModuleType("folioworks_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def vectors_of(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): the usable vectors of a list column in double precision.

    Null and zero vectors, those with null or non-finite components and, if
    ``size`` is given, those of another length are left out.
    """
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    if size is None:
        size = int(lengths.max(initial=0))
    places = np.flatnonzero((lengths == size) & (lengths > 0))
    if not len(places):
        return places, np.zeros((0, size or 0))
    flat = column.take(pa.array(places)).flatten()
    matrix = np.asarray(pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(places), size)
    with np.errstate(over="ignore", invalid="ignore"):
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return places[good], matrix[good] + 0.0  # no negative zero


def vector_size(table_: DataFrame, column: str) -> int:
    """The length of most vectors, the smaller one of a tie; zero if there are none."""
    found = (table_.where(F.size(column) > 0).groupBy(F.size(column).alias("size")).count()
             .orderBy(F.desc("count"), "size").first())
    return found["size"] if found else 0


def parts_for(rows: int, per_part: int) -> int:
    """How many partitions hold ``rows`` at ``per_part`` rows each."""
    return max(1, -(-int(rows) // per_part))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(text: bytes, spaces: bytes = b" \n\t\r\x0b\x0c", size: int = SLICE_CHARS) -> Iterator[bytes]:
    """``text`` cut behind white space into slices of about ``size`` bytes; together they are the text."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in spaces:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def spanning_pairs(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of ``pairs``, (node, root) for every node that is not the root of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def block_links(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what a block of a comparison joins, at most one for each row and column.

    ``hits[i, j]`` says that ``left[i]`` and ``right[j]`` are linked.  Labels are
    passed between rows and columns until none falls; a node is then linked to
    the node whose label it carries.
    """
    rows, cols = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
    if not len(rows):
        return []
    hits = hits[np.ix_(rows, cols)]
    nodes = np.concatenate([left[rows], right[cols]])
    _, label = np.unique(nodes, return_inverse=True)  # one label for a node on both sides
    least = np.full(label.max() + 1, len(nodes))
    np.minimum.at(least, label, np.arange(len(nodes)))
    a, b = least[label[: len(rows)]], least[label[len(rows):]]
    top = len(nodes)
    while True:
        new_a = np.minimum(a, np.where(hits, b[None, :], top).min(axis=1))
        new_b = np.minimum(b, np.where(hits, new_a[:, None], top).min(axis=0))
        if np.array_equal(new_a, a) and np.array_equal(new_b, b):
            break
        a, b = new_a, new_b
    heads = nodes[np.concatenate([a, b])]
    return [(int(x), int(y)) for x, y in zip(nodes, heads) if x != y]


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", most: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the smallest node reachable.

    Alternates the large-star and the small-star step until the edges stop
    changing.  Each step is an aggregate and an equi-join, whose skewed
    partitions AQE splits; each round is cut by a reliable checkpoint.  Nothing
    but the number of edges and a checksum reaches the driver.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    pairs = cut_lineage(edges.where(F.col(left) != F.col(right)).select(u.alias("u"), v.alias("v")).distinct())
    seen = None
    for _ in range(most):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.select(F.greatest("v", "m"), F.least("v", "m")))
        pairs = cut_lineage(small.where("u != v").distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return nodes.union(pairs.select("v", "v").distinct())
