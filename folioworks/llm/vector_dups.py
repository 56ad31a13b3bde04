"""Embedding near-duplicates: PCA-ordered tiles, compared by leading dimensions first.

Vectors are scaled to length one and turned by the principal axes of the whole
table, so that the leading dimensions hold most of every product.  Linked
vectors lie within sqrt(2 - 2 t) of each other, also along each axis; a grid of
that width over the leading axes gives cells of which only neighbours are
compared, cut into tiles of bounded size.  In a pair of tiles the products of
the leading dimensions are added up first; what the other dimensions can add is
at most the product of the suffix norms, and pairs that cannot reach the
threshold stop there.

Defined cases: null and zero vectors, those with null or non-finite components,
those of another length than most and rows without an id link with nothing;
equal vectors are compared as one; repeated rows are one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.common import block_links, connected_components, spanning_pairs, vector_size, vectors_of
from folioworks.session import write_once

THRESHOLD = 0.95
AXES = 3
TILE_ROWS = 2048
#: Dimensions after which a pair's bound is looked at.
STEPS = (8, 24)
CLOSE = 1e-9
BLOCK = 512
DIGIT = 20
BIAS = 1 << (DIGIT - 1)


def distinct_vectors(table: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(id, vector as bytes of doubles) of the usable rows, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, matrix = vectors_of(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array([r.tobytes() for r in matrix], pa.binary())],
                                             ["id", "vector"])

    source = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return source.mapInArrow(run, "id long, vector binary").distinct()


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(-1, size)


def _units(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(groups: DataFrame, size: int) -> np.ndarray:
    """Orthogonal axes by falling variance, from all vectors; the driver gets size x size sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            units = _units(_matrix(batch.column(0), size))
            total += units.T @ units
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["cell", "value"])

    sums = groups.select("vector").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    moments = np.zeros(size * size)
    moments[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    _, axes = np.linalg.eigh(moments.reshape(size, size))
    return np.ascontiguousarray(axes[:, ::-1])


def _cells(groups: DataFrame, axes: np.ndarray, width: float) -> DataFrame:
    """``groups`` with the number of its grid cell over the leading axes."""
    lead = axes[:, :min(AXES, axes.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.floor((_units(_matrix(batch.column(2), len(axes))) @ lead) / width).astype(np.int64) + BIAS
            cell = sum((place[:, i] << (DIGIT * i) for i in range(place.shape[1])), np.zeros(len(place), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "weight", "vector", "cell"])

    return groups.select("id", "weight", "vector").mapInArrow(run, "id long, weight long, vector binary, cell long")


def _neighbours(axes: int) -> list[int]:
    """Offsets of this cell and of the larger ones among those that touch it."""
    offsets = [0]
    for i in range(axes):
        offsets = [o + (d << (DIGIT * i)) for o in offsets for d in (-1, 0, 1)]
    return sorted(o for o in offsets if o >= 0)


def tile_hits(left: np.ndarray, right: np.ndarray, own_left: np.ndarray, own_right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``left`` and ``right``, units in axis order, have a cosine of at least ``threshold``.

    ``own_left`` and ``own_right`` are the vectors as they came; products that
    are close to the threshold are decided on them.
    """
    size = left.shape[1]
    cuts = [c for c in STEPS if c < size] + [size]
    suffix_left, suffix_right = (np.sqrt(np.maximum(0, 1 - np.cumsum(x * x, axis=1))) for x in (left, right))
    product, at = np.zeros((len(left), len(right))), 0
    for cut in cuts:
        product += left[:, at:cut] @ right[:, at:cut].T
        at = cut
        rest = np.multiply.outer(suffix_left[:, cut - 1], suffix_right[:, cut - 1]) if cut < size else 0.0
        alive = product + rest >= threshold - CLOSE
        if not (some := np.count_nonzero(alive)):
            return alive
        if cut < size and some * 20 < alive.size:  # few are left: go on with them alone
            rows, cols = np.nonzero(alive)
            sums = product[rows, cols]
            for nxt in cuts[cuts.index(cut) + 1:]:
                sums = sums + np.einsum("ij,ij->i", left[rows, at:nxt], right[cols, at:nxt])
                rest = suffix_left[rows, nxt - 1] * suffix_right[cols, nxt - 1] if nxt < size else 0.0
                stay = sums + rest >= threshold - CLOSE
                rows, cols, sums, at = rows[stay], cols[stay], sums[stay], nxt
            close = np.abs(sums - threshold) <= CLOSE
            good = ~close
            good[close] = _cosines(own_left[rows[close]], own_right[cols[close]]) >= threshold
            hits = np.zeros(alive.shape, bool)
            hits[rows[good], cols[good]] = True
            return hits
    rows, cols = np.nonzero(alive & (np.abs(product - threshold) <= CLOSE))
    alive[rows, cols] = _cosines(own_left[rows], own_right[cols]) >= threshold
    return alive


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def compared_tiles(groups: DataFrame, threshold: float, size: int, tile_rows: int) -> DataFrame:
    """(a, b, n): links as (a, b, null), a spanning forest for each pair of tiles; linked weights as (a, null, n)."""
    axes = principal_axes(groups, size)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    celled = write_once(_cells(groups, axes, width), "vector-cells")
    # A proven bound: a unit vector's leading coordinates are in [-1, 1], so there are (2 / width + 2) ** AXES cells.
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = F.broadcast(sizes) if (2 / width + 2) ** AXES <= 100_000 else sizes
    sub = F.pmod(F.xxhash64("id", "vector"), F.ceil(F.col("n") / tile_rows)).cast("int")
    tiles = celled.join(sizes, "cell").groupBy("cell", sub.alias("sub")).agg(F.collect_list(F.struct("id", "weight", "vector")).alias("rows"))
    tiles = write_once(tiles.withColumn("tile", F.concat_ws("/", "cell", "sub")), "vector-tiles")
    names = tiles.select("cell", "tile")
    near = F.explode(F.array(*[F.lit(x).cast("long") for x in _neighbours(min(AXES, size))]))
    pairs = (names.select(F.col("tile").alias("a"), "cell", near.alias("step")).select("a", (F.col("cell") + F.col("step")).alias("cell"), "step")
             .join(names.select("cell", F.col("tile").alias("b")), "cell").where("step > 0 OR a <= b").select("a", "b"))
    both = (pairs.join(tiles.select(F.col("tile").alias("a"), F.col("rows").alias("left")), "a")
            .join(tiles.select(F.col("tile").alias("b"), F.col("rows").alias("right")), "b")
            .select((F.col("a") == F.col("b")).alias("same"), "left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                (ids_a, w_a, own_a), (ids_b, w_b, own_b) = (_unpacked(batch.column(k)[i].values, size) for k in (1, 2))
                unit_a, unit_b = _units(own_a) @ axes, _units(own_b) @ axes
                links, counts_a, counts_b = [], np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
                for start in range(0, len(ids_a), BLOCK):
                    block = slice(start, start + BLOCK)
                    hits = tile_hits(unit_a[block], unit_b, own_a[block], own_b, threshold)
                    if same:
                        own = np.arange(len(hits))
                        hits[own, start + own] = False
                    if hits.any():
                        counts_a[block] += hits @ w_b
                        counts_b += w_a[block] @ hits
                        links += block_links(hits, ids_a[block], ids_b)
                out += [(x, y, None) for x, y in spanning_pairs(links)]
                out += [(int(x), None, int(n)) for x, n in zip(ids_a, counts_a) if n]
                if not same:
                    out += [(int(x), None, int(n)) for x, n in zip(ids_b, counts_b) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["a", "b", "n"])

    return both.mapInArrow(run, "a long, b long, n long")


def _unpacked(rows: pa.StructArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows.field(0).to_numpy(), rows.field(1).to_numpy(), _matrix(rows.field(2), size)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, n_links, component_id) for every row."""
    size = vector_size(table, vector_col)
    plain = table.select(F.col(id_col).cast("long").alias("id"))
    if not size:
        return plain.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    own = write_once(distinct_vectors(table, id_col, vector_col, size), "vector-rows")
    groups = own.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    groups = write_once(groups, "vector-groups")
    found = write_once(compared_tiles(groups, threshold, size, tile_rows), "vector-links")
    roots = connected_components(found.where("b IS NOT NULL"))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    facts = (groups.join(counts, F.col("id") == F.col("a"), "left").join(roots, F.col("id") == F.col("node"), "left")
             .select("vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    named = own.join(facts, "vector").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (plain.join(named, "id", "left")
            .select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
