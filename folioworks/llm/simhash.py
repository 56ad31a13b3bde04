"""SimHash near-duplicates by tiled exact comparison of all fingerprints.

Distinct fingerprints are put into cells by the population counts of their four
16-bit words, cells are cut into tiles of bounded size, and two tiles are
compared, exclusive-or and bit count over numpy arrays, unless their counts
differ by more than the radius: every differing bit changes one of the four
counts by one, so such tiles can hold no pair within it.

Defined cases: null and empty texts have fingerprint zero and link with each
other; texts of fewer words than a shingle are one shingle; equal texts share a
fingerprint; rows with the same id are reported once each; a null id links but
never names a component unless no other id is in it; extra columns stay out of
the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.common import (block_links, bounded_batches, connected_components, slices, spanning_pairs)
from folioworks.session import cut_lineage, write_once

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
TILE_ROWS = 4096
WORDS, WORD_BITS, DIGIT = 4, 16, 6
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set; byte lanes add up to 255 values without overflow."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[: len(hashes)] = hashes
    padded = padded.reshape(-1, 255)
    counts = np.zeros((8, 8), np.int64)  # byte, bit
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & _LANES).sum(axis=1)
        counts[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit majority fingerprint of a text's word shingles, as an unsigned number."""
    counts, total, carried = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in slices((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + part.split()
        if len(words) >= width:
            grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
            hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(words) - width + 1)
            counts += _bit_counts(hashes)
            total += len(hashes)
            carried = words[len(words) - width + 1:]
        else:
            carried = words
    if not total and carried:
        counts, total = _bit_counts(np.array([digest(b" ".join(carried), seed)], np.uint64)), 1
    bits = (2 * counts > total).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum()) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fingerprint as signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, fingerprint long")


def _cell(fingerprint: str):
    """The four population counts packed into one number; two spare values keep neighbours from running over."""
    cell = F.lit(0).cast("long")
    for i in range(WORDS):
        word = F.shiftrightunsigned(F.col(fingerprint), WORD_BITS * i).bitwiseAND(F.lit(0xFFFF))
        cell = cell + (F.bit_count(word) + 16).cast("long") * (1 << (DIGIT * i))
    return cell


def _neighbour_offsets(radius: int) -> list[int]:
    """Offsets of the cells, this one and larger ones, whose counts differ by ``radius`` at most in sum."""
    steps = [()]
    for _ in range(WORDS):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    offsets = {sum(d << (DIGIT * i) for i, d in enumerate(s)) for s in steps}
    return sorted(x for x in offsets if x >= 0)


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links that join exactly the fingerprints within ``radius`` bits, directly or through others.

    ``distinct`` has a column fingerprint without repeated values.  A pair of
    tiles yields a spanning forest of its links, not all of them.
    """
    cells = distinct.select("fingerprint", _cell("fingerprint").alias("cell"))
    # A proven bound: there are 17 ** 4 cells.
    sizes = F.broadcast(cells.groupBy("cell").agg(F.count("*").alias("n")))
    tile = F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("n") / tile_rows)).cast("int")
    tiles = (cells.join(sizes, "cell").groupBy("cell", tile.alias("sub"))
             .agg(F.collect_list("fingerprint").alias("prints")))
    tiles = write_once(tiles.withColumn("tile", F.col("cell") * (1 << 32) + F.col("sub")), "simhash-tiles")
    names = tiles.select("cell", "tile")
    near = F.explode(F.array(*[F.lit(x).cast("long") for x in _neighbour_offsets(radius)]))
    pairs = (names.select("cell", F.col("tile").alias("a"), near.alias("step"))
             .select("a", (F.col("cell") + F.col("step")).alias("cell"))
             .join(names.select("cell", F.col("tile").alias("b")), "cell").where("a <= b").select("a", "b"))
    first = tiles.select(F.col("tile").alias("a"), F.col("prints").alias("prints_a"))
    second = tiles.select(F.col("tile").alias("b"), F.col("prints").alias("prints_b"))
    compared = pairs.join(first, "a").join(second, "b").select((F.col("a") == F.col("b")).alias("same"), "prints_a", "prints_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                left, right = (np.asarray(batch.column(k)[i].values) for k in (1, 2))
                found += tile_links(left, right, same, radius)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                              pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return compared.mapInArrow(run, "a long, b long")


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one tile with another, or with itself, within ``radius`` bits."""
    found: list[tuple[int, int]] = []
    step = max(1, (1 << 20) // max(1, len(right)))
    columns = right.view(np.uint64)[None, :]
    for start in range(0, len(left), step):
        block = left[start:start + step]
        hits = np.bitwise_count(block.view(np.uint64)[:, None] ^ columns) <= radius
        if same:
            hits[np.arange(len(block)), start + np.arange(len(block))] = False
        found += block_links(hits, block, right)
    return spanning_pairs(found)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
               tile_rows: int = TILE_ROWS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fingerprint long, component_id): one row per document; the component is its smallest id."""
    marked = write_once(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    distinct = cut_lineage(marked.groupBy("fingerprint").agg(F.min("id").alias("least")))
    joined = connected_components(links(distinct, radius, tile_rows))
    # Fingerprints without a partner are their own root.
    rooted = (distinct.join(joined, distinct.fingerprint == joined.node, "left")
              .select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("fingerprint", "component_id")
    return marked.join(labels, "fingerprint").select("id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The document with the smallest id of every component, with all its columns.

    Rows without an id stay; of repeated rows with the kept id one stays.
    """
    found = components(docs, id_col, text_col, **settings)
    kept = found.where("id = component_id").select(F.col("id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def hex_print(fingerprint: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(F.col(fingerprint)), 16, "0"))
