"""Near copies by exact Jaccard similarity of five-word shingles.

Rows with the same shingle set are one node.  Two sets of similarity 0.8 or more
share one of their first n - ceil(0.8 n) + 1 shingles in any common order, so
these are a node's keys; shingles that a sample finds often come last in the
order, which makes keys rare and changes no result.  A key that one node holds
finds nothing and is dropped before keys meet: what the others are is sent to
the tasks as an array of bits of fixed size at most.

First the nodes are linked by SimHash: fingerprints of their shingles that differ
in a few bits name pairs, which are verified on the whole sets.  A radius misses
pairs that have the similarity, so the rest is found by keys, among nodes that
no link joins yet.

Nodes that share keys are counted by pairs.  Common shingles that are keys of
one of two nodes only lie behind the other's keys, so a similar pair shares at
least as many keys as its sizes ask for, and only such pairs are verified on the
whole sets, which are read again from the texts.  The verified links make
components.  Where keys have so many holders that pairs are many times the rows,
nodes are first compared with one hub of each of their keys, and then only pairs
that no link joins yet.

Defined cases: null and empty texts are the empty set and copies of each other;
texts of fewer words than a shingle are one shingle; rows without an id link but
never name a component; very long texts are read in slices; an empty table gives
no rows; extra columns stay out of the way.  A set is named by 64 bits of its
hash, as a shingle is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from folioworks.llm import simhash
from folioworks.llm.common import bounded_batches, connected_components, slices
from folioworks.session import cut_lineage, drop_stored, write_once

SHINGLE_WORDS = 5
SEED = 42
#: Similarity as a fraction of whole numbers.
PART, WHOLE = 4, 5
#: One in so many nodes is sampled; shingles of at least so many sampled nodes come last, so many of them at most.
SAMPLED, OFTEN, MOST_OFTEN = 16, 8, 200_000
#: Bits in which the fingerprints of a pair differ that SimHash names.
RADIUS = 3
#: Longs of a set's parity bits: bit i is the parity of how many shingles fall on it.
PARITY_LONGS = 4
#: Keys that one batch hands on.
SEND_KEYS = 500_000
#: Bits of a filter at most, and bits for each of its members while they fit.
MOST_BITS, BITS_EACH, BLOCK_BITS = 1 << 27, 16, 1 << 20
#: Hub rounds go on, so many at most, while more pairs are open than this multiple of the keys and each round halves them.
ROUNDS, OPEN = 12, 8


def shingle_set(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted, as signed numbers."""
    found, carried, digest = [], [], xxhash.xxh64_intdigest
    for part in slices((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + part.split()
        if len(words) >= width:
            grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
            found.append(np.unique(np.fromiter((digest(g, seed) for g in grams), np.uint64, len(words) - width + 1)))
            carried = words[len(words) - width + 1:]
        else:
            carried = words
    if not found and carried:
        found = [np.array([digest(b" ".join(carried), seed)], np.uint64)]
    return np.unique(np.concatenate(found).view(np.int64)) if found else np.zeros(0, np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Parity bits of a set; those of two sets differ in no more places than the sets have shingles of their own."""
    counts = np.bincount((shingles.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * PARITY_LONGS), minlength=64 * PARITY_LONGS)
    return np.packbits(counts & 1).astype(np.uint8).view(np.int64)


def print_of(shingles: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is set in over half the shingles."""
    return int(np.packbits(2 * simhash._bit_counts(shingles.view(np.uint64)) > len(shingles), bitorder="little").view(np.int64)[0])


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark): what all passes over the documents read; ``mark`` is a hash of the text."""
    bounded_batches(docs.sparkSession)
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))


def shingled(texts: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, mark, node, n, print, parity, sample) of every row; ``sample`` has the shingles of one in ``SAMPLED`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            nodes = [node_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([print_of(s) for s in sets], pa.int64()),
                 _lists([parity(s) for s in sets]), _lists([s if n % SAMPLED == 0 else s[:0] for s, n in zip(sets, nodes)])],
                ["id", "mark", "node", "n", "print", "parity", "sample"])

    return texts.mapInArrow(run, "id long, mark long, node long, n long, print long, parity array<long>, sample array<long>")


def often(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) by shingle: what many of the sampled nodes hold."""
    sample = marked.select("node", F.explode("sample").alias("key")).distinct()
    counted = sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = counted.orderBy(F.desc("n"), "key").limit(MOST_OFTEN).toArrow()
    keys, counts = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def key_count(n):
    """How many keys a node with ``n`` shingles has."""
    return n - -(-PART * n // WHOLE) + 1


def first_keys(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one."""
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        spot = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[spot] == shingles, counts[spot], 0)
    return shingles[np.lexsort((shingles, rank))[:key_count(len(shingles))]]


def keyed(texts: DataFrame, common: np.ndarray, counts: np.ndarray, width: int = SHINGLE_WORDS) -> DataFrame:
    """(key, node, n): the keys of every row with shingles, ``n`` of them."""
    sent = texts.sparkSession.sparkContext.broadcast((common, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[tuple]) -> pa.RecordBatch:
            sizes = [len(k) for k, _, _ in held]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _, _ in held])), pa.array(np.repeat([x for _, x, _ in held], sizes)),
                                               pa.array(np.repeat([n for _, _, n in held], sizes))], ["key", "node", "n"])

        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, width)
                if not len(own):
                    continue
                held.append((first_keys(own, *sent.value), node_of(own), len(own)))
                size += len(held[-1][0])
                if size > SEND_KEYS:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    return texts.select("text").mapInArrow(run, "key long, node long, n long")


# --- filters of fixed size -----------------------------------------------------------------------------------------

def _places(values: np.ndarray, size: int) -> np.ndarray:
    mixed = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def bit_filter(values: DataFrame) -> np.ndarray:
    """A bit for each place that a number of the one column of ``values`` falls on; ``MOST_BITS`` of them at most.

    Tasks send what they set, block by block; a full filter would let everything
    through, so nothing depends on it but how much is read.
    """
    size = min(MOST_BITS, max(BLOCK_BITS, 1 << (BITS_EACH * values.count() - 1).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, bool)
        for batch in batches:
            held[_places(batch.column(0).to_numpy(), size)] = True
        for block in range(size // BLOCK_BITS):
            part = held[block * BLOCK_BITS:(block + 1) * BLOCK_BITS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)])], ["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(part), np.uint8)
                held[block] = held[block] | own if block in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "bits"])

    merged = values.mapInArrow(bits, "block long, bits binary").repartition("block").mapInArrow(merge, "block long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.block * BLOCK_BITS // 8:(row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _let_through(batch: pa.RecordBatch, place: int, filter_: np.ndarray) -> pa.RecordBatch:
    spots = _places(batch.column(place).to_numpy(), 8 * len(filter_))
    return batch.filter(pa.array((filter_[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8) & 1).astype(bool)))


def passing(rows: DataFrame, column: str, filter_: np.ndarray) -> DataFrame:
    """The rows whose number may be in the filter."""
    sent, place = rows.sparkSession.sparkContext.broadcast(filter_), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _let_through(batch, place, sent.value)

    return rows.mapInArrow(run, rows.schema)


# --- pairs ---------------------------------------------------------------------------------------------------------

def _sizes_allow(a: str, b: str) -> Column:
    return (WHOLE * F.col(a) >= PART * F.col(b)) & (WHOLE * F.col(b) >= PART * F.col(a))


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of (a, b, n_both) whose parity bits do not rule the similarity out."""
    both = (pairs.join(sketches.select(F.col("node").alias("a"), F.col("parity").alias("left")), "a")
            .join(sketches.select(F.col("node").alias("b"), F.col("parity").alias("right")), "b"))
    differ = sum((F.bit_count(F.get("left", F.lit(i)).bitwiseXOR(F.get("right", F.lit(i)))) for i in range(PARITY_LONGS)), F.lit(0))
    # Similar sets differ in (WHOLE - PART) / (WHOLE + PART) of their sizes' sum at most.
    return both.where((WHOLE + PART) * differ <= (WHOLE - PART) * F.col("n_both")).select("a", "b")


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, stored.  Only texts that a filter lets through are read as sets again."""
    pairs = write_once(pairs.select("a", "b"), "shingle-pairs")
    named = write_once(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(sketches.select("node", "mark"), "node"), "shingle-named")
    # Filter and sets in one step: a second one would need Python workers of its own.
    sent = texts.sparkSession.sparkContext.broadcast(bit_filter(named.select("mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, batch = [], _let_through(batch, 0, sent.value)
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if mark not in seen:  # a text that fills a third of the table is sent once by each task
                    seen.add(mark)
                    held.append((mark, shingle_set(text, width)))
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in held], pa.int64()), _lists([s for _, s in held])], ["mark", "shingles"])

    sets = texts.select("mark", "text").mapInArrow(run, "mark long, shingles array<long>").join(named, "mark").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = write_once(sets, "shingle-sets")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b"))
    shared = F.size(F.array_intersect("left", "right"))
    # shared / (left + right - shared) >= PART / WHOLE
    found = write_once(both.where((PART + WHOLE) * shared >= PART * (F.size("left") + F.size("right"))).select("a", "b"), "shingle-links")
    for done in (pairs, named, sets):
        drop_stored(done)
    return found


def print_pairs(sketches: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, n_both): nodes whose fingerprints are equal or linked within ``radius`` bits.

    Of equal fingerprints the smallest node meets the others and stands for
    them; links between fingerprints are a spanning forest for each pair of tiles.
    """
    named = sketches.groupBy("print").agg(F.min(F.struct("node", "n")).alias("first"))
    named = write_once(named.select("print", F.col("first.node").alias("hub"), F.col("first.n").alias("hub_n")), "shingle-prints")
    same = sketches.join(named, "print").where("node != hub").select("node", "n", "hub", "hub_n")
    near = simhash.links(named.select(F.col("print").alias("fingerprint")), radius)
    side = lambda x, node, n: named.select(F.col("print").alias(x), F.col("hub").alias(node), F.col("hub_n").alias(n))
    near = near.join(side("a", "node", "n"), "a").join(side("b", "hub", "hub_n"), "b").select("node", "n", "hub", "hub_n")
    return (same.unionByName(near).where(_sizes_allow("n", "hub_n"))
            .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), (F.col("n") + F.col("hub_n")).alias("n_both")).distinct())


def _hub_pairs(open_: DataFrame, turn: int) -> DataFrame:
    """(a, b, n_both): every node with one node of each of its keys; the choice changes with ``turn``."""
    choice = F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
    hubs = open_.groupBy("key").agg(F.min(choice).alias("h")).select("key", "h.hub", "h.hub_n", "h.hub_root")
    return (open_.join(hubs, "key").where((F.col("root") != F.col("hub_root")) & _sizes_allow("n", "hub_n"))
            .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"),
                    (F.col("n") + F.col("hub_n")).alias("n_both")).distinct())


def _still_open(open_: DataFrame, edges: DataFrame) -> tuple[DataFrame, int, int]:
    """(keys of more than one component with the nodes' roots, stored; their rows; pairs of unlinked nodes in them)."""
    roots = connected_components(edges)
    rooted = (open_.drop("root").join(roots.withColumnRenamed("node", "joined"), F.col("node") == F.col("joined"), "left")
              .select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.count("*").alias("roots"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same")).where("roots > 1")
    parts = write_once(parts, "shingle-parts")
    found = parts.agg(F.sum("all"), F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()
    kept = write_once(rooted.join(parts.select("key"), "key", "left_semi"), "shingle-open")
    drop_stored(parts)
    return kept, int(found[0] or 0), int(found[1] or 0)


def open_keys(texts: DataFrame, marked: DataFrame, width: int) -> DataFrame:
    """(key, node, n, root): the keys that several nodes hold, once for each, stored; every node is its own root."""
    keys = write_once(keyed(texts, *often(marked), width), "shingle-keys")
    several = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("key")
    several = write_once(several, "shingle-several")
    fit = passing(keys, "key", bit_filter(several)).join(several, "key", "left_semi").distinct()
    found = write_once(fit.withColumn("root", F.col("node")), "shingle-open")
    for done in (keys, several):
        drop_stored(done)
    return found


def shared_enough(open_: DataFrame) -> DataFrame:
    """The pairs (a, b) of unlinked nodes that share as many keys as similar sets of their sizes do.

    Common shingles behind the keys of the node whose keys end first are at most
    its shingles that are no keys.
    """
    left = open_.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    right = open_.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _sizes_allow("n_a", "n_b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    behind = F.ceil(PART * F.greatest("n_a", "n_b") / WHOLE) - 1
    return counted.where((PART + WHOLE) * (F.col("shared") + behind) >= PART * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def links(texts: DataFrame, marked: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(a, b): links that join exactly the nodes of ``marked`` that are similar, directly or through others."""
    open_ = open_keys(texts, marked, width)
    sketches = marked.groupBy("node").agg(*[F.min(c).alias(c) for c in ("mark", "n", "print", "parity")])
    sketches = write_once(sketches.join(open_.select("node").distinct(), "node", "left_semi"), "shingle-sketches")
    edges, before = verified(possible(print_pairs(sketches), sketches), sketches, texts, width), None
    for turn in range(ROUNDS + 1):
        still, rows, pairs = _still_open(open_, edges)
        if still is not open_:
            drop_stored(open_)
        open_ = still
        if pairs <= OPEN * rows or turn == ROUNDS or before is not None and 2 * pairs > before:
            break
        before = pairs
        found = verified(possible(_hub_pairs(open_, turn), sketches), sketches, texts, width)
        edges = edges.unionByName(found)
    rest = verified(shared_enough(open_), sketches, texts, width)
    for done in (open_, sketches):
        drop_stored(done)
    return edges.unionByName(rest)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, component_id): one row per document; the component is its smallest id."""
    texts = texts_of(docs, id_col, text_col)
    marked = write_once(shingled(texts, width), "shingle-rows")
    distinct = cut_lineage(marked.groupBy("node").agg(F.min("id").alias("least")))
    joined = connected_components(links(texts, marked, width)).withColumnRenamed("node", "joined")
    rooted = (distinct.join(joined, F.col("node") == F.col("joined"), "left")
              .select("node", F.coalesce("root", "node").alias("root"), "least"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("node", "component_id")
    return marked.select("id", "node").join(labels, "node").select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The document with the smallest id of every component, with all its columns.

    Rows without an id stay; of repeated rows with the kept id one stays.
    """
    found = components(docs, id_col, text_col, **settings)
    kept = found.where("id = component_id").select(F.col("id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
