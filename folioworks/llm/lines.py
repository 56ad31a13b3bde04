"""Line deduplication through a sharded minimal perfect hash.

Distinct line keys are counted, dealt into shards by their hash, and each shard
becomes a few compact arrays: the bit levels of a minimal perfect hash, and in
its slot order a fingerprint, a saturating document count and the holder's id.
Documents send the hashes of their lines to the shards and probe the arrays;
line texts are never joined or shuffled.  A shard's probes are as many as the
documents that hold its keys, so a shard says how many tasks share them: probes
are dealt by shard and salt, and the arrays are repeated for every salt.

Defined cases: null and empty texts are one empty line; lines whose key has
fewer code points than ``min_chars`` always stay; a line repeated in a document
counts once, rows that share an id are one document; rows with a null id take
no part and stay whole; extra columns stay as they are; a very long text is cut
into its lines in one task; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.common import bounded_batches, free_name, parts_for
from folioworks.session import write_once

SPACES = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 65_536
COUNT_TOP = (1 << 32) - 1
#: Probes that one task takes.
TASK_PROBES = 2_000_000
GAMMA = 2  # bits a key in each level


# --- lines ---------------------------------------------------------------------------------------------------------

def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a UTF-8 line, or None if it is too short to take part."""
    key = line.strip(SPACES).lower()  # bytes: A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return key


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits of a key as two signed longs: place and fingerprint."""
    whole = xxhash.xxh3_128_intdigest(key)
    high, low = whole >> 64, whole & (1 << 64) - 1
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, h, f), once per row and key that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, prints = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {k for line in _encoded(text).split(b"\n") if (k := line_key(line, min_chars)) is not None}
                for h, f in {key_hash(k) for k in keys}:
                    ids.append(doc)
                    places.append(h)
                    prints.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, places, prints)], ["id", "h", "f"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, h long, f long")


# --- minimal perfect hash ------------------------------------------------------------------------------------------

def _spot(places: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the keys fall in a level: a multiply-and-shift mix of the hash, seeded by the level."""
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = places.view(np.uint64) ^ seed
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)


def build_levels(places: np.ndarray) -> list[np.ndarray]:
    """Bit levels: a key that is alone at its spot sets the bit there; the others go on to the next level."""
    levels, rest = [], places
    while len(rest):
        size = max(64, GAMMA * len(rest))
        spots = _spot(rest, len(levels), size)
        alone = np.bincount(spots, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[spots]]
    return levels


def probe_levels(levels: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """The slot of each hash, below the number of keys for every key of the set; -1 if no level has it."""
    slots, base = np.full(len(places), -1, np.int64), 0
    open_ = np.arange(len(places))
    for level, bits in enumerate(levels):
        if not len(open_):
            break
        rank = np.cumsum(bits) - 1
        spots = _spot(places[open_], level, len(bits))
        hit = bits[spots]
        slots[open_[hit]] = base + rank[spots[hit]]
        base += int(rank[-1]) + 1
        open_ = open_[~hit]
    return slots


def pack_shard(places: np.ndarray, prints: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> dict:
    """The arrays of one shard.  Keys with equal places (64 bits) but other fingerprints go to a plain side list."""
    order = np.lexsort((prints, places))
    places, prints, counts, holders = (x[order] for x in (places, prints, counts, holders))
    first = np.ones(len(places), bool)
    first[1:] = places[1:] != places[:-1]
    levels = build_levels(places[first])
    slots = probe_levels(levels, places[first])
    arrays = [np.empty(int(first.sum()), t) for t in (np.int64, np.uint32, np.int64)]
    for array, values in zip(arrays, (prints[first], np.minimum(counts[first], COUNT_TOP), holders[first])):
        array[slots] = values
    side = np.stack([x[~first].astype(np.int64) for x in (places, prints, np.minimum(counts, COUNT_TOP), holders)])
    return {"levels": [np.packbits(x).tobytes() for x in levels], "sizes": [len(x) for x in levels],
            "prints": arrays[0].tobytes(), "counts": arrays[1].tobytes(), "holders": arrays[2].tobytes(),
            "side": side.tobytes()}


def probe_shard(shard: dict, places: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document count, holder) of each hash; count zero if the fingerprint says it is no key of the shard."""
    levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(shard["levels"], shard["sizes"])]
    stored, counts = np.frombuffer(shard["prints"], np.int64), np.frombuffer(shard["counts"], np.uint32)
    holders = np.frombuffer(shard["holders"], np.int64)
    slots = probe_levels(levels, places)
    found = slots >= 0
    found[found] = stored[slots[found]] == prints[found]
    out_counts, out_holders = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    out_counts[found], out_holders[found] = counts[slots[found]], holders[slots[found]]
    side = np.frombuffer(shard["side"], np.int64).reshape(4, -1)
    for place, print_, count, holder in side.T:
        here = (places == place) & (prints == print_)
        out_counts[here], out_holders[here] = count, holder
    return out_counts, out_holders


_SHARD = "shard long, probes long, levels array<binary>, sizes array<long>, prints binary, counts binary, holders binary, side binary"


def _arrow_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int64()), ("probes", pa.int64()), ("levels", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())),
                      ("prints", pa.binary()), ("counts", pa.binary()), ("holders", pa.binary()), ("side", pa.binary())])


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard with its arrays.  ``keys``: (h, f, docs, holder), each key once."""

    def run(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_numpy() for c in ("shard", "h", "f", "docs", "holder")}
        packed = pack_shard(columns["h"], columns["f"], columns["docs"], columns["holder"])
        own = {"shard": int(columns["shard"][0]), "probes": int(columns["docs"].sum())}
        return pa.Table.from_pylist([own | packed], schema=_arrow_schema())

    return keys.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInArrow(run, _SHARD)


def _shard_of(shards: int):
    return F.pmod(F.col("f"), F.lit(shards)).cast("long")


# --- the operator --------------------------------------------------------------------------------------------------

def dropped_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, task_probes: int = TASK_PROBES) -> DataFrame:
    """(id, keys): per document the 64-bit fingerprints of the line keys it loses."""
    spark = docs.sparkSession
    bounded_batches(spark)
    probes = write_once(line_hashes(docs, id_col, text_col, min_chars).distinct(), "line-probes")
    keys = write_once(probes.groupBy("h", "f").agg(F.count("*").alias("docs"), F.max("id").alias("holder")), "line-keys")
    shards = parts_for(keys.count(), shard_keys)
    index = write_once(build_index(keys, shards).withColumn("salts", F.ceil(F.col("probes") / task_probes)), "line-shards")
    dealt = probes.withColumn("shard", _shard_of(shards))
    # Few shards are probed so often; the others have one salt.
    shared = index.where("salts > 1").select("shard", "salts")
    salt = F.pmod(F.xxhash64("id", F.lit(3)), F.coalesce("salts", F.lit(1).cast("long")))
    salted = dealt.join(shared, "shard", "left").select("id", "h", "f", "shard", salt.alias("salt"))
    repeated = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts", "probes")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        places, prints, ids = (left.column(c).to_numpy() for c in ("h", "f", "id"))
        lost = np.zeros(len(places), bool)
        for row in right.to_pylist():
            counts, holders = probe_shard(row, places, prints)
            lost = (counts >= min(min_docs, COUNT_TOP)) & (holders != ids)
        return pa.table({"id": pa.array(ids[lost], pa.int64()), "f": pa.array(prints[lost], pa.int64())})

    lost = salted.groupBy("shard", "salt").cogroup(repeated.groupBy("shard", "salt")).applyInArrow(probe, "id long, f long")
    return lost.groupBy("id").agg(F.collect_list("f").alias("keys"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                           min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, drop_emptied: bool = False) -> DataFrame:
    """Every row with its text less the lines that other documents hold, and two columns more.

    n_lines counts a document's lines before, n_dropped those it loses; if a
    column has such a name already, the new one gets underscores behind it.
    With ``drop_emptied`` documents go that lost lines and have only white
    space left.
    """
    lost = dropped_keys(docs, id_col, text_col, min_chars, min_docs, shard_keys)
    names = [f"c{i}" for i in range(len(docs.columns))]  # the table's columns may clash with the operator's own
    plain = docs.toDF(*names)
    key, place = names[docs.columns.index(id_col)], docs.columns.index(text_col)
    joined = plain.join(lost.withColumnRenamed("id", "lost_id"), F.col(key).cast("long") == F.col("lost_id"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped, stay = batch.column(place).to_pylist(), [], [], []
            for i, keys in enumerate(batch.column(len(names)).to_pylist()):
                lines = _encoded(texts[i]).split(b"\n")
                before = len(lines)
                if keys:
                    gone = set(keys)
                    lines = [x for x in lines if (k := line_key(x, min_chars)) is None or key_hash(k)[1] not in gone]
                    texts[i] = b"\n".join(lines).decode("utf-8", "surrogatepass")
                totals.append(before)
                dropped.append(before - len(lines))
                stay.append(not (drop_emptied and len(lines) < before and not any(map(bytes.strip, lines))))
            columns = [pa.array(texts, batch.column(i).type) if i == place else batch.column(i) for i in range(len(names))]
            columns += [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"]).filter(pa.array(stay))

    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    out = joined.drop("lost_id").mapInArrow(run, f"{schema}, n_lines long, n_dropped long")
    return out.toDF(*docs.columns, free_name(docs, "n_lines"), free_name(docs, "n_dropped"))
