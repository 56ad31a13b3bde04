"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts character n-grams (four characters, after lower-casing,
folding digits and joining white space) over all trusted texts.  Documents are
dealt into blocks by their id.  A block tells which n-grams its documents hold;
the distinct n-grams of all blocks are joined, order by order, with the count
tables, which are sharded by n-gram; and each block gets the log probabilities
of its own n-grams back, from which its documents' perplexities are summed up.
A document is kept if its perplexity is at most the limit of its language.

The limit is calibrated where bad documents are named as well: one in three
trusted documents is held out of the counts, and the limit is the step that
best parts the held-out trusted documents from the bad ones, by the share of
trusted documents kept less the share of bad ones kept.  Without named bad
documents it is a quantile of the trusted ones.

A text goes to its block in compressed batches.  Characters above U+FFFE are
read as U+FFFD, so an n-gram is one 64-bit number of four 16-bit characters.

Defined cases: null, empty and blank texts have no perplexity and are not kept;
a null language is a language of its own; a language without trusted documents
takes the quantile over all; without any trusted text every text that is not
blank is kept; repeated rows are judged each; rows without an id are judged too,
but are not trusted; a language with fewer than ten held-out or ten bad documents
takes the distance from its held-out median that is calibrated over all, one with
fewer than five held-out ones its quantile, and without ten of both all do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.llm.common import bounded_batches, parts_for
from folioworks.session import write_once

ORDER = 4
BITS = 16
BEGIN, END = "\x02", "\x03"
#: Characters of documents in a block.
BLOCK_CHARS = 16_000_000
#: A batch of texts for one block is sent when it holds this many characters.
SEND_CHARS, HOLD_CHARS = 1_000_000, 24_000_000
QUANTILE = 0.99
#: One in so many trusted documents is held out for the calibration; what it takes at least on either side.
HELD_OUT, LEAST_CALIBRATED, LEAST_CENTRE = 3, 10, 5
#: Log perplexities are counted in steps of this size for the quantiles.
STEP = 1e-3
SLICE = 1_000_000
_SPACE = re.compile(r"\s+")
_DIGIT = re.compile(r"\d")


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as signed 64-bit numbers, one for each character and for the end."""
    plain = _DIGIT.sub("0", _SPACE.sub(" ", text.strip().lower()))
    codes = np.frombuffer((BEGIN * (ORDER - 1) + plain + END).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes > 0xFFFE, 0xFFFD, codes).astype(np.uint64)
    n = len(codes) - ORDER + 1
    found = np.zeros(n, np.uint64)
    for i in range(ORDER):
        found = (found << np.uint64(BITS)) | codes[i:i + n]
    return found.view(np.int64)


# --- blocks --------------------------------------------------------------------------------------------------------

_DOC = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, docs): the rows (id, lang, text) of each block in compressed batches."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(blocks)).cast("int").alias("block"),
                        "id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        sizes: dict[int, int] = {}

        def send(wanted: list[int]) -> pa.RecordBatch:
            packed = [_packed(held.pop(b)) for b in wanted]
            for b in wanted:
                sizes.pop(b)
            return pa.RecordBatch.from_arrays([pa.array(wanted, pa.int32()), pa.array(packed, pa.binary())], ["block", "docs"])

        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(block, []).append(tuple(row))
                sizes[block] = sizes.get(block, 0) + len(row[2] or "") + 50
            full = [b for b, n in sizes.items() if n >= SEND_CHARS]
            if sum(sizes.values()) > HOLD_CHARS:
                full = list(sizes)
            if full:
                yield send(full)
        if held:
            yield send(list(held))

    return keyed.mapInArrow(run, "block int, docs binary")


def _packed(rows: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, _DOC, options=options) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DOC)], schema=_DOC))
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.ChunkedArray) -> Iterator[tuple]:
    for item in packed:
        for batch in pa.ipc.open_stream(item.as_buffer()):
            yield from zip(*(c.to_pylist() for c in batch.columns))


def block_grams(blobs: DataFrame, trusted: DataFrame, blocks: int) -> DataFrame:
    """(block, gram, n): every n-gram of a block's documents, with how often its trusted ones hold it."""
    ids = trusted.select(F.pmod(F.xxhash64("id", F.lit(None).cast("string")), F.lit(blocks)).cast("int").alias("block"), "id")

    def run(docs: pa.Table, good: pa.Table) -> pa.Table:
        known = set(good.column("id").to_pylist())
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *(k for k, _ in pending)])
            n = np.concatenate([counts, *(c for _, c in pending)])
            distinct, place = np.unique(every, return_inverse=True)
            return distinct, np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)

        parts: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = 0

        def fold() -> None:
            for trusted_, found in parts.items():
                if found:
                    k, c = np.unique(np.concatenate(found), return_counts=True)
                    pending.append((k, c if trusted_ else np.zeros(len(c), np.int64)))
                    found.clear()

        for doc, _, text in _unpacked(docs.column("docs")):
            if text and not text.isspace():
                found = grams(text)
                parts[doc in known].append(found)
                size += len(found)
                if size > SLICE:
                    fold()
                    size, waiting = 0, waiting + 1
                    if waiting == 16:
                        keys, counts = merged()
                        pending.clear()
                        waiting = 0
        fold()
        keys, counts = merged()
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        return pa.table({"block": pa.array(np.full(len(keys), block), pa.int32()), "gram": pa.array(keys), "n": pa.array(counts)})

    return blobs.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, "block int, gram long, n long")


# --- the model -----------------------------------------------------------------------------------------------------

def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS * order) - 1)) if order < ORDER else gram


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, BITS)


def count_tables(counted: DataFrame) -> dict[int, DataFrame]:
    """(gram, n) by order: how often an n-gram occurs, and below the highest order how many characters it follows."""
    tables = {ORDER: counted}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = tables[order + 1].groupBy(_suffix(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n"))
    return {order: write_once(t, f"kneser-{order}") for order, t in tables.items()}


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from its counts of counts."""
    found = {r["n"]: r["types"] for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("types")).collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in range(1, 5))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def log_probabilities(wanted: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """(gram, logp) of distinct n-grams: joined with each order's counts and contexts, from the lowest order up."""
    characters = tables[1].count() + 1  # and one that was never seen
    known = wanted.withColumn("p", F.lit(1.0 / characters))
    for order in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[order])
        contexts = tables[order].groupBy(_context(F.col("gram")).alias("context")).agg(
            F.sum("n").alias("total"),
            (d1 * F.count_if(F.col("n") == 1) + d2 * F.count_if(F.col("n") == 2) + d3 * F.count_if(F.col("n") > 2)).alias("held_back"))
        part = _suffix(F.col("gram"), order)
        counts = tables[order].select(F.col("gram").alias("part"), F.col("n").alias("count"))
        joined = (known.withColumn("part", part).withColumn("context", _context(part))
                  .join(counts, "part", "left").join(contexts, "context", "left"))
        off = F.when(F.col("count") == 1, d1).when(F.col("count") == 2, d2).otherwise(d3)
        here = (F.coalesce(F.col("count") - off, F.lit(0.0)) + F.col("held_back") * F.col("p")) / F.col("total")
        known = joined.select("gram", F.coalesce(here, F.col("p")).alias("p"))
    return known.select("gram", F.log("p").alias("logp"))


def perplexities(blobs: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, lang, log_perplexity) of every document; null for blank texts."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("gram").to_numpy(), kind="stable")
        keys, logs = table.column("gram").to_numpy()[order], table.column("logp").to_numpy()[order]
        rows = []
        for doc, lang, text in _unpacked(docs.column("docs")):
            value = None
            if text and not text.isspace():
                found = logs[np.searchsorted(keys, grams(text))]
                value = float(-found.sum() / len(found))
            rows.append((doc, lang, value))
        columns = list(zip(*rows)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64()))], ["id", "lang", "log_perplexity"])

    return blobs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "id long, lang string, log_perplexity double")


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, limit): the step of the trusted documents' log perplexities that holds the quantile; lang '' with whole is all."""
    counted = scored.where("trusted AND log_perplexity IS NOT NULL").groupBy("lang", F.floor(F.col("log_perplexity") / STEP).alias("step")).agg(F.count("*").alias("n"))
    every = counted.groupBy("step").agg(F.sum("n").alias("n"))
    both = counted.select(F.lit(False).alias("whole"), "lang", "step", "n").union(every.select(F.lit(True), F.lit(None).cast("string"), "step", "n"))
    # Steps are few whatever the number of documents.
    by = Window.partitionBy("whole", "lang")
    sofar = both.withColumn("upto", F.sum("n").over(by.orderBy("step"))).withColumn("total", F.sum("n").over(by))
    return sofar.where(F.col("upto") >= quantile * F.col("total")).groupBy("whole", "lang").agg(F.min("step").alias("limit"))


def held_out(ids: DataFrame) -> DataFrame:
    """The ids that the counts leave out: one in ``HELD_OUT`` by a hash."""
    return ids.where(F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(HELD_OUT)) == 0)


def calibrated(scored: DataFrame) -> DataFrame:
    """(whole, lang, limit): the step that best parts what is held out from what is bad; whole is for all other languages.

    ``scored`` has the marks ``held`` and ``bad``.  Steps are counted from the
    median of the language's held-out documents, so that languages can be added
    up.  Of equally good limits the middle one is taken.
    """
    step = F.floor(F.col("log_perplexity") / STEP)
    usable = scored.where("(held OR bad) AND log_perplexity IS NOT NULL").select("lang", step.alias("step"), "held", "bad")
    median = F.percentile_approx(F.when(F.col("held"), F.col("step")), 0.5).alias("centre")
    centres = usable.groupBy("lang").agg(median, F.count_if("held").alias("n")).where(F.col("n") >= LEAST_CENTRE).select(F.col("lang").alias("of"), "centre")
    middle = usable.agg(median).first()["centre"] or 0
    counted = (usable.groupBy("lang", "step").agg(F.count_if("held").alias("good"), F.count_if("bad").alias("poor"))
               .join(centres, F.col("lang").eqNullSafe(F.col("of"))).select("lang", (F.col("step") - F.col("centre")).alias("step"), "good", "poor"))
    every = counted.groupBy("step").agg(F.sum("good").alias("good"), F.sum("poor").alias("poor"))
    both = counted.select(F.lit(False).alias("whole"), "lang", "step", "good", "poor").union(
        every.select(F.lit(True), F.lit(None).cast("string"), "step", "good", "poor"))
    # Steps are few whatever the number of documents.
    by = Window.partitionBy("whole", "lang")
    so_far = by.orderBy("step")
    sums = both.select("whole", "lang", "step", F.sum("good").over(so_far).alias("kept"), F.sum("poor").over(so_far).alias("missed"),
                       F.sum("good").over(by).alias("goods"), F.sum("poor").over(by).alias("poors"), F.lead("step").over(so_far).alias("next"))
    gain = F.col("kept") / F.col("goods") - F.col("missed") / F.col("poors")
    enough = sums.where((F.col("goods") >= LEAST_CALIBRATED) & (F.col("poors") >= LEAST_CALIBRATED))
    best = enough.groupBy("whole", "lang").agg(F.max(F.struct(gain, F.col("step"), F.col("next"))).alias("best"))
    between = F.floor((F.col("best.step") + F.coalesce("best.next", F.col("best.step") + 1) - 1) / 2)
    best = best.select("whole", "lang", between.alias("limit"))
    whole = best.where("whole").first()
    if whole is None:
        return best
    own = best.where("NOT whole").select("lang", "limit")
    named = (centres.join(own, F.col("of").eqNullSafe(F.col("lang")), "left")
             .select(F.lit(False).alias("whole"), F.col("of").alias("lang"), (F.col("centre") + F.coalesce("limit", F.lit(whole["limit"]))).alias("limit")))
    return named.union(scored.sparkSession.range(1).select(F.lit(True), F.lit(None).cast("string"), F.lit(middle + whole["limit"]).cast("long")))


def judged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           quantile: float = QUANTILE, block_chars: int = BLOCK_CHARS, bad: DataFrame | None = None) -> DataFrame:
    """(id, lang, trusted, perplexity, threshold, keep) of every row.

    ``trusted`` has the trusted ids in column id, and so has ``bad`` those of
    documents that are to go, for the calibration.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    good = trusted.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct()
    blocks = parts_for(source.agg(F.sum(F.length("text"))).first()[0] or 1, block_chars)
    out = held_out(good) if bad is not None else good.limit(0)
    asked = write_once(block_grams(blocked(source, blocks), good.join(out, "id", "left_anti"), blocks), "kneser-asked")
    every = write_once(asked.groupBy("gram").agg(F.sum("n").alias("n")), "kneser-grams")
    tables = count_tables(every.where("n > 0"))
    known = write_once(log_probabilities(every.select("gram"), tables), "kneser-known")
    answers = asked.select("block", "gram").join(known, "gram").select("block", "gram", "logp")
    scored = write_once(perplexities(blocked(source, blocks), answers), "kneser-scored")
    scored = scored.join(good.withColumn("trusted", F.lit(True)), "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    limits = thresholds(scored, quantile)
    if bad is not None:
        poor = bad.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct().join(good, "id", "left_anti")
        marks = (scored.join(out.withColumn("held", F.lit(True)), "id", "left").join(poor.withColumn("bad", F.lit(True)), "id", "left")
                 .select("lang", "log_perplexity", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("bad", F.lit(False)).alias("bad")))
        better = write_once(calibrated(marks), "kneser-limits")
        # What is not calibrated keeps its quantile; AQE decides how these few rows are joined.
        other = better.select(F.col("whole").alias("w"), F.col("lang").alias("l"), F.col("limit").alias("better"))
        limits = (limits.join(other, (F.col("whole") == F.col("w")) & F.col("lang").eqNullSafe(F.col("l")), "left")
                  .select("whole", "lang", F.coalesce("better", "limit").alias("limit")))
    own = limits.where("NOT whole").select(F.coalesce("lang", F.lit("")).alias("key"), F.col("lang").isNull().alias("no_lang"), F.col("limit").alias("own"))
    whole = limits.where("whole").first()
    # Languages of trusted documents; AQE decides how they are joined.
    marked = scored.withColumn("key", F.coalesce("lang", F.lit(""))).withColumn("no_lang", F.col("lang").isNull()).join(own, ["key", "no_lang"], "left")
    limit = F.coalesce("own", F.lit(whole["limit"] if whole else None).cast("long"))
    inside = F.coalesce(F.floor(F.col("log_perplexity") / STEP) <= limit, F.lit(True))
    return marked.select("id", "lang", "trusted", F.exp("log_perplexity").alias("perplexity"), F.exp((limit + 1) * STEP).alias("threshold"),
                         (F.col("log_perplexity").isNotNull() & inside).alias("keep"))
