"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers cut the same bytes.  A shared cut is a byte offset where tokens
of both end.  An interval of a text is divided at a shared cut near its middle:
from the middle token of A outward, each end is looked up by bisection among the
ends of B until one is shared, and both halves are treated in the same way; an
interval without a cut inside is a group.  The intervals of all texts of a batch
are divided together, level by level.

Inside a group every overlap of an A and a B token is a link.  A document's
distinct links (id pairs) are stored beside their numbers; tasks count how many
documents hold a pair and the counts are added up.  Pairs are dealt into shards
by a hash, each packed into sorted arrays, and the documents' pairs are probed
against them: a shard's probes are dealt by a salt over as many tasks as their
number asks for, and the shard's arrays are repeated for each.  No pair is ever
joined as a row, and no document is in one task's hands as a whole.

Token bytes: an A entry byte-level decoded; a B piece in UTF-8 with U+2581 as a
blank and <0xHH> as a byte.  Special tokens' strings in a text are plain text.

Defined cases: null and empty texts have no tokens, nor have texts whose joined
A or B bytes differ from blank and text (those that hold U+2581, for instance);
rows with the same id and null ids are documents of their own; a very long text
is one interval at first and is divided like others, with memory in proportion
to its tokens; an empty table gives no rows; extra columns stay out of the way.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from folioworks.llm.common import bounded_batches, parts_for, per_process
from folioworks.session import write_once

VOCABULARY_A, RANKS_A, VOCABULARY_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
BLANK = "▁"
#: Characters of texts that are aligned at a time, unless one text has more.
GROUP_CHARS = 500_000
#: Pairs that a task counts before it hands them on, pairs of a shard, and pairs of documents that one task probes.
HELD_PAIRS, SHARD_PAIRS, TASK_PAIRS = 4_000_000, 2_000_000, 2_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Coders:
    """Both tokenizers with their tokens' bytes and the tokens' numbers as text.

    A's vocabulary is read as ranks, by the same numbers and merges.
    """

    def __init__(self, ranks: str, model: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as file:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_a = [b""] * (max(merges.values()) + 1)
        for token, rank in merges.items():
            self.bytes_a[rank] = token
        self.bytes_b = [bytes([int((p := self.b.id_to_piece(i))[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(BLANK, " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # Texts of a token with each sign that may follow it: A in a group, the last of A, B in a group, the last of B.
        self.many_a, self.many_b = len(self.bytes_a), len(self.bytes_b)
        self.spelt = ([f"{i}," for i in range(self.many_a)] + [f"{i}|" for i in range(self.many_a)]
                      + [f"{i}," for i in range(self.many_b)] + [f"{i};" for i in range(self.many_b)])

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both, empty if their bytes are not those of the text with a blank in front."""
        if not text:
            return [], []
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        whole = b" " + text.encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole or b"".join(map(self.bytes_a.__getitem__, a)) != whole:
            return [], []
        return a, b


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first A token, first B token) of every group, in order.

    ``ends_a`` and ``ends_b`` are the byte offsets where tokens end, rising over
    all texts; ``first_a`` and ``first_b`` have the first token of each text,
    with the number of tokens behind the last one.  No text is without tokens.
    """
    low_a, high_a, low_b, high_b = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    out_a, out_b = [], []
    while len(low_a):
        cut_a, cut_b = np.full(len(low_a), -1, np.int64), np.zeros(len(low_a), np.int64)
        open_ = np.flatnonzero((high_a - low_a > 1) & (high_b - low_b > 1))
        middle, step = (low_a[open_] + high_a[open_] - 2) // 2, 0
        while len(open_):
            # Outward from the middle: 0, 1, -1, 2, -2 ...; the last token's end is the interval's own.
            token = middle + (step + 1) // 2 * (1 if step % 2 else -1)
            inside = np.flatnonzero((token >= low_a[open_]) & (token < high_a[open_] - 1))
            spot = np.searchsorted(ends_b, ends_a[token[inside]])
            hit = inside[ends_b[spot] == ends_a[token[inside]]]
            cut_a[open_[hit]], cut_b[open_[hit]] = token[hit] + 1, np.searchsorted(ends_b, ends_a[token[hit]]) + 1
            # Above the middle lie as many ends as below, or one more: an odd step outside is the last of all.
            left = cut_a[open_] < 0
            if step % 2:
                outside = np.ones(len(open_), bool)
                outside[inside] = False
                left &= ~outside
            open_, middle, step = open_[left], middle[left], step + 1
        whole = cut_a < 0
        out_a.append(low_a[whole])
        out_b.append(low_b[whole])
        low_a, cut_a, high_a, low_b, cut_b, high_b = (x[~whole] for x in (low_a, cut_a, high_a, low_b, cut_b, high_b))
        low_a, high_a = np.concatenate([low_a, cut_a]), np.concatenate([cut_a, high_a])
        low_b, high_b = np.concatenate([low_b, cut_b]), np.concatenate([cut_b, high_b])
    if not out_a:
        return (np.zeros(0, np.int64),) * 2
    firsts_a, firsts_b = np.concatenate(out_a), np.concatenate(out_b)
    order = np.argsort(firsts_a)
    return firsts_a[order], firsts_b[order]


class Aligned:
    """The groups and links of some texts, all of which have tokens."""

    def __init__(self, coders: Coders, found: list[tuple[list[int], list[int]]]):
        self.coders = coders
        self.first_a, self.first_b = (np.cumsum([0, *(len(x[i]) for x in found)]) for i in (0, 1))
        self.a, self.b = (np.array([t for x in found for t in x[i]], np.int64) for i in (0, 1))
        ends_a, ends_b = np.cumsum(coders.size_a[self.a]), np.cumsum(coders.size_b[self.b])
        self.group_a, self.group_b = shared_cuts(ends_a, ends_b, self.first_a, self.first_b)
        self.groups = np.diff(np.searchsorted(self.group_a, self.first_a))
        ends = np.union1d(ends_a, ends_b)  # each stretch between ends lies in one token of either side, and no two lie in the same two
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.links = np.diff(np.searchsorted(at_a, self.first_a))
        self.link_doc = np.repeat(np.arange(len(found)), self.links)
        self.link_pair = self.a[at_a] * coders.many_b + self.b[at_b]

    def spelt(self) -> Iterator[str]:
        """Each text's groups: ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[np.append(self.group_a[1:], len(self.a)) - 1] = 1
        last_b[np.append(self.group_b[1:], len(self.b)) - 1] = 1
        # A group's A tokens come in front of its B tokens.
        size_a, size_b = np.diff(np.append(self.group_a, len(self.a))), np.diff(np.append(self.group_b, len(self.b)))
        signs = np.empty(len(self.a) + len(self.b), np.int64)
        signs[np.arange(len(self.a)) + np.repeat(self.group_b, size_a)] = self.a + self.coders.many_a * last_a
        signs[np.arange(len(self.b)) + np.repeat(self.group_a + size_a, size_b)] = 2 * self.coders.many_a + self.b + self.coders.many_b * last_b
        spell, cuts = self.coders.spelt.__getitem__, self.first_a + self.first_b
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield "".join(map(spell, signs[low:high].tolist()))[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of distinct pairs by text, pairs, how often each is linked in its text)."""
        whole, counts = np.unique(self.link_doc * (self.coders.many_a * self.coders.many_b) + self.link_pair, return_counts=True)
        doc, pair = np.divmod(whole, self.coders.many_a * self.coders.many_b)
        return np.bincount(doc, minlength=len(self.links)), pair.astype(np.uint32), counts.astype(np.uint32)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = f"row long, id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups string, pairs binary, times binary"


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
            ranks: Callable[[], str] = lambda: vocabulary_path(RANKS_A), model: Callable[[], str] = lambda: vocabulary_path(VOCABULARY_B)) -> DataFrame:
    """One row per document: its token and link counts, its groups, and its distinct id pairs.

    ``groups`` is the text of all groups, with ``digest`` its SHA-256 instead;
    ``pairs`` has the pairs (A id times the size of B, plus B id) as rising
    32-bit numbers and ``times`` how often each is linked.  ``row`` is a number
    of its own, to be stored.
    """
    bounded_batches(docs.sparkSession)

    def groups_of(texts: list[str | None]) -> Iterator[list[str | None]]:
        held, size = [], 0
        for text in texts:
            if held and size + len(text or "") > GROUP_CHARS:
                yield held
                held, size = [], 0
            held.append(text)
            size += len(text or "")
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranks(), model()
        coders = per_process(f"token coders {files}", lambda: Coders(*files))
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            begin = 0
            for texts in groups_of(batch.column(1).to_pylist()):
                found = [coders.encode(t) for t in texts]
                own = np.flatnonzero([bool(a) for a, _ in found])
                numbers = np.zeros((len(_COUNTS), len(texts)), np.int64)
                spelt, pairs, times = [""] * len(texts), [b""] * len(texts), [b""] * len(texts)
                if len(own):
                    work = Aligned(coders, [found[i] for i in own])
                    numbers[:, own] = np.diff(work.first_a), np.diff(work.first_b), work.groups, work.links
                    sizes, pair, count = work.pairs()
                    cuts = np.cumsum(sizes).tolist()
                    for i, low, high, text in zip(own.tolist(), [0, *cuts], cuts, work.spelt()):
                        spelt[i] = hashlib.sha256(text.encode()).hexdigest() if digest else text
                        pairs[i], times[i] = pair[low:high].tobytes(), count[low:high].tobytes()
                columns = [pa.array(np.arange(at, at + len(texts))), batch.column(0).slice(begin, len(texts)), *map(pa.array, numbers),
                           pa.array(spelt, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", *_COUNTS, "groups", "pairs", "times"])
                at, begin = at + len(texts), begin + len(texts)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, _ALIGNED)


# --- counts over the corpus ----------------------------------------------------------------------------------------

def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(how many numbers each row has, all of them) of a column of 32-bit numbers."""
    parts = [x.as_buffer() for x in column]
    return np.array([len(x) // 4 for x in parts], np.int64), np.frombuffer(b"".join(parts), np.uint32)


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each pair.  Tasks add up what they read before anything moves."""

    def summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
        return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, waiting = [], [], 0
        for batch in batches:
            _, found = _numbers(batch.column(0))
            pairs.append(found)
            counts.append(np.ones(len(found), np.int64))
            waiting += len(found)
            if waiting > HELD_PAIRS:
                held = summed(pairs, counts)
                if len(held[0]) > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int64)), pa.array(held[1])], ["pair", "n"])
                    pairs, counts, waiting = [], [], 0
                else:
                    pairs, counts, waiting = [held[0]], [held[1]], len(held[0])
        if pairs:
            held = summed(pairs, counts)
            yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int64)), pa.array(held[1])], ["pair", "n"])

    return stored.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)


def packed_shards(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: (shard, pairs, counts, best) with arrays in rising order of the pairs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard(batch.column(0).to_numpy(), shards).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", "pair", "n", "best"])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("pair")
        arrays = [group.column("pair").to_numpy().astype(np.uint32), group.column("n").to_numpy(), np.asarray(group.column("best")).astype(bool)]
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int64())}
                        | {k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("pairs", "counts", "best"), arrays)})

    marked = counts.select("pair", "n", "best").mapInArrow(mark, "shard long, pair long, n long, best boolean")
    return marked.groupBy("shard").applyInArrow(pack, "shard long, pairs binary, counts binary, best binary")


def document_sums(stored: DataFrame, index: DataFrame, shards: int, salts: int) -> DataFrame:
    """(row, n_best, count_sum): each document's links whose pair is its A id's most frequent one, and the sum of counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            sizes, pairs = _numbers(batch.column(1))
            _, times = _numbers(batch.column(2))
            doc, shard = np.repeat(np.arange(len(rows)), sizes), _shard(pairs, shards)
            salt = hash(int(rows[0])) * 0x9E3779B1 % salts if len(rows) else 0
            out = []
            for own in np.unique(shard).tolist():
                here = shard == own
                number = np.bincount(doc[here], minlength=len(rows))
                some = np.flatnonzero(number)
                out.append((own, salt, rows[some].tobytes(), number[some].astype("<i4").tobytes(), pairs[here].tobytes(), times[here].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)],
                                             ["shard", "salt", "rows", "sizes", "pairs", "times"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, best, total = [], [], []
        if right.num_rows:
            known = np.frombuffer(right.column("pairs")[0].as_buffer(), np.uint32)
            counts = np.frombuffer(right.column("counts")[0].as_buffer(), np.int64)
            top = np.frombuffer(right.column("best")[0].as_buffer(), bool)
            for block in left.to_batches():
                for name, size, pair, time in zip(*(block.column(c) for c in ("rows", "sizes", "pairs", "times"))):
                    spot = np.searchsorted(known, np.frombuffer(pair.as_buffer(), np.uint32))
                    times = np.frombuffer(time.as_buffer(), np.uint32).astype(np.int64)
                    first = np.concatenate([[0], np.cumsum(np.frombuffer(size.as_buffer(), "<i4"))[:-1]])
                    rows.append(np.frombuffer(name.as_buffer(), np.int64))
                    best.append(np.add.reduceat(times * top[spot], first))
                    total.append(np.add.reduceat(times * counts[spot], first))
        empty = np.zeros(0, np.int64)
        return pa.table({k: pa.array(np.concatenate([*x, empty]), pa.int64()) for k, x in (("row", rows), ("n_best", best), ("count_sum", total))})

    probes = stored.where("n_links > 0").select("row", "pairs", "times").mapInArrow(
        deal, "shard long, salt long, rows binary, sizes binary, pairs binary, times binary")
    repeated = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    sums = probes.groupBy("shard", "salt").cogroup(repeated.groupBy("shard", "salt")).applyInArrow(probe, "row long, n_best long, count_sum long")
    return sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, shard_pairs: int = SHARD_PAIRS,
           task_pairs: int = TASK_PAIRS, **files) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document."""
    stored = write_once(aligned(docs, id_col, text_col, digest, **files), "token-alignments")
    per_a = Window.partitionBy(F.expr(f"pair DIV {_many_b(**files)}"))  # as many rows as B has entries, at most
    counts = write_once(pair_counts(stored).withColumn("best", F.col("n") == F.max("n").over(per_a)), "token-pairs")
    size = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("probes")).first()
    shards = parts_for(size["pairs"], shard_pairs)
    salts = parts_for((size["probes"] or 0) // shards, task_pairs)
    index = write_once(packed_shards(counts, shards), "token-shards")
    sums = document_sums(stored, index, shards, salts).withColumnRenamed("row", "summed")
    joined = stored.drop("pairs", "times").join(sums, F.col("row") == F.col("summed"), "left")
    whole = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return joined.select("id", *_COUNTS, *whole, "groups")


def _many_b(model: Callable[[], str] = lambda: vocabulary_path(VOCABULARY_B), **_: object) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model()).get_piece_size()
