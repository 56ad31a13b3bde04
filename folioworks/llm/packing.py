"""Best-fit packing of tokenized documents by hierarchical residual packing.

Documents become token ids and are cut into pieces of at most ``capacity``.
Every partition packs its pieces best-fit, largest first, and emits the bins
that are full enough; what is underfull goes up a tree, where a task takes the
underfull bins of several tasks as items and packs them again.  The tree ends at
one task.  A best-fit task leaves at most one bin that is half empty or more,
and only such bins can still join others, so a task sends up the emptiest bins,
``carry`` at most, and emits the rest as they are; every piece is packed once.

Each level is written to the shared folder before the next one reads it: a lost
executor repeats its task from a table, never from an order that may change.

Defined cases: a null text is the empty text, whose document is the end token
alone; repeated rows are packed each; rows with null or equal ids are dealt like
others; a very long text is cut into pieces in one task; an empty table gives no
rows; extra columns stay out of the way.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from folioworks.llm.common import SLICE_CHARS, bounded_batches, parts_for, per_process
from folioworks.session import write_once

CAPACITY = 2048
END = 0
VOCABULARY = "word_bpe_49k.json"
#: Words that a task remembers, and the longest it remembers.
REMEMBERED, REMEMBERED_CHARS = 600_000, 40
PIECES_PER_TASK = 50_000
FAN_IN = 16
CARRY = 2_048
#: A bin with no more free places than this is full enough.
SLACK = 8


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Plain words: letters that the vocabulary's rules keep together and lower one by one, and punctuation behind them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,;:!?)]*)")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return dict(zip(own, own)) | {b: 256 + i for i, b in enumerate(rest)}


class WordCoder:
    """The ids of a text as bytes, by words that white space separates.

    The vocabulary's normaliser treats characters between white space on their
    own and its pre-tokenizer drops the white space, so the ids of a text are
    those of its words one after another.  Only blanks and line feeds cut, which
    any definition of white space holds.  A word of plain letters with
    punctuation behind it goes to the vocabulary's merges at once, as two parts;
    any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        found, at = [], 0
        while len(text) - at > SLICE_CHARS and (end := text.find(" ", at + SLICE_CHARS)) >= 0:
            found.append(self._encode(text[at:end]))
            at = end
        return b"".join([*found, self._encode(text[at:])])

    def _encode(self, text: str) -> bytes:
        if len(self.words) > REMEMBERED:
            self.words = {"": b""}
        if len(self.parts) > REMEMBERED:
            self.parts = {"": b""}
        words = text.replace("\n", " ").split(" ")
        ids = list(map(self.words.get, words))
        if None in ids:
            for i, found in enumerate(ids):
                if found is None:
                    ids[i] = self._word(words[i])
        return b"".join(ids)

    def _word(self, word: str) -> bytes:
        if len(word) > REMEMBERED_CHARS:
            return self._whole(word)
        if plain := _PLAIN.fullmatch(word):
            ids = self._part(plain[1].lower()) + self._part(plain[2])
        else:
            ids = self._whole(word)
        self.words[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[part] = array("I", [t.id for t in self.merges.tokenize(spelt)]).tobytes()
        return ids

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
              path: Callable[[], str] | str = vocabulary_path) -> DataFrame:
    """(id, piece, start, length, ids, deal): the pieces of every document with their ids as little-endian bytes.

    ``deal`` is a number of each row, to be stored, that deals rows out.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path() if callable(path) else path
        coder = per_process(f"word coder {file}", lambda: WordCoder(file))
        end, made = np.array([END], "<u4").tobytes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, part))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(np.arange(made, made + len(rows)))],
                                             ["id", "piece", "start", "length", "ids", "deal"])
            made += len(rows)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, piece int, start long, length long, ids binary, deal long")


# --- bins ----------------------------------------------------------------------------------------------------------

def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest items first, each into the fullest bin that still holds it."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # a bit for every amount of room that some bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            bin_ = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
            room -= size
        else:
            bin_, made, room = made, made + 1, capacity - size
        bins[i] = bin_
        by_room[room].append(bin_)
        rooms |= 1 << room
    return bins


_BIN = "sequence_id long, done boolean, size long, members array<struct<id: long, piece: int, start: long, length: long, crc: long>>"


def _packed(capacity: int, slack: int, carry: int, level: int, last: bool):
    """A task's work: best-fit over all items it holds; bins that go up are marked as not done."""
    member = pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if items is None or not items.num_rows:
            return
        items = items.sort_by([("size", "descending"), ("first_id", "ascending"), ("first_piece", "ascending")])
        sizes = items.column("size").to_numpy()
        bins = best_fit(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        members = items.column("members").combine_chunks().take(pa.array(order))
        counts = np.diff(members.offsets.to_numpy())
        made = int(bins.max()) + 1
        offsets = np.zeros(made + 1, np.int64)
        np.add.at(offsets, bins[order] + 1, counts)
        merged = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), members.flatten())
        filled = np.bincount(bins, weights=sizes, minlength=made).astype(np.int64)
        open_ = np.flatnonzero(filled < capacity - slack)
        open_ = open_[np.argsort(filled[open_], kind="stable")][:0 if last else carry]
        done = np.ones(made, bool)
        done[open_] = False
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(made), pa.int64()), pa.array(done), pa.array(filled),
                                          merged.cast(pa.list_(member))], ["sequence_id", "done", "size", "members"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, carry: int = CARRY, fan_in: int = FAN_IN,
         per_task: int = PIECES_PER_TASK) -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset) of every row of ``pieces``.

    ``pieces`` is a stored table; its columns are read as they are, so its rows
    are dealt to the same tasks whenever a task is repeated.
    """
    spark = pieces.sparkSession
    parts = parts_for(pieces.count(), per_task)
    member = F.struct("id", "piece", "start", "length", "crc")
    # Rows are dealt by a stored number: the same row goes to the same task in every attempt.
    own = F.col("deal") if "deal" in pieces.columns else F.xxhash64("id", "piece")
    items = pieces.select(F.col("length").alias("size"), F.col("id").alias("first_id"), F.col("piece").alias("first_piece"),
                          F.array(member).alias("members"), own.alias("deal"))
    level, levels = 0, []
    while True:
        last = parts == 1
        dealt = items.repartition(parts, F.xxhash64("deal"))
        bins = write_once(dealt.mapInArrow(_packed(capacity, slack, carry, level, last), _BIN), f"packed-{level}")
        levels.append(bins.where("done"))
        if last:
            break
        parts = parts_for(parts, fan_in)
        first = F.col("members")[0]
        items = bins.where("NOT done").select("size", first["id"].alias("first_id"), first["piece"].alias("first_piece"), "members",
                                              F.col("sequence_id").alias("deal"))
        level += 1
    packed = levels[0]
    for more in levels[1:]:
        packed = packed.unionByName(more)
    spread = packed.select("sequence_id", F.posexplode("members").alias("place", "m"), "members")
    before = F.aggregate(F.slice("members", 1, F.col("place")), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return spread.select("m.*", "sequence_id", before.alias("offset"))


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **settings) -> DataFrame:
    """Tokenize, cut and pack: (id, piece, start, length, crc, sequence_id, offset)."""
    cut = pieces_of(docs, id_col, text_col, capacity).select("id", "piece", "start", "length", F.crc32("ids").alias("crc"), "deal")
    return pack(write_once(cut, "packing-pieces"), capacity, **settings)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **settings) -> DataFrame:
    """(sequence_id, ids array): the token sequences themselves, built from the packed pieces."""
    stored = write_once(pieces_of(docs, id_col, text_col, capacity), "packing-ids")
    placed = pack(stored.withColumn("crc", F.crc32("ids")), capacity, **settings)
    key = ["id", "piece", "start", "length", "crc"]
    # Repeated rows have equal pieces, so any of their places will do: number them on both sides.
    left = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("sequence_id", "offset")))
    right = stored.withColumn("crc", F.crc32("ids")).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("length")))
    both = [left[c].eqNullSafe(right[c]) for c in (*key, "nth")]
    together = left.join(right, both).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct(left["offset"], right["ids"]))).alias("parts"))
    whole = F.concat_ws("", F.transform("parts", lambda x: F.hex(x["ids"])))
    return together.select("sequence_id", F.unhex(whole).alias("ids"))

