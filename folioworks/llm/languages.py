"""Language identification: script candidates, per-word scores and Viterbi over the words of a text.

Learning counts letter trigrams (with word edges) and letters by script for
every language over all learning rows; both tables have a fixed size, so a task
adds them up in numpy arrays and sends only what is not zero.  A word's score in
a language is the sum of its trigrams' smoothed log probabilities.  The script
of a word narrows the languages it may be in.  Viterbi with a switching penalty
labels the words; runs of equal labels are the spans.

Defined cases: a null text and a text without letters are ``und`` with score
zero; a word in a script that no language was learned from is free for all of
them and adds nothing to the score; rows without a language or an id teach
nothing; ties between languages go to the first in alphabetical order; with
nothing learned every text is ``und``; a very long text is one path, with memory
in proportion to its words times the languages; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.common import bounded_batches, free_name

BUCKETS = 1 << 16
#: Natural-log units that a change of language costs.
PENALTY = 20.0
SMOOTHING = 0.5
#: A language is a candidate for a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
SLICE = 2_000_000
UNKNOWN = "und"

# Scripts by code point ranges; what no range holds is script 0.
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF),
    ("Arabic", 0x750, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF),
    ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x2FFFF),
)
SCRIPT_NAMES = ("Other", *dict.fromkeys(s[0] for s in SCRIPTS))


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, script number) by code point."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = SCRIPT_NAMES.index(name)
    return letter, script


@dataclass
class Words:
    """The words of a piece of text: trigram buckets of all letters, and where each word starts and ends."""

    buckets: np.ndarray
    first: np.ndarray  # of each word, in buckets
    start: np.ndarray  # of each word, in the text
    end: np.ndarray
    script: np.ndarray


def words_of(text: str, letter: np.ndarray, script: np.ndarray) -> Words:
    """Words are maximal runs of letters; trigrams are hashed over lower-cased letters with word edges as zero."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[codes]
    edge = np.diff(is_letter.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lower = text.lower()
    if len(lower) != len(text):  # a few letters lower to two code points; those texts go letter by letter
        lower = "".join(c if len(low := c.lower()) != 1 else low for c in text)
    padded = np.zeros(len(codes) + 2, np.uint64)
    padded[1:-1] = np.where(is_letter, np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32), 0)
    at = np.flatnonzero(is_letter)
    mixed = (padded[at] * np.uint64(0x9E3779B1) + padded[at + 1] * np.uint64(0x85EBCA77C2B2AE63)
             + padded[at + 2] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    buckets = ((mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(end - start)[:-1]]) if len(start) else np.zeros(0, np.int64)
    return Words(buckets, first, start, end, script[codes[start]])


def text_slices(text: str, letter: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, str]]:
    """(offset, slice) of a long text, cut between words."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and letter[ord(text[end])]:
            end += 1
        yield start, text[start:end]
        start = end
    yield start, text[start:]


# --- learning ------------------------------------------------------------------------------------------------------

def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all ``rows``; what comes to the driver is languages x (buckets + scripts) numbers at most."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, script = code_tables()
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in grams:
                    grams[lang] = np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64)
                for _, part in text_slices(text or "", letter):
                    words = words_of(part, letter, script)
                    grams[lang][:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                    grams[lang][BUCKETS:] += np.bincount(words.script, weights=words.end - words.start,
                                                         minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang, counts in grams.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()),
                                              pa.array(counts[full], pa.int64())], ["lang", "place", "n"])

    known = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = known.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)), np.int64)
    if langs:
        which = np.searchsorted(np.array(langs), np.array(table.column("lang").to_pylist()))
        counts[table.column("place").to_numpy(), which] = table.column("n").to_numpy()
    return Model.of(langs, counts)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages, float32
    allowed: np.ndarray  # scripts x languages

    @classmethod
    def of(cls, langs: list[str], counts: np.ndarray) -> Model:
        grams, letters = counts[:BUCKETS].astype(np.float64), counts[BUCKETS:]
        scores = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
        allowed = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(axis=0))
        return cls(langs, scores.astype(np.float32), allowed)


# --- labelling -----------------------------------------------------------------------------------------------------

def word_scores(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(score of each word in each language, whether its script is one that was learned from)."""
    sums = np.add.reduceat(model.scores[words.buckets], words.first, axis=0).astype(np.float64)
    allowed = model.allowed[words.script]
    known = allowed.any(axis=1)
    # Where several languages are candidates the others are ruled out; where none is, all are open and equal.
    sums[known] = np.where(allowed[known], sums[known], -1e9)
    sums[~known] = 0.0
    return sums, known


def one_language(sums: np.ndarray, penalty: float) -> int | None:
    """The language that labels all words, if a bound shows that no path beats it.

    If no run of words gains half the penalty in another language, a path with m
    stretches in others gains m halves at most and pays for m switches, or for
    m - 1 if it is never in this language; and the whole text gains nothing in
    any one other language, for this one has the largest sum.
    """
    best = int(sums.sum(axis=0).argmax())
    gains = np.cumsum(sums - sums[:, best:best + 1], axis=0)
    lowest = np.minimum.accumulate(np.vstack([np.zeros((1, sums.shape[1])), gains[:-1]]), axis=0)
    return best if (gains - lowest).max() <= penalty / 2 else None


def viterbi(sums: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; a tie is resolved for staying, then for the first language."""
    if (one := one_language(sums, penalty)) is not None:
        return np.full(len(sums), one)
    count, langs = sums.shape
    came = np.empty((count, langs), np.int32)
    rows, own = sums.tolist(), range(langs)
    value = rows[0]
    for i in range(1, count):
        top = max(value)
        head = value.index(top)
        back = [j if value[j] >= top - penalty else head for j in own]
        value = [value[b] - (penalty if b != j else 0.0) + s for j, (b, s) in enumerate(zip(back, rows[i]))]
        came[i] = back
    labels = np.empty(count, np.int64)
    labels[-1] = value.index(max(value))
    for i in range(count - 1, 0, -1):
        labels[i - 1] = came[i, labels[i]]
    return labels


def label_text(model: Model, text: str | None, letter: np.ndarray, script: np.ndarray,
               penalty: float = PENALTY) -> tuple[str, float, list[tuple[int, int, str]]]:
    """(language, score, spans).  The score is the share of letters in words that carry the language.

    The words of a long text are scored slice by slice and labelled together.
    """
    starts, ends, scores, free = [], [], [], []
    letters = 0
    for offset, part in text_slices(text or "", letter):
        words = words_of(part, letter, script)
        letters += int((words.end - words.start).sum())
        if len(words.start) and model.langs:
            sums, known = word_scores(model, words)
            starts.append(words.start + offset)
            ends.append(words.end + offset)
            scores.append(sums)
            free.append(known)
    weights, spans = np.zeros(len(model.langs)), []
    if scores:
        start, end, known = (np.concatenate(x) for x in (starts, ends, free))
        labels = viterbi(np.concatenate(scores), penalty)
        weights = np.bincount(labels, weights=(end - start) * known, minlength=len(model.langs))
        turns = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
        spans = [(int(start[a]), int(end[b - 1]), model.langs[labels[a]]) for a, b in zip(turns[:-1], turns[1:])]
    if not letters or not model.langs:
        return UNKNOWN, 0.0, []
    return model.langs[int(weights.argmax())], float(weights.max() / letters), spans


def label(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_pred, score and spans (array of start, end, lang) behind its columns."""
    bounded_batches(docs.sparkSession)
    # A proven bound: buckets x languages.
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores, model.allowed))
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    plain = docs.toDF(*names)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (letter, script) = Model(*shared.value), code_tables()
        for batch in batches:
            found = [label_text(own, t, letter, script, penalty) for t in batch.column(place).to_pylist()]
            spans = [[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array(spans, span_type)], [*names, "lang_pred", "score", "spans"])

    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    out = plain.mapInArrow(run, f"{schema}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")
    return out.toDF(*docs.columns, *[free_name(docs, c) for c in ("lang_pred", "score", "spans")])
