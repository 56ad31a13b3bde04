"""Periodic run detection by an online sparse diagonal dynamic program.

A run is a stretch of words with smallest period ``q`` that is at least
``max(6, 4 q)`` words long and that neither neighbour extends.  On the diagonal
of lag ``q`` it is an unbroken row of matches, five or more of them.  Words are
read in order.  Each one, named by the five words that end with it, meets its
earlier occurrences: a lag whose matches go on has its length raised by one, an
occurrence whose diagonal has just come to five matches makes its lag active,
and a diagonal that ends with enough matches emits its run at once.

What keeps the program sparse drops no run.  Earlier occurrences are kept by
the word before them, so that only diagonals that begin are met, never those
that go on.  A lag is not taken up if the text ends before four periods, if the
next words do not match as far as a run needs (``LOOK`` of them are looked at),
if the word does not come back one and two lags later, or if a smaller active
lag that divides it already covers a whole period.  By the theorem of Fine and Wilf a
stretch of four periods has a smaller period only if its first period is itself
a power, which is tested before a run is emitted.

Defined cases: a null or blank text has no words and no runs; one word repeated
has period 1; overlapping runs of different periods are all found; repeated rows
are treated alike; rows with a null id are read as they are; an empty table
gives no rows; extra columns stay out of the way.  A text is read as a whole,
with memory in proportion to its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.common import bounded_batches

WORD = re.compile("[^ \t-\r]+")
#: Matches that every run has on its diagonal at least.
SEED = 5
#: Least length of a run: so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are looked at ahead of a diagonal that begins, at most.
LOOK = 64

Run = tuple[int, int, int]  # start, length, period


def word_numbers(words: Sequence[str]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def seed_names(ids: np.ndarray) -> np.ndarray:
    """For each place a number that names the ``SEED`` words ending there, -1 where there are fewer.

    Exact: names of two words are put together from those of the words, and so on.
    """
    n = len(ids)
    names, width = ids, 1
    for more in (1, 2, 1):  # 1 + 1, 2 + 2, 4 + 1 words
        tail = names if more == width else ids
        _, names = np.unique(names[:len(names) - more] * (n + 1) + tail[width:][:len(names) - more], return_inverse=True)
        width += more
    return np.concatenate([np.full(SEED - 1, -1, np.int64), names])


def _is_power(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether the period's words are a shorter stretch repeated."""
    root, rest, factor = ids[start:start + period], period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if np.array_equal(root[part:], root[:-part]):
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def runs_of(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    seeds = seed_names(ids)
    counts = np.bincount(seeds[SEED - 1:])
    again = np.flatnonzero(counts[seeds[SEED - 1:]] > 1) + SEED - 1
    if not len(again):
        return []
    word = ids.tolist()
    found: list[Run] = []
    active: dict[int, int] = {}  # lag: matches so far
    earlier: dict[int, dict[int, list[int]]] = {}  # seed: word before it: places, nearest last

    def end(lag: int, matches: int, at: int) -> None:
        """The diagonal's last match was at ``at``."""
        length, start = matches + lag, at - matches - lag + 1
        if length >= max(LEAST_WORDS, LEAST_PERIODS * lag) and not _is_power(ids, start, lag):
            found.append((start, length, lag))

    last = -1
    for i, seed in zip(again.tolist(), seeds[again].tolist()):
        if active:
            if i != last + 1:
                for lag, matches in active.items():
                    end(lag, matches, last)
                active.clear()
            else:
                for lag in list(active):
                    if word[i] == word[i - lag]:
                        active[lag] += 1
                    else:
                        end(lag, active.pop(lag), i - 1)
        last = i
        before = word[i - SEED] if i >= SEED else -1
        by_word = earlier.setdefault(seed, {})
        far = (n - i + SEED - 1) // (LEAST_PERIODS - 1)
        for other, places in by_word.items():
            if other == before:
                continue  # that diagonal had its fifth match earlier
            for j in reversed(places):
                lag = i - j
                if lag > far:
                    break
                if lag >= SEED and not (word[i + lag] == word[i] == word[i + 2 * lag]):
                    continue
                ahead = min(LOOK, (LEAST_PERIODS - 1) * lag - SEED)
                if ahead > 0 and word[i + 1:i + 1 + ahead] != word[j + 1:j + 1 + ahead]:
                    continue
                if any(lag % p == 0 and m + p >= lag for p, m in active.items() if p < lag):
                    continue
                active[lag] = SEED
        by_word.setdefault(before, []).append(i)
    for lag, matches in active.items():
        end(lag, matches, last)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: Sequence[Run]) -> np.ndarray:
    """Which of ``n`` words stay when every run is cut down to its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) == 0


Words = Callable[[int | None, list[str]], list[str]]


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", changed: Words | None = None) -> DataFrame:
    """(id, runs, text): every document's runs and its kept words, joined by blanks.

    ``changed`` may replace a document's words, given its id, before they are read.
    """
    bounded_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text or "")
                if changed:
                    words = changed(name, words)
                found = runs_of(word_numbers(words))
                if found:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                texts.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, run_type), pa.array(texts, pa.string())], ["id", "runs", "text"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, text string")
