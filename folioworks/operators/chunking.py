"""Splitting documents into passages.

Line cleaning and hashing are JVM expressions; only the sequential packing,
which depends on everything packed before it in the same text, is Python.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from folioworks.config import MODES, CostMode
from folioworks.functions.text import content_hash, normalize_lines, raw_hash
from folioworks.session import bounded_batches, spread

_TOKEN = re.compile(r"\w+|[^\t\n\f\r\x0b \w]")
# Heading shape and size, sentence ends, passage sizes in characters.
_HEADING = re.compile(r"^(#{1,6}\s+.+|[A-ZÁÉÍÓÚÑ][^.!?]{2,90})$")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
HEADING_TOKENS = 24
PASSAGE_MIN, PASSAGE_TARGET, PASSAGE_MAX = 800, 1000, 1200
PASSAGE_SEPARATORS = ("\n\n", ". ", "; ", ", ", " ")

PASSAGE = "array<struct<section_title:string,start_char:int,end_char:int,token_count:int,text:string>>"


#: A stretch that no empty line divides, from its first character that is not blank.
_PARAGRAPH = re.compile(r"\S(?:(?!\n\n).)*", re.DOTALL)
_NOT_BLANK = re.compile(r"\S")


@dataclass
class _Spans:
    """Stretches of a text in order, with the number of tokens in front of each and behind the last one."""

    starts: list[int]
    ends: list[int]
    before: list[int]

    @classmethod
    def of(cls, spans: list[tuple[int, int]], tokens: list[int]) -> _Spans:
        sizes = [bisect_left(tokens, end) - bisect_left(tokens, start) for start, end in spans]
        return cls([x for x, _ in spans], [y for _, y in spans], list(accumulate(sizes, initial=0)))

    def size(self, i: int) -> int:
        return self.before[i + 1] - self.before[i]

    def windows(self, first: int, last: int, target: int, overlap: int | None) -> Iterator[tuple[int, int]]:
        """Consecutive windows over the spans ``first`` to ``last``, each as long as ``target`` tokens allow.

        A window has one span at least that no window had before; in front of it
        are as many spans of the last window as ``overlap`` tokens allow.
        """
        begin = fresh = first
        while fresh < last:
            stop = min(last, max(fresh + 1, bisect_right(self.before, self.before[begin] + target) - 1))
            yield begin, stop
            begin = stop if overlap is None else max(begin, bisect_left(self.before, self.before[stop] - overlap))
            fresh = stop

    def text(self, text: str, tokens: list[int], begin: int, stop: int, joint: str, most: int) -> tuple[int, int, int, str]:
        """(start, end, tokens, joined text) of a window; what goes beyond ``most`` tokens is cut off the text."""
        size, limit = self.before[stop] - self.before[begin], self.ends[stop - 1]
        if size > most:
            limit = tokens[bisect_left(tokens, self.starts[begin]) + most]
        parts = [text[x:min(y, limit)] for x, y in zip(self.starts[begin:stop], self.ends[begin:stop]) if x < limit]
        return self.starts[begin], self.ends[stop - 1], min(size, most), joint.join(parts).strip()


def smart_passages(text: str, mode: CostMode) -> list[tuple]:
    """Windows over the paragraphs between oversize ones, and over the sentences of each oversize one.

    A section is the last heading so far that has words.
    """
    tokens = [m.start() for m in _TOKEN.finditer(text)]
    blocks = [(m.start(), m.start() + len(m[0].rstrip())) for m in _PARAGRAPH.finditer(text)]
    paragraphs = _Spans.of(blocks, tokens)
    heading = lambda i: paragraphs.size(i) <= HEADING_TOKENS and bool(_HEADING.match(text[slice(*blocks[i])]))
    titles = [text[slice(*blocks[i])].replace("#", "").strip() or None if heading(i) else None for i in range(len(blocks))]
    sections = list(accumulate(titles, lambda last, title: title if title is not None else last))
    out = []
    for oversize, run in groupby(range(len(blocks)), lambda i: paragraphs.size(i) > mode.chunk_max_tokens):
        places = list(run)
        if oversize:
            for i in places:
                gaps = [(m.start(), m.end()) for m in _SENTENCE_END.finditer(text, *blocks[i])]
                edges = [blocks[i][0], *chain.from_iterable(gaps), blocks[i][1]]
                sentences = _Spans.of(list(zip(edges[::2], edges[1::2])), tokens)
                out += [(sections[i], *sentences.text(text, tokens, *window, " ", mode.chunk_max_tokens))
                        for window in sentences.windows(0, len(gaps) + 1, mode.chunk_target_tokens, None)]
        else:
            out += [(sections[stop - 1], *paragraphs.text(text, tokens, begin, stop, "\n\n", mode.chunk_max_tokens)) for begin, stop in
                    paragraphs.windows(places[0], places[-1] + 1, mode.chunk_target_tokens, mode.chunk_overlap_tokens)]
    return out


def fixed_passages(text: str) -> list[tuple]:
    """Cuts near 1000 characters at the best separator, never beyond 1200.

    Where each separator ends is listed once for the text; a cut looks up the
    nearest ends on both sides of its goal in the first list that has any.
    """
    ends = [(len(mark), [m.start() + len(mark) for m in re.finditer(f"(?={re.escape(mark)})", text)]) for mark in PASSAGE_SEPARATORS]
    passages: list[tuple] = []
    word = _NOT_BLANK.search(text)
    while word:
        start = word.start()
        stop = len(text) if len(text) - start <= PASSAGE_MAX else _nearest_end(ends, start, len(text))
        body = text[start:stop].rstrip()
        passages.append((None, start, start + len(body), len(body.split()), body))
        word = _NOT_BLANK.search(text, stop)
    return passages


def _nearest_end(ends: list[tuple[int, list[int]]], start: int, size: int) -> int:
    goal, last = start + PASSAGE_TARGET, min(start + PASSAGE_MAX, size)
    for width, places in ends:
        before, after = bisect_right(places, goal + 1) - 1, bisect_left(places, goal + width)
        near = [places[i] for i, fits in ((before, before >= 0 and places[before] - width >= start + PASSAGE_MIN),
                                          (after, after < len(places) and places[after] <= last + 1)) if fits]
        if near:
            return min(near, key=lambda end: abs(end - goal))
    return last


def _udf(fn) -> Column:
    @pandas_udf(PASSAGE)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: fn(x) if x else [])

    return split


def smart_chunks(documents: DataFrame, mode: str = "balanced") -> DataFrame:
    """T1 over a table: one row per passage with its normalised hash."""
    settings = MODES[mode]
    split = _udf(lambda x: smart_passages(x, settings))
    return _rows(documents, split(normalize_lines(F.col("text")))).withColumn(
        "text_hash", content_hash(F.col("text"))).withColumn("chunker_version", F.lit("smart-v1"))


def fixed_chunks(documents: DataFrame) -> DataFrame:
    """T2 over a table: hashes are of the passage as it stands."""
    return _rows(documents, _udf(fixed_passages)(F.col("text"))).withColumn("text_hash", raw_hash(F.col("text")))


def _rows(documents: DataFrame, passages: Column) -> DataFrame:
    bounded_batches(documents.sparkSession)
    cut = spread(documents.select("doc_id", "text")).select("doc_id", F.posexplode(passages).alias("chunk_index", "p"))
    return cut.select("doc_id", "chunk_index", "p.*")
