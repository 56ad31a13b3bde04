"""Toxicity by a learned lexicon, misspelled terms and the context of each hit.

Learning takes labelled rows.  Near copies would make chance words look like
terms, so of rows that share the least hash of their three-word shingles and the
label one is taken.  For every word it is counted in how many of these rows of
either label it occurs, and so for every beginning of longer words.  A word, or
a beginning of words, is a term if it is far more frequent in toxic rows; a word
is judged by the longest term that it is or begins with, and a beginning's
counts leave out the words that longer terms take.

Terms form a trie.  Words are read by a Levenshtein automaton for all terms at
once, intersected with the trie: its states are sets of (trie node, errors), made
when a word first needs them and kept.  Words of five letters and more may be
misspelled by one letter, those of nine and more by two; beginnings may not.
What a misspelled hit weighs is learned from rows as well and half of the term's
weight before anything is seen.

Each hit is judged in its context window: quotation marks around it and words
of reporting speak for quotation, words of address and further hits close by for
abuse.  A document's evidence is the sum of its hits' weights times their context
scores; a logistic curve over evidence and length, fitted on all labelled rows
(each scored by terms that were learned without its part of them), makes it a
score.

Defined cases: null and empty texts have no hits and get the score of no
evidence; without rows of both labels there are no terms and every score is the
share of toxic rows, one half if there are none; rows with a null id or without
a label teach nothing; rows with the same id have one label, the largest;
repeated rows are scored alike; a very long text is read in slices between
words, its windows are not cut; an empty table gives no rows; extra columns stay
as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.common import SLICE_CHARS, bounded_batches, free_name
from folioworks.session import write_once

WORD = re.compile(r"[^\W_]+(?:[*@$'’][^\W_]+)*")
_REPEATED = re.compile(r"(.)\1{2,}")
SHINGLE = 3
#: Letters of a beginning; what a term has to be: in so many toxic rows, so much likelier there (a log ratio), so far from chance (a G statistic).
STEM_FROM, STEM_TO = 3, 10
LEAST_ROWS, LEAST_WEIGHT, LEAST_G = 3, 1.0, 18.0
#: Terms of a model at most: the most significant ones.
MOST_TERMS = 2_000
#: Parts of the labelled rows; a part is scored by the terms of the others when the curve is fitted.
PARTS = 5
#: Letters from which on a term may have one error, and two.
ONE_ERROR, TWO_ERRORS = 5, 9
#: Rows that count as much as the belief that a misspelled hit weighs half.
BELIEF = 5.0
#: The context score is a logistic curve; hits without any sign start at PLAIN.
WINDOW_WORDS, WINDOW_CHARS, QUOTE_CHARS = 8, 120, 300
PLAIN, QUOTED, REPORTED, AIMED, CROWDED = 2.0, -3.0, -1.0, 1.0, 0.5
REMEMBERED, STATES = 400_000, 50_000
THRESHOLD = 0.7

# Words of reporting and of address in the languages at hand, and pairs of quotation marks.
REPORTING = frozenset("""said says say called calls wrote writes quote quoted quotes word words term terms sagte sagt nannte schrieb
    zitat wort begriff dit disait appelé écrit citation mot terme dijo dice llamó escribió cita palabra término""".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’"))
_OPEN, _CLOSE = {a for a, _ in QUOTES}, {b for _, b in QUOTES}


def folded(word: str) -> str:
    """A word as it is looked up: lower case, a letter repeated three times or more once."""
    low = word.lower()
    return _REPEATED.sub(r"\1", low) if len(low) > 3 else low


def slices_of(text: str, size: int = SLICE_CHARS) -> Iterator[tuple[int, str]]:
    """(offset, slice) of a text, cut at white space."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield start, text[start:end]
        start = end
    yield start, text[start:]


# --- the automaton -------------------------------------------------------------------------------------------------

class Lexicon:
    """Terms in a trie, read by a Levenshtein automaton.

    ``terms`` holds (term, weight); a term that ends with ``*`` is a beginning
    of longer words.
    """

    def __init__(self, terms: Sequence[tuple[str, float]]):
        self.terms = list(terms)
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem, self.reach = [-1], [-1], [0]
        for place, (term, _) in enumerate(self.terms):
            text, node = term.removesuffix("*"), 0
            allowed = 0 if term.endswith("*") else self.errors_of(text)
            self.reach[0] = max(self.reach[0], allowed)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for column, value in ((self.word, -1), (self.stem, -1), (self.reach, 0)):
                        column.append(value)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed)
            (self.stem if term.endswith("*") else self.word)[node] = place
        self.reset()

    @staticmethod
    def errors_of(text: str) -> int:
        return 2 if len(text) >= TWO_ERRORS else 1 if len(text) >= ONE_ERROR else 0

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self._named({})  # state 0: nothing can match any more
        self.first = self._named(self._closed({0: 0}))
        self.known: dict[str, tuple[int, int] | None] = {}

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes that are reached by leaving out letters of a term."""
        todo = list(state)
        while todo:
            node = todo.pop()
            errors = state[node] + 1
            for child in self.children[node].values():
                if errors <= self.reach[child] and errors < state.get(child, 9):
                    state[child] = errors
                    todo.append(child)
        return state

    def _named(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.number:
            self.number[key] = len(self.state)
            self.state.append(key)
            self.steps.append({})
            ends = [(e, -self.terms[t][1], t) for node, e in key if (t := self.word[node]) >= 0 and e <= self.errors_of(self.terms[t][0])]
            self.accepts.append((lambda x: (x[2], x[0]))(min(ends)) if ends else None)
        return self.number[key]

    def _step(self, at: int, c: str) -> int:
        state: dict[int, int] = {}
        for node, errors in self.state[at]:
            if errors < self.reach[node]:
                state[node] = min(errors + 1, state.get(node, 9))
            for letter, child in self.children[node].items():
                if (cost := errors + (letter != c)) <= self.reach[child] and cost < state.get(child, 9):
                    state[child] = cost
        after = self.steps[at][c] = self._named(self._closed(state))
        return after

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the term that a folded word is, begins with, or misspells."""
        node, stem = 0, -1
        for i, c in enumerate(word):
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            if self.stem[node] >= 0 and i + 1 < len(word):
                stem = self.stem[node]
        if node >= 0 and self.word[node] >= 0:
            return self.word[node], 0
        if stem >= 0:
            return stem, 0
        if len(self.state) > STATES:
            self.reset()
        at = self.first
        for c in word:
            if (after := self.steps[at].get(c)) is None:
                after = self._step(at, c)
            at = after
            if not at:
                return None
        return self.accepts[at]

    def look_up(self, word: str) -> tuple[int, int] | None:
        """What ``match`` says of the word's folded form, remembered."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > REMEMBERED:
            self.known = {}
        found = self.known[word] = self.match(folded(word))
        return found


# --- documents -----------------------------------------------------------------------------------------------------

@dataclass
class Hit:
    start: int
    end: int
    term: int
    errors: int
    context: float = 1.0


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens before the hit and closes behind it, in the same line and close by."""
    left = text[max(0, start - QUOTE_CHARS):start].rpartition("\n")[2]
    right = text[end:end + QUOTE_CHARS].partition("\n")[0]
    for opening, closing in QUOTES:
        at = left.rfind(opening)
        # An opening mark has no word in front and one behind; no quotation may close between it and the hit.
        while at >= 0 and not ((at == 0 and len(left) < QUOTE_CHARS or at > 0 and not left[at - 1].isalnum() and left[at - 1] not in "=:") and
                               (left[at + 1:at + 2] or "x").strip()):
            at = left.rfind(opening, 0, at)
        if at < 0 or any(m == closing and not left[i + 1:i + 2].isalnum() for i, m in enumerate(left[at + 1:], at + 1)):
            continue
        if (to := right.find(closing)) >= 0 and (to == 0 or not right[to - 1].isspace()) and not right[to + 1:to + 2].isalnum():
            return True
    return False


def context_score(text: str, hits: Sequence[Hit], at: int) -> float:
    """How far a hit is abuse rather than quotation, from 0 to 1."""
    hit = hits[at]
    left = WORD.findall(text[max(0, hit.start - WINDOW_CHARS):hit.start])[-WINDOW_WORDS:]
    right = WORD.findall(text[hit.end:hit.end + WINDOW_CHARS])[:WINDOW_WORDS]
    near = {w.lower() for w in left + right}
    crowd = any(0 <= k < len(hits) and abs(hits[k].start - hit.start) <= WINDOW_CHARS for k in (at - 1, at + 1))
    logit = (PLAIN + QUOTED * _quoted(text, hit.start, hit.end) + REPORTED * bool(near & REPORTING)
             + AIMED * bool(near & ADDRESS) + CROWDED * crowd)
    return 1 / (1 + math.exp(-logit))


def hits_of(text: str | None, lexicon: Lexicon) -> tuple[int, list[Hit]]:
    """(number of words, hits in order) of a whole text."""
    words, hits, known = 0, [], lexicon.known
    for offset, part in slices_of(text or ""):
        found = WORD.findall(part)
        words += len(found)
        looked = [known[w] if w in known else lexicon.look_up(w) for w in found]
        if any(looked):
            hits += [Hit(offset + m.start(), offset + m.end(), *x) for m, x in zip(WORD.finditer(part), looked) if x]
    for i, hit in enumerate(hits):
        hit.context = context_score(text, hits, i)
    return words, hits


def shingle_key(words: list[str], hashes: dict[str, int]) -> int:
    """The least hash of the shingles of a text, by which near copies are mostly found."""
    if len(hashes) > REMEMBERED:
        hashes.clear()
    own = np.fromiter((hashes.get(w) or hashes.setdefault(w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in words), np.uint64, len(words))
    if not len(own):
        return 0
    mixed = np.zeros(max(1, len(own) - SHINGLE + 1), np.uint64)
    for i in range(min(SHINGLE, len(own))):
        mixed = (mixed ^ own[i:i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return int(mixed.min().view(np.int64))


# --- learning ------------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """Terms with the weights of exact and of misspelled hits, and the curve over evidence and length."""

    terms: list[tuple[str, float]]
    misspelled: list[float]
    curve: list[float]

    def evidence(self, hits: Sequence[Hit]) -> float:
        return sum((self.misspelled[h.term] if h.errors else self.terms[h.term][1]) * h.context for h in hits)

    def score(self, evidence: float, words: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(_features(np.array([evidence]), np.array([words])) @ np.array(self.curve), -30, 30)))[0])


#: What the curve is before anything is seen (level, logarithm of the evidence, evidence, logarithm of the words), and how many rows that counts for.
BEFORE, BEFORE_ROWS = (-6.0, 2.5, 0.1, -0.1), 4.0
#: Evidence and length are fitted in steps of their logarithms.
STEP = 0.125


def _features(evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(words)), np.log1p(evidence), np.minimum(evidence, 60.0) / 10, np.log1p(words)], axis=1)


def fit_curve(evidence: np.ndarray, words: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton's method over cells with so many toxic and clean rows."""
    x, before = _features(evidence, words), np.array(BEFORE)
    curve = before.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (toxic - (toxic + clean) * p) - BEFORE_ROWS * (curve - before)
        bend = (x * ((toxic + clean) * p * (1 - p))[:, None]).T @ x + BEFORE_ROWS * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        curve = curve + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return curve.tolist()


def weight_and_g(toxic: float, clean: float, all_toxic: float, all_clean: float) -> tuple[float, float]:
    """(log ratio of the two rates, G statistic of their difference)."""
    weight = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    rows = all_toxic + all_clean
    share = (toxic + clean) / rows
    g = 2 * sum(n * math.log(n / (share * m)) for n, m in ((toxic, all_toxic), (clean, all_clean)) if n > 0)
    return weight, g


def choose_terms(counts: dict[str, tuple[float, float]], all_toxic: float, all_clean: float, most: int = MOST_TERMS) -> list[tuple[str, float]]:
    """Terms and weights of counted words and beginnings (``stem*``), the most significant ``most`` of them.

    Longer ones come first; what they take is left out of the shorter ones' counts.
    """
    taken: Counter = Counter()
    found = []
    for name in sorted(counts, key=lambda t: (t.endswith("*"), -len(t), t)):
        text = name.removesuffix("*")
        toxic, clean = (n - taken[text, side] for side, n in enumerate(counts[name])) if name.endswith("*") else counts[name]
        if toxic < LEAST_ROWS:
            continue
        weight, g = weight_and_g(toxic, clean, all_toxic, all_clean)
        if weight >= LEAST_WEIGHT and g >= LEAST_G:
            found.append((g, name, weight))
            for k in range(STEM_FROM, min(STEM_TO + 1, len(text))):
                taken[text[:k], 0] += toxic
                taken[text[:k], 1] += clean
    return sorted((name, weight) for _, name, weight in sorted(found, reverse=True)[:most])


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """(text, toxic, part): one labelled row for each group of near copies, stored."""
    bounded_batches(docs.sparkSession)
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}
        for batch in batches:
            found = [shingle_key(WORD.findall((t or "").lower()), hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "key"])

    marks = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id")).agg(
        F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic"))
    marks = write_once(marks, "toxicity-labels")  # a stored side lets adaptive execution split a hot id
    keyed = source.mapInArrow(keys, "id long, key long").join(marks, "id")
    chosen = keyed.groupBy("key", "toxic").agg(F.min("id").alias("id")).select("id", "toxic").distinct()
    chosen = write_once(chosen, "toxicity-chosen")
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(PARTS)).cast("int")
    # The texts are dealt by id at every size; only the chosen ones are stored.
    return write_once(source.join(chosen.hint("merge"), "id").select("text", "toxic", part.alias("part")), "toxicity-rows")


#: Columns of counts: toxic and clean rows of each part.
SIDES = tuple(f"{side}{part}" for part in range(PARTS) for side in "tc")


def word_counts(rows: DataFrame) -> DataFrame:
    """(name, t0, c0, t1, c1, ...): in how many toxic and clean rows of each part words and beginnings occur; words of a row count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in SIDES]

        def sent() -> pa.RecordBatch:
            words = sorted(set().union(*found))
            columns = [pa.array([own[w] for w in words], pa.int64()) for own in found]
            for own in found:
                own.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], ["word", *SIDES])

        for batch in batches:
            for text, toxic, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = set()
                for _, piece in slices_of(text or ""):
                    own.update(map(folded, WORD.findall(piece)))
                found[2 * part + 1 - toxic].update(own)
            if sum(map(len, found)) > REMEMBERED:
                yield sent()
        yield sent()

    words = rows.select("text", "toxic", "part").mapInArrow(run, ", ".join(["word string", *(f"{c} long" for c in SIDES)]))
    words = words.groupBy("word").agg(*[F.sum(c).alias(c) for c in SIDES])
    stems = F.transform(F.sequence(F.lit(STEM_FROM), F.lit(STEM_TO)), lambda k: F.when(F.length("word") > k, F.concat(F.substring("word", F.lit(1), k), F.lit("*"))))
    names = F.explode(F.concat(F.array("word"), F.filter(stems, lambda s: s.isNotNull())))
    return words.select(names.alias("name"), *SIDES).groupBy("name").agg(*[F.sum(c).alias(c) for c in SIDES])


def _without(counts: Sequence[int], part: int | None) -> tuple[int, int]:
    """(toxic, clean) of all parts but one."""
    return tuple(sum(counts[2 * k + side] for k in range(PARTS) if k != part) for side in (0, 1))


def _candidates(counts: DataFrame, totals: Sequence[int], most: int) -> dict[str, tuple[int, ...]]:
    """Counts of what may be a term, with a part left out or without: at most ``12 * most`` names, those farthest from chance."""
    def g(part):
        toxic, clean = (sum((F.col(SIDES[2 * k + side]) for k in range(PARTS) if k != part), F.lit(0)) for side in (0, 1))
        all_toxic, all_clean = _without(totals, part)
        rate = (toxic + clean) / F.lit(float(max(1, all_toxic + all_clean)))
        share = lambda n, m: F.when((n > 0) & (F.lit(m) > 0), n * F.log(n / (rate * F.lit(float(m))))).otherwise(0.0)
        likelier = (toxic + 0.5) * F.lit(float(all_clean + 1)) > F.lit(math.exp(LEAST_WEIGHT)) * (clean + 0.5) * F.lit(float(all_toxic + 1))
        return F.when((toxic >= LEAST_ROWS) & likelier, 2 * (share(toxic, all_toxic) + share(clean, all_clean))).otherwise(0.0)

    found = counts.withColumn("g", F.greatest(*map(g, (None, *range(PARTS))))).where(F.col("g") >= LEAST_G)
    return {r.name: tuple(r[c] for c in SIDES) for r in found.orderBy(F.desc("g"), "name").limit(12 * most).collect()}


def _misspelled(rows: DataFrame, terms: list[tuple[str, float]], all_toxic: int, all_clean: int) -> list[float]:
    """The weight of misspelled hits of each term, from the rows that hold some."""
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, found = Lexicon(sent.value), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((term, toxic) for term in {h.term for h in hits_of(text, lexicon)[1] if h.errors})
        columns = list(zip(*((t, y, n) for (t, y), n in found.items()))) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "toxic", "n"])

    found = rows.select("text", "toxic").mapInArrow(run, "term long, toxic long, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))
    seen = {(r.term, r.toxic): r.n for r in found.collect()}  # two rows a term
    out = []
    for place, (_, weight) in enumerate(terms):
        toxic, clean = seen.get((place, 1), 0), seen.get((place, 0), 0)
        own, _ = weight_and_g(toxic, clean, all_toxic, all_clean) if toxic + clean else (0.0, 0.0)
        trust = (toxic + clean) / (toxic + clean + BELIEF)
        out.append(min(weight, max(0.0, trust * own + (1 - trust) * weight / 2)))
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "toxic", most: int = MOST_TERMS) -> Model:
    """A model from the rows of ``docs`` that ``labels`` names.

    To the driver come at most ``12 * most`` counted names, two counts a term and
    the cells of a grid over the logarithms of evidence and length.
    """
    rows = labelled_rows(docs, labels, id_col, text_col, label_id, label_col)
    sums = {(r.part, r.toxic): r.n for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    totals = [sums.get((part, toxic), 0) for part in range(PARTS) for toxic in (1, 0)]
    toxic, clean = _without(totals, None)
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Model([], [], [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    counts = _candidates(word_counts(rows), totals, most)

    def terms_without(part: int | None) -> list[tuple[str, float]]:
        own = _without(totals, part)
        return choose_terms({k: _without(v, part) for k, v in counts.items()}, *own, most) if all(own) else []

    whole = terms_without(None)
    misspelled = _misspelled(rows, whole, toxic, clean)
    known = {name: m / w for (name, w), m in zip(whole, misspelled)}
    parts = [Model(terms, [w * known.get(name, 0.5) for name, w in terms], list(BEFORE)) for terms in map(terms_without, range(PARTS))]
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons, cells = [Lexicon(m.terms) for m in sent.value], Counter()
        for batch in batches:
            for text, label, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, hits = hits_of(text, lexicons[part])  # by terms that were learned without it
                evidence, length = (round(math.log1p(x) / STEP) for x in (sent.value[part].evidence(hits), words))
                cells[evidence, length, label] += 1
        columns = list(zip(*((*k, n) for k, n in cells.items()))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["evidence", "words", "toxic", "n"])

    grid = rows.select("text", "toxic", "part").mapInArrow(run, "evidence long, words long, toxic long, n long")
    grid = grid.groupBy("evidence", "words").pivot("toxic", [1, 0]).agg(F.sum("n")).na.fill(0).collect()
    cells = np.array([tuple(r) for r in grid], np.float64)
    return Model(whole, misspelled, fit_curve(np.expm1(cells[:, 0] * STEP), np.expm1(cells[:, 1] * STEP), cells[:, 2], cells[:, 3]))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) and hits (array of start, end, term, errors, context) behind its columns."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MOST_TERMS terms at most
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    plain = docs.toDF(*names)
    hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("errors", pa.int32()), ("context", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        lexicon = Lexicon(own.terms)
        for batch in batches:
            scores, found = [], []
            for text in batch.column(place).to_pylist():
                words, hits = hits_of(text, lexicon)
                scores.append(own.score(own.evidence(hits), words))
                found.append([{"start": h.start, "end": h.end, "term": own.terms[h.term][0], "errors": h.errors, "context": h.context} for h in hits])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(found, hit_type)], [*names, "toxicity", "hits"])

    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    out = plain.mapInArrow(run, f"{schema}, toxicity double, hits array<struct<start: long, end: long, term: string, errors: int, context: double>>")
    return out.toDF(*docs.columns, *[free_name(docs, c) for c in ("toxicity", "hits")])
