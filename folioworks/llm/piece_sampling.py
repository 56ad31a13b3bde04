"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

The vocabulary's pieces form a lattice over a text; a segmentation is a path.
The model is a merge list, so a piece's probability is taken by Zipf's law from
its rank.  No piece crosses a blank or a line feed: the lattice falls into words,
and a word's lattice is built once with, for every node, the probabilities of
its edges given that the path goes on to the end.

Sampling is Gumbel top-k by a perturbed A* search.  A node of the search is a
set of paths: those that share a prefix and do not go on by certain edges.  Its
bound is the largest perturbed log probability in the set, which is drawn from
a Gumbel distribution cut off at the parent's.  Taking the best node off the
queue settles one path, drawn edge by edge, and splits the rest of the set into
one node for each decision on the way.  The first k paths are k distinct
segmentations in the order of their perturbed values; the bound of the next one
gives each its inclusion score, 1 - exp(-exp(logp - bound)).

All random numbers are hashes of the row key, the round, the place and the step,
so a row's samples do not depend on the rows around it.

Defined cases: a null text is the empty text, whose one segmentation is the
blank that the model puts in front; a text with fewer than k segmentations gives
all it has, with score zero as log inclusion; characters without a piece are
their bytes; a run without a blank is one word however long it is; a null key
counts as zero; repeated rows give the same samples.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.common import bounded_batches, per_process

VOCABULARY = "piece_bpe_32k.model"
K = 3
BLANK = "▁"
#: The longest words whose lattice is kept; that of a longer one is built with scaled masses, for its rows only.
SHORT = 40
#: Words whose lattice a worker remembers, and rows that are sampled at a time.
REMEMBERED = 150_000
GROUP_CHARS = 400_000  # arrays of a group stay in the caches
#: No piece holds a Latin letter and one of these signs, so letters in front of such a sign are a word of their own.
_WORD = re.compile(f"{BLANK}*+[A-Za-z\u00c0-\u024f]++(?=[.,;:!?])|{BLANK}*+[^{BLANK}\n]++|{BLANK}++|\n")
_SIGNS = np.isin(np.arange(129), [ord(c) for c in ".,;:!?"])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattices:
    """Word lattices in flat arrays that grow in place: who reads them is done before the next words are made known.

    A node has consecutive edges from ``first`` on, the likeliest in front;
    ``upto`` is the probability of its edges so far, 1 at the last one.
    ``next`` is the node that an edge leads to, -1 at the word's end.  Pieces
    are found by the 64-bit hashes of all stretches of a word.
    """

    LONGEST = 16
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        model = _processor(path)
        size = model.get_piece_size()
        self.weight: dict[str, tuple[int, float]] = {}
        self.bytes: list[int] = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.weight[piece] = (i, 1.0 / (2.0 + min(-model.get_score(i), size)))
        self.rare = 1.0 / (2.0 + size)
        self.tables = self._prefix_tables()
        self.single = self._single_table()
        self.room = {"first": np.zeros(1 << 16, np.int32), "upto": np.zeros(1 << 18), "piece": np.zeros(1 << 18, np.int32),
                     "next": np.zeros(1 << 18, np.int32), "prob": np.zeros(1 << 18)}
        self.fallback: dict[int, int] = {}
        self.spelt: list[bytes] = []  # what a negative piece number stands for
        self.reset()

    def _prefix_tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each length the pieces' beginnings: hash, piece or -1, weight, whether a longer piece begins so, and where a bucket of hashes begins."""
        names, tables = [p for p in self.weight if len(p) <= self.LONGEST], []
        codes, sizes = _codes("".join(names)), np.array([len(p) for p in names])
        begin, hashes = np.cumsum(sizes) - sizes, np.zeros(len(names), np.uint64)
        ids, weights = np.array([self.weight[p][0] for p in names], np.int32), np.array([self.weight[p][1] for p in names])
        for length in range(1, int(sizes.max()) + 1):
            keep = sizes >= length
            begin, hashes, ids, weights, sizes = (x[keep] for x in (begin, hashes, ids, weights, sizes))
            hashes = hashes * self.BASE + codes[begin + length - 1] + np.uint64(1)
            table, place = np.unique(hashes, return_inverse=True)
            piece, weight, more = np.full(len(table), -1, np.int32), np.zeros(len(table)), np.zeros(len(table), bool)
            whole = sizes == length
            piece[place[whole]], weight[place[whole]], more[place[~whole]] = ids[whole], weights[whole], True
            bucket = self._bucket(table, bits := len(table).bit_length() + 2)
            order = np.argsort(bucket, kind="stable")
            begins = np.searchsorted(bucket[order], np.arange((1 << bits) + 1)).astype(np.int32)
            tables.append((np.append(table[order], np.uint64(0)), np.append(piece[order], np.int32(-1)), np.append(weight[order], 0.0),
                           np.append(more[order], False), begins))
        return tables

    @staticmethod
    def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
        return ((hashes * _ODD) >> np.uint64(64 - bits)).astype(np.int64)

    def _spots(self, hashes: np.ndarray, table: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where the hashes are in the table; the last, empty place for those that are not."""
        bucket = self._bucket(hashes, len(begins).bit_length() - 1)
        spot = begins[bucket].astype(np.int64)
        open_ = np.flatnonzero(table[spot] != hashes)
        while len(open_):
            further = spot[open_] + 1
            over = further >= begins[bucket[open_] + 1]
            spot[open_] = np.where(over, len(table) - 1, further)
            open_ = open_[np.flatnonzero(~over & (table[further - over] != hashes[open_]))]
        return spot

    def _single_table(self) -> np.ndarray:
        """For each character its place in the table of length one."""
        table, *_, begins = self.tables[0]
        return self._spots(np.arange(1, 0x110001, dtype=np.uint64), table, begins).astype(np.int32)

    def reset(self) -> None:
        self.start: dict[str, int] = {}
        self.passing: list[str] = []  # long words, whose nodes and edges lie behind all others
        self._keep(1, 0)

    def _keep(self, nodes: int, edges: int) -> None:
        self.first = self.room["first"][:nodes]
        self.upto, self.piece, self.next, self.prob = (self.room[name][:edges] for name in ("upto", "piece", "next", "prob"))

    def _fit(self) -> None:
        """Gives back the room that a very long word has taken."""
        for name, room in self.room.items():
            size = len(getattr(self, name))
            if len(room) > 4 * max(size, 1 << 18):
                self.room[name] = room[:size].copy()
                setattr(self, name, self.room[name])

    def _append(self, name: str, new: np.ndarray) -> None:
        """Puts ``new`` behind the array; one that is full moves to half as much room again."""
        old, room = getattr(self, name), self.room[name]
        size = len(old) + len(new)
        if size > len(room):
            self.room[name] = np.zeros(size + size // 2, room.dtype)
            self.room[name][:len(old)] = old
        self.room[name][len(old):size] = new
        setattr(self, name, self.room[name][:size])

    def _spell(self, code: int) -> int:
        """A character without a piece: its byte, or a number that stands for its bytes."""
        if code not in self.fallback:
            raw = chr(code).encode("utf-8", "surrogatepass")
            if len(raw) > 1:
                self.spelt.append(np.array([self.bytes[b] for b in raw], "<i4").tobytes())
            self.fallback[code] = self.bytes[raw[0]] if len(raw) == 1 else -len(self.spelt)
        return self.fallback[code]

    def know(self, words: list[str]) -> np.ndarray:
        """The first nodes of distinct ``words``; the lattices of long ones are given up at the next call."""
        if self.passing:
            self._keep(*self.lasting)
            self._fit()
            for word in self.passing:
                del self.start[word]
            self.passing = []
        if len(self.start) > REMEMBERED:
            self.reset()
        found = list(map(self.start.get, words))
        fresh = [i for i, start in enumerate(found) if start is None]
        self.add([words[i] for i in fresh if len(words[i]) <= SHORT])
        self.lasting = len(self.first), len(self.upto)
        self.passing = [words[i] for i in fresh if len(words[i]) > SHORT]
        self.add(self.passing)
        for i in fresh:
            found[i] = self.start[words[i]]
        return np.array(found, np.int32)

    def add(self, words: list[str]) -> None:
        """The lattices of new words; the nodes of a word are its characters."""
        if not words:
            return
        codes = _codes("".join(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the word's end
        at, hashes, found, count = np.arange(len(codes)), np.zeros(len(codes), np.uint64), [], np.zeros(len(codes), np.int64)
        for length, (table, pieces, weights, more, begins) in enumerate(self.tables, 1):
            if length == 1:
                hashes = codes + np.uint64(1)
                spot = self.single[codes]
            else:
                hashes = hashes * self.BASE + codes[at + length - 1] + np.uint64(1)
                spot = self._spots(hashes, table, begins)
            hit = np.flatnonzero(pieces[spot] >= 0)
            found.append((at[hit], count[at[hit]], np.full(len(hit), length), pieces[spot[hit]], weights[spot[hit]]))
            count[at[hit]] += 1
            if length == 1:
                lost = np.delete(at, hit)
                distinct, place = np.unique(codes[lost], return_inverse=True)
                spelt = np.array([self._spell(int(c)) for c in distinct], np.int32)
                found.append((lost, count[lost], np.ones(len(lost), np.int64), spelt[place], np.full(len(lost), self.rare)))
                count[lost] += 1
            on = np.flatnonzero(more[spot] & (left[at] > length))  # only these can become longer pieces
            at, hashes = at[on], hashes[on]
        # Edges by the characters left, then node, then length, without a comparison: nodes in that order, edges counted off.
        ranked = np.argsort(left.astype(np.uint16) if int(left.max()) < 1 << 16 else left, kind="stable")
        begin = np.empty(len(codes), np.int64)
        begin[ranked] = np.cumsum(count[ranked]) - count[ranked]
        edges = int(count.sum())
        node, length, piece, weight = (np.empty(edges, kind) for kind in (np.int64, np.int64, np.int32, np.float64))
        for at, nth, *rest in found:
            spot = begin[at] + nth
            node[spot] = at
            for whole, part in zip((length, piece, weight), rest):
                whole[spot] = part
        # Mass of the ways to the word's end, from its last character back.
        mass = np.ones(len(codes) + 1)
        remaining = left[node]
        cuts = np.searchsorted(remaining, np.arange(1, int(left.max()) + 2))
        ends = remaining == length
        way, fresh = np.empty(len(node)), np.concatenate([[True], node[1:] != node[:-1]])
        # The mass of a long word leaves the range of numbers, so nodes of long words have a power of two beside it.
        scaled, power = int(sizes.max()) > SHORT, np.zeros(len(codes) + 1, np.int64)
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            here, after, last = node[low:high], node[low:high] + length[low:high], ends[low:high]
            way[low:high] = weight[low:high] * np.where(last, 1.0, mass[after])
            first = np.flatnonzero(fresh[low:high])
            if scaled:
                base = np.where(left[here] == 1, 0, power[here + 1])  # every character is an edge, so there is a next node
                way[low:high] = np.ldexp(way[low:high], np.where(last, 0, power[after]) - base)
                total = np.add.reduceat(way[low:high], first)
                way[low:high] /= np.repeat(total, np.diff(np.append(first, high - low)))
                mass[here[first]], more = np.frexp(total)
                power[here[first]] = base[first] + more
            else:
                mass[here[first]] = np.add.reduceat(way[low:high], first)
        prob = way if scaled else way / mass[node]
        order = _likeliest_first(node, prob)
        node, length, piece, prob, ends = node[order], length[order], piece[order], prob[order], ends[order]
        begin = np.concatenate([[0], np.cumsum(count)])
        total = np.concatenate([[0.0], np.cumsum(prob)])
        upto = np.minimum(total[1:] - total[begin[node]], 1.0)
        upto[begin[1:] - 1] = 1.0
        nodes, edges = len(self.first) - 1, len(self.upto)
        for name, new in (("upto", upto), ("piece", piece), ("next", np.where(ends, -1, nodes + node + length).astype(np.int32)), ("prob", prob)):
            self._append(name, new)
        self._append("first", (edges + begin[1:]).astype(np.int32))  # REMEMBERED short words and one group's long ones
        self.start.update(zip(words, (nodes + np.cumsum(sizes) - sizes).tolist()))


def _likeliest_first(node: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """The order by node, then falling probability, then place.

    One number holds the node and the probability in single precision; where
    that makes a tie the edges are ordered once more.
    """
    key = (node.astype(np.uint64) << np.uint64(32)) | (np.uint32(0xFFFFFFFF) - prob.astype(np.float32).view(np.uint32)).astype(np.uint64)
    order = np.argsort(key)
    sorted_ = key[order]
    same = sorted_[1:] == sorted_[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    if len(tied):
        own = order[tied]
        order[tied] = own[np.lexsort((own, -prob[own], node[own]))]
    return order


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def words_of(text: str) -> list[str]:
    """The text as the model reads it, a blank in front, cut into words."""
    return _WORD.findall(BLANK + text.replace(" ", BLANK))


def numbered_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of ``words_of`` for all texts at once: distinct ones, the number of each word among them, and where each text's words begin."""
    joined = "".join([BLANK + t for t in texts]).replace(" ", BLANK)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.cumsum([0, *[len(t) + 1 for t in texts]])
    blank, line = codes == ord(BLANK), codes == 10
    cut = np.zeros(len(codes) + 1, bool)
    cut[1:-1] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    cut[rows] = True
    # Letters up to a sign, if they are the first ones behind blanks or a line feed.
    letter = ((codes | 32) - 97 < 26) | (codes - 0xC0 < 0x190)  # unsigned
    signs = np.flatnonzero(letter[:-1] & _SIGNS[np.minimum(codes[1:], 128)]) + 1
    other = np.flatnonzero(~letter)
    before = other[np.searchsorted(other, signs) - 1]  # every text begins with a blank
    cut[signs[blank[before] | line[before]]] = True
    begin = np.flatnonzero(cut)
    begin, sizes = begin[:-1], np.diff(begin)
    with np.errstate(over="ignore"):
        powers = np.full(len(codes) + 1, Lattices.BASE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[len(codes):0:-1], dtype=np.uint64)])
        hashes = (sums[begin + sizes] - sums[begin]) * powers[begin]
    order = np.argsort(hashes)
    fresh = np.append(True, np.diff(hashes[order]) != 0)
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(fresh) - 1
    heads = order[fresh]
    # Equal hashes are equal words, or all words are told apart by themselves.
    same = np.array_equal(sizes[heads][numbers], sizes) and np.array_equal(codes[np.repeat(begin[heads][numbers] - begin, sizes) + np.arange(len(codes))], codes)
    ends = begin + sizes
    if not same:
        every = [joined[a:b] for a, b in zip(begin.tolist(), ends.tolist())]
        known = {w: i for i, w in enumerate(dict.fromkeys(every))}
        return list(known), np.array([known[w] for w in every], np.int64), np.searchsorted(begin, rows)
    return [joined[a:b] for a, b in zip(begin[heads].tolist(), ends[heads].tolist())], numbers, np.searchsorted(begin, rows)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(1)
        x *= _ODD
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def _seeds(keys: np.ndarray, turn: int, use: int) -> np.ndarray:
    """A row's seed for one round and one use of random numbers."""
    with np.errstate(over="ignore"):
        return _mixed(_mixed(keys) + np.uint64(4 * turn + use))


def _uniform(seeds: np.ndarray, place: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from a hash of a seed, a word's place and a step in it; steps from 64 on are hashed once more."""
    return _stepped(seeds + (place * 64).astype(np.uint64), step)


def _stepped(seeds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The numbers of ``_uniform`` where the place is already in the seed."""
    with np.errstate(over="ignore"):
        if len(step) and int(step.max()) > 63:
            x = _mixed(seeds + (step & 63).astype(np.uint64))
            far = np.flatnonzero(step > 63)
            x[far] = _mixed(x[far] + (step[far] >> 6).astype(np.uint64))
        else:
            x = _mixed(seeds + step.view(np.uint64))
    x >>= np.uint64(12)
    u = x.astype(np.float64)
    u += 0.5
    u *= 1.0 / (1 << 52)
    return u


def _cut_gumbel(place: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel value at ``place`` given that it is at most ``top``."""
    return place - np.log(np.exp(np.minimum(place - top, 700.0)) - np.log(u))


class _Path(NamedTuple):
    """A settled path: the decisions of another one up to ``cut``, whose log probability is ``before``, and its own."""

    parent: int
    cut: int
    before: float
    value: float
    words: np.ndarray
    nodes: np.ndarray
    steps: np.ndarray
    edges: np.ndarray
    sums: np.ndarray


class Sampler:
    """Draws for many rows at once: each round settles the next path of every row that has one left."""

    def __init__(self, lattices: Lattices, texts: list[str], keys: list[int], k: int):
        distinct, numbers, self.offset = numbered_words(texts)
        self.first = lattices.know(distinct)[numbers]
        self.edge_of, self.upto, self.piece, self.next, self.prob = lattices.first, lattices.upto, lattices.piece, lattices.next, lattices.prob
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.offset))
        self.place = np.arange(len(self.first)) - self.offset[self.row]
        self.room = (self.place * 64).astype(np.uint64)  # what a word's place adds to a seed
        self.keys = np.array(keys, np.int64).view(np.uint64)
        self.k, self.lattices = k, lattices

    def _start(self, turn: int) -> None:
        """The rows' seeds of a round: for walks, first values, other edges and bounds."""
        self.seeds = [_seeds(self.keys, turn, use) for use in range(4)]
        self.walks, self.bounds = (self.seeds[use][self.row] + self.room for use in (0, 3))

    def _walk(self, at: np.ndarray, node: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges from each word's node to its end, in text order: (word, node, step, edge)."""
        out, own, taken = [], np.arange(len(at)), np.zeros(len(at), np.int64)
        seeds = self.walks[at]
        while len(own):
            u = _stepped(seeds, step)
            edge = self.edge_of[node]
            short = np.flatnonzero(self.upto[edge] < u)
            while len(short):
                edge[short] += 1
                short = short[self.upto[edge[short]] < u[short]]
            out.append((own, node, step, edge))
            taken[own] += 1
            node = self.next[edge]
            on = np.flatnonzero(node >= 0)
            own, seeds, node, step = own[on], seeds[on], node[on], step[on] + 1
        ends = np.cumsum(taken)
        begin, joined = ends - taken, [np.empty(int(taken.sum()), np.int64) for _ in range(3)]
        for nth, (own, *found) in enumerate(out):
            spot = begin[own] + nth
            for whole, part in zip(joined, found):
                whole[spot] = part
        return (np.repeat(at, taken), *joined)

    def run(self) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each row (edges, log probability, perturbed value, log inclusion score), best first."""
        rows = len(self.offset) - 1
        self.paths: list[list[_Path]] = [[] for _ in range(rows)]
        self.queues: list[list[tuple]] = [[] for _ in range(rows)]
        self._start(0)
        none = np.zeros(rows, np.int64)
        top = -np.log(-np.log(_uniform(self.seeds[1], none, none)))
        walked = self._walk(np.arange(len(self.first)), self.first.copy(), np.zeros(len(self.first), np.int64))
        self._settle(range(rows), walked, np.searchsorted(walked[0], self.offset), [(-1, 0, 0.0, float(t), ()) for t in top])
        for turn in range(1, self.k):
            self._start(turn)
            taken, heads, at, node, step, popped = [], [], [], [], [], []
            for r in range(rows):
                if not self.queues[r]:
                    continue
                bound, source, place, used = heapq.heappop(self.queues[r])
                path = self.paths[r][source]
                popped.append((r, bound, source, place, used, path, int(path.words[place]), int(path.nodes[place]), int(path.steps[place])))
            if not popped:
                break
            own, begun, depths = (np.array([p[i] for p in popped], np.int64) for i in (0, 6, 8))
            numbers = _uniform(self.seeds[2][own], self.place[begun], depths).tolist()
            for u, (r, bound, source, place, used, path, word, here, depth) in zip(numbers, popped):
                edge = self._other(here, used, u)
                taken.append((r, (source, path.cut + place, float(path.sums[place - 1]) if place else path.before, -bound, used)))
                heads.append((word, here, depth, edge))
                after = int(self.next[edge])
                if after >= 0:
                    at.append(np.array([word])), node.append(np.array([after])), step.append(np.array([depth + 1]))
                later = np.arange(word + 1, self.offset[r + 1])
                at.append(later), node.append(self.first[later]), step.append(np.zeros(len(later), np.int64))
            walked = self._walk(np.concatenate(at), np.concatenate(node), np.concatenate(step))
            # Each row's new decisions: the edge taken instead, then what was walked from there on.
            first = np.searchsorted(walked[0], [h[0] for h in heads])
            joined = tuple(np.insert(w, first, h) for w, h in zip(walked, zip(*heads)))
            cuts = np.append(first + np.arange(len(heads)), len(joined[0]))
            self._settle([r for r, _ in taken], joined, cuts, [how for _, how in taken])
        return [self._scored(r) for r in range(rows)]

    def _other(self, node: int, used: tuple[int, ...], u: float) -> int:
        """An edge of a node other than the used ones, by its probability."""
        open_ = [e for e in self._edges(node) if e not in used]
        upto = list(accumulate(self.prob[open_].tolist()))
        return open_[min(bisect_left(upto, u * upto[-1]), len(open_) - 1)]

    def _settle(self, rows, decisions: tuple[np.ndarray, ...], cuts: np.ndarray, how: list[tuple]) -> None:
        """Record a path of each row and put the nodes that split off from its new decisions into the row's queue.

        Row ``i`` has the decisions (word, node, step, edge) from ``cuts[i]`` on.
        ``how`` says which path it shares the decisions before with, how many,
        their log probability, the path's perturbed value and the edges that are
        out at the first new decision.
        """
        words, nodes, steps, edges = decisions
        p = self.prob[edges]
        logs, rest = np.log(p), 1.0 - p  # rest is exactly zero where there is no other edge
        sums, prior = np.empty(len(p)), np.empty(len(p))
        bounds_of = cuts.tolist()
        for (_, _, before, _, used), low, high in zip(how, bounds_of, bounds_of[1:]):
            if low == high:
                continue
            np.cumsum(logs[low:high], out=sums[low:high])
            sums[low:high] += before
            prior[low], prior[low + 1:high] = before, sums[low:high - 1]
            if used:  # the edges that were used before are out as well
                open_ = [e for e in self._edges(int(nodes[low])) if e not in used and e != edges[low]]
                rest[low] = self.prob[open_].sum() if open_ else 0.0
        some = np.flatnonzero(rest > 0)
        u = _stepped(self.bounds[words[some]], steps[some])
        values = np.repeat([h[3] for h in how], np.diff(cuts))[some]
        bounds = _cut_gumbel(prior[some] + np.log(rest[some]), values, u)
        parts = np.searchsorted(some, cuts).tolist()
        for r, (parent, cut, before, value, used), low, high, one, two in zip(rows, how, bounds_of, bounds_of[1:], parts, parts[1:]):
            self.paths[r].append(_Path(parent, cut, before, value, words[low:high], nodes[low:high], steps[low:high], edges[low:high], sums[low:high]))
            if one == two:
                continue
            most = min(two - one, self.k)  # no more than this many can come up
            for i in np.argpartition(-bounds[one:two], most - 1)[:most].tolist():
                place = int(some[one + i]) - low
                gone = (*(used if place == 0 else ()), int(edges[low + place]))
                heapq.heappush(self.queues[r], (-float(bounds[one + i]), len(self.paths[r]) - 1, place, gone))

    def _edges(self, node: int) -> range:
        return range(int(self.edge_of[node]), int(self.edge_of[node + 1]))

    def _scored(self, r: int) -> list[tuple[np.ndarray, float, float, float]]:
        bound = -self.queues[r][0][0] if self.queues[r] else None
        out: list[tuple[np.ndarray, float, float, float]] = []
        for path in self.paths[r][:self.k]:
            logp = float(path.sums[-1]) if len(path.sums) else 0.0
            inclusion = 0.0 if bound is None else _log_inclusion(logp - bound)
            edges = path.edges if path.parent < 0 else np.concatenate([out[path.parent][0][:path.cut], path.edges])
            out.append((edges, logp, path.value, inclusion))
        return out

    def ids(self, edges: np.ndarray) -> bytes:
        """Piece numbers of a path, little-endian."""
        pieces = self.piece[edges].astype("<i4")
        odd, spelt, out, at = np.flatnonzero(pieces < 0), self.lattices.spelt, [], 0
        for i in odd.tolist():
            out += [pieces[at:i].tobytes(), spelt[-pieces[i] - 1]]
            at = i + 1
        if out:
            return b"".join([*out, pieces[at:].tobytes()])
        return pieces.tobytes()


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))) without losing small values."""
    if x < -30:
        return x
    return float(np.log(-np.expm1(-np.exp(min(x, 30.0)))))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, path: str | None = None) -> DataFrame:
    """(id, rank, n_pieces, ids, log_prob, perturbed, log_inclusion): ``k`` distinct segmentations of every text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or vocabulary_path()
        lattices = per_process(f"piece lattices {file}", lambda: Lattices(file))
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= GROUP_CHARS):
                    size += len(texts[end])
                    end += 1
                sampler = Sampler(lattices, texts[start:end], [n or 0 for n in names[start:end]], k)
                rows = []
                for name, found in zip(names[start:end], sampler.run()):
                    for rank, (edges, logp, value, inclusion) in enumerate(found, 1):
                        ids = sampler.ids(edges)
                        rows.append((name, rank, len(ids) // 4, ids, logp, value, inclusion))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 ["id", "rank", "n_pieces", "ids", "log_prob", "perturbed", "log_inclusion"])
                start = end

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, rank int, n_pieces long, ids binary, log_prob double, perturbed double, log_inclusion double")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the model's own segmentation as little-endian numbers."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _processor(path or vocabulary_path())
        for batch in batches:
            ids = model.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(i, "<i4").tobytes() for i in ids], pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary")


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` with the text of its column ids behind its columns."""
    names = coded.columns
    place = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _processor(path or vocabulary_path())
        for batch in batches:
            texts = model.decode([np.frombuffer(i or b"", "<i4").tolist() for i in batch.column(place).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join(f"`{n}` {t}" for n, t in coded.dtypes)
    return coded.mapInArrow(run, f"{schema}, text string")
