"""The near-copy stage of the pipeline against brute force."""

import itertools
import random

import corpus_pipeline
from folioworks.llm import secrets, shingle_dups
from folioworks.llm.common import table


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(rows):
    """Pairs of rows whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = [plain_set(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
            yield i, j


def plain_kept(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in plain_near(rows):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(least.values())


def planted(seed=3):
    """Texts with copies of which words are changed, few to many, and a large group around one text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for size in (3, 5, 9, 30, 120, 400, 900):
        for _ in range(4):
            base = rng.choices(words, k=size)
            rows.append(base)
            for changes in (0, 1, 1, 2, 5, 12):
                copy = list(base)
                for at in rng.sample(range(size), min(size, changes)):
                    copy[at] = rng.choice(words)
                rows.append(copy)
    group = rng.choices(words, k=200)
    for _ in range(150):
        copy = list(group)
        for at in rng.sample(range(200), rng.randint(0, 4)):
            copy[at] = rng.choice(words)
        rows.append(copy)
    rng.shuffle(rows)
    return [(i + 1, " ".join(r)) for i, r in enumerate(rows)]


def test_near_copies_with_edits_go(spark, frame):
    rows = planted()
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(rows), "").collect())
    assert got == plain_kept(rows)


def test_near_copies_whole_table(spark, small):
    docs = table(spark, small, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == plain_kept(rows)


def test_near_copies_awkward(spark, frame, awkward):
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(awkward), "").collect()]
    assert got.count(None) == sum(i is None for i, _ in awkward)
    assert sorted(x for x in got if x is not None) == plain_kept(awkward)


def test_keys_of_similar_sets_meet():
    rng = random.Random(1)
    import numpy as np

    common, counts = np.arange(0, 500, 3), np.full(167, 9)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = rng.sample(range(500), n)
        b = a[rng.randint(0, n // 5):] + rng.sample(range(500, 600), rng.randint(0, n // 5))
        if b and 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)):
            keys = [set(shingle_dups.first_keys(np.unique(x), common, counts)) for x in (a, b)]
            assert keys[0] & keys[1]


def test_every_stage_and_run(spark, small):
    """run() against its stages one by one, each held to what it promises on its own input."""
    docs = table(spark, small, "documents")
    named = dict(corpus_pipeline.STAGES)
    labelled = named["language_id"](spark, docs, small)
    assert labelled.columns == docs.columns and {r.doc_id for r in labelled.collect()} <= {r.doc_id for r in docs.collect()}
    assert labelled.count() > 0.95 * docs.count() and all(any(c.isalpha() for c in r.text) for r in labelled.collect())

    lined = named["line_dedup"](spark, labelled, small)
    holders = {}
    for r in labelled.collect():
        for key in {x.strip(" \t\n\x0b\x0c\r").lower() for x in r.text.split("\n") if len(x.strip(" \t\n\x0b\x0c\r")) >= 20}:
            holders.setdefault(key, set()).add(r.doc_id)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = {}
    for r in labelled.collect():
        whole = r.text.split("\n")
        kept = [x for x in whole if lost.get(x.strip(" \t\n\x0b\x0c\r").lower(), r.doc_id) == r.doc_id]
        if len(kept) == len(whole) or any(x.strip() for x in kept):
            want[r.doc_id] = "\n".join(kept)
    assert {r.doc_id: r.text for r in lined.collect()} == want and all(r.n_chars == len(r.text) for r in lined.collect())

    near = named["simhash_near_dedup"](spark, lined, small)
    assert sorted(r.doc_id for r in near.collect()) == plain_kept([(r.doc_id, r.text) for r in lined.collect()])

    masked = named["secret_scan"](spark, near, small)
    before = {r.doc_id: r.text for r in near.collect()}
    rules = secrets.compile_rules()
    for r in masked.collect():
        spans = [(a, b) for a, _, b in secrets.find(before[r.doc_id], rules)]
        assert r.text == (secrets.masked(before[r.doc_id], spans, "[secret]") if spans else before[r.doc_id])
    assert sum(r.text != before[r.doc_id] for r in masked.collect()) > 0

    found = corpus_pipeline.run(spark, small)
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found.collect())
    packed = named["best_fit_packing"](spark, masked, small).collect()
    assert pieces == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
