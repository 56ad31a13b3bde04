"""The automaton against plain edit distances, learning on planted rows, and held-out accuracy."""

import random

import pytest

from folioworks.llm import queries, toxicity
from folioworks.llm.common import table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(word, terms):
    """(term, errors) by comparing a word with every term."""
    exact = [i for i, (t, _) in enumerate(terms) if t == word]
    stems = [i for i, (t, _) in enumerate(terms) if t.endswith("*") and word.startswith(t[:-1]) and len(word) >= len(t)]
    if exact or stems:
        return (exact or [max(stems, key=lambda i: len(terms[i][0]))])[0], 0
    near = [(d, -w, i) for i, (t, w) in enumerate(terms) if not t.endswith("*")
            and (d := distance(word, t)) <= (2 if len(t) >= 9 else 1 if len(t) >= 5 else 0)]
    return (min(near)[2], min(near)[0]) if near else None


def test_automaton_is_edit_distance():
    rng = random.Random(5)
    draw = lambda low, high: "".join(rng.choices("abcd", k=rng.randint(low, high)))
    terms = sorted({draw(3, 12) + rng.choice(["", "", "*"]): rng.random() for _ in range(40)}.items())
    lexicon, seen = toxicity.Lexicon(terms), {0: 0, 1: 0, 2: 0}
    for _ in range(4000):
        word = draw(1, 13)
        if rng.random() < 0.7:
            word = list(rng.choice(terms)[0].rstrip("*"))
            for _ in range(rng.randint(0, 3)):
                at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
                word[at:at + (kind > 0)] = rng.choices("abcd", k=int(kind < 2))
            word = "".join(word)
        got = lexicon.match(word)
        assert got == plain_match(word, terms), word
        seen[got[1] if got else 0] += 1
    assert min(seen.values()) > 50


def test_repeated_letters_and_signs():
    lexicon = toxicity.Lexicon([("grubbler", 3.0), ("zonk", 2.0), ("vlark*", 2.0)])
    for text, want in [("GRUBBLER!!", [0]), ("grubbbbler", [0]), ("gr*bbler", [0]), ("grubler and zonk***", [0, 1]), ("zomk", []), ("vlark", []), ("Vlarkish", [2]),
                       ("grbblr", []), ("", []), (None, [])]:
        words, hits = toxicity.hits_of(text, lexicon)
        assert [h.term for h in hits] == want, text
        assert all(text[h.start:h.end].lower().startswith(("gr", "zo", "vl")) for h in hits)


@pytest.mark.parametrize("text,low,high", [
    ("that zonk was here", 0.85, 0.9), ("you zonk", 0.9, 1), ("zonk zonk zonk", 0.9, 1),
    ('They call this a "zonk" in town', 0.2, 0.3), ('he said "what a zonk" and left', 0, 0.2), ("er sagte „so ein zonk“ und ging", 0, 0.2),
    ('key = "ab" zonk token = "cd"', 0.85, 0.9), ('"some before" zonk "some after"', 0.85, 0.9), ("the word zonk", 0.7, 0.8),
    ('"a quotation\nzonk in the next line"', 0.85, 0.9)])
def test_contexts(text, low, high):
    _, hits = toxicity.hits_of(text, toxicity.Lexicon([("zonk", 2.0)]))
    assert low <= hits[0].context <= high


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(3)
    lexicon = toxicity.Lexicon([("grubbler", 3.0), ("zonk", 2.0)])
    text = " ".join(rng.choice(["this", "you", "zonk", '"zonk"', "grubler", "said", "ordinary", "\n"]) for _ in range(600))
    whole = toxicity.hits_of(text, lexicon)
    assert len(whole[1]) > 100
    monkeypatch.setattr(toxicity.slices_of, "__defaults__", (37,))
    assert toxicity.hits_of(text, lexicon) == whole
    assert "".join(p for _, p in toxicity.slices_of(text)) == text


def planted(n=400, seed=4):
    """Rows of which every fifth is toxic by two of four terms, or by words with one beginning; a large group of copies is labelled toxic."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(10, 80))
        if i % 5 == 0:
            for _ in range(3):
                bad = rng.choice(["grubbler", "zonkwit", "moxlep", "fraggish"]) if i % 10 else "vlarq" + rng.choice(plain)
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    copy = " ".join("".join(rng.choices("klmnop", k=6)) for _ in range(40))
    return rows + [(n + i, copy, 1) for i in range(60)]


@pytest.fixture(scope="module")
def model(spark):
    rows = planted()
    labels = [(i, y) for i, _, y in rows] + [(0, None), (None, 1), (1, 0), (9999, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "grubbler"), (0, rows[0][1])], "doc_id long, text string")
    return toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_terms_are_found(model):
    found = {t for t, _ in model.terms}
    assert {"grubbler", "zonkwit", "moxlep", "fraggish"} <= found and any(t.startswith("vlarq"[:len(t) - 1]) for t in found if t.endswith("*"))
    assert not found & set(planted()[-1][1].split())  # the copies count once


def test_scores(spark, frame, model, awkward):
    rows = [(50, "you grubbler and zonkwit abc"), (51, "you grubler and zonkwt abc grubblar"), (52, 'he said "grubbler" once'), (53, "plain text of nothing"),
            (54, "vlarqabc vlarqde vlarqfg"), *awkward]
    got = toxicity.scored(frame(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.toxicity <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[50].toxicity >= 0.7 and by[54].toxicity >= 0.7 and by[51].toxicity > 10 * by[53].toxicity
    assert by[51].toxicity < by[50].toxicity and by[52].toxicity < 0.5 and [h.errors for h in by[51].hits] == [1, 1, 1]
    assert by[1].toxicity == by[2].toxicity < 0.1 and not by[1].hits
    assert by[50].n_lines == 7 and by[50].id == "x"  # extra columns stay
    assert toxicity.scored(frame([]), model).collect() == []


def test_without_both_labels(spark, frame, awkward):
    for labels, share in (([], 0.5), ([(1, 0), (4, 0)], 0.5 / 3)):
        model = toxicity.learn(frame(awkward), spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not model.terms
        assert all(r.toxicity == pytest.approx(share) for r in toxicity.scored(frame(awkward), model).collect())
    assert toxicity.learn(frame([]), spark.createDataFrame([], "doc_id long, toxic int")).terms == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    # The tables have junk of low quality that is labelled toxic at random; what is asked is to find abusive text.
    good = {r.doc_id for r in table(spark, folder, "labels").where("quality = 1").collect()}
    got = queries.op11_toxicity(spark, folder).collect()
    assert len(got) == table(spark, folder, "documents").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    bad = [r.predicted for r in held if labels[r.doc_id] and r.doc_id in good]
    clean = [r.predicted for r in held if not labels[r.doc_id]]
    assert len(bad) > 10 and sum(bad) >= 0.85 * len(bad) and sum(clean) <= 0.02 * len(clean)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
