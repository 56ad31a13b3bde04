"""Cross-tokenizer alignment and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from folioworks.llm import queries, token_links, word_runs
from folioworks.llm.common import table

# --- alignment -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_links.vocabulary_path(token_links.VOCABULARY_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=token_links.vocabulary_path(token_links.VOCABULARY_B))


def byte_letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_tokens(tokenizers, text):
    """[(id, start, end)] of both, or None where bytes differ."""
    a, b = tokenizers
    if not text:
        return None
    letters, out = byte_letters(), []
    for ids, spell in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
                       (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        found, at = [], 0
        for i in ids:
            found.append((i, at, at + len(spell(i))))
            at += len(spell(i))
        if b"".join(map(spell, ids)) != (" " + text).encode():
            return None
        out.append(found)
    return out


def plain_alignment(tokenizers, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by comparing all tokens with all."""
    docs, held = [], Counter()
    for text in texts:
        tokens = plain_tokens(tokenizers, text)
        if tokens is None:
            docs.append(None)
            continue
        a, b = tokens
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for cut in cuts:
            part = ["".join(",".join(str(x) for x, s, _ in side if low <= s < cut)) for side in (a, b)]
            groups.append("|".join(part))
            low = cut
        held.update(set(links))
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (*d[:3], len(d[3]), sum(held[x] == top[x[0]] for x in d[3]), sum(held[x] for x in d[3]), d[4]) for d in docs]


ODD = ["twice upon a time", "twice upon a time", "日本語 русский 🎉", "a▁b", "<|endoftext|> <s> </s>", "  two\n\n x\t\r\n ", "\u0000 nul",
       "it's I'll don't 12345", "internationalization" * 30, "Zm9yZXZlcg/+" * 40, "x", " ", "​　é"]


@pytest.mark.parametrize("settings", [{}, {"shard_pairs": 40, "task_pairs": 5}])
def test_alignment(spark, frame, awkward, tokenizers, settings):
    rows = [(i, t if i != 7 else t[:3000]) for i, t in awkward if i != 8] + [(100 + i, t) for i, t in enumerate(ODD)]
    want = plain_alignment(tokenizers, [t for _, t in rows])
    got = token_links.linked(frame(rows), **settings).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert sum(w[0] == 0 for w in want) < 7 < sum(w[3] > 0 for w in want)


def test_alignment_of_nothing(spark, frame):
    assert token_links.linked(frame([])).collect() == []
    assert [tuple(r) for r in token_links.linked(frame([(1, None), (2, "")])).orderBy("id").collect()] == [(i, *[0] * 6, "") for i in (1, 2)]


def test_long_runs_are_divided_whole(tokenizers):
    coders = token_links.Coders(*(token_links.vocabulary_path(n) for n in (token_links.RANKS_A, token_links.VOCABULARY_B)))
    rng = random.Random(2)
    for text in ("".join(rng.choices("abcdefgh", k=30_000)), "x" * 9_000, "日本" * 3_000):
        work = token_links.Aligned(coders, [coders.encode("then"), coders.encode(text)])
        tokens = plain_tokens(tokenizers, text)
        cuts = {e for _, _, e in tokens[0]} & {e for _, _, e in tokens[1]}
        assert work.groups[1] == len(cuts) and work.links[1] == len(tokens[0]) + len(tokens[1]) - len(cuts)
        starts = [0, *sorted(cuts)]
        assert [s for _, s, _ in tokens[0] if s in cuts or not s] == [s for s in starts if s < len(text.encode()) + 1]


def test_alignment_query_whole_table(spark, small, tokenizers):
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 4000]  # the brute force compares all tokens with all
    want = {i: w for (i, _), w in zip(short, plain_alignment(tokenizers, [t for _, t in short]))}
    got = {r.doc_id: r for r in queries.op12_token_links(spark, small).collect()}
    assert sorted(got) == sorted(i for i, _ in rows)
    for i, w in want.items():
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links) == w[:4]
        assert got[i].groups_sha256 == hashlib.sha256(w[6].encode()).hexdigest()
    again = token_links.linked(table(spark, small, "documents").where("length(text) < 4000")).collect()
    assert {r.id: (r.n_best, r.count_sum) for r in again} == {i: w[4:6] for i, w in want.items()}


# --- runs ----------------------------------------------------------------------------------------------------------

def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        same = [words[i] == words[i - q] for i in range(q, len(words))] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                length = i - start + q
                stretch = words[start:start + length]
                if length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng, found = random.Random(1), 0
    for _ in range(1500):
        kinds, n = rng.choice([1, 2, 2, 3, 4, 8]), rng.randint(0, 80)
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 8:
                unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
                at = rng.randint(0, n - 1)
                row = (unit * 20)[:rng.randint(1, 50)]
                words[at:at + len(row)] = row
        want = plain_runs(words)
        assert word_runs.runs_of(word_runs.word_numbers([str(w) for w in words])) == want
        found += len(want)
    assert found > 500


@pytest.mark.parametrize("words,runs", [
    (["a"] * 30_000, [(0, 30_000, 1)]),
    ([str(i) for i in range(3000)] * 5, [(0, 15_000, 3000)]),
    ((["a"] * 6 + ["b"]) * 400, [(7 * i, 6, 1) for i in range(400)] + [(0, 2800, 7)]),
    (["a"] * 5, []), (["a"] * 6, [(0, 6, 1)]), (["a", "b"] * 4, [(0, 8, 2)]), (["a", "b"] * 3 + ["a"], [])])
def test_long_and_least_runs(words, runs):
    assert word_runs.runs_of(word_runs.word_numbers(words)) == sorted(runs, key=lambda r: (r[0], r[2]))


def plain_row(doc, text):
    words, part = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [part] if part else []
            part = ""
        else:
            part += c
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_whole_table(spark, small):
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, small).collect())
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    assert sum(r[1] > 0 for r in got) > 10
    long = {i for i, t in rows if len((t or "").split()) > 4000}  # the brute force tries every period
    assert [r for r in got if r[0] not in long] == sorted(plain_row(i, t) for i, t in rows if i not in long)


def test_runs_awkward(spark, frame, awkward):
    rows = awkward + [(20, "a b " * 9 + "c"), (21, "x y " * 7), (None, "z " * 8)]
    got = word_runs.collapsed(frame(rows)).collect()
    key = lambda r: (r[0] is None, r)
    want = []
    for i, text in rows:
        words = [w for w in (text or "").replace("\r", " ").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want.append((i, runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted(((r.id, [tuple(x) for x in r.runs], r.text) for r in got), key=key) == sorted(want, key=key)
    assert word_runs.collapsed(frame([])).collect() == []
