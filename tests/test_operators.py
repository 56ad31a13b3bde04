"""Operators against brute force on small frames."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from folioworks.config import MODES
from folioworks.operators import chunking, duplicates as dup, lexical, pages, ranking, skew, usage, vectors
from folioworks.sources import library as lib


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_greedy_skip_keeps_later_small_items(spark):
    df = spark.createDataFrame([("q", i + 1, n) for i, n in enumerate([5, 9, 3, 4])], "q string, rank int, tokens long")
    kept = ranking.fit_skipping(df, ["q"], "rank", "tokens", 12, 10)
    assert [r.tokens for r in kept.orderBy("rank").collect()] == [5, 3, 4]


def test_running_total_equals_one_window(spark):
    rng = random.Random(3)
    data = [(k, i, rng.randint(0, 9)) for k in "ab" for i in range(200 if k == "a" else 7)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    mine = skew.running_total(df, ["k"], [F.col("i")], F.floor(F.col("i") / 16), F.col("v"), "t")
    whole = df.withColumn("t", F.sum("v").over(Window.partitionBy("k").orderBy("i")))
    assert rows(mine, "k", "i", "t") == rows(whole, "k", "i", "t")


@pytest.mark.parametrize("hot_rows", [1, 5, 10_000])
def test_hot_groups_join_like_all_others(spark, hot_rows):
    members = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(60)], "k string, i long")
    groups = members.groupBy("k").agg(F.max("i").alias("top"), F.count("*").alias("n"))
    joined = skew.join_group_facts(members, groups, ["k"], "n", hot_rows=hot_rows)
    assert rows(joined, "k", "i", "top") == rows(members.join(groups, "k"), "k", "i", "top")


def brute_cover_density(words, terms, inverse):
    hits = [(i, w) for i, w in enumerate(words) if w in terms]
    total, start = 0.0, 0
    while True:
        end = next((e for e in range(start, len(hits)) if {w for _, w in hits[start:e + 1]} == terms), None)
        if end is None:
            return total
        begin = max(b for b in range(start, end + 1) if {w for _, w in hits[b:end + 1]} == terms)
        n = end - begin + 1
        weight = n / sum(inverse(p) for p, _ in hits[begin:end + 1])
        total += weight / (1 + hits[end][0] - hits[begin][0] - (n - 1))
        start = begin + 1


def test_match_and_rank_against_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=2)), rng.choice("abc"), " ".join(rng.choices("abcdefgh", k=rng.randint(1, 25))))
            for i in range(40)]
    queries = [(100 + i, sorted(set(rng.choices("abcdefgh", k=rng.randint(1, 3))))) for i in range(10)] + [(200, ["zz", "a"])]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, title string, author string, text string"))
    asked = spark.createDataFrame(queries, "query_id long, terms array<string>")
    found = {(r.query_id, r.doc_id): r.lexical_score for r in lexical.scored(index, asked).collect()}
    expected = {}
    for (q, terms), (d, title, author, text) in itertools.product(queries, docs):
        words = (title + " " + author + " " + text).split()
        if set(terms) <= set(words):
            a, b = len(title.split()), len(author.split())
            expected[q, d] = brute_cover_density(
                words, set(terms), lambda p: 1.0 if p < a else 2.5 if p < a + b else 5.0)
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in expected)


@pytest.mark.parametrize("tile", [8192, 7])
def test_nearest_batch_against_numpy(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE_POINTS", tile)
    rng = np.random.default_rng(1)
    points, asked = rng.normal(size=(50, 8)), rng.normal(size=(5, 8))
    p = spark.createDataFrame([(i, [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(points)],
                              "doc_id long, embedding array<double>, lang string")
    q = spark.createDataFrame([(i, [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(asked)],
                              "query_id long, embedding array<double>, lang string")
    odd = spark.createDataFrame([(90, [0.0] * 8, "a"), (91, None, "a"), (92, [float("nan")] * 8, "b")], p.schema)
    found = {(r.query_id, r.doc_id) for r in vectors.nearest_batch(p.unionByName(odd), q, 4, match="lang").collect()}
    cos = (asked @ points.T) / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(points, axis=1)
    expected = set()
    for i in range(5):
        mine = [j for j in range(50) if j % 2 == i % 2]
        expected |= {(i, j) for j in sorted(mine, key=lambda j: -cos[i, j])[:4]}
    assert found == expected


def test_smart_chunks_keep_their_promises():
    """Every block that fits is whole in some passage, budgets hold, and passages follow the text."""
    rng, mode = random.Random(5), MODES["balanced"]
    for _ in range(40):
        blocks = [" ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.choice([3, 40, 200, 500]))) for _ in range(rng.randint(1, 9))]
        text = "\n\n".join(blocks)
        passages = chunking.smart_passages(text, mode)
        assert all(any(block in p[4] for p in passages) for block in blocks)
        for _, start, end, count, body in passages:
            assert 0 <= start < end <= len(text) and body.strip()
            assert count <= mode.chunk_max_tokens + mode.chunk_overlap_tokens
        assert [p[2] for p in passages] == sorted(p[2] for p in passages)
        assert sum(len(p[4].split()) for p in passages) >= len(text.split())


def test_oversize_paragraph_is_cut_at_sentences():
    text = " ".join(f"{'w ' * 99}end." for _ in range(12))
    mode = MODES["balanced"]
    pieces = chunking.smart_passages(text, mode)
    assert len(pieces) == 2 and all(text[p[1]:p[2]] == p[4] for p in pieces)
    assert " ".join(p[4] for p in pieces) == text


def test_fixed_chunks_cover_the_text():
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice(["word ", "longer, ", "end. ", "stop; ", "\n\n", "x" * 40]) for _ in range(rng.randint(0, 700)))
        cut = chunking.fixed_passages(text)
        assert all(text[a:b].strip() == body and len(body) <= 1200 for _, a, b, _, body in cut)
        assert "".join(body for *_, body in cut).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
        assert all(len(body) >= 700 for *_, body in cut[:-1])


def record(i, **changes):
    base = {"doc_id": i, "title": "A shared talk title", "author": "Jane Doe", "published_on": None, "language": "en",
            "canonical_url": "https://example.org/talk?lang=eng", "content_hash": "a" * 64, "text": "Faith text. " * 60,
            "raw_metadata": {"k": "v"}, "created_at": None, "asset_count": 0, "relation_count": 0}
    return {**base, **changes}


SCHEMA = ("doc_id long, title string, author string, published_on date, language string, canonical_url string, content_hash string, "
          "text string, raw_metadata map<string,string>, created_at timestamp, asset_count long, relation_count long")


def resolve(spark, *records):
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.replace("map<string,string>", "m").split(", ")) for r in records], SCHEMA)
    return {r.duplicate_id: r for r in dup.resolve(frame).collect()}


def test_pair_classes(spark):
    other = "A completely different historical document. " * 80
    found = resolve(spark, record(1, asset_count=9), record(2))
    assert (found[2].classification, found[2].review_status, found[2].canonical_id) == ("exact_duplicate", "confirmed", 1)
    found = resolve(spark, record(1, asset_count=9), record(2, language="es", canonical_url="https://example.org/talk?lang=spa"))
    assert found[2].classification == "translation"
    found = resolve(spark, record(1, asset_count=9), record(2, canonical_url="https://example.org/talk?imageView=p.jpg"))
    assert found[2].classification == "related_media"
    found = resolve(spark, record(1, asset_count=9), record(2, canonical_url="https://example.org/b", content_hash="b" * 64, text=other))
    assert found.get(2, found.get(1)).classification == "not_duplicate"
    near = record(2, content_hash="b" * 64, text="Faith text. " * 59 + "Faith test. ")
    found = resolve(spark, record(1, asset_count=9), near)
    assert (found[2].classification, found[2].review_status) == ("probable_duplicate", "pending")
    assert 0.93 <= found[2].confidence <= 1


def test_official_host_beats_assets(spark):
    found = resolve(spark, record(1, canonical_url="https://mirror.example.org/talk", asset_count=20),
                    record(2, canonical_url="https://speeches.byu.edu/talks/example"))
    assert found[1].canonical_id == 2


def test_chains_and_loops(spark):
    edges = [(3, 2), (2, 1), (10, 11), (11, 12), (12, 10), (13, 10), (14, 13), (20, 21)]
    frame = spark.createDataFrame([(d, c, "confirmed", "exact_duplicate") for d, c in edges] + [(30, 3, "pending", "probable_duplicate")],
                                  "duplicate_id long, canonical_id long, review_status string, classification string")
    found = {r.duplicate_id: r.canonical_id for r in dup.flatten_roots(frame).collect()}
    assert found == {3: 1, 2: 1, 10: 11, 11: 12, 12: 10, 13: 10, 14: 10, 20: 21, 30: 1}


HTML = """<html><head><title>Faith in Christ | BYU Speeches</title><meta name="author" content="By Jane Doe" />
<meta property="article:published_time" content="2024-01-14" /><meta name="keywords" content="faith, hope ,"/>
<script type="application/ld+json">{"@graph": [{"headline": "LD"}]}</script></head><body><nav>menu</nav><h1>Faith in Christ</h1>
<p class="byline">Jane Doe</p><time datetime="2024-01-15">x</time><article><p>Alma 32:21 teaches <b>faith</b>.<br>Next &amp; last</p>
<a href="/sample.pdf">PDF</a><a href="sample.pdf#x">again</a><audio src="/sample.mp3"></audio><iframe src="//www.youtube.com/e/1"></iframe></article></body></html>"""


def test_page_record(spark):
    urls = ["https://speeches.byu.edu/talks/jane-doe/faith/", "https://speeches.byu.edu/spa/talks/jane-doe/fe/",
            "https://www.churchofjesuschrist.org/study/scriptures/bofm/alma/32", "https://www.josephsmithpapers.org/paper-summary/s"]
    frame = spark.createDataFrame([(i, u, HTML) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.parse(frame).collect()}
    first = got[0]
    assert (first.title, first.author, str(first.published_at.date())) == ("Faith in Christ", "Jane Doe", "2024-01-14")
    assert (first.source_type, first.language, first.category) == ("byu_speeches_en", "es", "BYU Speeches")  # "alma " is a Spanish hint
    assert first.tags == ["faith", "hope"] and first.scripture_refs == ["Alma 32:21"]
    assert [(a.asset_type, a.url) for a in first.assets][:1] == [("pdf", "https://speeches.byu.edu/sample.pdf")]
    assert {a.asset_type for a in first.assets} == {"pdf", "mp3", "video"}
    assert "menu" not in first.text and "Next & last" in first.text
    assert got[1].language == "es" and got[2].category == "Escrituras" and "historica" in got[3].source_note


def test_author_from_text_and_title_cascade(spark):
    bare = "<html><head><meta property='og:title' content='A Reliable Title'></head><body><p>Por José Núñez | x</p></body></html>"
    frame = spark.createDataFrame([(1, "https://x.org/a", bare), (2, "https://x.org/my-great_page.pdf", "<p>hi there</p>")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.parse(frame).collect()}
    assert (got[1].title, got[1].author) == ("A Reliable Title", "José Núñez")
    assert got[2].title == "My Great Page" and got[2].author is None


def test_frontier_stops_at_depth(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, 3), (4, 0)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "url long")
    got = {r.url: r.depth for r in pages.frontier(links, seeds, 4).collect()}
    assert got == {0: 0, 1: 1, 3: 1, 2: 2, 4: 2, 5: 3, 6: 4}


def test_similarity_follows_the_published_rule(spark):
    a, b = "the same words in one order " * 20, "the same words in other order " * 20
    rows = [("", "x"), (None, "x"), (a, a), ("a  b", "a\u00a0b "), (a, b), ("aaaa", "zzzz")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, r string")
    got = frame.select("i", dup.similarity(dup.sample(F.col("l")), dup.sample(F.col("r"))).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [0.0, 0.0, 1.0, 1.0, SequenceMatcher(None, a.strip(), b.strip()).ratio(), 0.0]
def test_decisions_cover_every_group_member(spark, small):
    docs = lib.documents(spark, small)
    got = dup.resolve(docs)
    keyed = dup.blocks(dup.features(docs))
    members = keyed.join(dup.groups(keyed).select("rule", "key", F.col("c.doc_id").alias("c")), ["rule", "key"]).where("doc_id <> c")
    assert {r[0] for r in members.select("doc_id").distinct().collect()} == {r.duplicate_id for r in got.collect()}


def test_embedding_plan_counts_a_hash_once(spark):
    """Half of the passages share one hash; ids are sparse; only the first batch with it pays, and stored hashes cost nothing."""
    rows = [(d * 1_000_003, i, "hot" if i % 2 else f"h{d}-{i}", 10) for d in range(40) for i in range(6)]
    chunks = spark.createDataFrame(rows + [(5, 0, None, 10), (5, 1, None, 10)], "doc_id long, chunk_index int, text_hash string, token_count long")
    cache = spark.createDataFrame([("h1-0",), ("h1-0",)], "text_hash string")
    got = {(r.doc_id, r.batch): r for r in usage.embedding_plan(chunks, 700, 2, cache=cache, used_today=100, bucket_rows=16).collect()}
    total, seen = 100, {"h1-0"}
    for doc in sorted({r[0] for r in rows} | {5}):
        for batch in range(3):
            mine = [h for d, i, h, _ in rows if d == doc and i // 2 == batch] if doc != 5 else (["n0", "n1"] if batch == 0 else [])
            if not mine:
                continue
            tokens = sum(10 for h in mine if h not in seen)
            seen |= set(mine)
            total += tokens
            assert (got[doc, batch].tokens, got[doc, batch].admitted) == (tokens, total <= 700)
    assert sum(r.chunks for r in got.values()) == len(rows) + 2


def test_matcher_gives_the_library_s_blocks():
    """Same blocks, ratio and bound as difflib, texts with frequent characters (200 and longer) included."""
    draw = random.Random(2)
    for turn in range(400):
        signs = draw.choice(["ab", "abc \u00e9\u65e5", "abcdefghijklmnop 12"])
        left = "".join(draw.choices(signs, k=draw.randrange(180, 420) if turn % 4 == 0 else draw.randrange(60)))
        right = list(left)
        for _ in range(draw.randrange(12) if right else 0):
            right[draw.randrange(len(right))] = draw.choice(signs + "zQ\U0001F600")
        right = "".join(right) if turn % 3 else "".join(draw.choices(signs, k=draw.randrange(300)))
        want, got = SequenceMatcher(None, left, right), dup._Matcher(None, left, right)
        assert got.get_matching_blocks() == want.get_matching_blocks() and got.ratio() == want.ratio()
        assert dup._quick_ratio(left, right) == want.quick_ratio()


def test_only_records_of_open_pairs_are_sampled(spark, monkeypatch):
    stored = {}
    write = dup.write_once
    monkeypatch.setattr(dup, "write_once", lambda df, label: stored.setdefault(label, write(df, label)))
    documents = spark.createDataFrame([(i, f"text  {i} " + "x" * 7000) for i in range(6)] + [(9, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (4, 9)], "canonical_id long, duplicate_id long")
    found = {(r.canonical_id, r.duplicate_id): r.similarity for r in dup.compare_texts(pairs, documents).collect()}
    assert set(found) == {(1, 2), (1, 3), (4, 9)} and found[4, 9] == 0.0 and found[1, 2] > 0.99
    assert {r.doc_id: len(r.text) for r in stored["samples"].collect()} == {1: 5999, 2: 5999, 3: 5999, 4: 5999, 9: 0}
