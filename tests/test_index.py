"""The stored index: segments, merging, opening again; lexemes by language."""

import os

import pytest
from pyspark.sql import functions as F

from folioworks.operators import lexical, search

DOCS = [(1, "Hablando claro", None, "los hablantes hablaban ayer", "es"), (2, "Talks", "Ann", "they talked and talking helps", "en"),
        (3, "Hablando", None, "ein Wort: talked hablaban", "de"), (4, "", None, "", "es"), (5, None, None, None, None), (6, "talk", "hablar", "hablado", "pt")]
SCHEMA = "doc_id long, title string, author string, text string, language string"


def hits(index, rows, **settings):
    asked = index.spark.createDataFrame(rows, "query_id long, language string, terms array<string>")
    return {(r.query_id, r.doc_id) for r in lexical.match_all(index, asked, **settings).collect()}


def test_hits_differ_by_language(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    index = lexical.build_index(docs, by_language=True)
    asked = [(1, "es", ["hablaban"]), (2, "en", ["hablaban"]), (3, "de", ["hablaban"]), (4, "en", ["talk"]), (5, "es", ["talk"]), (6, "pt", ["hablando"]),
             (7, "en", ["talked", "help"]), (8, "en", ["talked", "missing"]), (9, "es", [])]
    assert hits(index, asked) == {(1, 1), (1, 3), (2, 3), (3, 3), (4, 2), (6, 6), (6, 3), (7, 2)}
    assert hits(index, asked, same_language=True) == {(1, 1), (3, 3), (4, 2), (6, 6), (7, 2)}
    plain = lexical.build_index(docs)
    assert hits(plain, asked) == {(1, 1), (1, 3), (2, 1), (2, 3), (3, 1), (3, 3), (4, 6), (5, 6), (6, 1), (6, 3)}


@pytest.mark.parametrize("config,word,wanted", [
    ("spanish", "hablábamos", "hablabam"), ("spanish", "naciones", "nacion"), ("spanish", "sol", "sol"), ("english", "happiness", "happi"), ("english", "bed", "bed"),
    ("portuguese", "orações", "oraco"), ("simple", "Él", "Él"), ("spanish", "él", "el")])
def test_lexemes(values, config, wanted, word):
    assert values(lambda c: lexical.lexeme(c, F.lit(config)), [word]) == [wanted]


def test_segments_and_merging(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    whole = lexical.build_index(docs)
    parts = lexical.build_index(docs.where("doc_id < 3")).append(docs.where("doc_id >= 3"), 1)
    merged = parts.merged(str(tmp_path / "merged"))
    asked = [(1, None, ["talked"]), (2, None, ["hablaban", "hablando"]), (3, None, ["talk"])]
    assert hits(whole, asked) == hits(parts, asked) == hits(merged, asked) == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 6)}
    counts = [sorted(map(tuple, x.dictionary.collect())) for x in (whole, parts, merged)]
    assert counts[0] == counts[1] == counts[2]
    assert {r.segment for r in parts.postings.select("segment").distinct().collect()} == {0, 1}
    again = parts.append(docs.where("doc_id >= 3"), 1)  # the same segment once more changes nothing
    assert hits(again, asked) == hits(whole, asked)


def test_an_index_is_opened_again(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(DOCS[:2], SCHEMA).coalesce(1).write.parquet(path)
    first = lexical.open_index(spark.read.parquet(path), "t")
    made = os.path.getmtime(first.path.removeprefix("file:") + "/COMPLETE")
    assert lexical.open_index(spark.read.parquet(path), "t").path == first.path
    assert os.path.getmtime(first.path.removeprefix("file:") + "/COMPLETE") == made
    assert lexical.open_index(spark.read.parquet(path), "other").path != first.path
    spark.createDataFrame(DOCS, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    other = lexical.open_index(spark.read.parquet(path), "t")
    assert other.path != first.path and hits(other, [(1, None, ["talk"])]) == {(1, 6)}


def test_only_wanted_buckets_are_read(spark):
    index = lexical.build_index(spark.createDataFrame(DOCS, SCHEMA))
    wanted = spark.createDataFrame([("talked",), ("hablaban",)], "word string")
    rows = index.rows_of(wanted)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    files = {r.f.split("bucket=")[1].split("/")[0] for r in rows.select(F.input_file_name().alias("f")).collect()}
    assert len(files) <= 2 and {r.word for r in rows.collect()} >= {"talked", "hablaban"}


def plain_fallback(docs, asked):
    """Queries without a passage that has all their words take the documents that hold them as a part of a field."""
    import re

    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    out = set()
    for q, text in asked:
        held = {(q, "passage", i) for i, _, _, body, _ in docs if words(text) and words(text) <= words(body)}
        rest = {(q, "document", i) for i, *fields, _ in docs if any(text.lower() in (f or "").lower() for f in fields)}
        out |= held or (rest if words(text) else set())
    return out


def test_fallback_of_empty_legs_only(spark):
    import random

    rng = random.Random(6)
    docs = [(i, *[" ".join(rng.choices(["alpha", "beta", "gamma-delta", "a", "be", "ta", "Zeta.", "x_1"], k=rng.randint(0, n))) for n in (3, 2, 9)], "en") for i in range(60)]
    texts = ["alpha beta", "pha bet", "lph", "gamma", "a", "ta Ze", "zeta.", "x_1 al", "eta a be", "nothing here", "?!", "beta gamma-delta alp", "_1", "lta zeta", "alpha alpha alpha"]
    texts += [" ".join(d[3].split()[1:4])[1:-1].strip() for d in docs[:25]]
    asked = [(i, t) for i, t in enumerate(texts) if t]
    frame = spark.createDataFrame(docs, SCHEMA)
    passages = lexical.build_index(frame.select("doc_id", F.lit("").alias("title"), F.lit("").alias("author"), "text", "language"))
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = search.lexical_leg(passages, lexical.build_index(frame), frame, queries).collect()
    found = {(r.query_id, r.route, r.doc_id) for r in got}
    assert found == plain_fallback(docs, asked) and len(found) == len(got)
    assert {r.route for r in got} == {"passage", "document"}


def test_words_of_a_document_are_grouped_in_its_row(spark):
    rows = [(1, ["b", "a", "b", "é", "a", "b"]), (2, []), (3, None), (4, ["x"] * 5 + ["y"])]
    frame = spark.createDataFrame(rows, "doc_id long, w array<string>")
    got = {(r.doc_id, r.word): r.places for r in frame.select("doc_id", F.inline(lexical.placed_words(F.col("w")))).collect()}
    assert got == {(1, "a"): [2, 5], (1, "b"): [1, 3, 6], (1, "é"): [4], (4, "x"): [1, 2, 3, 4, 5], (4, "y"): [6]}


def test_postings_are_written_without_a_shuffle(spark):
    """Building writes what it reads in the same tasks: only the dictionary's counts are exchanged."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("").alias("title"), F.lit("").alias("author"), F.lit("es").alias("language"),
                                   F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id") % 3) % 50)), " ").alias("text"))
    tracker, group = spark.sparkContext.statusTracker(), "postings-test"
    spark.sparkContext.setJobGroup(group, group)
    index = lexical.build_index(docs)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s) is not None)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    postings = index.postings.count()
    assert postings == 400 * 50 and shuffled < postings / 4
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"
    one = index.postings.where("word = 'w7' AND doc_id = 3").first()
    assert one.places == [i + 1 for i in range(200) if i * 7 % 50 == 7]


def test_postings_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Spark falls back to a sort once the open files reach the setting, so it has to be above the number of buckets."""
    from pyspark.sql import DataFrameWriter

    seen, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **settings):
        seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return write(self, path, *args, **settings)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    rows = spark.range(64).select(F.lit(0).alias("segment"), (F.col("id") % lexical.BUCKETS).cast("int").alias("bucket"), F.col("id"))
    lexical._write_buckets(rows, str(tmp_path / "buckets"))
    assert seen == [lexical.BUCKETS + 1] and spark.read.parquet(str(tmp_path / "buckets")).count() == 64


def test_candidates_are_the_same_when_nothing_can_be_sent(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    index = lexical.build_index(docs)
    asked = [(1, None, ["talked"]), (2, None, ["hablaban", "hablando"]), (3, None, ["talk"])]
    sent = hits(index, asked)
    monkeypatch.setattr(lexical, "SENT_WORDS", 0)
    monkeypatch.setattr(lexical, "SENT_DOCUMENTS", 0)
    assert hits(index, asked) == sent == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 6)}


def test_only_documents_with_the_rarest_words_are_looked_up(spark):
    """A query's frequent words bring no candidates: what is stored for them is no larger than the matches of its rarest ones."""
    rows = [(i, "", None, " ".join(["all", f"half{i % 2}", f"third{i % 3}", f"fifth{i % 5}"]), "en") for i in range(120)]
    index = lexical.build_index(spark.createDataFrame(rows, SCHEMA))
    asked = [(1, None, ["all", "half0", "third0", "fifth0"]), (2, None, ["all"]), (3, None, ["all", "half1"]), (4, None, ["all", "missing"]), (5, None, ["half0", "half1"])]
    seen, store = {}, lexical.write_once

    def noted(df, label):
        seen[label] = store(df, label)
        return seen[label]

    lexical.write_once = noted
    try:
        got = hits(index, asked)
    finally:
        lexical.write_once = store
    assert got == {(1, i) for i in range(0, 120, 30)} | {(2, i) for i in range(120)} | {(3, i) for i in range(1, 120, 2)}
    looked_up = {(1, i) for i in range(0, 120, 15)} | {x for x in got if x[0] == 3}
    assert {(r.query_id, r.doc_id) for r in seen["query-candidates"].collect()} == looked_up


def test_words_of_one_lexeme_are_one_hit_list(spark):
    docs = [(1, "", None, "talk talked again", "en"), (2, "", None, "talks", "en")]
    index = lexical.build_index(spark.createDataFrame(docs, SCHEMA), by_language=True)
    asked = spark.createDataFrame([(1, "en", ["talking"]), (2, "en", ["again"])], "query_id long, language string, terms array<string>")
    got = {(r.query_id, r.doc_id): [h.at for h in r.hits] for r in lexical.match_all(index, asked).collect()}
    assert got == {(1, 1): [1, 2], (1, 2): [1], (2, 1): [3]}
