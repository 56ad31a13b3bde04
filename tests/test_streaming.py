"""Streaming forms agree with the batch forms; sinks can be replayed."""

import os

import pytest
from pyspark.sql import functions as F

from folioworks.operators import incremental as inc
from folioworks.sources import library as lib
from folioworks.sources.tables import KeyedTable
from folioworks.streaming import windows as stream


def events(spark, folder):
    return stream.event_stream(spark, folder, "events.parquet", lib.table(spark, folder, "events").schema)


def test_closed_windows_equal_batch_windows(spark, small):
    got = stream.materialize(stream.rate_windows(events(spark, small), "1 day", 3, ["event_type"], "10 minutes"), "t")
    batch = lib.table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    full = inc.rate_limited(batch, "1 day", 3, ["event_type"])
    last = batch.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    closed = full.where(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(last))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


def test_cache_walks_agree(spark, small):
    got = stream.materialize(stream.ttl_lookups(events(spark, small), "user_id", 90_000, "1 minute"), "t")
    batch = inc.cache_hits(lib.table(spark, small, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", 90_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def docs(spark, rows):
    return spark.createDataFrame(rows, "canonical_url string, content_hash string, version int, is_indexed boolean, raw_metadata map<string,string>")


PAGES = "canonical_url string, content_hash string, raw_metadata map<string,string>, seq int"
MERGE = lambda old, new: inc.upsert_documents(old, new.drop("seq"))


def table_at(spark, path, parts=8):
    return KeyedTable(spark, path, ["canonical_url"], docs(spark, []).schema, parts)


def state_of(table):
    return {r.canonical_url: (r.content_hash, r.version, r.is_indexed) for r in table.read().collect()}


def data_files(path):
    """Every data file with its size and time of change."""
    found = {}
    for folder, _, names in os.walk(f"{path}/data"):
        found |= {f"{folder}/{n}": (os.path.getsize(f"{folder}/{n}"), os.stat(f"{folder}/{n}").st_mtime_ns) for n in names if n.endswith(".parquet")}
    return found


def test_upsert_is_idempotent_and_versioned(spark, tmp_path):
    table = table_at(spark, str(tmp_path))
    assert state_of(table) == {}
    first = spark.createDataFrame([("a", "h1", {"s": "1"}, 1), ("a", "h2", {"s": "2"}, 2), ("b", "h1", {"s": "1"}, 1)], PAGES)
    apply = stream.upsert_sink(table, "seq", MERGE)
    apply(first, 0)
    apply(first, 0)
    assert table.versions() == [0]
    assert state_of(table) == {"a": ("h2", 1, False), "b": ("h1", 1, False)}
    changed = first.where("canonical_url = 'b'").withColumn("content_hash", F.lit("h9"))
    apply(changed, 1)
    apply(changed, 1)
    assert state_of(table) == {"a": ("h2", 1, False), "b": ("h9", 2, False)}
    stream.upsert_sink(table_at(spark, str(tmp_path)), "seq", MERGE, "another")(changed, 0)  # the same rows from another writer: unchanged
    assert state_of(table) == {"a": ("h2", 1, False), "b": ("h9", 2, False)} and table.versions() == [0, 1, 2]


def test_only_touched_parts_are_read_and_written(spark, tmp_path):
    table = table_at(spark, str(tmp_path), 16)
    table.apply(spark.createDataFrame([(f"u{i}", "h", {}, 1) for i in range(200)], PAGES), MERGE)
    before = data_files(tmp_path)
    one = spark.createDataFrame([("u7", "new", {}, 2)], PAGES)
    seen = []

    def merge(old, new):
        seen.extend(old.inputFiles())
        return MERGE(old, new)

    (part,) = table.apply(one, merge)
    after = data_files(tmp_path)
    fresh = set(after) - set(before)
    assert {f: after[f] for f in before} == before  # no old file was touched
    assert fresh and all(f"part={part}/" in f for f in fresh)
    assert seen and all(f"/part={part}/" in f for f in seen)
    assert state_of(table) == {f"u{i}": ("new", 2, False) if i == 7 else ("h", 1, False) for i in range(200)}
    assert table.vacuum() == 1 and table.vacuum() == 0
    assert len(table.read().inputFiles()) == len(data_files(tmp_path)) and table.read().count() == 200


def test_failed_batch_leaves_the_last_state(spark, tmp_path):
    table = table_at(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "h", {}, 1), ("b", "h", {}, 1)], PAGES)
    table.apply(rows, MERGE, "w", 0)
    broken = lambda old, new: MERGE(old, new).withColumn("version", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.apply(rows.withColumn("content_hash", F.lit("x")), broken, "w", 1)
    assert state_of(table) == {"a": ("h", 1, False), "b": ("h", 1, False)}
    table.apply(rows.withColumn("content_hash", F.lit("x")), MERGE, "w", 1)  # the replay
    assert state_of(table) == {"a": ("x", 2, False), "b": ("x", 2, False)}
    gone = table.apply(rows.where("canonical_url = 'a'"), lambda old, new: old.join(new, "canonical_url", "left_anti"), "w", 2)
    assert gone and set(state_of(table)) == {"b"}
    with pytest.raises(ValueError):  # a key of a part that the batch does not touch
        table.apply(rows.where("canonical_url = 'a'"), lambda old, new: MERGE(old, new.withColumn("canonical_url", F.explode(F.array([F.lit(f"x{i}") for i in range(40)])))))
    assert set(state_of(table)) == {"b"}


def test_stream_equals_batch(spark, small, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["user_id"], lib.table(spark, small, "events").schema, 8)
    newest = lambda old, new: old.join(new.select("user_id"), "user_id", "left_anti").unionByName(new.drop("order"))
    rows = events(spark, small).withColumn("ts", F.col("ts").cast(lib.table(spark, small, "events").schema["ts"].dataType))
    tagged = rows.withColumn("order", F.struct("ts", "event_id"))
    query = (tagged.writeStream.foreachBatch(stream.upsert_sink(table, "order", newest)).option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    batch = lib.table(spark, small, "events")
    expected = batch.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")))
    assert sorted((r.user_id, r.event_id) for r in table.read().collect()) == sorted(map(tuple, expected.collect()))


def test_unchanged_documents_keep_their_index_and_merge_metadata(spark):
    old = docs(spark, [("a", "h", 4, True, {"x": "1", "y": "1"})])
    new = spark.createDataFrame([("a", "h", {"y": "2"})], "canonical_url string, content_hash string, raw_metadata map<string,string>")
    row = inc.upsert_documents(old, new).first()
    assert (row.version, row.is_indexed, dict(row.raw_metadata)) == (4, True, {"x": "1", "y": "2"})
