"""Real files are read, recognised, stored once per content and given back."""

import hashlib
import os
import zlib

from pyspark.sql import functions as F

from folioworks.sources import assets

PDF, PNG = b"%PDF-1.7\n\xff\xfe body", b"\x89PNG\r\n\x1a\n" + bytes(range(256))
FILES = {
    "a.pdf": PDF, "copies/b.pdf": PDF, "copies/deep/c.dat": PDF, "d.png": PNG, "e.html": b"\n <!DOCTYPE html><p>x</p>", "f.txt": "n\u00fa\u00f1ez".encode(),
    "g.bin": b"\x00\x01\x02", "h.bin": b"\xff\xff\xff", "i.gz": b"\x1f\x8b" + zlib.compress(b"x"), "j.jpg": b"\xff\xd8\xff\xe0zz", "k.svg": b"<svg></svg>",
}
TYPES = {"a.pdf": "application/pdf", "copies/b.pdf": "application/pdf", "copies/deep/c.dat": "application/pdf", "d.png": "image/png", "e.html": "text/html",
         "f.txt": "text/plain", "g.bin": "application/octet-stream", "h.bin": "application/octet-stream", "i.gz": "application/gzip",
         "j.jpg": "image/jpeg", "k.svg": "text/plain"}


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)


def listed(store, folder):
    return {r.path.split(str(folder) + "/", 1)[1]: r for r in store.current().collect()}


def test_files_are_stored_once_and_read_back(spark, tmp_path):
    source, store = tmp_path / "in", assets.AssetStore(spark, str(tmp_path / "store"))
    assert store.current().count() == 0
    for name, content in FILES.items():
        put(source, name, content)
    put(source, "empty", b"")  # without content there is nothing to store
    store.add(assets.read_files(spark, str(source)))
    found = listed(store, source)
    assert {n: r.media_type for n, r in found.items()} == TYPES
    assert {n: (r.checksum, r.size_bytes) for n, r in found.items()} == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in FILES.items()}
    assert found["d.png"].storage_key == f"assets/{hashlib.sha256(PNG).hexdigest()}.png"
    assert store.contents().count() == len(set(FILES.values()))
    for content in set(FILES.values()):
        (row,) = store.content_of(hashlib.sha256(content).hexdigest()).collect()
        assert bytes(row.content) == content

    store.add(assets.read_files(spark, str(source)))  # nothing new
    assert (store.contents().count(), store.names().count()) == (len(set(FILES.values())), len(FILES))

    put(source, "copies/b.pdf", PNG)  # a path with another content, which the store has
    os.utime(source / "copies/b.pdf", (4e9, 4e9))
    put(source, "new.txt", b"new")
    store.add(assets.read_files(spark, str(source)))
    found = listed(store, source)
    assert found["copies/b.pdf"].media_type == "image/png" and found["new.txt"].size_bytes == 3
    assert (store.contents().count(), store.names().count()) == (len(set(FILES.values())) + 1, len(FILES) + 2)


def test_reads_are_pruned(spark, tmp_path):
    for name, content in FILES.items():
        put(tmp_path, name, content)
    assert assets.read_files(spark, str(tmp_path), "*.pdf").count() == 2
    small = assets.read_files(spark, str(tmp_path)).where(F.col("size_bytes") > 100).select("path", "size_bytes")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,100)" in plan and "content" not in plan.split("ReadSchema:")[1]
    assert [r.size_bytes for r in small.collect()] == [len(PNG)]


def test_a_lost_job_is_run_again(spark, tmp_path):
    put(tmp_path / "in", "a.pdf", PDF)
    store, files = assets.AssetStore(spark, str(tmp_path / "store")), assets.read_files(spark, str(tmp_path / "in"))
    store.add(files)
    half = assets.AssetStore(spark, str(tmp_path / "half"))  # contents were written, names were not
    store.contents().write.partitionBy("shard").parquet(str(tmp_path / "half/contents"))
    half.add(files)
    assert half.contents().count() == 1 and half.current().collect() == store.current().collect()
