"""Binary files: read with pruning, recognised by their first bytes, stored once per content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values: (first bytes in hex, media type, extension).
MAGIC = (
    ("25504446", "application/pdf", "pdf"),
    ("89504e470d0a1a0a", "image/png", "png"),
    ("ffd8ff", "image/jpeg", "jpg"),
    ("47494638", "image/gif", "gif"),
    ("504b0304", "application/zip", "zip"),
    ("1f8b", "application/gzip", "gz"),
)
_OTHER = ("application/octet-stream", "bin")
_TEXT, _HTML = ("text/plain", "txt"), ("text/html", "html")
_ASSET = "checksum string, media_type string, extension string, size_bytes long, content binary, shard string"
_NAME = "path string, checksum string, modified_at timestamp"


def media_kind(content: Column) -> Column:
    """struct(media_type, extension) by the first bytes; text is what is valid UTF-8 without a zero byte."""
    kind = lambda pair: F.struct(F.lit(pair[0]).alias("media_type"), F.lit(pair[1]).alias("extension"))
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    known = F.when(F.startswith(head, F.lit(MAGIC[0][0])), kind(MAGIC[0][1:]))
    for magic, *pair in MAGIC[1:]:
        known = known.when(F.startswith(head, F.lit(magic)), kind(pair))
    text = content.cast("string")
    readable = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0"))
    markup = F.rlike(F.substring(text, 1, 512), F.lit(r"(?i)^\s*<(!doctype html|html)\b"))
    return known.when(readable & markup, kind(_HTML)).when(readable, kind(_TEXT)).otherwise(kind(_OTHER))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified_at, size_bytes, content) below a folder, its sub-folders included.

    Empty files are left out, as a scan opens none; an empty download counts as
    failed anyway.  Conditions on size and time of change reach the listing, and a job that does
    not ask for the content does not open the files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), "content")


class AssetStore:
    """Contents keyed by their checksum, and the names they were found under.

    ``contents`` has one row per distinct content in folders by the first two
    digits of the checksum, ``names`` one per path and content.  Contents are
    appended before names; a job that died in between leaves contents that the
    next one finds by checksum, so running it again stores nothing twice.  One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def contents(self) -> DataFrame:
        return self._table("contents", _ASSET)

    def names(self) -> DataFrame:
        return self._table("names", _NAME)

    def add(self, files: DataFrame) -> None:
        """Store what is new of (path, modified_at, size_bytes, content).

        Only checksums and paths are shuffled: of equal contents the smallest
        path is chosen, what the store has is taken out, and the contents of the
        chosen paths are read again.  A name is new if its path had another
        content, or none, before.
        """
        summed = files.select("path", "modified_at", F.sha2("content", 256).alias("checksum")).dropDuplicates(["path", "checksum"])
        chosen = (summed.groupBy("checksum").agg(F.min("path").alias("path"))
                  .join(self.contents().select("checksum"), "checksum", "left_anti"))
        fresh = files.join(chosen, "path").select("checksum", "size_bytes", "content", media_kind(F.col("content")).alias("kind"))
        (fresh.select("checksum", "kind.media_type", "kind.extension", "size_bytes", "content", F.left("checksum", F.lit(2)).alias("shard"))
         .write.mode("append").partitionBy("shard").parquet(f"{self.path}/contents"))
        named = summed.join(self.names().select("path", "checksum"), ["path", "checksum"], "left_anti")
        named.select("path", "checksum", "modified_at").write.mode("append").parquet(f"{self.path}/names")

    def current(self) -> DataFrame:
        """(path, checksum, storage_key, media_type, size_bytes): the newest content of every path, without reading contents."""
        newest = self.names().groupBy("path").agg(F.max_by("checksum", F.struct("modified_at", "checksum")).alias("checksum"))
        facts = self.contents().select("checksum", "media_type", "extension", "size_bytes")
        key = F.concat(F.lit("assets/"), "checksum", F.lit("."), "extension")
        return newest.join(facts, "checksum").select("path", "checksum", key.alias("storage_key"), "media_type", "size_bytes")

    def content_of(self, checksum: str) -> DataFrame:
        """The content of one checksum; one folder is read."""
        return self.contents().where((F.col("shard") == checksum[:2]) & (F.col("checksum") == checksum)).select("content")
