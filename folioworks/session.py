"""Session construction and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

FULL_SPLIT_BYTES = 128 * 1024 * 1024
#: Rows in one Arrow batch of texts or pages that Python parses; what it makes of them is several times as large.
PARSED_ROWS = 200


def build_session(app_name: str = "folioworks", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on.

    ``spark.sql.shuffle.partitions`` is only a starting point: AQE coalesces
    small shuffles and splits skewed ones at run time.  On a cluster leave
    ``master`` unset and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"  # not local-cluster, whose executors are other processes


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent *and* the
    master is local, which is the case in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return os.path.dirname(current.get().rstrip("/"))
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="folioworks-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, for written tables and stream state."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def inline_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A fixed lookup table built from literals; no Python data crosses to the JVM."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after a count has shown the side to be small.

    Counting stops one row past the bound; a larger side is left to a shuffle
    join, where AQE splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bounded_batches(spark: SparkSession, rows: int = PARSED_ROWS) -> None:
    """Keep Arrow batches of long texts small; never raises a smaller setting of the caller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    current = int(spark.conf.get(key, "10000"))
    if current <= 0 or current > rows:
        spark.conf.set(key, str(rows))


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Store a derived table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # known, so that no file is opened to find it


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table from ``write_once`` once nothing that is still to run reads it."""
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core before a CPU-heavy step.

    Decided from the size estimate alone, without running anything: an input
    smaller than one full split per core would leave cores idle, so it is dealt
    out; an input of cluster size has more splits than cores and is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * FULL_SPLIT_BYTES else df
