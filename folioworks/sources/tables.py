"""Keyed parquet tables that rewrite only the partitions a batch touches, and the document layout."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """Rows dealt to ``parts`` folders by the hash of their keys; a batch writes the folders it touches anew.

    A batch writes to a folder of its own, and then a state file that names, for
    every part, the folder that holds it now.  A reader takes the newest state,
    so it never sees half a batch, and files of other parts are neither read nor
    written.  Overwriting partitions in place would delete a part before its
    successor is there, so a lost driver could lose it; here it leaves the last
    state.  The state keeps the last batch number of every writer, and a batch
    that is replayed is skipped.  Two writers of one state cannot both win, the
    later one fails.  A key's rows always lie in one part, so ``parts`` should
    grow with the table; a part is written as several files where it is large.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, parts: int = 64) -> None:
        self.spark, self.path, self.keys, self.schema, self.parts = spark, path.rstrip("/"), list(keys), schema, parts
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        there = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(name[:-5]) for name in self._names(f"{self.path}/state") if name.endswith(".json") and not name.startswith("."))

    def _state(self) -> dict:
        known = self.versions()
        if not known:
            return {"version": -1, "parts": {}, "writers": {}}
        text = self.spark.read.text(f"{self.path}/state/{known[-1]:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, state: dict) -> None:
        name = f"{self.path}/state/{state['version']:012d}.json"
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.writeBytes(json.dumps(state))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/state"))
        if self._fs.exists(self._path(name)) or not self._fs.rename(draft, self._path(name)):
            raise RuntimeError(f"another writer has stored version {state['version']} of {self.path}")

    def _read(self, state: dict, parts: Sequence[int] | None = None) -> DataFrame:
        wanted = state["parts"] if parts is None else {k: v for k, v in state["parts"].items() if int(k) in parts}
        folders = [f"{self.path}/{folder}/part={part}" for part, folder in wanted.items()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the newest state; a table never written to is empty."""
        return self._read(self._state())

    def apply(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", number: int | None = None) -> list[int]:
        """Merge a batch into the parts of its keys and return their numbers; an earlier ``number`` of the writer does nothing.

        ``merge(stored, batch)`` gets the stored rows of these parts and returns
        all rows they shall have, matched on the table's keys.  Rows that it
        leaves out are deleted.
        """
        state = self._state()
        if number is not None and state["writers"].get(writer, -1) >= number:
            return []
        touched = sorted(r[0] for r in batch.select(self.part_of()).distinct().collect())  # at most ``parts`` numbers
        if touched:
            folder = f"data/{state['version'] + 1:012d}-{uuid.uuid4().hex}"
            rows = merge(self._read(state, touched), batch).select(*self.schema.names).withColumn("part", self.part_of())
            # Rebalanced, so that a large part becomes several files and small ones are not split.
            rows.hint("rebalance", F.col("part")).write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/{folder}")
            written = {name.split("=")[1] for name in self._names(f"{self.path}/{folder}") if name.startswith("part=")}
            if written - {str(p) for p in touched}:
                raise ValueError("merge returned rows of keys that are not in the touched parts")
            for part in map(str, touched):
                state["parts"].pop(part, None)
            state["parts"] |= {part: folder for part in written}
        if number is not None:
            state["writers"][writer] = number
        if touched or number is not None:
            state["version"] += 1
            self._commit(state)
        return touched

    def vacuum(self, keep: int = 1) -> int:
        """Delete what none of the last ``keep`` states names; not while a batch is being written.  Returns the number of folders deleted."""
        known = self.versions()
        if not known:
            return 0
        live, gone = set(), 0
        for version in known[-keep:]:
            text = self.spark.read.text(f"{self.path}/state/{version:012d}.json", wholetext=True).first()[0]
            live |= {f"{folder}/part={part}" for part, folder in json.loads(text)["parts"].items()}
        for version in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/state/{version:012d}.json"), False)
        for folder in self._names(f"{self.path}/data"):
            for part in self._names(f"{self.path}/data/{folder}"):
                if part.startswith("part=") and f"data/{folder}/{part}" not in live:
                    self._fs.delete(self._path(f"{self.path}/data/{folder}/{part}"), True)
                    gone += 1
        return gone


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents laid out for the filters searches use; files are sorted by id inside a language."""
    (documents.repartitionByRange("language", "doc_id").sortWithinPartitions("doc_id")
     .write.mode("overwrite").partitionBy("language").parquet(path))
