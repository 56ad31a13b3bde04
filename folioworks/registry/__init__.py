"""The queries the driver can run, each with its inventory ids and oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "scans", "projections", "filters", "joins", "aggregates", "ordering", "sets",
    "scalars", "chunks", "retrieval", "duplicates", "markup", "incremental",
    "maintenance", "study", "curation",
)


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def wrap(fn):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, tuple(ids.split()), fn, sql)
        return fn

    return wrap


def load() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return ENTRIES
