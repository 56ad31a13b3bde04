"""Expected schemas beside actual ones, nested types included."""

import pytest
from pyspark.sql import types as T

from folioworks.operators import schemas


def _diff(df, ddl):
    rows = schemas.schema_diff(df, T.StructType.fromDDL(ddl), "t").collect()
    return {r.path: (r.expected, r.actual, r.verdict, r.filled, r.convertible) for r in rows}


def test_nested_paths(spark):
    df = spark.createDataFrame(
        [(1, "7", [(1, "x"), (None, "y")], {"k": 1.5}), (2, "seven", None, {}), (3, None, [None], None)],
        "id int, n string, items array<struct<a: int, b: string>>, scores map<string, double>")
    assert _diff(df, "id bigint, n int, items array<struct<a: string, c: date>>, scores map<string, int>, more struct<x: int>") == {
        "id": ("bigint", "int", "widened", 3, None),
        "n": ("int", "string", "incompatible", 2, 1),
        "items": ("array", "array", "same", 2, None),
        "items[]": ("struct", "struct", "same", 2, None),
        "items[].a": ("string", "int", "incompatible", 1, 1),
        "items[].b": (None, "string", "extra", 2, None),
        "items[].c": ("date", None, "missing", None, None),
        "scores": ("map", "map", "same", 2, None),
        "scores{key}": ("string", "string", "same", 1, None),
        "scores{value}": ("int", "double", "incompatible", 1, 1),
        "more": ("struct", None, "missing", None, None),
        "more.x": ("int", None, "missing", None, None),
    }


def test_kind_changes_and_empty_tables(spark):
    df = spark.createDataFrame([], "a array<int>, `b.c` string")
    assert _diff(df, "a string, `b.c` string") == {
        "a": ("string", "array", "incompatible", 0, 0), "a[]": (None, "int", "extra", 0, None),
        "b.c": ("string", "string", "same", 0, None)}


@pytest.mark.parametrize("actual, expected, fits", [
    ("int", "bigint", True), ("bigint", "int", False), ("int", "float", False), ("bigint", "double", False),
    ("decimal(10,2)", "decimal(12,2)", True), ("decimal(10,2)", "decimal(10,3)", False), ("int", "decimal(12,2)", True),
    ("bigint", "decimal(20,2)", False), ("date", "timestamp", True), ("string", "int", False)])
def test_widening(actual, expected, fits):
    assert schemas.widens(actual, expected) is fits
