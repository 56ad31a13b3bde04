"""The schema a job expects beside the schema and the values a table has."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: What every listed type may be read as without loss.
_WIDER = {
    "tinyint": {"smallint", "int", "bigint", "float", "double"},
    "smallint": {"int", "bigint", "float", "double"},
    "int": {"bigint", "double"},
    "float": {"double"},
    "date": {"timestamp", "timestamp_ntz"},
}
_WHOLE_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
_DECIMAL = re.compile(r"decimal\((\d+),(\d+)\)")

Step = Callable[[Column], Column]


def _steps(kind: T.DataType) -> list[tuple[str, T.DataType, Step]]:
    """The parts of a nested type: name, type, and how a list of values becomes the list of their parts."""
    if isinstance(kind, T.StructType):
        return [(f".{f.name}", f.dataType, lambda vs, n=f.name: F.transform(vs, lambda v: v.getField(n))) for f in kind.fields]
    if isinstance(kind, T.ArrayType):
        return [("[]", kind.elementType, lambda vs: F.flatten(F.array_compact(vs)))]
    if isinstance(kind, T.MapType):
        parts = [("{key}", kind.keyType, F.map_keys), ("{value}", kind.valueType, F.map_values)]
        return [(name, part, lambda vs, of=of: F.flatten(F.transform(F.array_compact(vs), of))) for name, part, of in parts]
    return []


def _kind(kind: T.DataType) -> str:
    """A type without its parts, which are paths of their own."""
    return kind.simpleString() if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else kind.typeName()


def paths(schema: T.StructType) -> dict[str, tuple[str, Callable[[], Column]]]:
    """Every path of a schema with its type and an expression for the list of its values in a row."""
    found: dict[str, tuple[str, Callable[[], Column]]] = {}

    def walk(path: str, kind: T.DataType, values: Callable[[], Column]) -> None:
        found[path] = (_kind(kind), values)
        for name, part, step in _steps(kind):
            walk(path + name, part, lambda step=step: step(values()))

    for field in schema.fields:
        quoted = f"`{field.name.replace('`', '``')}`"
        walk(field.name, field.dataType, lambda quoted=quoted: F.array(F.col(quoted)))
    return found


def widens(actual: str, expected: str) -> bool:
    """Whether every value of the type ``actual`` is one of ``expected``."""
    if expected in _WIDER.get(actual, ()):
        return True
    target = _DECIMAL.fullmatch(expected)
    if not target:
        return False
    whole, scale = int(target[1]) - int(target[2]), int(target[2])
    source = _DECIMAL.fullmatch(actual)
    if source:
        return int(source[1]) - int(source[2]) <= whole and int(source[2]) <= scale
    return _WHOLE_DIGITS.get(actual, 99) <= whole


def verdict(actual: str | None, expected: str | None) -> str:
    if actual is None:
        return "missing"
    if expected is None:
        return "extra"
    return "same" if actual == expected else "widened" if widens(actual, expected) else "incompatible"


def _cast_to(kind: str) -> Step:
    return lambda value: value.try_cast(kind)


def schema_diff(table: DataFrame, expected: T.StructType, name: str) -> DataFrame:
    """One row for every path that the table or the expected schema has.

    Nested types are opened: ``a.b`` is a field, ``a[]`` an element, ``a{key}``
    and ``a{value}`` the sides of a map.  ``filled`` counts the values that are
    not null and ``convertible`` those of an incompatible path that a cast to
    the expected type keeps, so that a mend can be judged before it is made.
    Paths are as many as a schema has; the values are read once, as partial
    aggregates of one row, whatever their number.
    """
    here, wanted = paths(table.schema), paths(expected)
    order = sorted(here.keys() | wanted.keys())
    counts: list[Column] = []
    rows: list[Column] = []
    for place, path in enumerate(order):
        actual, values = here.get(path, (None, None))
        target = wanted[path][0] if path in wanted else None
        judged = verdict(actual, target)
        filled = convertible = F.lit(None).cast("long")
        if values is not None:
            present = F.size(F.array_compact(values()))
            counts.append(F.coalesce(F.sum(present), F.lit(0)).alias(f"f{place}"))
            filled = F.col(f"f{place}")
        if judged == "incompatible":
            kept = F.lit(0)
            if not {actual, target} & {"struct", "array", "map"}:
                kept = F.size(F.array_compact(F.transform(values(), _cast_to(target))))
            counts.append(F.coalesce(F.sum(kept), F.lit(0)).alias(f"c{place}"))
            convertible = F.col(f"c{place}")
        rows.append(F.struct(
            F.lit(name).alias("table_name"), F.lit(path).alias("path"), F.lit(target).cast("string").alias("expected"),
            F.lit(actual).cast("string").alias("actual"), F.lit(judged).alias("verdict"), filled.alias("filled"),
            convertible.alias("convertible")))
    return table.agg(F.count(F.lit(1)).alias("n"), *counts).select(F.inline(F.array(*rows)))
