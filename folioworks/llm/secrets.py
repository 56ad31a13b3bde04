"""Secret scans with an incremental ledger of content-addressed blobs.

Every text is a blob named by its SHA-256; the same content under other paths,
or in another historical version, is the same blob.  The ledger holds a row for
each blob and rule version that was scanned, with what was found.  A scan reads
the ledger, takes only the pairs that are not in it, scans each such blob once,
and joins the findings back to all paths.

Defined cases: a null text is the empty text; repeated rows are paths of the
same blob and get a row each; a blob without findings is in the ledger too, with
an empty list; extra columns stay out of the way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioworks.llm.common import bounded_batches
from folioworks.session import write_once

RULES_VERSION = "2"

# The base rules and their least lengths, in the order in which kinds are listed.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 12), ("access", r"(AKIA[A-Z0-9]+)", 1, 18), ("hex", r"([0-9a-f]+)", 1, 16))
# Rules of this library: whole matches count.
ADDED = (
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 0),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 0),
    ("url_login", r"(://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@)", 1, 0),
)
RULES = BASE + ADDED
KINDS = tuple(r[0] for r in RULES)
#: A text that holds none of these, letters of either case, has no match of the rule.  They save the slow search.
NEEDLES = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "pem": ("-----begin ",), "jwt": ("eyj",),
           "url_login": ("://",)}

_FINDING = "array<struct<kind: string, start: long, end: long>>"
_LEDGER = f"blob string, rules string, findings {_FINDING}"


def find(text: str, compiled: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of all findings, in code points, in order."""
    lower = text.lower()  # only for the needles, which are ASCII
    found = []
    for place, (kind, pattern, group, least) in enumerate(compiled):
        if any(n in lower for n in NEEDLES.get(kind, ("",))):
            found += [(m.start(), place, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def compile_rules() -> list[tuple[str, re.Pattern, int, int]]:
    """Maximal runs under the least length match nothing, so the search for hex may ask for the length at once."""
    patterns = {kind: pattern for kind, pattern, _, _ in RULES} | {"hex": r"([0-9a-f]{16,})"}
    return [(kind, re.compile(patterns[kind]), group, least) for kind, _, group, least in RULES]


def blob_of(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def unseen_blobs(docs: DataFrame, ledger: DataFrame | None, text_col: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """(blob, text): every content that the ledger has no row for under ``rules``, once per task that holds it.

    Copies are dropped inside each task before anything moves, so a content that
    fills a third of the table costs one row per task.
    """
    bounded_batches(docs.sparkSession)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts, blobs = [], []
            for text in batch.column(0).to_pylist():
                digest = hashlib.sha256((text or "").encode("utf-8", "surrogatepass"))
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    blobs.append(digest.hexdigest())
                    texts.append(text or "")
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(texts, pa.string())], ["blob", "text"])

    blobs = docs.select(F.col(text_col).alias("text")).mapInArrow(once, "blob string, text string")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == rules).select("blob").distinct(), "blob", "left_anti")
    return blobs


def scan(blobs: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
    """Ledger rows of ``blobs``; each blob is scanned once, in the task that its name is dealt to."""
    finding = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, seen = compile_rules(), set()
        for batch in batches:
            names, findings = [], []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blob not in seen:
                    seen.add(blob)
                    names.append(blob)
                    findings.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(text, compiled)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([rules] * len(names), pa.string()),
                                              pa.array(findings, finding)], ["blob", "rules", "findings"])

    return blobs.repartition("blob").mapInArrow(run, _LEDGER)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """The ledger with the rows of all blobs of ``docs``; the new rows are written before anything uses them."""
    added = write_once(scan(unseen_blobs(docs, ledger, text_col, rules), rules), "secret-ledger")
    return added if ledger is None else ledger.select("blob", "rules", "findings").unionByName(added)


def findings_by_path(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rules: str = RULES_VERSION) -> DataFrame:
    """(id, findings): every path with the findings of its blob; null if the blob is not in the ledger.

    Only blobs with findings are joined as such; a path is known to be clean if
    its blob has a row without findings.
    """
    paths = docs.select(F.col(id_col).alias("id"), blob_of(text_col).alias("blob"))
    known = ledger.where(F.col("rules") == rules).select("blob", "findings")
    return paths.join(known, "blob", "left").select("id", "findings")


def span_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def counts_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")


def base_of(findings: Column) -> Column:
    return F.filter(findings, lambda x: x["kind"].isin([r[0] for r in BASE]))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]",
             ledger: DataFrame | None = None) -> DataFrame:
    """The documents with every found span replaced by ``mask``; overlapping spans become one mask."""
    ledger = update_ledger(docs, ledger, text_col)
    hits = ledger.where((F.col("rules") == RULES_VERSION) & (F.size("findings") > 0)).select(F.col("blob").alias("_blob"), F.col("findings").alias("_found"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    place = docs.columns.index(text_col)
    joined = plain.withColumn("_key", blob_of(names[place])).join(hits, F.col("_key") == F.col("_blob"), "left").select(*names, "_found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, found in enumerate(batch.column(len(names)).to_pylist()):
                if found:
                    texts[i] = masked(texts[i], [(x["start"], x["end"]) for x in found], mask)
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(place).type) if i == place else batch.column(i)
                                              for i in range(len(names))], names)

    return joined.mapInArrow(run, plain.schema).toDF(*docs.columns)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]
