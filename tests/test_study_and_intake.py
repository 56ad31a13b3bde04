"""Export lines and the curated intake."""

import textwrap

from pyspark.sql import functions as F

from folioworks.operators import curation, pages, study

SPANISH = "El Señor es bueno con los que en su fe y por la gracia de Dios se acercan a Cristo como una familia para el bien. " * 6


def test_wrapping_follows_textwrap(values):
    rows = ["## " + "palabra " * 40, "x" * 200 + " y", "> corto", ""]
    plain = [r.replace("#", "").replace(">", "").strip() for r in rows]
    assert values(study.wrap_lines, rows) == [textwrap.wrap(p, 88) or [""] for p in plain]


def test_curated_text_thresholds(spark):
    long = [f"Bloque {i} " + "palabra " * 30 for i in range(4)]
    rows = [(1, long + [long[0].upper(), "corto"]), (2, long[:3]), (3, ["corto"] * 9)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, b array<string>").select(
        "i", pages.curated_text(F.col("b")).alias("c")).collect()}
    assert got == {1: "\n\n".join(x.strip() for x in long), 2: None, 3: None}


def test_intake_reports_the_first_reason(spark):
    page = f"<html><body><nav>menu</nav><article><h1>Un título</h1><p>{SPANISH}</p><p>{SPANISH}</p></article></body></html>"
    items = [
        (1, "https://discursosud.com/a", "es", 200, "text/html", page), (2, "http://discursosud.com/a", "es", 200, "text/html", page),
        (3, "https://example.org/a", "es", 200, "text/html", page), (4, "https://discursosud.com/a", "eng", 200, "text/html", page),
        (5, "https://discursosud.com/a", "es", 500, "text/html", page), (6, "https://discursosud.com/a.pdf", "es", 200, "", page),
        (7, "https://discursosud.com/a", "es", 200, "text/html", "<p>poco</p>"),
    ]
    frame = spark.createDataFrame(items, "item_id int, url string, language string, http_status int, content_type string, body string")
    got = {r.item_id: r for r in curation.intake(frame.withColumn("tags", F.array(F.lit("Faith")))).collect()}
    assert got[1].status == "ready" and got[1].title == "Un título" and got[1].tags == ["Fe", "Discursos SUD", "Doctrina"]
    assert got[1].content.count(SPANISH.strip()) == 1 and "menu" not in got[1].content
    assert [got[i].reason for i in range(2, 8)] == [
        curation.BAD_URL, curation.NOT_ALLOWED, curation.DECLARED_LANGUAGE, curation.NOT_200, curation.PDF_PENDING, curation.NO_TITLE]
