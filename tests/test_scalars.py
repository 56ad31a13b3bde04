"""Golden values and plain-Python models of the scalar rules."""

import hashlib
import re
import uuid

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from folioworks.functions import privacy, scripture, spanish, text as t, urls

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
texts = st.lists(st.text(alphabet="aé ß\n\t.A1_ -", max_size=40), min_size=1, max_size=30)


@quick
@given(texts)
def test_collapse_and_hash_follow_python(values, rows):
    clean = [" ".join(r.split()) for r in rows]
    assert values(t.collapse_ws, rows) == clean
    assert values(t.content_hash, rows) == [hashlib.sha256(c.encode()).hexdigest() for c in clean]


@quick
@given(texts)
def test_line_normaliser_follows_python(values, rows):
    def model(x):
        lines = [" ".join(line.split()) for line in re.split(r"\r\n|\r|\n", x)]
        out = []
        for line in lines:
            if line or (out and out[-1]):
                out.append(line)
        return "\n".join(out).strip()

    assert values(t.normalize_lines, rows) == [model(r) for r in rows]


@quick
@given(texts)
def test_title_key_follows_python(values, rows):
    model = [" ".join(re.sub(r"[^\w]+", " ", r.casefold()).split()) for r in rows]
    assert values(t.normalize_title, rows) == model


def test_url_goldens(values):
    assert values(urls.identity, ["HTTPS://Example.org/talk/?id=p3&lang=eng#note"]) == ["https://example.org/talk"]
    assert values(urls.identity, ["http://h.org:8080//a//b%20c/"]) == ["http://h.org:8080/a/b c"]
    assert values(urls.canonical, ["HTTP://H.org/a/?utm_x=1&b=2&a=1&gclid=z#f"]) == ["http://h.org/a/?a=1&b=2"]
    assert values(urls.curated_canonical, ["https://H.org:443//a//?b=&a=1"]) == ["https://h.org/a?a=1"]
    assert values(urls.allowlisted_canonical, ["http://discursosud.com/x", "https://discursosud.com/x/"]) == [
        None, "https://discursosud.com/x"]


def test_url_language_and_media(values):
    assert values(urls.language, [("https://x.org/?lang=spa", "en"), ("https://x.org/", "EN"), ("https://x.org/?lang=zz", None)]
                  ) == ["es", "en", "zz"]
    assert values(urls.media_variant, [("https://x.org/t?imageView=p.jpg", ""), ("https://x.org/", "photo.JPG"),
                                       ("https://x.org/", "talk")]) == [True, True, False]


def test_metadata_from_url(values):
    talk = "https://speeches.byu.edu/talks/dallin-h-oaks/coming-closer-jesus-christ/"
    assert values(urls.author_from_url, [talk]) == ["Dallin H. Oaks"]
    assert values(urls.title_from_url, [(talk, "byu_speeches_en"), ("https://speeches.byu.edu/talks/a/", "x")]) == [
        "Coming Closer Jesus Christ", None]
    conference = "https://www.churchofjesuschrist.org/study/general-conference/1998/04/x"
    assert values(urls.published_from_url, [(conference, "general_conference"), (conference, "scriptures")]) == [
        891388800, None]


def test_source_types(values):
    cases = {
        "https://speeches.byu.edu/talks/a/b": "byu_speeches_en", "https://speeches.byu.edu/spa/talks/a/b": "byu_speeches_es",
        "https://www.churchofjesuschrist.org/study/manual/x": "church_manuals",
        "https://www.churchofjesuschrist.org/study/scriptures/x": "scriptures",
        "https://newsroom.churchofjesuschrist.org/x": "church_news", "https://rsc.byu.edu/x": "byu_rsc", "https://other.org": "custom",
    }
    assert values(lambda u: urls.source_type(F.lit(""), u), list(cases)) == list(cases.values())


def test_curated_gate(values):
    cases = {
        "https://discursosud.com/tema": "discursos_sud_es", "https://discursosud.com/tag/x": None, "http://discursosud.com/tema": None,
        "https://speeches.byu.edu/spa/talks/a/b": "byu_speeches_es", "https://speeches.byu.edu/spa/talks/a": None,
        "https://www.churchofjesuschrist.org/study/manual/x?lang=spa": "church_official_es",
        "https://www.churchofjesuschrist.org/study/manual/x?lang=eng": None,
    }
    assert values(urls.curated_source, list(cases)) == list(cases.values())


def test_scripture_references(values):
    rows = ["¿Que ensena Alma 32:21?", "d&c 4:2-3 y DyC 4:2–3; Mateo 005:01", "1Nephi 3:7 and 2  nephi 2:25", "", "Almas 3:4"]
    assert values(scripture.extract_refs, rows) == [
        ["Alma 32:21"], ["Doctrine and Covenants 4:2-3", "Matthew 5:1"], ["1Nephi 3:7", "2 Nephi 2:25"], [], []]


def damaged(value, rounds=1):
    for _ in range(rounds):
        value = value.encode("utf-8").decode("latin1")
    return value


def test_damage_is_repaired():
    for word in ("reflexión", "¿Cómo", "más", "élder", "Últimos Días", "Espíritu", "Señor", "enseñanzas"):
        assert spanish.repair_damage(damaged(word, 2)) == word
        assert spanish.repair_damage(damaged(word)) == word
    assert spanish.repair_damage("Ãƒltimos DÃƒÂ­as") == "Últimos Días"
    assert spanish.repair_damage("Ãltimos DÃ­as") == "Últimos Días"
    assert spanish.repair_damage("ÃƒÆ’Ã‚Â©lder") == "élder"


def test_clean_text_is_idempotent():
    good = "¿Cómo puedo sentir más el Espíritu del Señor?"
    assert spanish.clean_text(good, False) == good
    assert spanish.clean_text("D.Â Todd", False) == "D. Todd"
    assert spanish.clean_text(" https://x.org/a  b ", False) == "https://x.org/a  b"
    assert spanish.clean_text("a  b\n\n\n\nc", True) == "a b\n\nc"


def test_json_keeps_identifiers():
    value = {"title": damaged("Restauración", 2), "nested": {"document_id": damaged("ñ"), "source_url": " https://x/?q=%C3%AD "},
             "items": [damaged("Señor", 2)]}
    clean = spanish.clean_json(value)
    assert clean == {"title": "Restauración", "nested": {"document_id": damaged("ñ"), "source_url": "https://x/?q=%C3%AD"},
                     "items": ["Señor"]}


def test_user_ids_are_version_five(values):
    rows = ["abc", " ñandú ", "6BA7B811-9DAD-11D1-80B4-00C04FD430C8"]
    expected = [str(uuid.uuid5(uuid.NAMESPACE_URL, "p:abc")), str(uuid.uuid5(uuid.NAMESPACE_URL, "p:ñandú")), rows[2].lower()]
    assert values(lambda c: privacy.user_id(c, "p:"), rows) == expected


def test_trigram_similarity(values):
    same, none = values(lambda a, b: t.trigram_similarity(t.trigrams(a), t.trigrams(b)), [("Word Two", "two word"), ("abc", "xyz")])
    assert same == 1.0 and none == 0.0


def test_asset_checks(values):
    from folioworks.operators.assets import response_error

    def check(kind, status, body, content_type):
        return response_error(asset_type=kind, url=F.lit("https://x.org/a.pdf"), status=status.cast("int"), content=body,
                              content_type=content_type)

    assert values(check, [("pdf", "404", "x", ""), ("pdf", "200", "", ""), ("pdf", "200", "<html>", "text/html"),
                          ("pdf", "200", "no", ""), ("pdf", "200", "%PDF-1", "application/pdf"), ("mp3", "200", "x", "audio/mpeg")]) == [
        "Asset returned HTTP 404", "Asset response was empty",
        "Asset URL resolved to HTML/login content (https://x.org/a.pdf)", "PDF signature missing (content-type: unknown)", None, None]
