"""Pages of the listing: totals hold without hits and beyond the last page."""

import pytest

from folioworks.operators import catalog
from folioworks.sources import library as lib


def _page(spark, small, **options):
    docs = lib.documents(spark, small)
    return catalog.list_documents(docs, lib.sources(spark, small), decisions=lib.decisions(spark, small), **options).collect()


@pytest.mark.parametrize("search", [None, "de"])
def test_pages_join_to_the_selection(spark, small, search):
    first = _page(spark, small, search=search, limit=100)
    total = first[0]["total"]
    pages = [_page(spark, small, search=search, limit=100, offset=at) for at in range(0, total, 100)]
    ids = [row["doc_id"] for page in pages for row in page]
    assert len(ids) == len(set(ids)) == total
    assert {row["total"] for page in pages for row in page} == {total}


def test_no_hits_and_beyond_the_end(spark, small):
    assert _page(spark, small, search="no such words anywhere") == []
    assert _page(spark, small, offset=100_000) == []
