import re

import pytest
from gleanery import catalog, catalog_fields, catalog_files, catalog_sources  # noqa: F401
from gleanery.functions import html
from pyspark.sql import functions as F

from tests.oracle import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


#: Rows at this size of the queries that SQL can't say: one a page or document, or counted by hand.
ROWS = {
    "page_article": 50, "page_markdown": 50, "page_visible_text": 50, "page_safe_markdown": 50, "page_rescue": 50, "page_attachments": 50,
    "page_similar": None, "stream_admission": None,
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"page_text_search"}))
def test_rows(spark, name):
    """As many as there should be, and something in them."""
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert len(rows) == ROWS[name] if ROWS[name] else len(rows) > 0
    assert name == "page_attachments" or any(v not in (None, "", []) for r in rows for v in list(r)[1:] or list(r))


def test_similar_and_found_rows_by_hand(spark):
    """The elements that a plain reading of each page's markup finds."""
    more = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = catalog.QUERIES["page_text_search"](spark, more).collect()
    assert found and {r.page_id for r in found} == {p.page_id for p in spark.read.parquet(f"{more}/pages.parquet").collect() if "Licensed under" in p.html.replace("</b>", "")}
    assert all("Licensed under" in r.text for r in found)
    items = {p.page_id: re.findall(r"<li><a[^>]*>([^<]*)</a></li>", p.html) for p in pages}
    like = catalog.QUERIES["page_similar"](spark, SF).collect()
    assert all(sorted(html.parse(x).text() for x in items[p][1:]) == sorted(r.text for r in like if r.page_id == p and r.tag == "li") for p in items)
    rescued = catalog.QUERIES["page_rescue"](spark, SF).collect()
    assert all(r.title for r in rescued) and {r.first_action for r in rescued} <= {"rescued", "none"}


@pytest.mark.parametrize("name", ["css_fields", "css_rows", "page_repeated_rows", "article_spec", "page_main", "rows_by_site"])
def test_references_that_are_cut_off(spark, tmp_path, name):
    """Texts that end inside a character reference, as those of some pages on sf0.1 do."""
    html = F.replace(F.replace(F.replace("html", F.lit("</h1>"), F.lit("&amp</h1>")), F.lit("</title>"), F.lit(" x&lty &am</title>")), F.lit("</a>"), F.lit("&#x27 &copy 1</a>"))
    spark.read.parquet(f"{SF}/pages.parquet").withColumn("html", html).toPandas().to_parquet(tmp_path / "pages.parquet")
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], str(tmp_path))


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
