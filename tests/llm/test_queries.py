import re

import pytest
from gleanery.llm import queries

from tests.oracle import same_rows

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL and n != "op3_packing"])
def test_a_row_for_each_document(spark, name):
    out = queries.QUERIES[name](spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF}/documents.parquet").count()
