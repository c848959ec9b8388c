"""Queries that must reach every row of their tables."""

import pytest

from inkmill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["diff_stats", "diff_opcodes", "consensus_locked_spans"])
def test_all_pages_of_all_documents(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    key = "document_id" if name == "diff_opcodes" else "doc_id"
    want = {(r.doc_id, i) for r in docs for i, x in enumerate(r.text.replace("\f", "\n").split("\n")) if x or name != "diff_opcodes"}
    got = QUERIES[name](spark, SF).select(key, "page").distinct().collect()
    assert any(len(r.text) >= 600 for r in docs) and {tuple(r) for r in got} == want
