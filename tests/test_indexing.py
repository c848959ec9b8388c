"""The index pipeline against chunks made one by one."""

import hashlib

from pyspark.sql import functions as F

from inkmill.operators import chunking as C
from inkmill.operators.indexing import index_revisions
from inkmill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def first_number(section, text):
    return float(int(hashlib.md5((f"{section}\n{text}" if section else text).encode()).hexdigest()[:4], 16))


def test_pipeline_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = []
    for i, r in docs.items():
        text = r.text.replace("\n", "\f")
        for d in C.chunk(text.upper() if i % 3 == 0 else text):
            want.append((i, d.chunk_index, d.page_start, d.page_end, d.token_count, r.source, hashlib.md5(d.text.encode()).hexdigest(), first_number(d.section_path, d.text)))
    got = [tuple(r) for r in QUERIES["chunk_pipeline"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and any(p > 1 for _, _, _, p, *_ in got)


def test_revisions_replace_their_own_rows_only(spark):
    schema = "document_id long, revision_id long, text string"
    long = " ".join(f"word{i}" for i in range(900))
    meta = spark.createDataFrame([(1, "contract"), (2, "letter")], "document_id long, doc_type string")
    embed = lambda t: t.select("document_id", "chunk_index", F.array(F.length("embed_text").cast("float")).alias("embedding"))
    index, runs = index_revisions(spark.createDataFrame([(1, 10, long + "\f" + long), (2, 20, long), (3, 30, " \n"), (4, 40, None), (5, 50, "tiny")], schema), meta, embed)
    assert {r.document_id: (r.status, r.error) for r in runs.collect()} == {1: ("succeeded", None), 2: ("succeeded", None), 3: ("failed", "no finalized text"), 4: ("failed", "no finalized text"), 5: ("failed", "chunking produced no chunks")}
    before = index.count()
    # A new revision of document 1 stands beside the old one; the same revision of document 2 is replaced.
    index, runs = index_revisions(spark.createDataFrame([(1, 11, long), (2, 20, "new " * 300), (3, 30, "")], schema), meta, embed, index)
    rows = index.collect()
    assert {r.revision_id for r in rows} == {10, 11, 20} and all("word" not in r.text for r in rows if r.revision_id == 20)
    assert all(r.embedding and r.doc_type for r in rows) and len(rows) > before - 5
    # What fails leaves its rows as they are.
    kept, runs = index_revisions(spark.createDataFrame([(2, 20, "tiny")], schema), meta, embed, index)
    assert kept.count() == len(rows) and runs.first().status == "failed"


def test_pages_that_fit_are_not_measured_by_place(monkeypatch):
    """Only a page that is cut needs the places of what counts; before, all bodies and carries had them."""
    from inkmill.operators import chunking as C

    text = "\f".join(["A line of some words, 12 of them. " * 9, "سطر من كلمات ٣٤ " * 20, "short", "word " * 300] * 5)
    want = C.chunk(text)
    made = []
    monkeypatch.setattr(C, "Sizes", lambda t, f=C.Sizes: made.append(t) or f(t))
    assert C.chunk(text) == want and len(want) > 10 and not made
    size = C.tokens  # the estimate itself, by its formula
    assert size("abc 12 سط") == int(2 / 2.7 + 5 / 4.0 + 2 / 2.0) + 1 and size("") == 0
    assert C.tail("one two 33 four", 3) == "33 four" and C.tail("one", 50) == "one"
