"""Tools over documents, attachments, files with their metadata, and files written from rows."""

import pytest
from pyspark.sql import functions as F

from inkmill import session
from inkmill.operators import library as L
from inkmill.sources import files as X


def rows(df):
    return {r[0]: r[1:] if len(r) > 2 else r[1] for r in df.collect()}


def test_pages_and_metadata(spark):
    asked = spark.createDataFrame([(1, "a", 1, None), (2, "a", 3, None), (3, "b", 1, ["a"]), (4, "z", 1, None), (5, None, 1, None), (6, "a", None, ["a"]), (7, "a", 2, []), (8, "e", 1, None), (1, "a", 1, None)], "request_id int, document_id string, page_number int, scope array<string>")
    held = spark.createDataFrame([("a", ["p", "q"]), ("b", ["r"]), ("e", None)], "document_id string, pages array<string>")
    got = L.pages_read(asked, held)
    assert got.count() == 9
    got = rows(got)
    assert got[1] == "p" and "has 2 page(s)" in got[2] and got[3] == got[7] == L.OUTSIDE
    assert got[4].endswith("document z.") and got[5].endswith("without id.") and "without number" in got[6] and got[8].endswith("document e.")
    about = L.metadata_read(asked, spark.createDataFrame([("a", "letter")], "document_id string, doc_type string")).select("request_id", "record.doc_type", "error")
    about = rows(about)
    assert about[1] == ("letter", None) and about[3] == (None, L.OUTSIDE) and about[4][0] is None and about[4][1].endswith("z.")
    assert L.pages_read(asked.limit(0), held).count() == 0


def test_contexts(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", "r", i, t) for i, t in enumerate(["x", "y", "z", "w"])] + [("o", "e", "s", 0, "alone")], "chunk_id string, document_id string, revision_id string, chunk_index int, text string")
    asked = spark.createDataFrame([(1, "c1", None, None, None), (2, "c0", 10**9, 10**9, ["d"]), (3, "c3", 0, 0, ["e"]), (4, "none", 1, 1, None), (5, "o", 1, 1, ["e"]), (6, "c2", -1, -1, None)], "request_id int, chunk_id string, before long, after long, scope array<string>")
    got = rows(L.contexts_read(asked, chunks))
    assert (got[1], got[2], got[5], got[6]) == ("x\n\ny\n\nz", "x\n\ny\n\nz\n\nw", "alone", "")
    assert got[3].endswith("of this conversation.") and got[4] == "There is no chunk none."


def test_scopes(spark):
    asked = spark.createDataFrame([(1, 7, "all", ["x"]), (2, 7, "selected", ["b", "a", "b"]), (3, 7, "selected", ["a", "c", "z"]), (4, 7, "selected", []), (5, 7, None, ["a"]), (6, 7, "selected", None)], "request_id int, owner int, scope string, document_ids array<string>")
    held = spark.createDataFrame([("a", 7), ("b", 7), ("c", 8), ("a", 7)], "document_id string, owner int")
    got = rows(L.scopes_checked(asked, held))
    assert got[1] == ([], None) and got[2] == (["b", "a"], None) and got[3] == (None, "Not available: c, z")
    assert [got[k][0] for k in (4, 5, 6)] == [None] * 3 and all(got[k][1] for k in (4, 5, 6))


def test_listed(spark):
    docs = spark.createDataFrame([(f"d{i:02}", "ready" if i % 2 else "new", f"Title {i}", ["tax"] if i % 3 == 0 else None, "letter", "en") for i in range(130)], "document_id string, status string, title string, keywords array<string>, doc_type string, lang string")
    assert L.documents_listed(docs).count() == 20 and L.documents_listed(docs, limit=99).count() == 50
    assert [r.document_id for r in L.documents_listed(docs, ["d09", "d11", "d10"], text="tax").collect()] == ["d09"]
    assert L.documents_listed(docs, []).count() == 0 == L.documents_listed(docs, lang="ar").count()


def test_attachments(spark):
    pages = spark.createDataFrame([("a", 2, "two ", True, False), ("a", 1, "  one", True, False), ("b", 1, "x", True, False), ("b", 2, None, None, False), ("c", 1, "y", True, True)] + [("d", i, "", False, None) for i in range(6)], "f string, n int, t string, ok boolean, bad boolean")
    got = rows(L.attachments_read(pages, ["f"], "n", "t", F.col("ok"), F.col("bad")))
    assert got == {"a": (2, True, "one\ftwo", None), "b": (2, False, None, [1, 2]), "c": (1, False, None, [1]), "d": (6, False, None, [0, 1, 2, 3])}


def test_page_metadata(spark, tmp_path):
    for stem, data in (("x", '{"pages": 3, "tokens": 9}'), ("y", "not json"), ("z", None), ("w", "[1]")):
        (tmp_path / stem).mkdir()
        (tmp_path / stem / f"{stem}.md").write_text(f"text of {stem}")
        if data:
            (tmp_path / stem / f"{stem}_metadata.json").write_text(data)
    (tmp_path / "x" / "other_metadata.json").write_text('{"pages": 7}')
    assert {(r.stem, r.metadata) for r in X.page_metadata(spark, str(tmp_path)).collect()} == {("x", '{"pages": 3, "tokens": 9}'), ("y", "{}"), ("z", "{}"), ("w", "{}")}
    assert {(r.stem, r.pages) for r in X.page_metadata(spark, str(tmp_path), "pages int").collect()} == {("x", 3), ("y", None), ("z", None), ("w", None)}


def test_write_files(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.txt", b"one"), (1, "b.bin", bytes(range(256))), (2, "a.txt", b""), (3, "../up", b"no"), (4, None, b"no"), (5, "c", None), (1, "a.txt", b"one")], "id long, name string, content binary").repartition(3)
    root = f"file://{tmp_path}/out"
    for _ in range(2):  # written again, the files are the same
        got = X.write_files(files, root, "id").collect()
        assert sorted((r.folder, r.name, r.size) for r in got) == [("1", "a.txt", 3), ("1", "a.txt", 3), ("1", "b.bin", 256), ("2", "a.txt", 0)]
    back = {(p.parent.name, p.name): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert {("1", r.name) for r in X.read_files(spark, root).collect()} <= set(back)
    assert back == {("1", "a.txt"): b"one", ("1", "b.bin"): bytes(range(256)), ("2", "a.txt"): b""}
    assert X.write_files(files.limit(0), root, "id").count() == 0


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.build("spark://somewhere:7077")
