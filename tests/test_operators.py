"""Operators that SQL cannot express, and cases with hand-derived results."""

import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from inkmill.functions import conversation as K
from inkmill.functions import edits as G
from inkmill.functions import layout as L
from inkmill.functions import metadata as E
from inkmill.functions import text as T
from inkmill.operators import chunking as C
from inkmill.operators import diffing as D
from inkmill.operators import lifecycle as M
from inkmill.operators import relational as R
from inkmill.operators import retrieval as V
from inkmill.plans.text import language_of
from inkmill.sources import files as X
from inkmill.sources import tables as S
from inkmill.streaming import lifecycle as ST


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_chunks_cover_and_overlap():
    text = "Heading\n" + " ".join(f"word{i}" for i in range(4000)) + "\f" + "second page. " * 40
    drafts = C.chunk(text)
    assert [d.chunk_index for d in drafts] == list(range(len(drafts)))
    assert drafts[0].section_path == "Heading" and drafts[-1].page_end == 2
    for a, b in zip(drafts, drafts[1:]):
        assert b.text.split()[0] in a.text.split()
    words = {w for d in drafts for w in d.text.split()}
    assert {f"word{i}" for i in range(4000)} <= words


def test_chunk_edges():
    assert C.chunk(None) == C.chunk("") == C.chunk("\f\f") == []
    assert C.chunk("tiny") == []
    # Leading blank pages leave the first page number at 1, and the last carry is a chunk of its own.
    text = "\f\f" + "some words here. " * 60
    drafts = C.chunk(text)
    assert drafts[0].page_start == 1 and drafts[0].page_end == 3
    assert drafts[-1].section_path == "" and drafts[-1].arabic_ratio is None
    long = ["x" * 10_000][0]
    cut = C.spans(long, 768)
    assert "".join(long[a:z] for a, z in cut) == long and all(C.tokens(long[a:z]) <= 769 for a, z in cut)


def test_chunk_rules():
    """The seven rules, on texts written for them; least 4, most 10 and overlap 2 tokens make them short."""
    cut = lambda t: C.chunk(t, overlap=2, least=4, most=10)
    pages = cut("Intro\nfirst words of page one\fsecond page goes on here")
    assert [(d.page_start, d.page_end) for d in pages] == [(1, 1), (1, 2)]  # what is carried crosses pages
    assert pages[0].section_path == "Intro" and pages[1].section_path == "second page goes on here"
    assert pages[1].text.startswith("page one\n") and pages[1].char_count == len(pages[1].text)
    first, second = cut("a longer sentence here.another longer sentence here.")[:2]
    assert "." not in first.text and second.text.split("\n")[0] == "here"  # the separator between two pieces is dropped
    assert [C.spans(t, 3) for t in ("", "abc", "aa bb cc dd ee ff")] == [[(0, 0)], [(0, 3)], [(0, 11), (12, 17)]]
    assert C.tail("one two three", 0) == "" and C.tail("one two three", 2) == "three" and C.tail("one two", 99) == "one two"
    last = C.chunk("word " * 400)[-1]
    assert last.section_path == "" and last.arabic_ratio is None and last.token_count >= C.LAST


def test_tokens_agree_with_the_expression(spark):
    for t in ["", "hello world 12", "سلام ١٢", "a" * 99]:
        assert value(spark, T.heuristic_tokens(F.lit(t))) == C.tokens(t)


def test_headings_agree_with_the_expression(spark):
    for t in ["1. Intro", "SUMMARY", "A short line", "A sentence.", "", "x" * 81, "ABC", "Total:", "خلاصة،"]:
        assert value(spark, C.is_heading(F.lit(t))) == C.heading(t), t


def test_diff():
    assert D.opcodes_of("abc", "abd") == [("equal", 0, 2, 0, 2), ("replace", 2, 3, 2, 3)]
    assert D.stats_of("abcd", "abXcd") == (1, 0, 0, 0.25, 0.8889)
    assert D.stats_of("", "") == (0, 0, 0, 0.0, 1.0)


def test_consensus():
    base = "The quick brown fox jumps over the dog"
    spans, share = D.agreed([base, base.replace("fox", "fax"), None, " "])
    assert spans == [(0, 17), (18, 38)] and share == round(37 / 38, 4)
    assert D.agreed([base]) == ([], 0.0)


def test_edited_pages(spark):
    assert value(spark, D.edited_pages(F.lit("a\fb\fc"), F.lit("a\fx"))) == [2, 3]
    assert value(spark, D.edited_pages(F.lit("a"), F.lit("a"))) == []


def test_guards_sum_up(spark):
    page = "Quote: EUR 48,200 sent on 2031-03-09 by Lena Ltd."
    proposals = [
        (11, 17, "48,200", "49,300", 0.9, "digit", "digit_invented"), (0, 5, "Quote", "Quote", 0.9, "spacing", "no_op"), (0, 5, "Qote", "Quote", 0.9, "spacing", "span_mismatch"),
        (-1, 5, "x", "y", 0.9, "spacing", "invalid_span"), (9, 5, "x", "y", 0.9, "spacing", "invalid_span"), (40, 44, "Lena", "Lenz", 0.95, "letterform", None), (41, 45, "ena ", "enz ", 0.5, "letterform", None),
        (45, 49, "Ltd.", "Limited by its many shares", 0.9, "other", "expansion"), (18, 22, "sent", "zzzz", 0.9, "other", "too_dissimilar"), (18, 22, "sent", "sen\u0648", 0.9, "other", "script_switch"),
        (7, 10, "EUR", "E U R", 0.9, "spacing", None), (18, 22, "sent", "set", 0.7, "spacing", None), (None, 3, "x", "y", 0.9, "spacing", "invalid_span"), (0, 5, "Quote", "Quota", 0.9, "spacing", "consensus_locked"),
    ]
    schema = "span_start int, span_end int, original string, replacement string, confidence double, kind string, rule string, n int"
    rows = spark.createDataFrame([(*p, n) for n, p in enumerate(proposals)], schema)
    change = F.struct("span_start", "span_end", "original", "replacement", "confidence", "kind")
    locked, seen = F.array(F.struct(F.lit(0).alias("s"), F.lit(5).alias("e"))), F.array(F.lit("7"))
    judged = rows.select("n", G.rule(F.lit(page), change, locked, seen).alias("rule")).collect()
    assert {r.n: r.rule for r in judged} == {n: p[-1] for n, p in enumerate(proposals)}
    all_ = rows.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("n", change.alias("c")))), lambda x: x["c"]).alias("c"))
    r = all_.select(G.guarded(F.lit(page), F.col("c"), locked, seen).alias("j")).select("j", G.without_overlaps(F.col("j")).alias("k")).withColumn("text", G.apply_changes(F.lit(page), F.col("k"))).first()
    accepted = [x for x in r.j if x.rule is None]
    assert len(r.k) == 3 < len(accepted) and all(page[k.span_start : k.span_end] == k.original for k in r.k)
    assert r.text == "Quote: E U R 48,200 set on 2031-03-09 by Lenz Ltd."


def test_citations_are_retrieved(spark):
    r = value(spark, K.resolve_citations(F.lit("x [[cite:aaaaaa]] y [[cite:bbbbbb]]"), F.array(F.lit("bbbbbb"))))
    assert (r.display, r.cited, r.mode) == ("x  y [1]", ["bbbbbb"], "explicit")


def test_message_text(spark):
    parts = F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("other").alias("type"), F.lit("z").alias("text")))
    assert value(spark, K.message_text(parts)) == "a\n[image]"


def test_layout_boxes(spark):
    assert value(spark, L.bbox_of(F.lit("25 310 640 875"))).asDict() == {"x0": 0.025, "y0": 0.31, "x1": 0.64, "y1": 0.875}
    assert value(spark, L.bbox_of(F.lit("5 5 5 9"))) is None and value(spark, L.bbox_of(F.lit("a b c d"))) is None
    assert value(spark, L.to_pixels(L.bbox_of(F.lit("0,0,500,999")), F.lit(1000), F.lit(100))) == [0, 0, 500, 99]


def test_page_windows(spark):
    pages = ["a" * 5000, "b" * 2000, "c" * 4000, "d" * 9000, "e"]
    assert [len(w) for w in value(spark, E.windows(F.lit("\f".join(pages))))] == [7001, 4000, 9000, 1]


def test_hijri_fixture(spark):
    assert str(value(spark, E.hijri_day(E.hijri_parts(F.lit("١ محرم ١٤٤٥ هـ"), T.ar_normalize)))) == "2023-07-19"


def test_graphemes(spark):
    assert value(spark, T.graphemes(F.lit("é🇫🇷a"))) == ["é", "🇫🇷", "a"]


def test_lifecycle(spark):
    asked = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("force")) for s, f in [("preprocessing", False), ("preprocessing", False), ("ready", False), ("ready", True), ("indexing", False)]])
    assert value(spark, M.replay(asked, "uploaded")) == ("indexing", 3, 1, 1)


def test_cover_density(spark):
    one = lambda *ps: F.array(*[F.lit(p) for p in ps])
    assert value(spark, V.cover_density([one(1, 5, 9)])) == pytest.approx(0.3)
    assert value(spark, V.cover_density([one(0), one(1)])) == pytest.approx(0.1)
    assert value(spark, V.cover_density([one(0), one(4)])) == pytest.approx(0.1 / 4)


def test_web_query():
    assert V.parse_web_query('a "b c" -d or e') == [[(False, ["a"]), (False, ["b", "c"]), (True, ["d"])], [(False, ["e"])]]
    assert V.parse_web_query("-only") == [] == V.parse_web_query(" ")


def test_search_branches(spark):
    rows = [(i, i, t, [float(i), 1.0], "en", "letter") for i, t in enumerate(["apple pie", "apple tart", "banana"], 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string, embedding array<double>, lang string, doc_type string")
    ids = lambda df: [r.chunk_id for r in df.collect()]
    assert ids(V.hybrid_search(chunks, " ", [1.0, 1.0])) == []
    assert ids(V.hybrid_search(chunks, "apple", [1.0, 1.0], doc_ids=[])) == []
    assert ids(V.hybrid_search(chunks, "appel pie", None)) == [1]
    assert ids(V.hybrid_search(chunks, "banana", [3.0, 1.0]))[0] == 3
    # The fallback keeps the scope and ignores the type; hints that leave nothing are dropped, the scope is not.
    assert ids(V.hybrid_search(chunks, "apple", [1.0, 1.0], doc_type="memo", doc_ids=[2, 3])) == [2]
    assert ids(V.hybrid_search(chunks, "zzz", [1.0, 1.0], doc_type="memo")) == []
    assert set(ids(V.search_with_hints(chunks, "zzz", [1.0, 1.0], doc_type="memo", doc_ids=[1, 2]))) == {1, 2}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ﻻ text".encode())
    (tmp_path / "b.txt").write_bytes(b"zero\x00byte")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "d.bin").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (tmp_path / "f.txt").write_bytes("é".encode("cp1256"))
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{p("One")}{p(" ")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    got = {r.name: (r.handler, r.text) for r in X.attachment_text(X.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("text", "ﻻ text"), "b.txt": ("text", None), "c.pdf": ("pdf", None), "d.bin": ("image", None), "e.docx": ("docx", "One\na | b"), "f.txt": ("text", "é")}


def test_page_folders(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "x.md").write_text("p1\np2")
    (tmp_path / "x" / "y.md").write_text("no")
    assert [(r.stem, r.markdown) for r in X.page_folders(spark, str(tmp_path)).collect()] == [("x", "p1\np2")]


def test_replace_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    S.replace_partitions(df, f"{tmp_path}/t", ["k"])
    S.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), f"{tmp_path}/t", ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "a"), (2, "c")}


def test_update_treats_null_as_false(spark):
    df = spark.createDataFrame([(1, None), (2, True)], "k int, b boolean")
    assert {(r.k, r.b) for r in S.update_where(df, F.col("b"), b=F.lit(False)).collect()} == {(1, None), (2, False)}


def test_catalog_order(spark):
    df = spark.createDataFrame([("a", False, 1, 1.0), ("b", True, 2, 1.0), ("c", True, 1, 9.0), ("d", True, 1, 3.0)], "name string, available boolean, tier int, seconds double")
    assert [r.name for r in R.catalog_order(df).collect()] == ["d", "c", "b", "a"]


def test_heartbeats(spark, tmp_path):
    frames = ST.heartbeats(spark, 1)
    assert frames.isStreaming
    query = frames.writeStream.format("parquet").option("path", f"{tmp_path}/f").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        for _ in range(30):
            query.awaitTermination(1)
            if query.lastProgress and spark.read.schema(frames.schema).parquet(f"{tmp_path}/f").count():
                break
    finally:
        query.stop()
    assert {r.frame for r in spark.read.parquet(f"{tmp_path}/f").collect()} == {": ping\n\n"}


def test_files_by_ending(spark):
    files = spark.sql("SELECT array(named_struct('name', 'a.PNG', 'size', 5L), named_struct('name', 'b.sh', 'size', 1L), named_struct('name', '.c.png', 'size', 1L), named_struct('name', 'd.csv', 'size', 9L)) AS f")
    assert files.select(K.fit_files(F.col("f"), total=10, endings=[".png", ".csv"]).alias("n")).first().n == ["a.PNG"]
    assert files.select(K.fit_files(F.col("f"), total=15).alias("n")).first().n == ["a.PNG", "b.sh", "d.csv"]


def test_finalize_without_such_a_revision(spark):
    revisions = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True)], "document_id int, revision_no int, is_final boolean")
    chosen = spark.createDataFrame([(1, 9, 1), (2, None, 1)], "document_id int, revision_no int, current_no int")
    assert {(r.document_id, r.revision_no): r.is_final for r in M.finalize(revisions, chosen).collect()} == {(1, 1): True, (1, 2): False, (2, 1): True}


def test_vector_literals_keep_the_sign_of_zero(spark):
    from inkmill.functions import text as T

    v = [-1e-9, 0.0, -0.5, 0.00390625, -0.01171875, 1e-9, 12.25]
    row = spark.createDataFrame([(v,)], "v array<float>").select(T.vector_literal(F.col("v"))).first()[0]
    assert row == "[" + ",".join(f"{x:.7f}" for x in v) + "]"


def test_hints_are_dropped_before_texts_that_only_resemble(spark):
    rows = [(1, 1, "apple pie", [1.0, 1.0], "en", "letter"), (2, 2, "apples", [2.0, 1.0], "en", "letter"), (3, 3, "plum", [3.0, 1.0], "en", "letter")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string, embedding array<double>, lang string, doc_type string")
    found = V.search_with_hints(chunks, "apple", [1.0, 1.0], lang="none such").collect()
    assert [(r.chunk_id, r.rank_vec, r.rank_fts) for r in found] == [(r.chunk_id, r.rank_vec, r.rank_fts) for r in V.hybrid_search(chunks, "apple", [1.0, 1.0]).collect()]
    assert found[0].rank_vec == 1 and len(found) == 3


def test_siblings_of_a_large_group_are_made_in_slices(spark):
    rows = spark.createDataFrame([(1 if i < 60 else i % 5 + 2 if i < 75 else None, i) for i in range(80)], "g int, k int")
    got = R.siblings(rows, "g", "k", pairs=100)
    held = rows.collect()
    assert sorted(map(tuple, got.collect())) == sorted((a.g, a.k, b.k) for a in held for b in held if a.g is not None and a.g == b.g and a.k != b.k)
    largest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 60 * 59 / 2


def test_postings_deal_texts_and_merge_repeated_ids(spark):
    """One row a word and chunk, whatever rows its texts come in, and no exchange by words."""
    texts = [(1, "b a b"), (1, "a c"), (2, None), (2, "   "), (3, " ".join(f"w{i % 700}" for i in range(3000))), (None, "a a")]
    got = V.postings(spark.createDataFrame(texts, "chunk_id long, text string"))
    want = {}
    for i, text in texts:
        for place, word in enumerate((text or "").split()):
            want.setdefault((word, i), []).append(place)
    assert sorted((r.word, str(r.chunk_id), r.places) for r in got.collect()) == sorted((w, str(i), sorted(p)) for (w, i), p in want.items())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk_id") == plan.count("Exchange ") > 0


def test_letters_are_counted_once(spark):
    """Ratio, language and direction from one count, on texts with letters of many planes, marks, forms, digits and nothing."""
    rng = random.Random(5)
    alphabet = "abé中\U00010400\U0001f600 \n1٣۴ابًـٱ۔ﻻﷲﹰ﻿؀אݐé"
    texts = [None, "", "12 ٣", "ا", "a"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)]
    found = language_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\P{L}+") == 1 and "regexp_count" not in plan
    for r in found.collect():
        letters = [c for c in texts[r.doc_id] or "" if unicodedata.category(c).startswith("L")]
        ratio = sum(re.fullmatch(f"[{T.ARABIC}]", c) is not None for c in letters) / len(letters) if letters else 0.0
        assert r.arabic_ratio == pytest.approx(ratio, abs=1e-6)
        assert (r.lang_tag, r.direction) == ("ar" if ratio > 0.6 else "en" if ratio < 0.15 else "mixed", "rtl" if ratio > 0.4 else "ltr")
