"""Indexes of words and trigrams against searches over the texts themselves."""

import random

import pytest
from pyspark.sql import functions as F

from inkmill.functions.text import ar_normalize
from inkmill.operators import retrieval as R
from inkmill.operators import textindex as X
from inkmill.plans import search as P
from inkmill.session import table

SF = "/root/testdata/sf0.001"
QUERIES = [*P.KINDS, 'a b', '"a b" c', 'a or "b c d" -e', '-a b', '"a a"', "", '"" or', "é الكتاب"]


def texts(seed=1, n=400):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "é", "الكتاب", "the", "of", "and", "under", "apache", "mit", "licensed"]
    body = lambda n: " ".join(rng.choice(words[: rng.choice([3, 6, len(words)])]) for _ in range(n))
    rows = [(i, body(rng.choice([0, 1, 3, 10, 60])), rng.choice(["x", "y"])) for i in range(n)]
    return rows + [(n, None, "x"), (n + 1, "", "y"), (n + 2, "a b " * 3000, "x"), (n + 3, rows[5][1], "y")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(texts(), "chunk_id long, text string, lang string").repartition(3).cache()


@pytest.fixture(scope="module")
def words(chunks, tmp_path_factory):
    return X.build_words(chunks, str(tmp_path_factory.mktemp("words")), ["lang"])


def rows(found):
    return [(r.chunk_id, round(r.density, 9), r.rank_fts) for r in found.orderBy("rank_fts").collect()]


@pytest.mark.parametrize("text", QUERIES)
def test_words_like_lexical(chunks, words, text):
    """The same rows in the same order, with few blocks first so that bounds decide about the rest."""
    assert rows(X.search_words(words, text, 10, first=1)) == rows(R.lexical(chunks, text, 10))


def test_scopes(spark, chunks, words):
    inside = chunks.filter("chunk_id % 3 = 0").select("chunk_id")
    want = rows(R.lexical(chunks.filter("lang = 'x' AND chunk_id % 3 = 0"), "a b", 20))
    assert rows(X.search_words(words, "a b", 20, where=F.col("lang") == "x", allowed=inside, first=1)) == want and want


def test_long_documents_come_in_rows(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PLACES_MOST", 50)
    index = X.build_words(chunks, str(tmp_path / "w"))
    assert index.rows.agg(F.max(F.array_max(F.transform("places", F.size)))).first()[0] <= 50
    for text in ("a b", '"b a"'):
        assert rows(X.search_words(index, text, 10, first=1)) == rows(R.lexical(chunks, text, 10))


def test_blocks_are_passed_over(spark, tmp_path):
    table_words = table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    index = X.build_words(table_words, str(tmp_path / "w"))
    assert rows(X.search_words(index, "the", 3, first=1)) == rows(R.lexical(table_words, "the", 3))
    blocks, skipped = X.passed_over(index, "the", 3, first=1)
    assert blocks > 4 and skipped > 0


def test_only_the_words_rows_are_read(words):
    plan = words.of(["apache"]).select("word", "block", "most")._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "EqualTo(word,apache)" in plan
    assert "places" not in plan.split("ReadSchema")[1]


@pytest.fixture(scope="module")
def trigrams(chunks, tmp_path_factory):
    return X.build_trigrams(chunks, str(tmp_path_factory.mktemp("trigrams")), ["lang"])


@pytest.mark.parametrize("text", ["a", "apache mit", "aapche licnesed", "the of and under a b c d e é", "zzz", "", "الكتاب", "under the apache licensed mit of and"])
@pytest.mark.parametrize("above", [0.25, 0.6])
def test_trigrams_like_scores_of_all(chunks, trigrams, text, above):
    score = R.similarity(R.trigrams(ar_normalize(F.col("text"))), R.trigrams(ar_normalize(F.lit(text))))
    want = chunks.select("chunk_id", score.alias("score")).filter(F.col("score") > above).orderBy(F.desc("score"), "chunk_id").limit(15)
    got = X.search_trigrams(trigrams, text, 15, above)
    assert [(r.chunk_id, round(r.score, 9)) for r in got.collect()] == [(r.chunk_id, round(r.score, 9)) for r in want.collect()]


def test_candidates_are_few(spark, tmp_path):
    docs = table(spark, SF, "documents").select(F.col("doc_id").alias("chunk_id"), F.explode(F.split("text", "\n")).alias("text"))
    lines = docs.select(F.monotonically_increasing_id().alias("chunk_id"), "text").cache()
    index = X.build_trigrams(lines, str(tmp_path / "t"))
    query = lines.filter(F.length("text").between(40, 60)).orderBy("chunk_id").first().text
    found, n = X.candidates(index, query, 0.6), lines.count()
    want = R.similarity(R.trigrams(ar_normalize(F.col("text"))), R.trigrams(ar_normalize(F.lit(query))))
    near = {r.chunk_id for r in lines.select("chunk_id", want.alias("s")).filter("s > 0.6").collect()}
    assert near <= {r.chunk_id for r in found.collect()} and found.count() < n / 4


def test_trigram_lists_are_long(spark, tmp_path):
    """A list holds the texts of thousands that follow each other, so there are few rows by postings."""
    lines = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    lines = lines.select((F.col("doc_id") * 100000 + F.col("i")).alias("chunk_id"), "text")
    index = X.build_trigrams(lines, str(tmp_path / "t"))
    postings = lines.select(F.sum(F.size(R.trigrams(ar_normalize(F.col("text")))))).first()[0]
    assert index.lists.count() < postings / 8


ODD = ["", None, "  ", "a", "A a", "-a--b- ", "naïve Ünï", "İSTANBUL ΣΑΣ ß", "\U0001f600 x\U00020000y \U0001d538z", "日本語 テキスト 東京", "مُحَمَّد كتاب ٣٤ ۵", "e\u0301 ab\u0301c", "½ ² x²", "word " * 40, "tab\tnew\nline\x00nul", "한글 ‘q’ a_b"]


@pytest.mark.parametrize("limits", [{}, {"TEXTS": 3}, {"LETTERS": 20}, {"LETTER_BITS": 2}])
def test_trigram_lists_hold_the_sets(spark, tmp_path, monkeypatch, limits):
    """Of texts with all kinds of letters, however they fall into blocks."""
    from inkmill.functions import trigrams as T

    for name, value in limits.items():
        monkeypatch.setattr(T, name, value)
    rows = [(i, t, "x" if i % 2 else "y") for i, t in enumerate(ODD * 3)] + [(0, "again a", "x")]
    sets = spark.createDataFrame(rows, "id long, text string, lang string").select("id", R.spaced(ar_normalize(F.col("text"))).alias("spaced"), "lang", R.trigrams(ar_normalize(F.col("text"))).alias("t"))
    source = sets.toArrow()
    want = sorted((r["id"], r["lang"], x) for r in source.to_pylist() for x in r["t"])
    got, most = [], 0
    for n, block in enumerate(T.blocks(iter(source.drop_columns("t").to_batches(max_chunksize=7)), "spaced")):
        held = [r for b in T.rows_of(block, n, "spaced") for r in b.to_pylist()]
        texts = {r["class"]: r["texts"] for r in held if not r["trigram"]}
        got += [(texts[r["class"]][p]["id"], texts[r["class"]][p]["lang"], r["trigram"]) for r in held if r["trigram"] for p in r["places"]]
        assert all(t["size"] == sum(r["places"].count(p) for r in held if r["trigram"] and r["class"] == c) for c, ts in texts.items() for p, t in enumerate(ts))
        most = max(most, block.num_rows)
    assert sorted(got) == want and most <= limits.get("TEXTS", 1000)


def test_trigrams_in_scopes(spark, chunks, trigrams):
    score = R.similarity(R.trigrams(ar_normalize(F.col("text"))), R.trigrams(ar_normalize(F.lit("the of and a"))))
    inside = chunks.filter("chunk_id % 3 = 0").select("chunk_id")
    want = chunks.filter("lang = 'x' AND chunk_id % 3 = 0").select("chunk_id", score.alias("score")).filter("score > 0.25").orderBy(F.desc("score"), "chunk_id").limit(15)
    got = X.search_trigrams(trigrams, "the of and a", 15, where=F.col("lang") == "x", allowed=inside)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] != []


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, text string, lang string")
    assert X.search_words(X.build_words(none, str(tmp_path / "w")), "a").count() == 0
    assert X.search_trigrams(X.build_trigrams(none, str(tmp_path / "t")), "abc").count() == 0


def test_indexes_shuffle_texts_and_not_their_words(spark):
    """By block every grouping is done where the texts went."""
    docs = spark.range(2000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    rows = X.by_block(docs, 1000)
    assert rows.rdd.getNumPartitions() >= 12  # some 16,000 letters
    words = rows.select("block", F.explode(F.split("text", " ")).alias("word")).groupBy("word", "block").count()
    assert words._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
