"""Common runs against the standard library's matcher, which defines them."""

import difflib
import random
import time

import pytest

from inkmill.functions import matching as M
from inkmill.operators import diffing as D


def library(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False)


def pairs(seed=1):
    rng = random.Random(seed)
    for alphabet in ("ab", "abcde ", "abcdefghijklmnopqrstuvwxyz  "):
        for n in (0, 1, 5, 30, 150, 700):
            for _ in range(8):
                a = [rng.choice(alphabet) for _ in range(n)]
                b = list(a)
                for _ in range(rng.choice([0, 1, 4, 20])):
                    at = rng.randrange(len(b) + 1)
                    b[at : at + rng.choice([0, 1, 3])] = [rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3]))]
                yield a, b if rng.random() < 0.8 else [rng.choice(alphabet) for _ in range(rng.randrange(n + 1))]
    yield list("ab" * 300), list("ab" * 200 + "c" + "ab" * 150)
    yield list("x" * 500), list("x" * 380 + "y" + "x" * 90)
    yield list("abc" * 100 + "q" + "cab" * 100), list("cab" * 120)


@pytest.mark.parametrize("limit", [M.PAIRS, 0])
def test_like_the_library(monkeypatch, limit):
    """All by pieces where these suffice, and all by the automaton."""
    monkeypatch.setattr(M, "PAIRS", limit)
    for a, b in pairs():
        m = library(a, b)
        assert M.steps(a, b) == m.get_opcodes(), (a, b)
        assert M.runs(a, b) == [tuple(x) for x in m.get_matching_blocks()][:-1]
        assert M.by_automaton(a, b)[2] == M.by_table(a, b)[2] == m.find_longest_match().size


def test_stats_like_the_library():
    for a, b in [("naïve café\r\n", "naive cafe\r\n"), ("", ""), ("abc", ""), (None, "x"), ("والكتاب", "الكتاب")]:
        x, y = D.clusters(a), D.clusters(b)
        assert D.stats_of(a, b)[4] == round(library(x, y).ratio(), 4)
        assert [o[0] for o in D.opcodes_of(a, b)] == [o[0] for o in library(x, y).get_opcodes()]


def test_long_pages_end_soon():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(20_000))
    other = text.replace("abc", "xyz")
    began = time.time()
    assert D.stats_of(text, other)[2] > 0 and D.stats_of("na " * 20_000, "na " * 15_000 + "x" + "na " * 4_000)[4] > 0.9
    assert time.time() - began < 60


def test_equal_places_are_taken_at_once(monkeypatch):
    """Where no piece lies elsewhere too, no range is searched for its longest run."""
    asked = []
    monkeypatch.setattr(M, "longest", lambda *a, f=M.longest: asked.append(a) or f(*a))
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(200))
    other = text.replace("ab", "xb").replace("cd", "cy")
    for a, b in [(text, other), (text + "ñ", other + "ñ"), (text + "م", other + "م"), (list(text), list(other))]:
        assert M.steps(a, b) == library(a, b).get_opcodes()
    assert not asked


def test_characters_that_nothing_joins():
    text = "".join(c for c in map(chr, range(0x3000)) if not D.JOINED.match(c))
    assert D.clusters(text) == text and len(text) > 1000
    assert D.clusters("a\r\nb") == ["a", "\r\n", "b"] and D.clusters("éx") == ["é", "x"]


def test_transcripts_in_rows_as_gathered(spark):
    from pyspark.sql import functions as F

    from inkmill.plans.edits import pages_of

    docs = spark.createDataFrame([(1, "the nation and the station\nother lines of the text"), (2, None), (3, "")], "doc_id long, text string")
    rows = pages_of(docs)
    pages = rows.select("doc_id", "page", F.lit(1).alias("engine"), "text").union(rows.select("doc_id", "page", F.lit(2), "other")).union(rows.select("doc_id", "page", F.lit(3), "third"))
    here = rows.withColumn("f", D.locked_spans(F.array("text", "other", "third"))).select("doc_id", "page", "f.spans", "f.agreement")
    assert sorted(here.collect()) == sorted(D.consensus(pages, ["doc_id", "page"], "engine").collect())
    ids = rows.withColumn("document_id", F.struct("doc_id", "page"))
    revisions = ids.select("document_id", F.lit(1).alias("revision_no"), "text").union(ids.select("document_id", F.lit(2), "other"))
    assert sorted(D.revision_diff(revisions).collect()) == sorted(ids.select("document_id", D.opcodes("text", "other").alias("ops")).collect())
