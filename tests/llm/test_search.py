"""Hashed words and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkmill.llm import ranked_search as S
from inkmill.llm import words as W

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ascii_lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


@pytest.mark.parametrize("inside, pattern", [(W.BLANK_SEPARATED, r"[^\x20\x09-\x0D]+"), (W.ALPHANUMERIC, TERM.pattern)])
def test_hashed_words(inside, pattern):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB éÉ日\t\n.0\x1c") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", "y" * (3 * W.CHUNK) + " y a", "a b " * W.CHUNK, " " * (2 * W.CHUNK), "z" * W.CHUNK]
    hashes, sizes = W.hashed(pa.array(texts), inside)
    want = [re.findall(pattern, ascii_lower(t or "")) for t in texts]
    assert sizes.tolist() == [len(x) for x in want]
    names = {}
    assert all(names.setdefault(w, h) == h for w, h in zip((w for x in want for w in x), hashes.tolist()))
    assert len(set(names.values())) == len(names)
    sliced = W.hashed(pa.array(texts).slice(100, 50), inside)
    assert sliced[1].tolist() == sizes[100:150].tolist()


def plain(docs, items, top=S.TOP):
    """(item number, rank, id, score) from every document's score."""
    terms = [(i, TERM.findall(ascii_lower(t or ""))) for i, t in docs]
    held = [(i, Counter(x), len(x)) for i, x in terms if x]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for k, text in enumerate(items):
        scored = []
        for i, c, size in held:
            m = 100 - 25 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(ascii_lower(text or "")) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(k, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize("block_terms", [S.BLOCK_TERMS, 40])
def test_rank(spark, monkeypatch, block_terms):
    monkeypatch.setattr(S, "LEAF", 4)
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice(["", ".", "-X"])
    docs = [(i, text(rng.choice([1, 5, 20, 90]))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(60)]  # more copies than answers: ties
    docs += [(7, docs[7][1]), (7, "other"), (None, docs[3][1]), (900, None), (901, ""), (902, "... --"), (903, "a " * 300_000)]
    items = [docs[3][1], text(8), text(30), text(3), "", None, "absent", "a A a", docs[3][1], docs[9][1]]
    d = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in docs], "doc_id long, text string, item long, score double, rank string").repartition(5)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in S.rank(d, q, block_terms=block_terms).collect()]
    assert sorted(got, key=lambda r: r[:2]) == plain(docs, items)


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(4)
    kinds = rng.permutation(np.repeat(np.arange(4), 64))
    docs = [np.unique(rng.integers(0, 50, 20)) + 100 * k for k in kinds]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    order = S.bisected(starts, np.concatenate(docs), leaf=64)
    assert sorted(order) == list(range(256))
    assert all(len(set(kinds[order[a : a + 64]])) == 1 for a in range(0, 256, 64))


def test_clusters_are_passed_over(monkeypatch):
    """The bounds let most clusters go unseen where documents differ, without loss."""
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 50, 20)) + 100 * (i % 8) for i in range(512)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    order = S.bisected(starts, np.concatenate(docs))
    sizes = np.diff(starts)[order]
    arrays = {"ids": order, "lengths": sizes, "starts": np.concatenate([[0], np.cumsum(sizes)]), "terms": np.concatenate([docs[i] for i in order]).astype("<i4"), "counts": np.ones(sizes.sum(), "<i4")}
    held = S.Clusters({k: pa.scalar(v.tobytes(), pa.binary()) for k, v in arrays.items()}, 512, int(sizes.sum()), np.full(800, 1000))
    seen = []
    monkeypatch.setattr(S, "ranges", lambda a, n, f=S.ranges: seen.append(len(a)) or f(a, n))
    terms = docs[0]
    held.best(terms, np.ones(len(terms), np.int64), 1, 20, None)
    looked = sum(seen[1::2])  # clusters of which postings were read
    assert looked <= 4


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.op13(docs.limit(0), items).count() == 0 and S.op13(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in S.op13(docs, items).collect()] == [(1, 1, 1)]
