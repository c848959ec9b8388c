"""The n-gram model against a plain one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import ngram_lm as L

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["</s>"]


class Plain:
    """Dictionaries of n-grams as tuples of words."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {n: Counter() for n in range(1, order + 1)}
        self.raw = Counter()
        for t in texts:
            x = ["<s>"] * (order - 1) + words_of(t)
            self.raw.update(x[order - 1 :])
            self.counts[order].update(tuple(x[i - order + 1 : i + 1]) for i in range(order - 1, len(x)))
        for n in range(order - 1, 0, -1):
            self.counts[n].update(g[1:] for g in self.counts[n + 1])
        self.n, self.v = sum(self.raw.values()), len(self.raw)
        self.d, self.by_context = {}, {}
        for n, c in self.counts.items():
            times = Counter(c.values())
            self.d[n] = L.discounts(*(times[k] for k in (1, 2, 3, 4)))
            held = self.by_context[n] = defaultdict(lambda: [0, 0, 0, 0])
            for g, k in c.items():
                held[g[:-1]][0] += k
                held[g[:-1]][min(k, 3)] += 1

    def p(self, context, word, n=None):
        n = self.order if n is None else n
        if n == 0:
            return 1 / (self.v + 1)
        context = context[len(context) - n + 1 :] if n > 1 else ()
        s = self.by_context[n].get(context)
        below = self.p(context[1:], word, n - 1)
        if not s:
            return below
        c = self.counts[n].get((*context, word), 0)
        return (c - self.d[n][min(c, 3)]) / s[0] + sum(self.d[n][k] * s[k] for k in (1, 2, 3)) / s[0] * below

    def row(self, i, text, held):
        x = ["<s>"] * (self.order - 1) + words_of(text)
        at = range(self.order - 1, len(x))
        base = sum(math.log10((self.raw[x[k]] + 1) / (self.n + self.v + 1)) for k in at)
        return (i, held, len(at), sum(self.raw[x[k]] > 0 for k in at), self.n, base, sum(math.log10(self.p(tuple(x[k - self.order + 1 : k]), x[k])) for k in at))


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcÉé") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    text = lambda: rng.choice([" ", "", "\t"]) + " ".join(rng.choice(vocabulary[: rng.choice([3, 40])]) for _ in range(rng.choice([0, 1, 4, 40]))) + rng.choice(["", "\n", "  Z\x1c"])
    rows = [(i, text()) for i in range(n)]
    return rows + [(5, rows[5][1]), (6, "other"), (None, "a b"), (None, None), (901, None), (902, ""), (903, "the " * 5000 + "A b " * 3000)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], r[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("order, block, shard", [(2, L.BLOCK, L.SHARD), (2, 300, 700), (3, 500, 900), (1, 300, 900), (4, 2000, 5000)])
def test_scores(spark, monkeypatch, order, block, shard):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "SHARD", shard)
    rows = corpus()
    model = Plain([t for i, t in rows if not is_held(i)], order)
    want = [model.row(i, t, is_held(i)) for i, t in rows]
    df = spark.createDataFrame([(i, t, is_held(i), 1, "s") for i, t in rows], "doc_id long, text string, held boolean, block long, shard string").repartition(3)
    got, made = L.fit_and_score(df, order)
    same([tuple(r) for r in got.collect()], want)
    if order == 3:  # other documents by the stored model, and again the same ones
        again = [tuple(r) for r in L.score(df.drop("held"), made).collect()]
        same([(*r[:1], is_held(r[0]), *r[2:]) for r in again], want)


def test_probabilities_add_up_to_one():
    model = Plain([t for _, t in corpus()], 2)
    for context in [("<s>",), ("a",), ("never",)]:
        assert abs(sum(model.p(context, w) for w in [*model.raw, "unknown"]) - 1) < 1e-9


def test_op11_beats_the_base_on_held_out_documents(spark):
    rows = L.op11(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = Plain([t for i, t in docs.items() if not is_held(i)], L.ORDER)
    same([tuple(r) for r in rows], [model.row(i, t, is_held(i)) for i, t in docs.items()])
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.op11(none).count() == 0
    held = next(i for i in range(99) if is_held(i))
    only = L.op11(spark.createDataFrame([(held, "a b"), (held, None)], none.schema)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in only} == {(0, 0, 0.0, 0.0)}
    long = "word " * 1_100_000
    r = L.op11(spark.createDataFrame([(held + 1, long)], none.schema)).first()
    assert r.n_tokens == 1_100_001 and r.base_score < r.score < 0
    wide = L.fit_and_score(spark.createDataFrame([(1, "a", True), (2, "b", False)], "doc_id long, text string, held boolean").withColumn("kind", F.lit("ask")).withColumn("n_tokens", F.lit("x")))[0]
    assert wide.columns == [x.split()[0] for x in L.RESULT.split(", ")] and wide.count() == 2


def test_packing_ids():
    x = np.array([0, 1, 2**56 - 1, 123456789012345], np.uint64)
    assert L.ids_of(L.packed(x)).tolist() == x.tolist() and len(L.packed(x)) == 28
