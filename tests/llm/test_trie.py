"""The trie of conversations against a plain one, and its parts."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkmill.llm import prefix_trie as T

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Every node from dictionaries of whole prefixes; rows of (conv_id, turn, role, text), no ties of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].append(c)
        ends[tuple(new)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(COLUMNS).collect())


def corpus(seed=3, n=260):
    """Conversations with common beginnings, whole copies, prefixes of others, and a long pair."""
    rng, rows = random.Random(seed), []
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "é日", "", None, "go on", "x" * 9]))
    stems = [[say() for _ in range(9)] for _ in range(6)]
    for c in range(n):
        turns = list(rng.choice(stems)[: rng.randrange(1, 9)]) + [say() for _ in range(rng.choice([0, 0, 1, 3]))]
        rows += [(c, None if i == 0 else i * 2, *t) for i, t in enumerate(turns)]
    long = [(str(i % 7), "w" * (i % 5)) for i in range(3000)]
    rows += [(c, i, *t) for c in (500, 700, 800) for i, t in enumerate(long[: 3000 - (c == 800) * 40])]
    return rows + [(None, 1, "user", "nobody's"), (-7, 1, "user", "hi"), (1203, 1, "a", "b"), (1203, 2, "a", "b")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("heavy, band, shard", [(T.HEAVY, T.BAND, T.SHARD), (5, 64, 20), (2, 700, 100)])
def test_op12(spark, monkeypatch, heavy, band, shard):
    monkeypatch.setattr(T, "HEAVY", heavy)
    monkeypatch.setattr(T, "BAND", band) if band > 64 else monkeypatch.setattr(T, "BAND", 4)
    monkeypatch.setattr(T, "SHARD", shard)
    rows = corpus() if band > 64 else [r for r in corpus() if r[0] not in (500, 700, 800)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(T.op12(df)) == plain(rows)


def test_op12_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(T.op12(df)) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_op12_sql(spark):
    """The SQL against the plain trie, on an own corpus and the supplied table."""
    import duckdb
    import pandas as pd

    for rows in (corpus(5, 150)[:-5], [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]):
        rows = [r for r in rows if r[0] not in (500, 700, 800)]
        conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
        found = duckdb.sql(T.OP12_SQL)
        assert found.columns == COLUMNS
        assert sorted(tuple(-1 if x is None else x for x in r) for r in found.fetchall()) == plain(rows)


def test_edges(spark):
    """Ties, repeated rows, clashing names, a very long text and empty tables."""
    df = spark.createDataFrame([(1, 1, "a", "b")] * 3 + [(2, 1, "a", "b"), (2, 1, "a", "b"), (2, None, "z", "long " * 400_000), (3, 1, "x", "y"), (3, 1, "y", "x")], SCHEMA)
    wide = df.selectExpr("*", "1 AS depth", "'v' AS v1", "0 AS pos", "true AS ends", "2 AS l1", "3 AS points", "'n' AS n_convs")
    nodes = got(T.op12(wide))
    assert nodes == got(T.op12(df)) and sum(n[1] == 0 for n in nodes) == 1
    assert T.op12(df.limit(0)).count() == 0 and T.op12(df.filter("conv_id = 3")).count() >= 1
    assert T.op12(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    ids = [c for c in range(1000, 1100) if zlib.crc32(str(c).encode()) % 6 >= 2 and c % 100][:4]
    rows = [(c, 1, "user", "only turn") for c in ids]  # none has a conversation to begin with
    nodes = got(T.op12(spark.createDataFrame(rows, SCHEMA)))
    assert nodes == plain(rows) == [(ids[0], 0, -1, 4, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_end_digest_in_parts(spark, monkeypatch):
    rows = [(c, 1, "user", "same") for c in range(3000)] + [(c, 2, "user", "same") for c in range(3000)]
    f = T.end_digests
    monkeypatch.setattr(T, "end_digests", lambda r, n: f(r, n, 7))
    assert got(T.op12(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_louds():
    rng = np.random.default_rng(1)
    parents = np.sort(rng.integers(0, 50, 400))
    parents = np.minimum(parents, np.arange(400))  # of nodes 1 .. 400, in level order
    louds = T.Louds.of(parents)
    assert louds.parents[1:].tolist() == parents.tolist() and len(louds.bits) == 801
    for node in range(401):
        assert list(louds.children(node)) == (np.flatnonzero(parents == node) + 1).tolist()
    values, want = rng.integers(0, 9, 401), None
    want = values.copy()
    for node in range(400, 0, -1):
        if parents[node - 1]:
            want[parents[node - 1]] += want[node]
    assert louds.rolled(values)[1:].tolist() == want[1:].tolist()
