"""Loops in rounds and order statistics against plain versions."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from inkmill.operators import rounds as Q
from inkmill.operators import selection as S


def plain_research(steps, others, hits, checks, attempts=3):
    """One turn after the other."""
    out = []
    for turn in sorted({s[0] for s in steps}):
        held = [{"step": s[1], "question": s[2], "query": s[3], "confidence": 0.0, "answer": None} for s in sorted(steps) if s[0] == turn and s[1] < 5]
        if not held:
            continue
        found, n, why = False, 0, None
        for attempt in range(attempts):
            pending = [s for s in held if s["confidence"] < 0.6]
            if not pending:
                why = "answered"
                break
            n = attempt + 1
            for s in pending:
                new = next((q for t, a, question, q in others if (t, a, question) == (turn, attempt, s["question"]) and q.strip()), None)
                s["query"] = new.strip() if attempt and new else s["query"]
                found |= any((t, q) == (turn, s["query"]) for t, q, _ in hits)
            if not found:
                why = "nothing found"
                break
            for t, a, question, confidence, answer in checks:
                for s in held:
                    if (t, a, question) == (turn, attempt, s["question"]) and confidence is not None and confidence > s["confidence"]:
                        s["confidence"], s["answer"] = confidence, answer
        why = why or ("answered" if all(s["confidence"] >= 0.6 for s in held) else "attempts ended")
        out += [(turn, s["step"], s["question"], s["query"], s["confidence"], s["answer"], n, why) for s in held]
    return sorted(out)


def test_research(spark):
    rng = random.Random(8)
    steps = [(t, k, f"q{k}", f"q{k} 0") for t in range(40) for k in range(rng.randrange(1, 8))]
    others = [(t, a, q, rng.choice(["", " ", f"{q} {a}"])) for t, _, q, _ in steps for a in (1, 2) if rng.random() < 0.8]
    hits = [(t, f"{q} {a}", rng.randrange(9)) for t, _, q, _ in steps for a in (0, 1, 2) if rng.random() < (0.4 if t % 3 else 0.02)]
    checks = [(t, a, q, rng.choice([None, 0.0, 0.3, 0.6, 0.9]), f"{q}:{a}") for t, _, q, _ in steps for a in range(3) if rng.random() < 0.9]
    table = spark.createDataFrame(hits, "turn_id long, query string, chunk_id long")
    done, found = Q.research(
        spark.createDataFrame(steps, "turn_id long, step int, question string, query string"), spark.createDataFrame(others, "turn_id long, attempt int, question string, query string"),
        lambda asked: asked.join(table, ["turn_id", "query"]).select("turn_id", "chunk_id", "step"), spark.createDataFrame(checks, "turn_id long, attempt int, question string, confidence double, answer string"),
    )
    rows = sorted(tuple(r) for r in done.select("turn_id", "step", "question", "query", "confidence", "answer", "attempts", "stopped").collect())
    assert rows == plain_research(steps, others, hits, checks)
    assert {r[-1] for r in rows} == {"answered", "nothing found", "attempts ended"}
    assert found.count() == found.select("turn_id", "chunk_id").distinct().count() > 0


def test_rungs_see_only_what_is_open(spark):
    items, seen = spark.range(20).withColumnRenamed("id", "k"), []

    def rung(below):
        def run(open_):
            seen.append(sorted(r.k for r in open_.collect()))
            return open_.select("k", (F.col("k") < below).alias("valid"), F.col("error").alias("record"), F.concat(F.lit("e"), "k").alias("error"))

        return run

    got = {r.k: tuple(r)[1:] for r in Q.ladder(items, "k", [rung(5), rung(8), rung(8), rung(12)]).collect()}
    assert seen == [list(range(20)), list(range(5, 20)), list(range(8, 20)), list(range(8, 20))]
    assert got == {k: (None if k < 5 else f"e{k}", 1 if k < 5 else 2 if k < 8 else 4, k >= 8, ["metadata_degraded"] if k >= 8 else []) for k in range(12)}


@pytest.mark.parametrize("hot", [0, 25, 10**9])
@pytest.mark.parametrize("kind", ["long", "double", "date"])
def test_kth(spark, monkeypatch, hot, kind):
    monkeypatch.setattr(S, "BINS", 7)
    rng = random.Random(1)
    draw = {"long": lambda: rng.choice([rng.randrange(-50, 50), 10**12, -(10**15)]), "double": lambda: rng.choice([rng.random() * 1e-6, 1e9, -0.5]), "date": lambda: rng.randrange(100)}[kind]
    rows = [(k, draw() if rng.random() < 0.95 else None) for k in "abc" for _ in range({"a": 300, "b": 20, "c": 60}[k])] + [("d", 7 if kind != "double" else 7.0)] * 50 + [("e", None)]
    df = spark.createDataFrame(rows, f"k string, v {'long' if kind == 'date' else kind}").repartition(4)
    for share in (0.0, 0.5, 0.99):
        got = {r.k: r.v for r in S.kth_by(df, ["k"], "v", F.floor(F.col("n") * share), "v", hot).collect()}
        want = {k: sorted(v for c, v in rows if c == k and v is not None) for k in "abcd"}
        assert got == {k: v[int(len(v) * share)] for k, v in want.items()}


def test_running_median(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), i, rng.choice([None, 0, *range(1, 60)])) for i in range(300)]
    got = {r.i: r.m for r in S.running_upper_median(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], "v", "m").collect()}
    held = {k: [] for k in range(4)}
    for k, i, v in rows:
        assert got[i] == (held[k][len(held[k]) // 2] if held[k] else None)
        if v:
            bisect.insort(held[k], v)
