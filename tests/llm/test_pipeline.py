"""Each stage of the pipeline, on what its predecessor kept, against a plain version of it."""

import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from inkmill.llm import common, tokens
from test_brute_force import blocks_agree, components, edits, simhash_blocks

SF = "/root/testdata/sf0.001"


def rules(spark, docs):
    def kept(text):
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, n in zip(*np.unique(np.array([" ".join(g) for g in grams]), return_counts=True)) if n > 1}
        repeated = len({i + d for i, g in enumerate(grams) if (g if len(grams) < 400 else " ".join(g)) in twice for d in range(3)})
        n, chars = len(w), sum(map(len, w))
        symbols, shouts = len(re.findall(r"[#*$%&|<>]", text or "")), (text or "").count("!!")
        return not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or 10 * shouts > n or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * n or chars > 15 * n)

    return {i: t for i, t in docs.items() if kept(t)}


def lines(spark, docs):
    norm = lambda x: regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", x.lower()).strip(" ")
    names = sorted({norm(x) for t in docs.values() for x in t.split("\n")} - {""})
    words = sorted({w for x in names for w in x.split(" ")})
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    blocks = [simhash_blocks(x, hashes) for x in names]
    at = {}
    for k, b in enumerate(blocks):
        for j, (bits, n) in enumerate(b):
            if n:
                at.setdefault((j, bits, n), []).append(k)
    pairs = {(a, b) for ks in at.values() for i, a in enumerate(ks) for b in ks[:i]}
    near = [(a, b) for a, b in pairs if blocks_agree(blocks[a], blocks[b]) and abs(len(names[a]) - len(names[b])) <= int(max(len(names[a]), len(names[b])) * 0.2 + 1e-9) and edits(names[a], names[b]) <= int(max(len(names[a]), len(names[b])) * 0.2 + 1e-9)]
    root, number, seen, out = components(len(names), near), {x: k for k, x in enumerate(names)}, set(), {}
    for i in sorted(docs):
        kept = []
        for x in docs[i].split("\n"):
            k = root[number[norm(x)]] if norm(x) else None
            if k is None or k not in seen:
                kept.append(x)
                seen.add(k)
        out[i] = "\n".join(kept)
    return out


def near(spark, docs):
    def fingerprint(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    names = sorted(docs)
    fps = [fingerprint(docs[i]) for i in names]
    root = components(len(names), [(a, b) for a in range(len(names)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    first = {}
    for i, r in zip(names, root):
        first.setdefault(r, i)
    return {i: docs[i] for i in first.values()}


def clean(spark, docs):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1 if w else 0)}
    sizes = {len(w) for w in windows}
    return {i: t for i, t in docs.items() if not any(tuple(w[p : p + k]) in windows for w in [words(t)] for k in sizes for p in range(len(w) - k + 1))}


@pytest.fixture(scope="module")
def outputs(spark):
    """What each stage is given, and what the last one returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = common.materialize(stage(spark, docs, SF))
    return [*out, docs]


@pytest.mark.parametrize("at, plain", [(0, rules), (1, lines), (2, near), (3, clean)])
def test_stage(spark, outputs, at, plain):
    given, got = ({r.doc_id: r.text for r in outputs[k].select("doc_id", "text").collect()} for k in (at, at + 1))
    want = plain(spark, given)
    assert got == want and outputs[at + 1].columns == outputs[0].columns
    assert got != given  # the supplied documents give every stage something to do


def test_packing_stage(spark, outputs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in outputs[4].collect()}
    pieces = {}
    for r in outputs[5].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, n in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == n
    assert pieces.keys() == want.keys()


def test_stages_are_the_pipeline(spark, outputs):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(outputs[5].collect())
