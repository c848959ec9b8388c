"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from inkmill.llm import cascade, decontam, license_scan, line_dedup, packing, pii, quality_gbdt, sharding, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, fp long, n_dropped int, root string, licences string, score string, row int, place int, text_hash string, words string, shard string, slot string, features string, spans string, bucket string, size string, kept string, gone string, n long, at long, k string"
PROSE = "the quick brown fox jumps over the lazy dog near the old river bank while " * 8


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (None, PROSE), (None, None), (5, "one line\n\nanother line here\n" + PROSE), (6, "x " * 1_100_000), (7, "mail a.b@example.com\nLicensed under CC BY 4.0."), (8, "ÀÉ ²³ \x1c odd   text <|endoftext|>"), (5, "same id, other text")]
    return spark.createDataFrame([(i, t, None, None, len(t or ""), "l", 1, 2, "r", "x", "s", 0, 0, "h", "w", "s", "s", "f", "s", "b", "z", "k", "g", 1, 1, "k") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "Quick brown fox jumps over the lazy dog near the OLD river"), (1, None), (2, ""), (3, "one line"), (None, "another line here"), (4, "one line")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


def operators(benchmark, labels):
    return {
        "op1": line_dedup.op1, "op2": tokens.op2, "op3": packing.op3, "op4": sharding.op4, "op5": lambda d: pii.op5(d, "a key"), "op6": simhash.op6,
        "op7": lambda d: decontam.op7(d, benchmark), "op8": lambda d: quality_gbdt.op8(d, labels), "op9": license_scan.op9, "op10": cascade.op10,
    }


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_edges(spark, docs, benchmark, labels, name):
    rows = operators(benchmark, labels)[name](docs).collect()
    if name == "op3":
        assert {(r.doc_id, r.doc_tokens) for r in rows} and sum(r.start == 0 for r in rows) == 12
    else:
        assert len(rows) == 12


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_empty(spark, docs, benchmark, labels, name):
    assert operators(benchmark, labels)[name](docs.limit(0)).count() == 0


def test_empty_side_tables(docs, benchmark, labels):
    assert {r.n_hit for r in decontam.op7(docs, benchmark.limit(0)).collect()} == {0}
    assert {r.score for r in quality_gbdt.op8(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, benchmark, tmp_path, name, empty):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs.limit(0) if empty else docs, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns
    assert (out.count() == 0) == empty or name == "quality rules"


def test_null_texts_have_defined_results(docs, benchmark):
    null = docs.filter("text IS NULL AND doc_id IS NOT NULL")
    assert simhash.op6(null).first().fingerprint == "0" * 16
    assert tokens.op2(null).first().n_tokens == 1
    assert sharding.op4(null).select("size", "text_crc32").first() == (8, 0)
    assert cascade.op10(null).select("n_words", "kept").first() == (0, False)
    assert pii.op5(null, "a key").first().text is None and line_dedup.op1(null).first().text is None
    assert license_scan.op9(null).first().families == ""
    assert decontam.op7(null, benchmark).select("n_words", "contaminated").first() == (0, False)


def test_null_id_is_no_component_name(docs):
    rows = simhash.op6(docs).collect()
    assert all(r.component_id is not None for r in rows if r.doc_id is not None)
    assert {r.component_id for r in rows if r.doc_id is None} <= {1, 3}


def test_ties(spark, labels):
    """Rows that tie in every way get one result each, the same for all that are equal."""
    rows = spark.createDataFrame([(1, PROSE)] * 5 + [(2, PROSE)] * 5 + [(None, PROSE)] * 2, "doc_id long, text string")
    sharded = sharding.op4(rows, 3).collect()
    assert sorted((r.shard, r.slot) for r in sharded) == [(s, k) for s in range(3) for k in range(4)]
    scored = quality_gbdt.op8(rows, labels).collect()
    assert len(scored) == 12 and len({r.score for r in scored}) == 1
    judged = cascade.op10(rows).collect()
    assert len(judged) == 12 and len({r[1:] for r in judged}) == 1
    lines = line_dedup.op1(rows).collect()
    assert sorted(r.n_dropped for r in lines) == [0] * 5 + [1] * 7  # rows equal in id and text share their fate


def test_near_dedup_keeps_one_of_a_group(docs):
    kept = simhash.near_dedup(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None).count(1) == 1
    assert 2 not in {r.doc_id for r in kept} and sum(r.doc_id is None for r in kept) == 2
