"""Approximate neighbours against exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.operators import ann
from inkmill.operators import retrieval as R
from inkmill.plans import search as P
from inkmill.session import table

SF = "/root/testdata/sf0.01"


def chunks(spark, x, **columns):
    rows = [(i, None if v is None else [float(a) for a in v], *(c[i] for c in columns.values())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>" + "".join(f", {k} string" for k in columns))


@pytest.fixture(scope="module")
def table_index(spark, tmp_path_factory):
    vectors = table(spark, SF, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return vectors, ann.build(vectors, str(tmp_path_factory.mktemp("ann")), ["label"])


def exact(x, q, k, keep=None):
    x = np.asarray(x, dtype=np.float32).astype(float)
    d = 1 - x @ np.asarray(q, float) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    ids = np.arange(len(x)) if keep is None else np.flatnonzero(keep)
    return [int(i) for i in sorted(ids, key=lambda i: (round(d[i], 12), i))[:k]]


def test_recall_on_the_table(spark, table_index):
    """All queries of the contract (ids divisible by 20), ten answers each."""
    vectors, index = table_index
    queries = vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    want = {(r.query_id, r.chunk_id) for r in R.knn(vectors, queries, 10).collect()}
    rows = ann.search_all(index, queries, 10).collect()
    got = {(r.query_id, r.chunk_id) for r in rows}
    assert len(got) == len(rows) == len(want) and len(got & want) / len(want) >= 0.9
    assert index.rows.count() == vectors.count()  # every vector is indexed


def test_recall_of_the_query(spark):
    rows = P.QUERIES["retrieval_ann"](spark, SF).collect()
    vectors = table(spark, SF, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    want = {(r.query_id, r.chunk_id) for r in R.knn(vectors, vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), 10).collect()}
    assert len({(r.query_id, r.chunk_id) for r in rows} & want) / len(want) >= 0.9


def test_only_the_probed_cells_are_read(table_index):
    _, index = table_index
    cells = index.model.probes(np.ones((1, 64)), 3)[0].tolist()
    plan = index.rows.filter(F.col("cell").isin(cells)).select("id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "embedding" not in plan.split("ReadSchema")[1]
    read = index.rows.filter(F.col("cell").isin(cells)).inputFiles()
    assert {f.split("cell=")[1].split("/")[0] for f in read} <= {str(c) for c in range(index.n_cells)}


def test_exact_mode_and_filters(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(40, 16)) * 0.2 for c in centres])
    kinds = [f"k{i % 7}" for i in range(len(x))]
    index = ann.build(chunks(spark, x, kind=kinds), str(tmp_path / "i"), ["kind"], cells=12)
    for q in (x[5], x[200] + 0.1, rng.normal(size=16)):
        assert [i for i, _ in ann.search(index, q, 10, probes=2, exact=True)] == exact(x, q, 10)
        rare = [k == "k3" for k in kinds]
        assert [i for i, _ in ann.search(index, q, 10, probes=2, where=F.col("kind") == "k3", exact=True)] == exact(x, q, 10, rare)
        # Probes widen until a rare filter has its answers.
        assert len(ann.search(index, q, 50, probes=1, where=F.col("kind") == "k3")) == 50
        assert ann.search(index, q, 5, where=F.col("kind") == "none") == []
    got = [i for i, _ in ann.search(index, x[5], 10, probes=3)]
    assert len(set(got) & set(exact(x, x[5], 10))) >= 9 and got[0] == 5


def test_copies_ties_and_odd_vectors(spark, tmp_path, monkeypatch):
    """A third of all vectors are the same one; answers are the least ids among equals, and no row is lost."""
    monkeypatch.setattr(ann, "CHUNK", 16)  # cells in many parts
    rng = np.random.default_rng(5)
    x = list(rng.normal(size=(200, 8)))
    x += [x[7]] * 100 + [np.zeros(8), None, [float("nan")] * 8]
    df = chunks(spark, x).repartition(4)
    index = ann.build(df, str(tmp_path / "i"), cells=6)
    assert index.rows.count() == 300
    queries = df.filter("chunk_id IN (7, 3, 250, 299, 300, 301, 302)").withColumnRenamed("chunk_id", "query_id")
    rows = ann.search_all(index, queries.unionByName(queries.filter("query_id = 3").withColumn("query_id", F.lit(1000).cast("long"))), 10, probes=6).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert set(got) == {3, 7, 250, 299, 1000}
    for q in (7, 250, 299):
        assert got[q] == [7, *range(200, 209)]
    assert got[3] == got[1000] and got[3][0] == 3
    full = exact(x[:300], x[3], 10)
    assert len(set(got[3]) & set(full)) >= 9
    with pytest.raises(ValueError):
        ann.build(df.filter("chunk_id > 299"), str(tmp_path / "none"))


def test_nearest_orders_only_what_may_stay(monkeypatch):
    rng = np.random.default_rng(3)
    all_d = rng.integers(0, 9, (40, 300)).astype(float)  # many equal distances
    ids = rng.permutation(300)
    want = [[(d, i) for d, i in sorted(zip(row, ids))[:7]] for row in all_d]
    sizes = []
    monkeypatch.setattr(R.np, "lexsort", lambda keys, f=np.lexsort: sizes.append(len(keys[0])) or f(keys))
    d, i = R.nearest(all_d[:, :128], np.zeros((40, 0), np.int64), ids[:128], 7)
    d, i = R.nearest(np.concatenate([d, all_d[:, 128:]], axis=1), i, ids[128:], 7)
    assert [list(zip(*x)) for x in zip(d.tolist(), i.tolist())] == want
    assert max(sizes) < 40 * 128
    few, _ = R.nearest(all_d[:, :3], np.zeros((40, 0), np.int64), ids[:3], 7)
    assert few.shape == (40, 3)


def test_two_rounds_find_what_all_cells_at_once_do(spark, table_index, monkeypatch):
    """The answers are those of ranking every probed cell's codes, and the later cells send few of their rows."""
    vectors, index = table_index
    sent, met = [], ann.met
    monkeypatch.setattr(ann, "VALUES", 2_000)  # a few queries at a time
    monkeypatch.setattr(ann, "met", lambda *a: sent.append(met(*a)) or sent[-1])
    k, refine, probes = 3, 2, index.n_cells
    queries = vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in ann.search_all(index, queries, k, probes, refine).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.chunk_id
    rows = index.rows.filter("first").orderBy("id").toPandas()
    x = index.model.decode(rows.cell.to_numpy(), np.stack([np.frombuffer(c, np.uint8) for c in rows.code]))
    real = np.stack(rows.embedding).astype(float)
    for r in queries.collect():
        q = np.array(r.embedding, float)
        best = np.lexsort((rows.id, -(x @ q)))[: k * refine]
        assert [rows.id[best[i]] for i in exact(real[best], q, k)] == [got[r.query_id][n] for n in range(1, k + 1)]
    first, later = (s.count() for s in sent)
    assert later < (probes - round(probes**0.5)) * k * refine * queries.count() / 4 and first <= round(probes**0.5) * k * refine * queries.count()
