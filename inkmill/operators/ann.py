"""Approximate nearest neighbours by cosine: an inverted file of cells with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample of the vectors (those of least hash of their id, at most
`SAMPLE_VALUES` numbers in all); every vector is then indexed. The exact neighbours of TRIALS of the sample, found by a scan of all
vectors, tell how many cells a search must probe to read RECALL of them: that number is kept with the index. The index is a table partitioned by cell: a search reads
the cells next to its query only, first ids and codes, then the vectors of the best candidates, which are ranked exactly.
`search` serves one query with any filter on the kept columns, and widens its probes until it has k answers; with
exact=True it goes on until the cells' radii prove that no other cell holds a nearer vector. `search_all` serves a table of
queries: queries meet the cells that they probe by a join on cell, in chunks of both, so that no task gets a whole cell;
equal vectors are searched once and expanded to the least k ids after.

Vectors of zeros, with a null or not a number in them, and null vectors are not indexed and find nothing. Ties go to the lesser id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.session import written as kept

SAMPLE_VALUES = 4_000_000
CELLS_MOST = 4096
SUBSPACE = 4  #: numbers coded by one byte
CHUNK = 20_000  #: rows of a cell, and queries that probe it, that meet in one task
ROWS = 2_000_000  #: candidates that one task orders, as a mean
VALUES = 4_000_000  #: numbers that a task holds of queries with their cells, or of products
REFINE = 8  #: candidates for each answer that are ranked exactly
TRIALS, RECALL, TRIAL_K = 128, 0.98, 10


def usable(vector: str = "embedding") -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def units(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k means; those that lose all their rows keep their place."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin((centres**2).sum(axis=1) - 2 * x[i : i + 4096] @ centres.T, axis=1)
    return out


class Quantizer:
    """Centroids of cells, and codebooks of the residuals' parts."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 0):
        rng, d = np.random.default_rng(seed), sample.shape[1]
        self.centroids = means(sample, min(cells, len(sample)), rng)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.cuts = list(range(0, d, SUBSPACE)) + [d]
        self.books = [means(rest[:, a:b], min(256, len(rest)), rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = nearest(x, self.centroids)
        rest = x - self.centroids[cells]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        return cells, codes.astype(np.uint8)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centroids[cells] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The n cells next to each query, nearest first."""
        closeness = queries @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2
        return np.argsort(-closeness, axis=1, kind="stable")[:, :n]


class Index:
    """path: table of (cell, id, code, angle, first, h1, h2, embedding, kept columns); model: the quantizer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/rows")
        self.model: Quantizer = pickle.loads(spark.read.parquet(f"{path}/model").first().model)
        cells = spark.read.parquet(f"{path}/cells").collect()  # one row a cell, CELLS_MOST at most
        self.sizes, self.radius = {r.cell: r.n for r in cells}, {r.cell: r.radius for r in cells}
        self.probes = spark.read.parquet(f"{path}/probes").first().probes

    @property
    def n_cells(self) -> int:
        return len(self.model.centroids)


def build(vectors: DataFrame, path: str, keep: list[str] = (), cells: int | None = None, id_col: str = "chunk_id") -> Index:
    """Fits on the sample and writes every usable vector's row. cells: by default the root of the number of vectors."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable()).select(F.col(id_col).cast("long").alias("id"), "embedding", *keep)
    n, d = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError("there is no usable vector")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, SAMPLE_VALUES // d)).select("embedding").toArrow()
    model = Quantizer(units(sample.column(0).combine_chunks(), d), cells or max(1, min(CELLS_MOST, round(n**0.5))))
    extra = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in keep}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = units(b.column("embedding"), d)
                at, codes = model.encode(x)
                centre = model.centroids[at]
                angle = np.arccos(np.clip((x * centre).sum(axis=1) / np.maximum(np.linalg.norm(centre, axis=1), 1e-12), -1, 1))
                added = [pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(angle)]
                yield pa.record_batch([*b.columns, *added], names=[*b.schema.names, "cell", "code", "angle"])

    # Equal vectors are named by two hashes; the least id stands for them.
    named = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    first = named.groupBy("h1", "h2").agg(F.min("id").alias("first_id"))
    marked = named.join(first, ["h1", "h2"]).withColumn("first", F.col("id") == F.col("first_id")).drop("first_id").select("id", "embedding", "h1", "h2", "first", *keep)
    schema = "id long, embedding array<float>, h1 long, h2 long, first boolean, " + "".join(f"`{k}` {v}, " for k, v in extra.items()) + "cell int, code binary, angle double"
    coded = marked.withColumn("embedding", F.col("embedding").cast("array<float>")).mapInArrow(task, schema)
    # Rebalancing brings a cell's rows together and splits those of large cells.
    coded.hint("rebalance", "cell").write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    written.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(pickle.dumps(model),)], "model binary").coalesce(1).write.parquet(f"{path}/model")
    trials = units(sample.column(0).combine_chunks().slice(0, TRIALS), d)
    spark.createDataFrame([(probes_needed(written.select("cell", "embedding"), model, trials),)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    return Index(spark, path)


def probes_needed(rows: DataFrame, model: Quantizer, trials: np.ndarray) -> int:
    """So many of the nearest cells hold RECALL of the TRIAL_K nearest other vectors of the trials; one scan, TRIAL_K rows a trial and task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close, cells = np.full((len(trials), 0), -2.0), np.zeros((len(trials), 0), np.int32)
        for b in batches:
            if b.num_rows:
                new = trials @ units(b.column("embedding"), trials.shape[1]).T
                new[new > 1 - 1e-9] = -2.0  # the trial itself, and its copies
                close = np.concatenate([close, new], axis=1)
                cells = np.concatenate([cells, np.broadcast_to(b.column("cell").to_numpy(), new.shape)], axis=1)
                top = np.argsort(-close, axis=1)[:, :TRIAL_K]
                close, cells = np.take_along_axis(close, top, 1), np.take_along_axis(cells, top, 1)
        trial = np.repeat(np.arange(len(trials)), close.shape[1])
        yield pa.record_batch([pa.array(trial), pa.array(cells.reshape(-1)), pa.array(close.reshape(-1))], names=["trial", "cell", "close"])

    found = rows.mapInArrow(task, "trial long, cell int, close double").filter("close > -1.5")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("close"), "cell"))).filter(F.col("n") <= TRIAL_K)
    order = model.probes(trials, len(model.centroids))
    place = np.argsort(order, axis=1)  # of each cell in the order of probes
    ranks = sorted(int(place[r.trial, r.cell]) for r in best.select("trial", "cell").collect())  # TRIALS * TRIAL_K rows at most
    return ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))] + 1 if ranks else 1


def best_codes(index: Index, cells: list[int], query: np.ndarray, where: Column | None, most: int) -> DataFrame:
    """The `most` rows of these cells with the best approximate closeness: id, cell."""
    model = index.model

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, close = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        for b in batches:
            if b.num_rows:
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                ids, at = np.concatenate([ids, b.column(0).to_numpy()]), np.concatenate([at, b.column(1).to_numpy()])
                close = np.concatenate([close, query @ model.centroids[b.column(1).to_numpy()].T + sum((book @ query[a:z])[codes[:, i]] for i, (a, z, book) in enumerate(zip(model.cuts, model.cuts[1:], model.books)))])
                kept = np.lexsort((ids, -close))[:most]
                ids, at, close = ids[kept], at[kept], close[kept]
        yield pa.record_batch([pa.array(ids), pa.array(at), pa.array(close)], names=["id", "cell", "close"])

    rows = index.rows.filter(F.col("cell").isin([int(c) for c in cells]))  # read by partition: other cells' files are not opened
    rows = rows.filter(where) if where is not None else rows
    found = rows.select("id", "cell", "code").mapInArrow(task, "id long, cell int, close double")
    return found.orderBy(F.desc("close"), "id").limit(most)


def exact_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(vector, q) / (F.sqrt(dot(vector, vector)) * float(np.sqrt(np.dot(query, query))))


def search(index: Index, query: list[float], k: int, probes: int | None = None, where: Column | None = None, exact: bool = False, refine: int = REFINE) -> list[tuple[int, float]]:
    """The k nearest (id, distance) of one query; at most k rows come to the driver.

    Cells are probed from the nearest on; where filters leave fewer than k answers, four times as many are probed, until all are.
    """
    raw, probes = [float(x) for x in query], probes or index.probes
    q = np.array(raw) / np.linalg.norm(raw)
    order = [c for c in index.model.probes(q[None], index.n_cells)[0].tolist() if c in index.sizes]
    if exact:  # by the least angle that a cell's vectors can have to the query
        centres = index.model.centroids
        angle = {c: float(np.arccos(np.clip(q @ centres[c] / max(np.linalg.norm(centres[c]), 1e-12), -1, 1))) for c in order}
        least = {c: max(0.0, angle[c] - index.radius[c]) for c in order}
        order.sort(key=lambda c: (least[c], angle[c]))
    best: list[tuple[float, int]] = []
    done = 0
    while done < len(order) and (not done or len(best) < k or exact):
        if exact and len(best) == k and 1 - np.cos(least[order[done]]) > best[-1][0] + 1e-9:
            break
        cells = order[done : max(probes, 4 * done)]
        rows = index.rows.filter(F.col("cell").isin(cells))
        if exact:
            rows = rows.filter(where) if where is not None else rows
        else:
            rows = rows.join(F.broadcast(best_codes(index, cells, q, where, refine * k).select("cell", "id")), ["cell", "id"])  # refine * k rows
        found = rows.select("id", exact_distance(F.col("embedding"), raw).alias("distance")).orderBy("distance", "id").limit(k).collect()
        best = sorted(best + [(r.distance, r.id) for r in found])[:k]
        done += len(cells)
    return [(i, d) for d, i in best]


def met(index: Index, asked: DataFrame, start: int, stop: int, most: int, tasks: int) -> DataFrame:
    """The best rows, `most` at most in each part of a cell, for queries (q1, q2, vector, bound) in their nearest cells from `start` to `stop`: q1, q2, id, close.

    Rows that are less close than the query's bound are left out. The result is dealt by query to so many tasks.
    """
    model, d = index.model, index.model.centroids.shape[1]

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, VALUES // ((stop - start) * d))  # a query's vector goes with each cell, so few queries are taken at a time
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                near = model.probes(units(b.column("vector"), d), stop)[:, start:]
                many = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.record_batch([*(b.column(c).take(many) for c in ("q1", "q2", "vector", "bound")), pa.array(near.reshape(-1).astype(np.int32))], names=["q1", "q2", "vector", "bound", "cell"])

    pairs = asked.select("q1", "q2", "vector", "bound").mapInArrow(cells_of, "q1 long, q2 long, vector array<float>, bound double, cell int")
    held = index.rows.filter("first").select("id", "cell", "code")
    # Both sides of a cell are cut into parts of CHUNK rows; each part of the one meets each of the other.
    sizes = held.groupBy("cell").agg(F.count("*").alias("n")).join(pairs.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / CHUNK).alias("row_parts"), F.ceil(F.col("m") / CHUNK).alias("query_parts")))  # a row a cell
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = held.join(parts, "cell").withColumn("r", F.pmod(F.xxhash64("id"), F.col("row_parts"))).withColumn("q", upto("query_parts")).select("cell", "r", "q", "id", "code")
    right = pairs.join(parts, "cell").withColumn("q", F.pmod(F.xxhash64("q1", "q2"), F.col("query_parts"))).withColumn("r", upto("row_parts")).select("cell", "r", "q", "q1", "q2", "vector", "bound")

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        q1, q2, ids, close = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        if rows.num_rows and asked.num_rows:
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            x, own = model.decode(rows.column("cell").to_numpy(), codes), rows.column("id").to_numpy()
            n, out = min(most, len(own)), []
            step = max(1, min(512, VALUES // len(own)))
            for i in range(0, asked.num_rows, step):
                part = asked.slice(i, step)
                score = units(part.column("vector").combine_chunks(), d) @ x.T
                top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                best = np.take_along_axis(score, top, 1)
                # Products of one pair may differ in the last digits from one call to the next.
                at, place = np.nonzero(best >= part.column("bound").to_numpy()[:, None] - 1e-9)
                out.append((part.column("q1").to_numpy()[at], part.column("q2").to_numpy()[at], own[top[at, place]], best[at, place]))
            q1, q2, ids, close = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(q1), pa.array(q2), pa.array(ids), pa.array(close)], names=["q1", "q2", "id", "close"])

    keys = ["cell", "r", "q"]
    # The tasks are as many as the rows that come out ask for; those that go in are few.
    both = [side.repartition(tasks, *keys).groupBy(*keys) for side in (left, right)]
    return both[0].cogroup(both[1]).applyInArrow(meet, "q1 long, q2 long, id long, close double").repartition(tasks, "q1", "q2")


def search_all(index: Index, queries: DataFrame, k: int, probes: int | None = None, refine: int = REFINE) -> DataFrame:
    """For every query (query_id, embedding) its k nearest: query_id, chunk_id, distance, rank.

    Cells are met in two rounds: the nearest, by the root of the number of probes, give each query its best candidates so far; the others
    give only candidates that are as close as the last of these, so that most of what cannot be among the best is not sent.
    """
    model, d, probes = index.model, index.model.centroids.shape[1], min(probes or index.probes, index.n_cells)
    asked = queries.filter(usable()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("vector"))
    asked = asked.withColumns({"q1": F.xxhash64("vector"), "q2": F.xxhash64(F.lit(1), "vector")})
    distinct = asked.groupBy("q1", "q2").agg(F.first("vector").alias("vector"))
    most, early = refine * k, max(1, round(probes**0.5))
    # A query has some `early` times `most` candidates in a round, and a task ROWS of them.
    tasks = max(index.spark.sparkContext.defaultParallelism, -(-distinct.count() * early * most // ROWS))
    rank = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = lambda rows: rows.withColumn("n", rank(["q1", "q2"], F.desc("close"), "id")).filter(F.col("n") <= most).drop("n")

    near = top(met(index, distinct.withColumn("bound", F.lit(float("-inf"))), 0, early, most, tasks))
    if early < probes:
        near = kept(near)
        last = near.groupBy("q1", "q2").agg(F.min("close").alias("least"), F.count("*").alias("n"))
        bound = F.when(F.col("n") == most, F.col("least")).otherwise(float("-inf"))
        bounded = distinct.join(last, ["q1", "q2"], "left").select("q1", "q2", "vector", bound.alias("bound"))
        near = top(near.union(met(index, bounded, early, probes, most, tasks)))
    near = near.drop("close")
    full = near.join(index.rows.filter("first").select("id", "h1", "h2", "embedding"), "id").join(distinct, ["q1", "q2"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                distance = 1 - (units(b.column("embedding"), d) * units(b.column("vector"), d)).sum(axis=1)
                yield pa.record_batch([*(b.column(c) for c in ("q1", "q2", "id", "h1", "h2")), pa.array(distance)], names=["q1", "q2", "id", "h1", "h2", "distance"])

    measured = full.select("q1", "q2", "id", "h1", "h2", "embedding", "vector").mapInArrow(measure, "q1 long, q2 long, id long, h1 long, h2 long, distance double")
    best = measured.withColumn("n", rank(["q1", "q2"], "distance", "id")).filter(F.col("n") <= k).drop("n", "id")
    # Each class of equal vectors gives its k least ids at most.
    members = index.rows.select("h1", "h2", "id").withColumn("n", rank(["h1", "h2"], "id")).filter(F.col("n") <= k).drop("n")
    answers = best.join(members, ["h1", "h2"]).withColumn("rank", rank(["q1", "q2"], "distance", "id")).filter(F.col("rank") <= k)
    return asked.select("query_id", "q1", "q2").join(answers, ["q1", "q2"]).select("query_id", F.col("id").alias("chunk_id"), "distance", "rank")
