r"""Ranked lexical search: the best documents for each item, exactly, over an index of reordered documents.

Each task takes documents in segments and reorders them by recursive graph bisection (Dhulipala et al., 2016):
a range is halved, and documents are swapped between the halves while that makes the gaps between postings
cheaper, so that documents of like words come to lie together. Runs of `LEAF` documents of that order are
clusters. For a search each task takes, for each item, the greatest value of every term in every cluster; their
sums bound the scores in it. Clusters are visited by falling bound, until the bound is below the score that is
needed: the search's own worst of the best so far, or the one known from elsewhere. A first round visits the best
clusters only and gives each item a score that its answers reach; the second round visits all clusters that
can reach it. Equal scores go by doc_id, so a cluster whose bound equals what is needed is still visited.

The index holds the terms that items ask for: the items are a query set against all rows, and go to the tasks in
blocks of at most `BLOCK_TERMS` terms; each further block takes a further pass over the documents. Terms are known
by 64-bit hashes.

Defined results: null texts and texts without terms are not counted and not found; an item without terms, or
whose terms no document holds, gives no rows; items with equal ids or texts each get their rows; repeated documents
are found as often as they are there; a null doc_id comes behind all others on ties; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.common import materialize
from inkmill.llm.words import ALPHANUMERIC, hashed

SEGMENT = 16_384  #: documents that are reordered together, at most
POSTINGS = 4_000_000  #: a segment also ends behind so many postings
LEAF = 64  #: documents of a cluster
ROUNDS = 8  #: swaps of a range's halves, at most
BLOCK_TERMS = 250_000
STEP = 4  #: clusters visited between two looks at the bound
TOP = 20
LAST = np.iinfo(np.int64).max  #: stands for a null doc_id in ties

SEGMENTS = "n_docs long, n_terms long, df_terms binary, df binary, ids binary, lengths binary, starts binary, terms binary, counts binary"
NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]


def gap_cost(d: np.ndarray, n: int) -> np.ndarray:
    """Bits for the gaps of a term with d of n documents, by its average gap."""
    return d * (math.log2(max(n, 1)) - np.log2(d + 1))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[0], ..., first[0] + size[0] - 1, first[1], ..."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


def bisected(starts: np.ndarray, terms: np.ndarray, leaf: int = LEAF, rounds: int = ROUNDS) -> np.ndarray:
    """An order of the documents whose terms are terms[starts[i]:starts[i + 1]]; leaves are runs of `leaf` of them."""
    sizes = np.diff(starts)
    order, open_ = np.arange(len(sizes)), [(0, len(sizes))]
    while open_:
        a, b = open_.pop()
        if b - a <= leaf:
            continue
        half = leaf * -(-(-(-(b - a) // leaf)) // 2)
        docs = order[a:b]
        row = np.repeat(np.arange(b - a), sizes[docs])
        names, t = np.unique(terms[ranges(starts[docs], sizes[docs])], return_inverse=True)
        total = np.bincount(t, minlength=len(names))
        shared = total[t] > 1  # a term of one document costs the same on either side
        row, t = row[shared], t[shared]
        left = np.arange(b - a) < half
        for _ in range(rounds):
            here = np.bincount(t[left[row]], minlength=len(names))
            there = total - here
            now = gap_cost(here, half) + gap_cost(there, b - a - half)
            go = now - gap_cost(np.maximum(here - 1, 0), half) - gap_cost(there + 1, b - a - half)
            come = now - gap_cost(here + 1, half) - gap_cost(np.maximum(there - 1, 0), b - a - half)
            gain = np.bincount(row, weights=np.where(left[row], go[t], come[t]), minlength=b - a)
            out, in_ = np.flatnonzero(left), np.flatnonzero(~left)
            out, in_ = out[np.argsort(-gain[out], kind="stable")], in_[np.argsort(-gain[in_], kind="stable")]
            n = min(len(out), len(in_))
            swap = int(np.argmin(np.append(gain[out[:n]] + gain[in_[:n]] > 1e-9, False)))
            if not swap:
                break
            left[out[:swap]], left[in_[:swap]] = False, True
        order[a:b] = np.concatenate([docs[left], docs[~left]])
        open_ += [(a, a + half), (a + half, b)]
    return order


def index(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments: reordered documents with those of their terms that the sorted vocabulary of hashes holds.

    Of each segment: numbers of documents with a term and of their terms, its documents with a term of the
    vocabulary (ids, lengths in terms, where their postings start), and for each posting term number and count.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_terms, size, postings = [], 0, 0, 0, 0

        def segment() -> pa.RecordBatch:
            ids, lengths, sizes, terms, counts = (np.concatenate(x) for x in zip(*held))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            order = bisected(starts, terms)
            at = ranges(starts[order], sizes[order])
            seen, df = np.unique(terms, return_counts=True)
            arrays = [seen.astype("<i4"), df.astype("<i4"), ids[order], lengths[order], np.concatenate([[0], np.cumsum(sizes[order])]), terms[at], counts[at]]
            return pa.record_batch([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in arrays], names=NAMES)

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                words, sizes = hashed(part.column(1), ALPHANUMERIC)
                n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + len(words)
                place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                hit = vocabulary[place] == words
                doc = np.repeat(np.arange(len(sizes)), sizes)[hit]
                key, counts = np.unique(doc << 32 | place[hit], return_counts=True)
                doc, per = np.unique(key >> 32, return_counts=True)
                ids = part.column(0).fill_null(LAST).to_numpy()
                held.append((ids[doc], sizes[doc], per, (key & 0xFFFFFFFF).astype("<i4"), counts.astype("<i4")))
                size, postings = size + len(doc), postings + len(key)
                if size >= SEGMENT or postings >= POSTINGS:
                    yield segment()
                    held, n_docs, n_terms, size, postings = [], 0, 0, 0, 0
        if held:
            yield segment()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(task, SEGMENTS)


def statistics(segments: DataFrame, n_vocabulary: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms, and each vocabulary term's documents; one row a term comes to the driver."""
    n, total = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_vocabulary, np.int64)
        for b in batches:
            for terms, counts in zip(b.column(0), b.column(1)):
                df[np.frombuffer(terms.as_buffer(), "<i4")] += np.frombuffer(counts.as_buffer(), "<i4")
        t = np.flatnonzero(df)
        yield pa.record_batch([pa.array(t), pa.array(df[t])], names=["term", "df"])

    df = np.zeros(n_vocabulary, np.int64)
    for t, d in segments.select("df_terms", "df").mapInArrow(task, "term long, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
        df[t] = d
    return n, total, df


class Clusters:
    """One segment ready for searches."""

    def __init__(self, row: dict, n: int, total: int, weights: np.ndarray, leaf: int = LEAF):
        read = lambda name, kind="<i8": np.frombuffer(row[name].as_buffer(), kind)
        self.ids, self.leaf = read("ids"), leaf
        starts, terms, tf = read("starts"), read("terms", "<i4").astype(np.int64), read("counts", "<i4").astype(np.int64)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(starts))
        m = 75 + 25 * read("lengths") * n // max(total, 1)
        value = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        order = np.argsort(terms, kind="stable")  # by term, then by place in the order of documents
        self.doc, self.value, terms = doc[order], value[order], terms[order]
        pair = terms << 32 | self.doc // leaf
        self.first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, len(pair)))
        self.most = np.maximum.reduceat(self.value, self.first) if len(pair) else self.value
        self.cluster, self.of_term = (pair & 0xFFFFFFFF)[self.first], (pair >> 32)[self.first]

    def best(self, terms: np.ndarray, repeats: np.ndarray, needed: int, top: int, visits: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the `top` best documents that reach `needed`; visits: clusters looked at, all that can matter if None."""
        a, b = np.searchsorted(self.of_term, terms), np.searchsorted(self.of_term, terms, "right")
        pairs, times = ranges(a, b - a), np.repeat(repeats, b - a)
        bound = np.zeros(-(-len(self.ids) // self.leaf), np.int64)
        np.add.at(bound, self.cluster[pairs], self.most[pairs] * times)
        by_cluster = np.argsort(self.cluster[pairs], kind="stable")
        pairs, times = pairs[by_cluster], times[by_cluster]
        edges = np.searchsorted(self.cluster[pairs], np.arange(len(bound) + 1))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0][:visits]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(0, len(order), STEP):
            now = order[i : i + STEP]
            now = now[bound[now] >= needed]
            if not len(now):
                break
            which = ranges(edges[now], edges[now + 1] - edges[now])
            at = ranges(self.first[pairs[which]], self.size[pairs[which]])
            docs, slot = np.unique(self.doc[at], return_inverse=True)
            found = np.zeros(len(docs), np.int64)
            np.add.at(found, slot, self.value[at] * np.repeat(times[which], self.size[pairs[which]]))
            reach = (found >= needed) & (found > 0)
            ids, scores = np.concatenate([ids, self.ids[docs[reach]]]), np.concatenate([scores, found[reach]])
            if len(ids) >= top:
                kept = np.lexsort((ids, -scores))[:top]
                ids, scores = ids[kept], scores[kept]
                needed = max(needed, int(scores[-1]))
        return ids, scores


FOUND = "item long, doc_id long, score long"


def search(segments: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], stats: tuple[int, int, np.ndarray], top: int, needed: np.ndarray, visits: int | None) -> DataFrame:
    """item (number of the query), doc_id and score: the best of each segment that reach what their item needs."""
    n, total, df = stats
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = Clusters({name: batch.column(name)[i] for name in NAMES[4:]}, n, total, weights)
                for item, (terms, repeats) in enumerate(queries):
                    ids, scores = held.best(terms, repeats, int(needed[item]), top, visits)
                    yield pa.record_batch([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])

    return segments.select(*NAMES[4:]).mapInArrow(task, FOUND)


def top_of(found: DataFrame, top: int) -> DataFrame:
    """The best of each item with their rank; the limit by rank is taken within each task first."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and term hashes of the items, in blocks of `most` terms or one item."""
    ids, words, size = [], [], 0
    for name, text in items.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        found = hashed(pa.array([text], pa.string()), ALPHANUMERIC)[0]
        if words and size + len(found) > most:
            yield ids, words
            ids, words, size = [], [], 0
        ids.append(name)
        words.append(found)
        size += len(found)
    if any(len(x) for x in words):
        yield ids, words


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The `top` best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long")
    for ids, words in blocks(items, item_col, text_col, block_terms):
        vocabulary = np.unique(np.concatenate(words))
        queries = [np.unique(np.searchsorted(vocabulary, x), return_counts=True) for x in words]
        segments = materialize(index(docs, vocabulary, id_col, text_col))
        stats = statistics(segments, len(vocabulary))
        # What each item's answers reach at least: the last of `top` scores found in the best clusters.
        first = top_of(search(segments, queries, stats, top, np.ones(len(ids), np.int64), STEP), top).filter(F.col("rank") == top).select("item", "score")
        needed = np.ones(len(ids), np.int64)
        for item, score in first.collect():  # a row an item of the block
            needed[item] = score
        found = top_of(search(segments, queries, stats, top, needed, None), top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {items.schema[item_col].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(int(LAST))).alias("doc_id"), "score")
        out = out.unionByName(found)
    return out


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    return rank(docs, items)


OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
e AS (SELECT r, doc_id, len(t) AS n, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d WHERE len(t) > 0),
s AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS total FROM e),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM e GROUP BY ALL),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, translate(unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
x AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20"""
