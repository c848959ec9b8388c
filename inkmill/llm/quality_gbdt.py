"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Executors turn whole texts into statistics; the trees are fitted on the driver on a bounded sample of
labelled rows (SAMPLE, taken in order of a hash of the id) and sent to the executors as flat arrays,
which numpy walks for all documents of a batch at once, level by level. Scores are probabilities: the
trees minimise logistic loss.

Statistics are of the text alone: neither labels nor lang, source or doc_id are inputs of a score.
Labels of held-out rows, those with crc32(doc_id as text) mod 4 = 2, are never read for fitting.

Defined results: null and empty texts have statistics of zero and are scored as such; a null label or
doc_id teaches nothing; a document with several label rows counts once for each; without labels, or
with labels of one kind only, every score is that kind's share (a half where there are none); repeated
rows get equal scores; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  #: labelled rows at most that the trees are fitted on
THRESHOLD = 0.7
FEATURES = ["log_words", "word_length", "symbols", "marks", "upper", "digits", "distinct_words", "top_word", "line_words", "repeated_lines", "same_neighbours", "ended_words", "beyond_ascii", "repeated_triples"]
SYMBOLS = "#*$%&|<>"


def statistics(text: str | None) -> list[float]:
    """The features of one text, each a share or a logarithm, so that they do not depend on its length alone."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars, seen = len(text), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = Counter(zip(words, words[1:], words[2:]))
    count = text.count
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        sum(count(c) for c in SYMBOLS) / n,
        (count("!") + count("?")) / n,
        sum(map(str.isupper, words)) / n,
        sum(count(c) for c in "0123456789") / chars,
        len(seen) / n,
        seen.most_common(1)[0][1] / n,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        (count(".") + count(",")) / n,
        1 - len(text.encode("ascii", "ignore")) / chars,
        sum(c for c in triples.values() if c > 1) / n,
    ]


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@dataclass
class Forest:
    """Trees as arrays of [tree, node]: children of node i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # -1 in a leaf
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]))
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least: int = 5, ridge: float = 1.0) -> Forest:
    """Boosts `trees` trees; a split is searched in histograms of gradients over `bins` bins a feature."""
    size, n = 2 ** (depth + 1) - 1, len(y)
    feature, cut, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    share = float(y.mean()) if n else 0.5
    if not n or not 0 < share < 1:
        base = 0.0 if not n else (20.0 if share else -20.0)
        return Forest(feature, cut, value, base, depth)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if not len(rows):
                    continue
                sum_g, sum_h = g[rows].sum(), h[rows].sum()
                value[t, k] = -rate * sum_g / (sum_h + ridge)
                if level == depth or len(rows) < 2 * least:
                    continue
                best, at = 1e-6, None
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    left_g = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (sum_g - left_g) ** 2 / (sum_h - left_h + ridge) - sum_g**2 / (sum_h + ridge)
                    gain[(left_n < least) | (len(rows) - left_n < least)] = 0
                    if gain.max() > best:
                        best, at = gain.max(), (f, int(gain.argmax()))
                if at:
                    f, b = at
                    feature[t, k], cut[t, k] = f, edges[f][b]
                    node[rows] = 2 * k + 1 + (binned[rows, f] > b)
        at = np.zeros(n, dtype=np.int64)
        for _ in range(depth):
            f = feature[t, at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[np.arange(n), np.maximum(f, 0)] > cut[t, at]))
        total += value[t, at]
    return Forest(feature, cut, value, base, depth)


def with_statistics(rows: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, and features (array of double) of the text."""
    rows = rows.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", features array<double>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    return rows.mapInArrow(task, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fits on at most `sample` labelled rows that are not held out."""
    chosen = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    # A doc_id may repeat in docs; the bound holds for rows, which are taken in the order of their hashes.
    rows = with_statistics(texts.withColumn("k", F.xxhash64("doc_id", "text")), ["y", "k"]).orderBy("k", "y").limit(sample).collect()
    x = np.array([r.features for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in rows], dtype=float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # a few thousand numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.record_batch([b.column("doc_id"), pa.array(sent.value.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, score double")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
