"""Benchmark decontamination with suffix arrays over the training documents.

Each task cuts its documents into shards of bounded size and builds a suffix array over a shard's
words. The suffixes of every benchmark item are then binary-searched in every shard by their first
`window` words, their windows; this gives all locations of each. A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window. Document words in any occurrence
of a window are hit.

The array is ordered to `window` words: what windows need; longest verbatim matches go on beyond that
where the windows at neighbouring locations follow each other. Suffixes shorter than a window, at an
item's end, are none and are not searched. Words that no item holds cannot be part of a
match, so only runs of items' words that are as long as the shortest window enter the array; that
changes no match of a window.

The items are a query set against all rows: they go to the tasks in blocks of at most `block_words`
words (100 bytes a word in a task: some 25 MB), so a block's size is bounded whatever the benchmark's; a
larger benchmark takes more passes. An item of more words is cut into pieces, each of which repeats the
last window - 1 words of the one before, so that every window lies in one piece.

Defined results: null texts and texts without words have no hits; items without words have no windows;
equal items each count; repeated documents each get their row; a null item_id is left out; an empty
table of documents gives an empty result, an empty benchmark no hits; other columns are ignored. A
document is never cut: one longer than a shard is a shard of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import materialize

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SHARD_BYTES = 16 << 20
BLOCK_WORDS = 250_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes runs of digits, letters and characters beyond ASCII."""
    return WORD.findall((text or "").encode().lower())


class Items:
    """The windows of some benchmark items, ready for search."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids, self.words = window, [], {}
        text, start, need, owner = [], [], [], []
        for item_id, w in items:
            size = min(window, len(w))
            for k in range(len(w) - size + 1):
                start.append(len(text) + k)
                need.append(size)
                owner.append(len(self.ids))
            self.ids.append(item_id)
            text += [self.words.setdefault(x, len(self.words) + 1) for x in w]
            text.append(0)
        self.start, self.need, self.owner = (np.array(x, dtype=np.int64) for x in (start, need, owner))
        self.least = min(need, default=0)
        padded = np.array([*text, *[0] * window], dtype=np.int64)
        self.words_at = padded[self.start[:, None] + np.arange(window)] if start else np.zeros((0, window), dtype=np.int64)
        self.counts = np.arange(window) < self.need[:, None]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of text that begin with a word over 0, in the order of their first `depth` words.

    Prefix doubling: ranks of 2, 4, 8 ... words, the last step overlapping. Word 0, an end, comes first.
    """
    live, rank, size = np.flatnonzero(text > 0), text, 1
    while size < depth:
        step = min(size, depth - size)
        second = np.zeros_like(rank)
        second[:-step] = rank[step:]
        _, dense = np.unique(rank[live] * (rank.max() + 1) + second[live], return_inverse=True)
        rank = np.zeros_like(text)
        rank[live] = dense + 1
        size += step
    return live[np.argsort(rank[live], kind="stable")]


def search(text: np.ndarray, array: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For every window the range of the suffix array whose suffixes begin with it: all binary searches step together."""
    padded = np.concatenate([text, np.zeros(items.window, dtype=np.int64)])
    span, n = np.arange(items.window), len(items.start)

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(array), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            there = padded[array[mid][:, None] + span]
            differs = (there != items.words_at[open_]) & items.counts[open_]
            first = differs.argmax(axis=1)
            row = np.arange(len(open_))
            less = differs[row, first] & (there[row, first] < items.words_at[open_][row, first])
            right = less | ~differs.any(axis=1) if upper else less
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    return bound(False), bound(True)


def scan(texts: list[str | None], items: Items) -> tuple[list[int], tuple[np.ndarray, ...]]:
    """Word counts of one shard's texts, and all matches of windows in it: arrays text, word, window."""
    get, counts, coded = items.words.get, [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        coded.append(np.array([get(x, 0) for x in w] + [0], dtype=np.int64))
    none = (np.zeros(0, dtype=np.int64),) * 3
    if not items.ids or not coded:
        return counts, none
    whole = np.concatenate(coded)
    sizes = np.array(counts, dtype=np.int64) + 1
    # Only runs of items' words that are long enough for the shortest window can hold a match.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (whole > 0).astype(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    fit = end - begin >= items.least
    begin, length = begin[fit], (end - begin)[fit]
    if not len(begin):
        return counts, none
    # The runs laid side by side with a 0 after each.
    offset = np.cumsum(length + 1) - (length + 1)
    place = np.repeat(begin - offset, length + 1) + np.arange(int((length + 1).sum()))
    text = np.where(whole[place] > 0, whole[place], 0)
    array = suffix_array(text, items.window)
    low, high = search(text, array, items)
    found = high - low
    window = np.repeat(np.arange(len(found)), found)
    row = np.arange(int(found.sum())) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
    at = place[array[row]]
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, at, side="right")
    return counts, (doc, at - (ends - sizes)[doc], window)


def spans_of(doc: np.ndarray, word: np.ndarray, window: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """Longest verbatim matches: (text, item, first word there, first window there, words), windows that follow each other joined."""
    if not len(doc):
        return []
    order = np.lexsort((word, word - window, items.owner[window], doc))
    doc, word, window = doc[order], word[order], window[order]
    owner = items.owner[window]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (word[1:] != word[:-1] + 1) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(doc)))
    return list(zip(doc[first].tolist(), owner[first].tolist(), word[first].tolist(), window[first].tolist(), (run - 1 + items.need[window[first]]).tolist()))


def shards(batches: Iterator[pa.RecordBatch], column: int, chars: int) -> Iterator[pa.Table]:
    """Batches gathered to tables of about `chars` bytes of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= chars:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def blocks(benchmark: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> Iterator[Items]:
    """The items, or pieces of them, in blocks of at most block_words words; no more than a block is read ahead."""
    held, size = [], 0
    most = max(block_words, window)
    for item_id, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        w = words_of(text)
        if item_id is None or not w:
            continue
        for at in range(0, max(1, len(w) - window + 1), most - window + 1):
            piece = w[at : at + most]
            if held and size + len(piece) > most:
                yield Items(held, window)
                held, size = [], 0
            held.append((item_id, piece))
            size += len(piece)
    yield Items(held, window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_hash, n_words, and spans, the longest verbatim matches.

    spans: item_id, start and length in words of the document, item_window (the number of the first window in its block).
    With several blocks, documents are numbered in a table first, and a document's spans are brought together by its number.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, text_hash long, n_words long, spans array<struct<item_id:string,start:long,length:long,item_window:long>>"
    span_type = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("item_window", pa.int64())]))
    sent_blocks = [docs.sparkSession.sparkContext.broadcast(items) for items in blocks(benchmark, window, block_words, item_col, item_text_col)]
    if len(sent_blocks) > 1:
        rows = materialize(rows)
    found = None
    for sent in sent_blocks:

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for table in shards(batches, 3, shard_bytes):
                counts, hits = scan(table.column("text").to_pylist(), items)
                spans: list[list[dict]] = [[] for _ in counts]
                for doc, owner, word, first, length in spans_of(*hits, items):
                    spans[doc].append({"item_id": items.ids[owner], "start": word, "length": length, "item_window": first})
                out = pa.table({"row": table.column("row"), "doc_id": table.column("doc_id"), "text_hash": table.column("text_hash"), "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span_type)})
                yield from out.to_batches()

        part = rows.mapInArrow(task, schema)
        found = part if found is None else found.unionByName(part)
    if len(sent_blocks) > 1:
        found = found.groupBy("row", "doc_id", "text_hash", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return found.drop("row")


def covered(spans: list[dict]) -> int:
    """Words in any of the spans."""
    total, reached = 0, -1
    for start, end in sorted((s["start"], s["start"] + s["length"]) for s in spans):
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


def report(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated and longest (words of the longest match)."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spans in b.column("spans").to_pylist():
                items = sorted({s["item_id"] for s in spans})
                out.append((covered(spans), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), max((s["length"] for s in spans), default=0)))
            hit, n, sha, longest = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch(
                [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array(longest, pa.int64())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
            )

    return found.select("doc_id", "n_words", "spans").mapInArrow(task, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of an item. Documents are told apart by doc_id and text."""
    hit = matches(docs, benchmark, window).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__ink_id"), F.col("text_hash").alias("__ink_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__ink_id")) & (F.xxhash64("text") == F.col("__ink_hash"))
    return docs.join(hit, same, "left_anti").select(docs.columns)


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(matches(docs, benchmark)).drop("longest")


OP7_SQL = r"""
WITH item AS (
  SELECT item_id::VARCHAR AS item_id, w, least(10, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0 AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM item)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
place AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM win))),
hit AS (SELECT r, p, k, item_id FROM place JOIN win USING (k, t)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
