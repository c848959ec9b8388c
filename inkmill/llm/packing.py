"""Harmonic packing of token sequences.

Class k holds pieces of which k, and no k + 1, fit into a sequence: their lengths lie between
capacity / (k + 1) and capacity / k. A bin of class k takes exactly k pieces, so each worker fills its
bins by counting, without looking at any other. A piece that would leave more than capacity / 64
of such a bin empty is cut: the largest exact part of the next class is taken off until the rest fits.

Each worker leaves at most one open bin a class. The pieces of open bins, a number bounded for each
worker by the classes' counts, meet in groups of FAN_IN workers, which fill bins by the same count; so
round by round until one group is left, whose open bins (fewer pieces than the sum of the classes'
counts, whatever the input) are packed by first fit.

Defined results: a null text counts as empty: a document of the end id alone; repeated rows are packed
each; a null doc_id is carried; an empty table gives an empty result; other columns are ignored; a
text of any length is cut into sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import materialize
from inkmill.llm.tokens import encoder_of, vocabulary_path

CAPACITY = 1024
FAN_IN = 16
PLACE_BITS = 32


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(class, length) of each piece of a document, in order."""
    pieces, left = [(1, capacity)] * (length // capacity), length % capacity
    while left:
        k = capacity // left
        if capacity - k * left <= capacity // 64:
            pieces.append((k, left))
            break
        pieces.append((k + 1, capacity // (k + 1)))
        left -= capacity // (k + 1)
    return pieces


class Bins:
    """Counts pieces into bins of their class; sequences are numbered from `first` on."""

    def __init__(self, first: int):
        self.next, self.open = first, {}

    def add(self, k: int, piece: int, length: int, place: list) -> None:
        """place[piece] becomes (sequence, offset) when the piece's bin is full."""
        held = self.open.setdefault(k, [])
        held.append((piece, length))
        if len(held) == k:
            self.close(self.open.pop(k), place)

    def close(self, held: list[tuple[int, int]], place: list) -> None:
        at = 0
        for piece, length in held:
            place[piece] = (self.next, at)
            at += length
        self.next += 1


def first_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes, longest first."""
    bins, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), None)
        if at is None:
            at = len(bins)
            bins.append([])
            room.append(capacity)
        bins[at].append(i)
        room[at] -= lengths[i]
    return bins


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "class", "worker", "sequence_id", "offset"]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces; sequence_id and offset are null for those left in a worker's open bins."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer)
        bins = Bins(worker << PLACE_BITS)
        waiting: dict[int, list] = {}  # pieces of open bins: their rows wait for a place

        def send(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [kind, *[pa.int64()] * 8, *([pa.binary()] if with_ids else [])]
            return pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["doc_id", *COLUMNS, *(["ids"] if with_ids else [])])

        number = 0
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 512):
                names, texts = batch.column(0).slice(at, 512).to_pylist(), batch.column(1).slice(at, 512).to_pylist()
                place: dict[int, tuple[int, int]] = {}
                for name, ids in zip(names, encoder.encode(texts)):
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                    start = 0
                    for k, length in cut(len(ids), capacity):
                        data = ids[start : start + length].tobytes()
                        waiting[number] = [name, start, length, zlib.crc32(data), len(ids), k, worker, None, None, *([data] if with_ids else [])]
                        bins.add(k, number, length, place)
                        start += length
                        number += 1
                if place:
                    done = []
                    for piece, where in place.items():
                        row = waiting.pop(piece)
                        row[7], row[8] = where
                        done.append(row)
                    yield send(done)
        if waiting:
            yield send(list(waiting.values()))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, " + ", ".join(f"`{c}` long" for c in COLUMNS) + (", ids binary" if with_ids else ""))


def fill(left: DataFrame, fan_in: int, capacity: int, round_: int, last: bool) -> DataFrame:
    """Counts the pieces of groups of workers into bins; with `last` the rest is packed by first fit."""

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("class", "ascending"), ("worker", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        k, length, at = table.column("class").to_pylist(), table.column("length").to_pylist(), table.column("worker")[0].as_py() // fan_in
        # Rounds after the first number their sequences below zero, each round and group apart from the others.
        bins, place = Bins(-(((round_ << 24) + at + 1) << PLACE_BITS)), [(None, None)] * table.num_rows
        for i, (c, n) in enumerate(zip(k, length)):
            bins.add(c, i, n, place)
        if last:
            rest = [x for held in bins.open.values() for x in held]
            for members in first_fit([n for _, n in rest], capacity):
                bins.close([rest[m] for m in members], place)
        for name, values in (("worker", [at] * len(place)), ("sequence_id", [p[0] for p in place]), ("offset", [p[1] for p in place])):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return table

    return left.groupBy(F.floor(F.col("worker") / fan_in).alias("meeting")).applyInArrow(group, left.schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    now = materialize(pieces(docs, tokenizer, end_id, capacity, with_ids))
    out, left, round_ = now.filter("sequence_id IS NOT NULL"), now.filter("sequence_id IS NULL"), 0
    workers = (left.agg(F.max("worker")).first()[0] or 0) + 1
    while True:
        last = workers <= FAN_IN
        filled = materialize(fill(left, FAN_IN, capacity, round_, last))
        out = out.unionByName(filled.filter("sequence_id IS NOT NULL"))
        if last:
            break
        left, round_, workers = filled.filter("sequence_id IS NULL"), round_ + 1, -(-workers // FAN_IN)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """From pack(..., with_ids=True): sequence_id and its ids, at most `capacity` of them, in order."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x["h"]))
    return packed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"), F.sum("length").alias("n_tokens"))


def op3(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(docs, tokenizer or vocabulary_path())
