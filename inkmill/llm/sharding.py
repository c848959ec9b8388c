"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual_nodes` points of a ring; a row's key hashes to a place on it and belongs to
the next point clockwise. Shards are bounded: each holds the floor or the ceiling of rows / shards
(the first rows % shards of them the ceiling), so their counts differ by one at most. Rows that meet
a full shard go on clockwise to the next point whose shard has room. Rows are dealt in ring order.

How it runs: one narrow range-sort by place on the ring (key hash, then the row's own order), written
to the shared folder; a count for each arc, of which there are shards * virtual_nodes however many
rows there are; the walk over these counts on the driver; and a look-up of each row's rank in the
result. A key that holds a third of all rows is spread over many sort partitions by the rows' own order.

Defined results: null and empty texts are sharded as any other; rows equal in all columns get slots
next to each other; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import materialize, partitions

SIGNED = 1 << 63


def ring(n_shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order; places are signed 64-bit integers."""
    points = []
    for shard in range(n_shards):
        for k in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big") - SIGNED, shard))
    return sorted(points)


def walk(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """Deals the rows of each arc, in ring order, to shards with room: (first rank, shard, first slot) of each run."""
    n, room, used, runs, rank = len(owners), list(capacity), [0] * len(capacity), [], 0
    for arc, left in enumerate(counts):
        at = arc
        while left:
            shard = owners[at % n]
            if take := min(left, room[shard]):
                runs.append((rank, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                rank += take
                left -= take
            at += 1
    return runs


def assign(docs: DataFrame, key: Column, carry: dict[str, Column], order: list[Column], n_shards: int = 24, virtual_nodes: int = 64) -> DataFrame:
    """Returns the columns named in carry for each row of docs, with shard (int) and slot (long, gapless from 0 in a shard).

    key: what is hashed onto the ring; equal keys stay together until their shard is full.
    order: the rows' order where they meet on the ring.
    """
    points = ring(n_shards, virtual_nodes)
    places = [p for p, _ in points]
    narrow = docs.select(*[c.alias(f"c_{n}") for n, c in carry.items()], F.xxhash64(key).alias("ring_place"), *[c.alias(f"o_{i}") for i, c in enumerate(order)])
    by = ["ring_place", *[f"o_{i}" for i in range(len(order))]]
    # The id that Spark numbers rows with holds the partition in its upper bits and the row's place there in the lower 33.
    dealt = narrow.repartitionByRange(partitions(docs), *by).sortWithinPartitions(*by).withColumn("ring_row", F.monotonically_increasing_id())
    dealt = materialize(dealt.drop(*by[1:]))

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array(places, dtype=np.int64)
        for b in batches:
            arc = np.searchsorted(ends, b.column("ring_place").to_numpy()) % len(ends)
            part = b.column("ring_row").to_numpy() >> 33
            both, n = np.unique(np.stack([part, arc]), axis=1, return_counts=True)
            yield pa.record_batch([pa.array(both[0]), pa.array(both[1]), pa.array(n.astype(np.int64))], names=["part", "arc", "n"])

    per = dealt.select("ring_place", "ring_row").mapInArrow(arcs, "part long, arc long, n long")
    counts, starts = [0] * len(points), {}
    for part, n in sorted(per.groupBy("part").agg(F.sum("n")).collect()):  # a row for each sort partition
        starts[part] = n
    total = 0
    for part, n in list(starts.items()):
        starts[part], total = total, total + n
    for arc, n in per.groupBy("arc").agg(F.sum("n")).collect():  # a row for each arc
        counts[arc] = n
    # Places beyond the last point belong to the first: they come last in ring order.
    beyond = 0
    if total:
        beyond = dealt.filter(F.col("ring_place") > places[-1]).count()
    owners = [s for _, s in points]
    runs = walk([counts[0] - beyond, *counts[1:], beyond], [*owners, owners[0]], [total // n_shards + (s < total % n_shards) for s in range(n_shards)])
    first_of, schema = starts, ", ".join([*[f"`{n}` {dealt.schema[f'c_{n}'].dataType.simpleString()}" for n in carry], "shard int", "slot long"])
    names = list(carry)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.array([r[0] for r in runs], dtype=np.int64)
        shards, slots = np.array([r[1] for r in runs], dtype=np.int32), np.array([r[2] for r in runs], dtype=np.int64)
        part_ids = np.array(sorted(first_of), dtype=np.int64)
        part_starts = np.array([first_of[p] for p in part_ids.tolist()], dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            row = b.column("ring_row").to_numpy()
            rank = part_starts[np.searchsorted(part_ids, row >> 33)] + (row & ((1 << 33) - 1))
            run = np.searchsorted(ranks, rank, side="right") - 1
            yield pa.record_batch([*[b.column(f"c_{n}") for n in names], pa.array(shards[run]), pa.array(slots[run] + rank - ranks[run])], names=[*names, "shard", "slot"])

    return dealt.mapInArrow(look_up, schema)


def shard_of(place: int, points: list[tuple[int, int]]) -> int:
    """The shard that owns a place while none is full."""
    return points[bisect.bisect_left(points, (place, -1)) % len(points)][1]


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the rows of docs into one folder a shard, in slot order; assigned: what assign() returned with key in carry."""
    joined = docs.join(assigned.select(key, "shard", "slot"), key)
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The contract's columns under the law `rows`, with equal texts next to each other on the ring."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = {"doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text)}
    out = assign(docs, text, carry, [F.col("doc_id"), F.crc32(text)], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
