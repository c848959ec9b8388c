"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint: for each of its word shingles (repeats included) an XXH64; a bit is set if
set in over half of them. Documents link where fingerprints differ in at most `radius` bits, and each
gets the least id that it reaches over links.

How it runs: equal fingerprints are first made one row, so groups of exact copies cost one comparison.
Two values within the radius agree in at least one of radius + 1 blocks of their bits; the distinct
values are dealt by each block's value and compared there in tiles with numpy: exclusive-or and bit
counts of a whole tile pair at once, in order of population count, leaving out tile pairs whose
population counts differ by more than the radius (two values differ in at least as many bits as their
counts do). So the result is that of comparing all with all, and no link is lost. A block value with
more than `tile` rows is divided into tiles by population count and a hash, and pairs of tiles are
separate groups of bounded size. From each group come only edges to its local components' least
member, never its pairs; components over groups are then joined by `common.connected`.

Defined results: a null text counts as empty; texts without words have fingerprint zero; a null doc_id
links as any other row but is no component's name unless no other id is there; repeated rows are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import connected, materialize, partitions, sorted_runs, split_join

BITS = 64
TILE = 4096


def fingerprint(words: list[bytes], width: int, seed: int = 42) -> int:
    """The SimHash of a sequence of words, as an unsigned integer."""
    import xxhash

    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    k = min(width, len(words))
    a, b = start[: len(words) - k + 1].tolist(), (start + size)[k - 1 :].tolist()
    digest, ones, step = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), 1 << 16
    for i in range(0, len(a), step):
        h = np.array([digest(joined[x:y], seed) for x, y in zip(a[i : i + step], b[i : i + step])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(a), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) for each row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # bytes.lower() and bytes.split() know only ASCII letters and white space, as the definition does.
            fps = [fingerprint((t or "").encode().lower().split(), width) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the radius + 1 blocks of a fingerprint."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def local_roots(values: np.ndarray, radius: int, side: int = 512) -> np.ndarray:
    """For each of values (uint64) the index of the first member of its component, by tiled comparison."""
    order = np.argsort(np.bitwise_count(values), kind="stable")
    v = values[order]
    pop, n = np.bitwise_count(v).astype(np.int64), len(v)
    label, tiles, found = order.copy(), [(i, min(i + side, n)) for i in range(0, n, side)], []
    for x, (a, b) in enumerate(tiles):
        for c, d in tiles[x:]:
            if pop[c] - pop[b - 1] > radius:
                break  # all further tiles differ by more still
            near = np.bitwise_count(v[a:b, None] ^ v[None, c:d]) <= radius
            if near.sum() > (b - a if a == c else 0):
                found.append((a, b, c, d, near))
    changed = True
    while changed:
        changed = False
        for a, b, c, d, near in found:
            down = np.where(near, label[a:b, None], n).min(axis=0)
            up = np.where(near, label[None, c:d], n).min(axis=1)
            if (down < label[c:d]).any() or (up < label[a:b]).any():
                label[c:d] = np.minimum(label[c:d], down)
                label[a:b] = np.minimum(label[a:b], up)
                changed = True
    out = np.empty(n, dtype=np.int64)
    out[order] = label
    return out


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect what lies within the radius; distinct: one column fp without repeats."""
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned(fp, {s}) & {(1 << w) - 1}L").alias("value")) for i, (s, w) in enumerate(block_bounds(radius))]))
    rows = distinct.select("fp", blocks.alias("b")).select("fp", "b.*")
    # At most (radius + 1) * 2 ** width rows; only those of large groups are looked up.
    large = rows.groupBy("block", "value").count().filter(F.col("count") > tile).select("block", "value", F.ceil(F.col("count") / tile).cast("int").alias("k"))
    rows = rows.join(large, ["block", "value"], "left")
    pop, salt = F.bit_count("fp"), F.expr("pmod(xxhash64(fp), k)").cast("int")
    own = F.struct(pop.cast("int").alias("p"), salt.alias("s"))
    others = F.expr(f"flatten(transform(sequence(-{radius}, {radius}), d -> transform(sequence(0, k - 1), s -> named_struct('p', cast(bit_count(fp) as int) + d, 's', s))))")
    pairs = F.when(F.col("k").isNull(), F.array(F.struct(F.struct(F.lit(0).alias("p"), F.lit(0).alias("s")).alias("a"), F.struct(F.lit(0).alias("p"), F.lit(0).alias("s")).alias("b")))).otherwise(
        F.transform(others, lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
    )
    keyed = rows.select("fp", "block", "value", F.explode(pairs).alias("t")).select("fp", F.xxhash64("block", "value", "t").alias("group"))
    dealt = keyed.repartition(partitions(distinct), "group").sortWithinPartitions("group")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["group"]):
            group, fp = table.column("group").to_numpy(), table.column("fp").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            us, vs = [], []
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 2:
                    continue
                root = local_roots(fp[a:b].view(np.uint64), radius)
                moved = np.flatnonzero(root != np.arange(b - a))
                if len(moved):
                    us.append(fp[a:b][moved])
                    vs.append(fp[a:b][root[moved]])
            if us:
                yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def components(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp and component_id for each row of docs."""
    fps = materialize(fingerprints(docs, width, id_col, text_col))
    values = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs"))
    roots = connected(links(values.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    values = materialize(values.join(roots, "fp", "left").select("fp", "least", "n_docs", F.coalesce("root", "fp").alias("root")))
    # A component may hold very many fingerprints, and a fingerprint very many documents: such are joined apart.
    names = materialize(values.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = split_join(values.select("fp", "root", "n_docs"), names, "root", "n").select("fp", "component_id", "n_docs")
    return split_join(fps, named, "fp", "n_docs").select("doc_id", "text_hash", "fp", "component_id")


def near_dedup(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """docs without those whose component holds a lesser doc_id. Rows equal in doc_id and text share their fate; rows without an id stay."""
    gone = components(docs, width, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias("__ink_id"), F.col("text_hash").alias("__ink_hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("__ink_id")) & (F.xxhash64(docs["text"]) == F.col("__ink_hash")), "left_anti").select(docs.columns)


def op6(docs: DataFrame) -> DataFrame:
    found = components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
