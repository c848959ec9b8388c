"""A trie of the turns of conversations, so that what many of them begin with is seen (and can be stored or computed) once.

Turns are sorted by range into (conversation, turn) and numbered where they lie; a prefix is named by the number
of its turns and two 64-bit sums of their labels times powers of an odd number, which numpy takes as running sums,
and which a prefix taken from another conversation only shifts. So neither numbering nor naming gathers a
conversation in one task. Prefixes are counted by name, with partial sums before the shuffle.

A prefix of one conversation has a known subtree: the rest of that conversation. Those that are shared form
succinct tries. The upper prefixes, of over `HEAVY` conversations and over a 10,000th of all, are a trie of their
own; the trees below them are dealt to shards, by their roots. numpy puts a shard's prefixes into level order (by
their parent's place, then by label) and writes the LOUDS bitvector (for each node a one a child and a zero) beside
arrays of labels and counts. The tries are a table in the shared folder. Subtree sums go through each trie from its last
level to its first by add.at; those of a shard's roots are then handed to the trie that holds their parents. Tries are cut
into bands of `BAND` levels too, so that no conversation is too long for a task.

Defined results: rows of one conversation are ordered by turn, null first, then by a hash of role and text; null roles and
texts are empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are
left out; an empty table has no nodes; other columns are ignored. Labels and names are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import materialize, partitions
from inkmill.llm.words import FACTOR

HEAVY = 1_000  #: conversations of a prefix that may be dealt to a shard, or a 10,000th of all if that is more
BAND = 1 << 16  #: levels of a trie
SHARD = 200_000  #: prefixes of a shard, as a mean
BROADCAST = 500_000  #: prefixes that are broadcast (under 32 MB)
MOST_SHARED = 5  #: turns that a rebuilt conversation takes from another, at most
MASK = (1 << 64) - 1
KEY = ["depth", "v1", "v2"]


def power(exponents: np.ndarray) -> np.ndarray:
    """FACTOR to each exponent modulo 2^64, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(FACTOR), exponents.astype(np.uint64)
    for _ in range(int(left.max()).bit_length() if len(left) else 0):
        out = np.where(left & np.uint64(1), out * square, out)
        left = left >> np.uint64(1)
        square = np.multiply(square, square, dtype=np.uint64)
    return out


def unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64)


def batch_of(**columns: np.ndarray) -> pa.RecordBatch:
    held = [x.view(np.int64) if x.dtype == np.uint64 else x for x in columns.values()]
    return pa.record_batch([pa.array(x) for x in held], names=list(columns))


RUNS = "part int, conv_id long, i long, l1 long, l2 long, a1 long, a2 long, points long"


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their number and running sums of labels within their conversation: conv_id, pos, l1, l2, w1, w2, points.

    Tasks number what they hold of a conversation; where one goes on in the next task's range, its count and sums
    up to there are added when the table is read: one row a task comes to the driver.
    """
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("l1"), F.col("l2")]
    # The last key parts rows that are equal in all, so that they need not lie in one range.
    ranged = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(turns), *order, F.col("row")).sortWithinPartitions(*order)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conv, carry = TaskContext.get().partitionId(), None, (0, np.uint64(0), np.uint64(0))
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("conv_id").to_numpy()
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ids[1:] != ids[:-1]]), np.arange(len(ids)), 0))
            i, goes_on = np.arange(len(ids)) - start, (start == 0) & (ids[0] == conv)
            i[goes_on] += carry[0]
            weight, sums = power(i), []
            for lane, name in ((1, "l1"), (2, "l2")):
                terms = unsigned(b, name) * weight
                total = np.cumsum(terms)
                total -= (total - terms)[start]
                total[goes_on] += carry[lane]
                sums.append(total)
            conv, carry = ids[-1], (int(i[-1]) + 1, sums[0][-1], sums[1][-1])
            yield batch_of(part=np.full(len(ids), part, np.int32), conv_id=ids, i=i, l1=unsigned(b, "l1"), l2=unsigned(b, "l2"), a1=sums[0], a2=sums[1], points=b.column("points").to_numpy())

    runs = materialize(ranged.select("conv_id", "l1", "l2", "points").mapInArrow(task, RUNS))
    ends = runs.groupBy("part").agg(F.min("conv_id"), F.max("conv_id"), F.max_by(F.struct("i", "a1", "a2"), F.struct("conv_id", "i")))
    before, conv, n, sums = {}, None, 0, (0, 0)
    for part, first, last, tail in sorted(ends.collect(), key=lambda r: r[0]):
        if first != conv:
            n, sums = 0, (0, 0)
        before[part] = (first, n, *sums)
        if first != last:
            n, sums = 0, (0, 0)
        n, sums, conv = n + tail.i + 1, tuple((s + pow(FACTOR, n, 1 << 64) * a) & MASK for s, a in zip(sums, (tail.a1, tail.a2))), last

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, ids, pos = b.column("part").to_numpy(), b.column("conv_id").to_numpy(), b.column("i").to_numpy() + 1
            w = [unsigned(b, "a1").copy(), unsigned(b, "a2").copy()]
            for p in np.unique(part):
                first, n, *sums = before[int(p)]
                if n:
                    on = (part == p) & (ids == first)
                    pos[on] += n
                    for lane in (0, 1):
                        w[lane][on] = w[lane][on] * np.uint64(pow(FACTOR, n, 1 << 64)) + np.uint64(sums[lane])
            yield batch_of(conv_id=ids, pos=pos, l1=unsigned(b, "l1"), l2=unsigned(b, "l2"), w1=w[0], w2=w[1], points=b.column("points").to_numpy())

    return runs.mapInArrow(place, "conv_id long, pos long, l1 long, l2 long, w1 long, w2 long, points long")


ROWS = "conv_id long, depth long, v1 long, v2 long, u1 long, u2 long, l1 long, l2 long, points long, ends boolean"


def rebuilt(placed: DataFrame, base: Column, shared: Column) -> DataFrame:
    """The prefixes of all rebuilt conversations, a row for each and conversation that starts with it, from depth 0 on.

    A conversation takes the first `shared` turns (at most MOST_SHARED) of the conversation `base`, all if it has fewer and
    none if it is absent, then its own turns after its first `shared`. v names the prefix, u the one before its last
    turn, l is the label of that turn.
    """
    head = F.array_sort(F.collect_list(F.when(F.col("pos") <= MOST_SHARED, F.struct("pos", "l1", "l2", "w1", "w2", "points"))))
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("n"), head.alias("head"))
    other = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("theirs"))
    joined = convs.withColumns({"h": shared.cast("long"), "base": base}).join(other, "base", "left")
    k = F.when(F.col("theirs").isNull(), 0).otherwise(F.least("h", F.size("theirs"))).cast("long")
    sums = lambda turns, at, lane: F.coalesce(F.get(turns, (at - 1).cast("int"))[lane], F.lit(0))
    info = joined.withColumn("k", k).select(
        "conv_id", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"), F.slice(F.coalesce("theirs", F.array()), 1, F.col("k").cast("int")).alias("taken"),
        *[sums(F.col("theirs"), F.col("k"), f"w{i}").alias(f"t{i}") for i in (1, 2)], *[sums(F.col("head"), F.col("h"), f"w{i}").alias(f"s{i}") for i in (1, 2)],
    )
    info = materialize(info)
    zero = F.lit(0).cast("long")
    roots = info.select("conv_id", zero.alias("depth"), zero.alias("v1"), zero.alias("v2"), zero.alias("u1"), zero.alias("u2"), zero.alias("l1"), zero.alias("l2"), zero.alias("points"), (F.col("size") == 0).alias("ends"))
    past = lambda i, lane: F.coalesce(F.get("taken", i - 1)[lane], zero)
    turns = F.transform("taken", lambda t, i: F.struct(t["pos"].alias("depth"), t["w1"].alias("v1"), t["w2"].alias("v2"), past(i, "w1").alias("u1"), past(i, "w2").alias("u2"), t["l1"].alias("l1"), t["l2"].alias("l2"), t["points"].alias("points")))
    heads = info.select("conv_id", "size", F.explode(turns).alias("t")).select("conv_id", "t.*", (F.col("t.depth") == F.col("size")).alias("ends"))
    own = placed.join(info.drop("taken"), "conv_id").filter(F.col("pos") > F.col("h"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = np.array([pow(FACTOR, -e, 1 << 64) for e in range(MOST_SHARED + 1)], dtype=np.uint64)
        for b in batches:
            n = {c: b.column(c).to_numpy() for c in ("conv_id", "pos", "h", "k", "size", "points")}
            depth = n["pos"] - n["h"] + n["k"]
            shift, last, out = back[n["h"] - n["k"]], power(depth - 1) if len(depth) else np.zeros(0, np.uint64), {}
            for i in (1, 2):
                out[f"v{i}"] = unsigned(b, f"t{i}") + shift * (unsigned(b, f"w{i}") - unsigned(b, f"s{i}"))
                out[f"u{i}"] = out[f"v{i}"] - last * unsigned(b, f"l{i}")
            yield batch_of(conv_id=n["conv_id"], depth=depth, v1=out["v1"], v2=out["v2"], u1=out["u1"], u2=out["u2"], l1=unsigned(b, "l1"), l2=unsigned(b, "l2"), points=n["points"], ends=depth == n["size"])

    return roots.unionByName(heads).unionByName(own.mapInArrow(task, ROWS))


def counted(rows: DataFrame) -> DataFrame:
    """A row for each prefix: its least conversation, how many start with it, how many end with it and the least of these."""
    ends = F.when(F.col("ends"), F.col("conv_id"))
    same = [F.max(c).alias(c) for c in ("u1", "u2", "l1", "l2", "points")]
    return rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count(ends).alias("n_ends"), F.min(ends).alias("end_id"), *same)


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


class Louds:
    """A trie in level order below a node 0 that stands for what is above its roots."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.zeros = np.flatnonzero(~bits)
        #: of nodes 1, 2, ...: a one with z zeros before it is a child of node z
        self.parents = np.concatenate([[-1], np.cumsum(~bits)[bits]])

    @classmethod
    def of(cls, parents: np.ndarray) -> Louds:
        """parents: of nodes 1, 2, ... in level order."""
        degrees = np.bincount(parents, minlength=len(parents) + 1)
        bits = np.ones(2 * len(parents) + 1, dtype=bool)
        bits[np.cumsum(degrees) + np.arange(len(degrees))] = False
        return cls(bits)

    @classmethod
    def read(cls, data: bytes, n: int) -> Louds:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8), count=2 * n + 1).astype(bool))

    def children(self, node: int) -> range:
        """Children are neighbours: the ones between two zeros."""
        a = int(self.zeros[node - 1]) + 1 if node else 0
        first = a - node + 1  # ones before a, counted from node 1 on
        return range(first, first + int(self.zeros[node]) - a)

    def levels(self) -> list[tuple[int, int]]:
        out, a, b = [], 0, 1
        while a < b:
            out.append((a, b))
            a, b = b, int(np.searchsorted(self.parents, b))
        return out

    def rolled(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from the last level to the first."""
        total = values.copy()
        for a, b in reversed(self.levels()[2:]):  # roots hand nothing to node 0
            np.add.at(total, self.parents[a:b], total[a:b])
        return total


TRIES = "band long, shard long, n long, bits binary, depth binary, v1 binary, v2 binary, u1 binary, u2 binary, l1 binary, l2 binary, conv_id binary, n_convs binary, leaves binary, saved binary"
ARRAYS = [x.split()[0] for x in TRIES.split(", ")][4:]


def level_order(depth: np.ndarray, name: np.ndarray, above: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The level order of nodes with these names and those of their parents, and the place of each one's parent (0: not here)."""
    by_name = np.argsort(name, kind="stable")
    at = np.minimum(np.searchsorted(name[by_name], above), len(name) - 1)
    parent = np.where(name[by_name][at] == above, by_name[at], -1)
    by_depth = np.argsort(depth, kind="stable")
    level, cuts = np.zeros(len(depth), np.int64), np.flatnonzero(np.diff(depth[by_depth])) + 1
    for here in np.split(by_depth, cuts):
        level[here] = np.where(parent[here] < 0, 0, level[parent[here]] + 1)
    place, order, up = np.zeros(len(depth) + 1, np.int64), [], []  # place[-1] = 0 is that of no parent
    n, by_level = 1, np.argsort(level, kind="stable")
    for here in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        above_at = place[parent[here]]
        o = np.lexsort((label[here], above_at))
        place[here[o]] = np.arange(n, n + len(here))
        order.append(here[o])
        up.append(above_at[o])
        n += len(here)
    return np.concatenate(order), np.concatenate(up)


def tries(nodes: DataFrame) -> DataFrame:
    """One trie a band and shard, from nodes with shard, band, leaves and saved (what they have besides children here)."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c = {name: table.column(name).to_numpy() for name in ("band", "shard", *ARRAYS)}
        word = lambda d, a, b: a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(FACTOR)) ^ (d.astype(np.uint64) << np.uint64(32))
        order, parents = level_order(c["depth"], word(c["depth"], c["v1"], c["v2"]), word(c["depth"] - 1, c["u1"], c["u2"]), c["l1"])
        row = {"band": [int(c["band"][0])], "shard": [int(c["shard"][0])], "n": [len(order)], "bits": [np.packbits(Louds.of(parents).bits).tobytes()]}
        row |= {name: [c[name][order].tobytes()] for name in ARRAYS}
        return pa.table([pa.array(v, pa.int64() if k in ("band", "shard", "n") else pa.binary()) for k, v in row.items()], names=list(row))

    return nodes.select("band", "shard", *ARRAYS).groupBy("band", "shard").applyInArrow(build, TRIES)


ROLLED = "depth long, v1 long, v2 long, u1 long, u2 long, n_leaves long, saved_tokens long, is_root boolean"


def rollups(held: DataFrame) -> DataFrame:
    """Leaves and saved tokens of the subtrees of each trie's nodes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                louds = Louds.read(b.column("bits")[i].as_buffer(), b.column("n")[i].as_py())
                c = {name: np.frombuffer(b.column(name)[i].as_buffer(), np.int64) for name in ("depth", "v1", "v2", "u1", "u2", "leaves", "saved")}
                total = {name: louds.rolled(np.concatenate([[0], c[name]]))[1:] for name in ("leaves", "saved")}
                out = batch_of(**{k: c[k] for k in ("depth", "v1", "v2", "u1", "u2")}, n_leaves=total["leaves"], saved_tokens=total["saved"], is_root=louds.parents[1:] == 0)
                yield from pa.Table.from_batches([out]).to_batches(max_chunksize=50_000)

    return held.mapInArrow(task, ROLLED)


def subtree_sums(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """depth, v1, v2, n_leaves and saved_tokens of shared prefixes (with n_children); rows: those of rebuilt()."""
    n, most, deepest = shared.agg(F.count("*"), F.max("n_convs"), F.max("depth")).first()
    limit = max(HEAVY, (most or 0) // 10_000)  # the root's conversations are all
    own = {"band": F.floor(F.col("depth") / BAND), "leaves": F.col("n_single") + (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("points")}
    nodes, heavy = shared.withColumns(own), shared.filter(F.col("n_convs") > limit).select(*KEY, F.lit(True).alias("heavy"))
    # Of each conversation the first prefix below the heavy ones: the root of the tree that holds its further shared ones.
    marked = rows.select("conv_id", *KEY).join(small(heavy, heavy.count()), KEY, "left")
    below = F.when(F.col("heavy").isNull(), F.col("depth"))
    roots = marked.groupBy("conv_id").agg(F.min_by(F.xxhash64("v1", "v2"), below).alias("root"))
    dealt = F.when(F.col("n_convs") > limit, -1).otherwise(F.pmod("root", F.lit(-(-(n or 1) // SHARD)))).cast("long")
    nodes = materialize(nodes.join(roots, "conv_id", "left").withColumn("shard", dealt).drop("root"))
    out, handed = None, None
    for band in range((deepest or 0) // BAND, -1, -1):
        for upper in (False, True):
            here = nodes.filter((F.col("band") == band) & ((F.col("shard") < 0) == upper))
            if handed is not None:
                added = here.join(handed, KEY, "left")
                here = added.withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
            rolled = materialize(rollups(materialize(tries(here))))
            up = rolled.filter("is_root AND depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("v1"), F.col("u2").alias("v2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            handed = up if handed is None else handed.unionByName(up)
            # A prefix has children in both the shards and the upper trie, and in the band below.
            handed = handed.groupBy(*KEY).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
            out = rolled if out is None else out.unionByName(rolled)
    return out.select(*KEY, "n_leaves", "saved_tokens")


def end_digests(rows: DataFrame, nodes: DataFrame, size: int = 100_000) -> DataFrame:
    """SHA-256 of the ids of the conversations that end with a prefix, for prefixes with which several end.

    Ids are sorted by range and joined to strings of at most `size` ids where they lie; these come in order to the one
    task that takes the digest, which holds one of them at a time.
    """
    several = nodes.filter("n_ends > 1").select(*KEY)
    ends = rows.filter("ends").select(*KEY, "conv_id").join(small(several, several.count()), KEY, "left_semi")
    ranged = ends.repartitionByRange(partitions(rows), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [b.column(c).to_numpy() for c in (*KEY, "conv_id")]
            if not len(k[0]):
                continue
            new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in k[:3]], axis=0)])
            starts = np.flatnonzero(new | (np.arange(len(new)) % size == 0))
            for first, stop in zip(starts, np.append(starts[1:], len(new))):
                text = ",".join(map(str, k[3][first:stop].tolist()))
                yield pa.record_batch([pa.array([int(x[first])], pa.int64()) for x in k] + [pa.array([text])], names=[*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, taken = None, None
        put = lambda: pa.record_batch([pa.array([x], pa.int64()) for x in key] + [pa.array([taken.hexdigest()])], names=[*KEY, "ends_sha256"])
        for b in batches:
            for *at, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids"))):
                if at != key:
                    if key:
                        yield put()
                    key, taken = at, hashlib.sha256(ids.encode())
                else:
                    taken.update(b"," + ids.encode())
        if key:
            yield put()

    strings = ranged.mapInArrow(joined, "depth long, v1 long, v2 long, first long, ids string")
    together = strings.repartition(partitions(rows), *KEY).sortWithinPartitions(*KEY, "first")
    return together.select(*KEY, "ids").mapInArrow(digests, "depth long, v1 long, v2 long, ends_sha256 string")


def labelled(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, two hashes of (role, text) and the text's code points."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("l1"), F.xxhash64(F.lit(1), text, role).alias("l2"), F.length(text).cast("long").alias("points"))
    return rows.filter("conv_id IS NOT NULL")


def summary(rows: DataFrame) -> DataFrame:
    """The nodes of the trie over rebuilt() rows: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialize(rows)
    nodes = materialize(counted(rows))
    shared = nodes.filter("n_convs > 1")
    n_shared = shared.count()
    # Of a node the parent, if that is shared: else the node and it are of one conversation.
    above = shared.select((F.col("depth") + 1).alias("depth"), F.col("v1").alias("u1"), F.col("v2").alias("u2"), F.col("conv_id").alias("above"))
    parented = nodes.join(small(above, n_shared), ["depth", "u1", "u2"], "left")
    kids = parented.filter("above IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("v1"), F.col("u2").alias("v2")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("n_single"))
    shared = materialize(shared.join(kids, KEY, "left").fillna(0, ["n_children", "n_single"]))
    sums = shared.select(*KEY, "n_children").join(subtree_sums(shared, rows), KEY)
    out = parented.join(small(sums, n_shared), KEY, "left").join(end_digests(rows, nodes), KEY, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    digest = F.when(F.col("n_ends") == 0, F.lit(hashlib.sha256(b"").hexdigest())).when(F.col("n_ends") == 1, F.sha2(F.col("end_id").cast("string").cast("binary"), 256)).otherwise(F.col("ends_sha256"))
    alone = {"n_children": F.lit(1) - F.col("n_ends"), "n_leaves": F.lit(1), "saved_tokens": F.lit(0)}
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", *[F.when(F.col("n_convs") == 1, v).otherwise(F.col(c)).cast("long").alias(c) for c, v in alone.items()], digest.alias("ends_sha256"))


def op12(conversations: DataFrame) -> DataFrame:
    placed = numbered(labelled(conversations))
    c = F.col("conv_id")
    return summary(rebuilt(placed, c - c % 100, F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)))


#: Prefixes are whole sequences of labels here; a node's subtree are the nodes whose smallest member passes it.
OP12_SQL = """
WITH own AS (
  SELECT conv_id, list({'k': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'n': length(coalesce(text, ''))} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
dealt AS (
  SELECT conv_id, t, xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT)) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT a.conv_id AS c, list_concat(list_slice(coalesce(b.t, []), 1, h), list_slice(a.t, h + 1, len(a.t))) AS t
  FROM dealt a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (
  SELECT c, d, len(t) = d AS is_end, CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS size,
         array_to_string(list_transform(list_slice(t, 1, d), lambda x: x.k), '') AS name,
         CASE WHEN d > 0 THEN array_to_string(list_transform(list_slice(t, 1, d - 1), lambda x: x.k), '') END AS up
  FROM (SELECT c, t, unnest(range(len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT name, any_value(d) AS d, any_value(up) AS up, any_value(size) AS size, min(c) AS c, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends
  FROM prefixes GROUP BY name),
kids AS (SELECT up AS name, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
sums AS (
  SELECT p.name, sum((y.n - 1) * y.size) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM nodes y JOIN prefixes p ON p.c = y.c AND p.d <= y.d LEFT JOIN kids k ON k.name = y.name GROUP BY p.name)
SELECT x.c AS conv_id, x.d AS depth, u.c AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN sums s USING (name) LEFT JOIN kids k USING (name) LEFT JOIN nodes u ON u.name = x.up
"""
