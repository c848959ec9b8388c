r"""An interpolated modified Kneser-Ney model of word n-grams (Chen and Goodman, 1999), counted in Spark, and scores by it.

Texts become blocks of word numbers once. For each order, from the highest down, a block sends its distinct n-grams with
their counts in training documents to shards by context; a shard adds them up to sorted arrays of n-gram hashes with
counts and of context hashes with sums (all, and words seen once, twice, more often after the context), writes
these to the model's table, and answers the blocks from them: the arrays lie in a file without a name that the worker maps
into memory, and n-grams are found by binary search. The distinct n-grams also tell each n-gram of the next lower order how
many words it follows, which is its count there. Contexts with a share of a shard's size of all tokens are dealt over all shards by
word, and their sums are added up after. Discounts come from the numbers of n-grams with counts one to four of
the whole corpus, so they are applied at last, where a block's answers meet its documents:
p = (c - D(c)) / sum + (D1 n1 + D2 n2 + D3 n3) / sum * p of the order below, down to 1 / (V + 1) for any word.

Nothing is pruned and no counts are capped. Ids of words, contexts and n-grams are hashes of 56 bits; so a word's counts are wrong with a
chance of V / 2^56. Each text is preceded by order - 1 start signs, which are context only, and closed by an end.

Defined results: null texts are empty; an empty text is its end alone; a null doc_id is a training document;
repeated documents each count and get their row; without training documents every probability is 1 / (V + 1) = 1; an
empty table gives no rows; other columns are ignored. Where numbers of counts allow no estimate, discounts are
0.5, 1 and 1.5.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import discard, materialize, release
from inkmill.llm.words import BLANK_SEPARATED, FACTOR, hashed, mix

ORDER = 2
BLOCK = 1_000_000  #: tokens of a block; its last text is not cut
SHARD = 3_000_000  #: tokens for each shard
START, END = np.uint64(1), np.uint64(2)
ID_BYTES = 7

BLOCKS = "block long, n_tokens long, doc_ids array<long>, held binary, sizes binary, vocabulary binary, words binary"


def packed(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids).view(np.uint8).reshape(-1, 8)[:, :ID_BYTES].tobytes()


def ids_of(data) -> np.ndarray:
    held = np.frombuffer(data, np.uint8).reshape(-1, ID_BYTES)
    out = np.zeros((len(held), 8), np.uint8)
    out[:, :ID_BYTES] = held
    return out.view(np.uint64).reshape(-1)


def squeezed(x: np.ndarray) -> bytes:
    """Small numbers: their bytes by place (all least bytes first, and so on), compressed, behind their length."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def loosened(data: pa.Buffer, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8].to_pybytes(), "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def rising(ids: np.ndarray) -> bytes:
    """Ids in ascending order, by their differences."""
    return squeezed(np.diff(ids, prepend=np.uint64(0)))


def risen(data: pa.Buffer) -> np.ndarray:
    return np.cumsum(loosened(data, "<u8"), dtype=np.uint64)


def combined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(FACTOR) + word) >> np.uint64(8)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held") -> DataFrame:
    """Blocks of documents as numbers of words in the block's sorted vocabulary of ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            names, out, sizes, ids = pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            vocabulary, words = np.unique(ids, return_inverse=True)
            # The most frequent words get numbers of one byte, the next of two; each class is in ascending order.
            rank = np.empty(len(vocabulary), np.int64)
            rank[np.argsort(-np.bincount(words), kind="stable")] = np.arange(len(vocabulary))
            cuts = [*(c for c in (1 << 8, 1 << 16) if c < len(vocabulary)), len(vocabulary)]
            order = np.argsort(np.searchsorted(cuts, rank, "right"), kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            vocabulary, words = vocabulary[order], number[words]
            values = [squeezed(out.view(np.uint8)), squeezed(sizes.astype("<i4")), b"".join(len(x).to_bytes(8, "little") + x for x in map(rising, np.split(vocabulary, cuts[:-1]))), squeezed(words.astype("<i4"))]
            arrays = [pa.array([first]), pa.array([len(ids)]), pa.ListArray.from_arrays([0, len(names)], names), *(pa.array([v], pa.binary()) for v in values)]
            return pa.record_batch(arrays, names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                words, sizes = hashed(part.column(1), BLANK_SEPARATED)
                ends = np.cumsum(sizes + 1) - 1
                ids = np.full(len(words) + len(sizes), END)
                inner = np.ones(len(ids), dtype=bool)
                inner[ends] = False
                ids[inner] = words >> np.uint64(8)
                held.append((part.column(0), part.column(2).to_numpy(zero_copy_only=False).astype(bool), sizes + 1, ids))
                n += len(ids)
                if n >= BLOCK:
                    yield block()
                    first, held, n = first + 1, [], 0
        if held:
            yield block()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), held_col).mapInArrow(task, BLOCKS)


class Grams:
    """The distinct n-grams of a block, in order of their context's and their word's ids, and that of each token."""

    def __init__(self, row: dict, n: int):
        read = lambda name, kind: loosened(row[name].as_buffer(), kind)
        words, self.sizes = read("words", "<i4"), read("sizes", "<i4")
        held, parts = row["vocabulary"].as_buffer(), []
        while held.size:
            size = 8 + int.from_bytes(held[:8].to_pybytes(), "little")
            parts.append(risen(held[8:size]))
            held = held[size:]
        vocabulary = np.concatenate(parts)
        order = np.argsort(vocabulary)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(1, len(order) + 1)
        self.vocabulary = np.concatenate([[START], vocabulary[order]])  # the start sign has the least id
        words = number[words]
        first = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        at = np.arange(len(words))
        earlier = lambda k: np.where(at - k >= first, words[np.maximum(at - k, 0)], 0)  # noqa: E731  the word k before
        self.shorter = None  # contexts without their earliest word, where they have one
        if n == 1:
            self.contexts, context = np.zeros(1, np.uint64), np.zeros(len(words), np.int64)
        elif n == 2:
            context = earlier(1)
            seen = np.bincount(context, minlength=len(self.vocabulary)) > 0
            self.contexts, context = self.vocabulary[seen], (np.cumsum(seen) - 1)[context]
        else:
            before = [None, self.vocabulary[earlier(1)]]
            for k in range(2, n):
                before.append(combined(before[-1], self.vocabulary[earlier(k)]))
            self.contexts, seen, context = np.unique(before[n - 1], return_index=True, return_inverse=True)
            self.shorter = before[n - 2][seen]
        key, self.of_token = np.unique(context << 32 | words, return_inverse=True)
        self.context, self.word = key >> 32, self.vocabulary[key & 0xFFFFFFFF]
        self.train = np.repeat(read("held", np.uint8) == 0, self.sizes)

    def by_shard(self, n_shards: int, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, n-grams, where contexts begin among these)."""
        ids = np.where(np.isin(self.contexts, hot)[self.context], self.word, self.contexts[self.context])
        shard = shard_of(ids, n_shards)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) > 0, [True]]))
        for a, b in zip(edges, edges[1:]):
            chosen = order[a:b]
            yield int(shard[chosen[0]]), chosen, np.flatnonzero(np.concatenate([[True], np.diff(self.context[chosen]) > 0]))


def shard_of(ids: np.ndarray, n_shards: int) -> np.ndarray:
    return ((ids >> np.uint64(24)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def hot_contexts(blocks: DataFrame, n: int, n_shards: int) -> np.ndarray:
    """Contexts of an n_shards-th of all tokens at least: n_shards of them at most. A block names those with half of that share of it."""
    if n == 1 or n_shards == 1:
        return np.zeros(1, np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                g = Grams(row, n)
                size = np.bincount(g.context[g.of_token])
                often = np.flatnonzero(size * 2 * n_shards >= len(g.of_token))
                yield pa.record_batch([pa.array(g.contexts[often].view(np.int64)), pa.array(size[often])], names=["context", "n"])

    total = blocks.agg(F.sum("n_tokens")).first()[0]
    found = blocks.mapInArrow(task, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).filter(F.col("n") * 2 * n_shards >= total)
    return np.sort(np.array([r.context for r in found.collect()], dtype=np.int64).view(np.uint64))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i] for name in batch.schema.names}


#: ask: n-grams of a block. left: n-grams that follow so many words. model: see the module. answer: to an ask.
SHARDED = "kind string, part int, shard int, block long, contexts binary, runs binary, shorter binary, words binary, counts binary, raw binary, sums binary, hot array<long>, stats array<long>"
COLUMNS = [x.split()[0] for x in SHARDED.split(", ")]
TYPES = {"kind": pa.string(), "part": pa.int32(), "shard": pa.int32(), "block": pa.int64(), "hot": pa.list_(pa.int64()), "stats": pa.list_(pa.int64())}


def row_batch(**values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([values.get(c)], TYPES.get(c, pa.binary())) for c in COLUMNS], names=COLUMNS)


def asks(blocks: DataFrame, n: int, n_shards: int, hot: np.ndarray) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                g = Grams(row, n)
                counts = np.bincount(g.of_token[g.train], minlength=len(g.word)).astype("<i4")
                for shard, chosen, starts in g.by_shard(n_shards, hot):
                    heads = g.context[chosen[starts]]
                    shorter = packed(g.shorter[heads]) if n > 2 else None
                    yield row_batch(kind="ask", shard=shard, block=row["block"].as_py(), contexts=rising(g.contexts[heads]), runs=squeezed(np.diff(np.append(starts, len(chosen))).astype("<i4")), shorter=shorter, words=packed(g.word[chosen]), counts=squeezed(counts[chosen]))

    return blocks.mapInArrow(task, SHARDED)


def mapped(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays in a file without a name, mapped into memory: the system may drop their pages and read them again."""
    out, at = {}, 0
    with tempfile.TemporaryFile() as f:
        for x in arrays.values():
            f.write(x.tobytes())
        f.flush()
        for name, x in arrays.items():
            out[name] = np.memmap(f, dtype=x.dtype, mode="r", offset=at, shape=x.shape) if x.size else x
            at += x.nbytes
    return out


def looked_up(sorted_ids: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values of ids, 0 for those that are not there."""
    if not len(sorted_ids):
        return np.zeros((len(ids), *values.shape[1:]), values.dtype)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    found = sorted_ids[at] == ids
    return values[at] * (found if values.ndim == 1 else found[:, None])


def classes(of: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each context the sum of counts, and how many are 1, 2 and more."""
    parts = [np.bincount(of, weights=counts, minlength=n)] + [np.bincount(of[t], minlength=n) for t in (counts == 1, counts == 2, counts > 2)]
    return np.stack(parts, axis=1).astype(np.int64)


def learned(rows: list[dict], n: int, adjusted: bool, hot: np.ndarray) -> tuple[dict[str, np.ndarray], dict | None, list[int], list[int]]:
    """A shard's arrays, what it tells the order below, sums of hot contexts, and [n1, n2, n3, n4, distinct words, tokens]."""
    parts = [(np.repeat(risen(r["contexts"].as_buffer()), loosened(r["runs"].as_buffer(), "<i4")), ids_of(r["words"].as_buffer()), loosened(r["counts"].as_buffer(), "<i4"), r) for r in rows]
    seen = [x[2] > 0 for x in parts]
    context, word, count = (np.concatenate([x[i][s] for x, s in zip(parts, seen)] or [np.zeros(0, np.uint64)]) for i in (0, 1, 2))
    told = np.concatenate([np.full(s.sum(), x[3]["kind"].as_py() == "left") for x, s in zip(parts, seen)] or [np.zeros(0, bool)])
    grams, first, of = np.unique(combined(context, word), return_index=True, return_inverse=True)
    of_asks = lambda kind: np.bincount(of[told == kind], weights=count[told == kind], minlength=len(grams)).astype(np.int64)
    raw = of_asks(False)
    counts = of_asks(True) if adjusted else raw
    contexts, inverse = np.unique(context[first], return_inverse=True)
    sums = classes(inverse, counts, len(contexts))
    left = None
    if n > 1:
        target = np.zeros(len(first), np.uint64)
        if n > 2:
            shorter = np.concatenate([np.repeat(ids_of(x[3]["shorter"].as_buffer()), loosened(x[3]["runs"].as_buffer(), "<i4"))[s] if x[3]["kind"].as_py() == "ask" else x[0][s] * np.uint64(0) for x, s in zip(parts, seen)])
            # A context is asked with its shorter form by every block that has it; rows told from above carry none.
            known, at = np.unique(context[~told], return_index=True)
            target = looked_up(known, context[first], shorter[~told][at])
        _, one, times = np.unique(combined(target, word[first]), return_index=True, return_counts=True)
        left = {"context": target[one], "word": word[first][one], "count": times}
    is_hot = np.isin(contexts, hot)
    partial = np.concatenate([contexts[is_hot].view(np.int64)[:, None], sums[is_hot]], axis=1).reshape(-1).tolist()
    stats = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((raw > 0).sum()), int(raw.sum())]
    return {"grams": grams, "counts": counts.astype("<i8"), "raw": raw.astype("<i8"), "contexts": contexts, "sums": sums.astype("<i8")}, left, partial, stats


def at_shards(rows: DataFrame, n: int, n_shards: int, adjusted: bool, hot: np.ndarray, hot_below: np.ndarray) -> DataFrame:
    """Model, left and answer rows of order n from its ask rows and either left rows from the order above or model rows."""

    def task(table: pa.Table) -> pa.Table:
        held, out = [r for b in table.to_batches() for r in rows_of(b)], []
        shard, kinds = held[0]["shard"].as_py(), [r["kind"].as_py() for r in held]
        models = [r for r, k in zip(held, kinds) if k == "model"]
        if models:  # a shard has one
            m, read = models[0], lambda name, kind: loosened(models[0][name].as_buffer(), kind)
            arrays = {"grams": risen(m["words"].as_buffer()), "counts": read("counts", "<i8"), "raw": read("raw", "<i8") if n == 1 else np.zeros(0), "contexts": risen(m["contexts"].as_buffer()), "sums": read("sums", "<i8").reshape(-1, 4)}
        else:
            arrays, left, partial, stats = learned(held, n, adjusted, hot)
            out.append(row_batch(kind="model", part=n, shard=shard, contexts=rising(arrays["contexts"]), words=rising(arrays["grams"]), counts=squeezed(arrays["counts"]), raw=squeezed(arrays["raw"]) if n == 1 else None, sums=squeezed(arrays["sums"].reshape(-1)), hot=partial, stats=stats))
            if left:
                to = shard_of(np.where(np.isin(left["context"], hot_below), left["word"], left["context"]), n_shards)
                order = np.lexsort((left["word"], left["context"], to))
                edges = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0, [True]])) if len(order) else []
                for a, b in zip(edges, edges[1:]):
                    x = order[a:b]
                    starts = np.flatnonzero(np.concatenate([[True], left["context"][x][1:] != left["context"][x][:-1]]))
                    out.append(row_batch(kind="left", part=n, shard=int(to[x[0]]), contexts=rising(left["context"][x[starts]]), runs=squeezed(np.diff(np.append(starts, len(x))).astype("<i4")), words=packed(left["word"][x]), counts=squeezed(left["count"][x].astype("<i4"))))
        arrays = mapped(arrays)
        for r, kind in zip(held, kinds):
            if kind == "ask":
                contexts, runs = risen(r["contexts"].as_buffer()), loosened(r["runs"].as_buffer(), "<i4")
                grams = combined(np.repeat(contexts, runs), ids_of(r["words"].as_buffer()))
                raw = squeezed(looked_up(arrays["grams"], grams, arrays["raw"])) if n == 1 else None
                out.append(row_batch(kind="answer", part=n, shard=shard, block=r["block"].as_py(), counts=squeezed(looked_up(arrays["grams"], grams, arrays["counts"])), raw=raw, sums=squeezed(looked_up(arrays["contexts"], contexts, arrays["sums"]).reshape(-1))))
        return pa.Table.from_batches(out, schema=out[0].schema)

    return rows.groupBy("shard").applyInArrow(task, SHARDED)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0), D(1), D(2) and D(3 or more) after Chen and Goodman."""
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        if all(0 < d[k] <= k for k in (1, 2, 3)):
            return d
    return np.array([0, 0.5, 1.0, 1.5])


class Model:
    """order, n_shards, hot contexts of each order, and a table of model rows, which score() reads; statistics come to the driver."""

    def __init__(self, order: int, n_shards: int, hot: dict[int, np.ndarray], rows: DataFrame):
        self.order, self.n_shards, self.hot, self.rows = order, n_shards, hot, rows
        self.discounts, self.hot_sums = {}, {n: (np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)) for n in hot}
        self.distinct = self.tokens = 0
        for r in rows.groupBy("part").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(6)]).collect():
            self.discounts[r.part] = discounts(*r[1:5])
            if r.part == 1:
                self.distinct, self.tokens = r.s4, r.s5
        cell = lambda k: F.get("hot", F.col("i") * 5 + k)
        partial = rows.filter(F.size("hot") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.expr("size(hot) div 5") - 1))).select("part", cell(0).alias("context"), *[cell(k).alias(f"s{k}") for k in (1, 2, 3, 4)])
        found = partial.groupBy("part", "context").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in (1, 2, 3, 4)]).orderBy("part", "context").collect()  # n_shards rows an order at most
        for n in hot:
            own = [r for r in found if r.part == n]
            if own:
                self.hot_sums[n] = (np.array([r.context for r in own], np.int64).view(np.uint64), np.array([r[2:] for r in own], np.int64))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(blocks: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    order, n_shards, hot, cuts, hot_sums, distinct, tokens = model.order, model.n_shards, model.hot, model.discounts, model.hot_sums, model.distinct, model.tokens

    def task(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(rows_of(block.to_batches()[0]))
        told = {(r["part"].as_py(), r["shard"].as_py()): r for b in answers.to_batches() for r in rows_of(b)}
        p = None
        for n in range(1, order + 1):
            g = Grams(row, n)
            counts, raw, sums = np.zeros(len(g.word), np.int64), np.zeros(len(g.word), np.int64), np.zeros((len(g.contexts), 4), np.int64)
            for shard, chosen, starts in g.by_shard(n_shards, hot[n]):
                r = told[n, shard]
                counts[chosen] = loosened(r["counts"].as_buffer(), "<i8")
                sums[g.context[chosen[starts]]] = loosened(r["sums"].as_buffer(), "<i8").reshape(-1, 4)
                if n == 1:
                    raw[chosen] = loosened(r["raw"].as_buffer(), "<i8")
            names, whole = hot_sums[n]
            is_hot = np.isin(g.contexts, names)
            sums[is_hot] = whole[np.searchsorted(names, g.contexts[is_hot])]
            d = cuts.get(n, np.zeros(4))
            total = np.maximum(sums[:, 0], 1)
            share = np.where(sums[:, 0] > 0, (sums[:, 1:] @ d[1:]) / total, 1.0)
            own = (counts - d[np.minimum(counts, 3)]) / total[g.context]
            if n == 1:
                base = (np.log10(raw + 1) - np.log10(tokens + distinct + 1))[g.of_token]
                known = (raw > 0)[g.of_token]
                p = np.full(len(g.of_token), 1 / (distinct + 1))
            p = own[g.of_token] + share[g.context][g.of_token] * p
        starts = np.cumsum(g.sizes) - g.sizes
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has an end
        arrays = [block.column("doc_ids").combine_chunks().flatten(), pa.array(loosened(row["held"].as_buffer(), np.uint8).astype(bool)), pa.array(g.sizes.astype(np.int64)), pa.array(add(known.astype(np.int64))), pa.array(np.full(len(starts), tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.table(arrays, names=[x.split()[0] for x in RESULT.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(task, RESULT)


def fit_and_score(docs: DataFrame, order: int = ORDER, **columns: str) -> tuple[DataFrame, Model]:
    """Learns from the documents that are not held (a boolean column) and scores all."""
    blocks = materialize(tokenised(docs, **columns))
    n_shards = max(1, -(-(blocks.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD))
    hot = {n: hot_contexts(blocks, n, n_shards) for n in range(1, order + 1)}
    tables = []
    for n in range(order, 0, -1):
        rows = asks(blocks, n, n_shards, hot[n])
        if tables:
            rows = rows.unionByName(tables[-1].filter("kind = 'left'"))
        tables.append(materialize(at_shards(rows, n, n_shards, n < order, hot[n], hot.get(n - 1)), by="kind"))
        release(docs.sparkSession)
        if n < order:
            discard(tables[-2], "kind=left")
    made = tables[0]
    for t in tables[1:]:
        made = made.unionByName(t)
    model = Model(order, n_shards, hot, made.filter("kind = 'model'"))
    return scored(blocks, made.filter("kind = 'answer'"), model), model


def score(docs: DataFrame, model: Model, **columns: str) -> DataFrame:
    """Scores documents by a model that fit_and_score() made; nothing is learned from them."""
    blocks = materialize(tokenised(docs.withColumn(columns.get("held_col", "held"), F.lit(True)), **columns))
    made = None
    for n in range(1, model.order + 1):
        rows = asks(blocks, n, model.n_shards, model.hot[n]).unionByName(model.rows.filter(F.col("part") == n))
        answers = at_shards(rows, n, model.n_shards, False, model.hot[n], model.hot.get(n - 1))
        made = answers if made is None else made.unionByName(answers)
    return scored(blocks, materialize(made.filter("kind = 'answer'")), model)


def op11(docs: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "text", (F.crc32(name.cast("binary")) % 7 == 2).alias("held"))
    return fit_and_score(rows)[0]
