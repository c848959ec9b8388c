"""Token ids of whole texts with the tokenizers library, and a bit-packed file format for them.

Encoder gives the ids that the library gives for the whole text. A byte-level tokenizer encodes each
pre-token by itself, so the encoder keeps the ids of pre-tokens that it has seen in a bounded memory,
which a worker process keeps from task to task, and asks the library's model for new ones only. It does
so for texts of characters whose classes are beyond doubt (Latin blocks) that hold no string of an added
token, such as <|endoftext|>; every other text goes to the library as it is, whose defaults are kept.

The file format. A table of blocks in Parquet, in ascending order of documents; a block holds whole
documents. Each id takes the fewest bits that the vocabulary needs; an id's place in its block is its
number times that width, so a block is unpacked by numpy at once and any id can be read by itself. Of
each block the table holds: part and part_start (its place: the part's start plus this many ids),
n_tokens, bits, doc_ids and doc_sizes, payload. Blocks end after `block_tokens` ids, at a document's end.

Defined results: a null text counts as empty, an empty document is its end id alone; a null doc_id
sorts first; rows that repeat a doc_id sort by text and each count; an empty table makes an empty
file; other columns are ignored; a long text makes a long block, never two.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.common import partitions, shared_dir

VOCABULARY = "byte_bpe_50k.json"
BLOCK_TOKENS = 1 << 16
MEMORY = 1_000_000  #: pre-tokens that an encoder remembers
#: Characters whose classes differ between Python's expressions and the tokenizer's pattern, or may.
DOUBTFUL = re.compile("[\x1c-\x1f\x85²³¹¼½¾]|[^\x00-ɏ]")
#: The published pattern of byte-level tokenizers, for texts without doubtful characters.
PRE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level tokenizers write bytes: printable ones as they are, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """Ids of words; asks for those that it does not hold."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.ask(word)
        return found


class Encoder:
    """Encodes many texts to arrays of ids."""

    def __init__(self, path: str, memory: int = MEMORY):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = made["pre_tokenizer"] or {}
        self.by_word = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not made["normalizer"]
        # Strings that the library takes out of a text before it looks for words.
        self.added = re.compile("|".join(re.escape(x["content"]) for x in made["added_tokens"]) or "(?!)")
        self.size = self.tokenizer.get_vocab_size()
        self.code, self.letters = "H" if self.size <= 1 << 16 else "I", byte_letters()
        self.memory, self.known = memory, Known(self._word)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[bytes] = []
        for i in range(0, len(texts), 256):
            part = [t or "" for t in texts[i : i + 256]]
            out += self._slice(part) if self.by_word else self._whole(part)
        return [np.frombuffer(x, dtype=self.code) for x in out]

    def _slice(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if DOUBTFUL.search(t) or self.added.search(t)]
        whole = [texts[i] for i in odd]
        for i in odd:
            texts[i] = ""
        if len(self.known) > self.memory:
            self.known.clear()
        ask = self.known.__getitem__
        ids = [b"".join(map(ask, PRE_TOKEN.findall(t))) for t in texts]
        for i, x in zip(odd, self._whole(whole)):
            ids[i] = x
        return ids


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The worker process's encoder."""
    return Encoder(path)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, least bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """n ids from number `first` on, as unsigned 32-bit integers; reads only the bytes that hold them."""
    a, b = first * bits, (first + n) * bits
    data = np.frombuffer(payload, dtype=np.uint8)[a // 8 : -(-b // 8)]
    if bits in (8, 16, 32):
        return data.view(f"<u{bits // 8}").astype("<u4")
    flags = np.unpackbits(data, bitorder="little")[a % 8 : a % 8 + n * bits].reshape(n, bits)
    return (flags.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs, ends each with end_id and writes the blocks to path in ascending order of documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer)
        bits = max(1, (max(encoder.size - 1, end_id)).bit_length())
        start, held, ids, size = 0, [], [], 0

        def block() -> pa.RecordBatch:
            values = [[part], [start], [size], [bits], [held], [[len(x) for x in ids]], [pack(np.concatenate(ids), bits)]]
            return pa.record_batch([pa.array(v, type=t) for v, t in zip(values, TYPES)], names=NAMES)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(names), 512):
                for name, x in zip(names[i : i + 512], encoder.encode(texts.slice(i, 512).to_pylist())):
                    held.append(name)
                    ids.append(np.append(x.astype("<u4"), np.uint32(end_id)))
                    size += len(x) + 1
                    if size >= block_tokens:
                        yield block()
                        start, held, ids, size = start + size, [], [], 0
        if held:
            yield block()

    rows.mapInArrow(task, SCHEMA).write.option("compression", "zstd").parquet(path)


NAMES = ["part", "part_start", "n_tokens", "bits", "doc_ids", "doc_sizes", "payload"]
TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
SCHEMA = "part int, part_start long, n_tokens long, bits int, doc_ids array<long>, doc_sizes array<long>, payload binary"


def part_starts(blocks: DataFrame) -> dict[int, int]:
    """The ids before each part; one row a part comes to the driver."""
    total, starts = 0, {}
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part], total = total, total + n
    return starts


def read(spark: SparkSession, path: str) -> DataFrame:
    """The file's documents: doc_id, start, n_tokens, and ids as little-endian unsigned 32-bit integers."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    starts = part_starts(blocks)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids, at, out = unpack(b["payload"], b["bits"], b["n_tokens"]), 0, []
                first = starts[b["part"]] + b["part_start"]
                for n in b["doc_sizes"]:
                    out.append((first + at, n, ids[at : at + n].tobytes()))
                    at += n
                start, size, data = zip(*out)
                yield pa.record_batch([pa.array(b["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """ids number start to start + n - 1 of the whole file; reads only the blocks that hold them."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    starts = part_starts(blocks)
    near = [p for p, s in starts.items() if s < start + n]
    found = {}
    for p in near:
        here = blocks.filter((F.col("part") == p) & (F.col("part_start") < start + n - starts[p]) & (F.col("part_start") + F.col("n_tokens") > start - starts[p]))
        for b in here.select("part_start", "n_tokens", "bits", "payload").collect():
            first = starts[p] + b.part_start
            a, z = max(start, first), min(start + n, first + b.n_tokens)
            found[a] = unpack(bytes(b.payload), b.bits, z - a, a - first)
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(0, dtype="<u4")


def op2(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    path = shared_dir(docs.sparkSession)
    write(docs, path, tokenizer or vocabulary_path())
    # Spark's crc32 is unsigned and ids hold the bytes that it is asked of.
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
