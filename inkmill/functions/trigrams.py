"""Posting lists of the trigrams of many texts, by numpy over Arrow batches, without a Python object for each trigram.

Texts come from retrieval.spaced(), where the trigrams of a text are the windows of three letters that do not end in two blanks. A block is as
many texts as fit TEXTS and LETTERS, one at least, so memory is bounded by these and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXTS = 1 << 15  #: of a block, so that places are short numbers
LETTERS = 4_000_000  #: of a block, in bytes
LETTER_BITS = 14  #: of a letter's number; where a block has more kinds of letters, its trigrams are numbered instead
PLACE_BITS = 15


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """The rows of all batches in tables of TEXTS rows and LETTERS bytes of text, or of one row."""
    held, n, letters = [], 0, 0
    for b in batches:
        ends, at = np.cumsum(pc.binary_length(b.column(b.schema.get_field_index(text))).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, before + LETTERS - letters, "right")), at + TEXTS - n)
            if to <= at and n:
                yield pa.Table.from_batches(held)
                held, n, letters = [], 0, 0
                continue
            to = max(to, at + 1)
            held.append(b.slice(at, to - at))
            n, letters, at = n + to - at, letters + int(ends[to - 1]) - before, to
    if n:
        yield pa.Table.from_batches(held)


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text starts, with the end."""
    held = texts.cast(pa.large_string())
    bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if len(data) and data.max() > 127:
        starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), starts
    return data, bounds


def size_classes(sizes: np.ndarray) -> np.ndarray:
    """Sizes from 2^(c / 2) on are of class c: the largest of a class is about 1.4 times its least."""
    return np.floor(2 * np.log2(sizes) + 1e-9).astype(np.int64)


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sizes, classes), one for each text with trigrams, by class; and (trigrams, classes, starts, places): a posting list for each trigram of a class.

    rows: which text; sizes: its number of trigrams. A place counts the texts of a class, in the order of rows.
    """
    letters, starts = letters_of(texts)
    kinds = np.flatnonzero(np.bincount(letters))
    width = max(1, int(len(kinds)).bit_length())
    number = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, np.int32 if 3 * width < 32 else np.int64)
    number[kinds] = np.arange(len(kinds))
    x, blank = number[letters], letters == 32
    code = (x[:-2] << 2 * width) | (x[1:-1] << width) | x[2:]
    names, bits = None, 3 * width
    if width > LETTER_BITS:
        names, code = np.unique(code, return_inverse=True)
        bits = int(len(names)).bit_length()
    # By trigram and then by text, once each; texts of a class keep their order below.
    key = code.astype(np.int64) << PLACE_BITS
    key |= np.repeat(np.arange(len(texts)), np.diff(starts))[2:]
    key = key[~(blank[1:-1] & blank[2:])]
    key.sort()
    key = key[firsts(key)]
    row, code = key & ((1 << PLACE_BITS) - 1), key >> PLACE_BITS
    sizes = np.bincount(row, minlength=len(texts))
    some = np.flatnonzero(sizes)
    classes = size_classes(sizes[some])
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    some, classes = some[order], classes[order]
    runs = firsts(classes)
    class_of, place_of = np.zeros(len(texts), np.uint8), np.zeros(len(texts), np.int16)
    class_of[some] = classes
    place_of[some] = np.arange(len(some)) - np.repeat(runs, np.diff(np.append(runs, len(some))))
    order = np.argsort(class_of[row], kind="stable")
    row, code = row[order], code[order]
    of, places = class_of[row], place_of[row]
    at = firsts(of.astype(np.int64) << bits | code)
    code, of = code[at], of[at]
    code = code if names is None else names[code]
    three = np.stack([kinds[code >> s * width & ((1 << width) - 1)] for s in (2, 1, 0)], axis=1) if len(code) else np.zeros((0, 3))
    whole = three.astype("<u4").tobytes().decode("utf-32-le")
    return some, sizes[some], classes, [whole[i : i + 3] for i in range(0, len(whole), 3)], of, np.append(at, len(places)), places


def rows_of(block: pa.Table, number: int, text: str) -> Iterator[pa.RecordBatch]:
    """class, trigram, block, places, texts: first for each class its texts under an empty trigram, then a row for each trigram of a class."""
    block = block.combine_chunks()
    some, sizes, classes, trigrams, of, starts, places = lists(pa.concat_arrays(block.column(text).chunks))
    if not len(some):
        return
    kept = block.drop_columns([text]).take(pa.array(some)).append_column("size", pa.array(sizes, pa.int32())).combine_chunks()
    held = pa.StructArray.from_arrays([pa.concat_arrays(c.chunks) for c in kept.columns], names=kept.column_names)
    runs = firsts(classes)
    texts = pa.ListArray.from_arrays(pa.array(np.append(runs, len(some)), pa.int32()), held)
    names = ["class", "trigram", "block", "places", "texts"]
    n = len(runs)
    yield pa.record_batch([pa.array(classes[runs], pa.int32()), pa.array([""] * n), pa.array(np.full(n, number)), pa.nulls(n, pa.list_(pa.int16())), texts], names=names)
    n = len(trigrams)
    yield pa.record_batch([pa.array(of, pa.int32()), pa.array(trigrams), pa.array(np.full(n, number)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(places)), pa.nulls(n, texts.type)], names=names)
