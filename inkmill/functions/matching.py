"""The longest common runs of two sequences, taken first the longest, then the longest to its left and right, and so on.

Of equally long runs the first of the first sequence counts, then the first of the second. Runs are found by equal pieces of 64, 16, 4 and 1
items, the longest that are there, which are numbered once for the whole pair: pieces on one diagonal that follow each other
make a run. So a range costs little more than a sort of it. Where pieces repeat so much that pairs of them are too
many, a suffix automaton of the second sequence finds the run in linear time. Sequences of one length are first held against each other
in place: where no longer piece of one lies elsewhere in the other, what is equal in place is taken at once.
"""

from __future__ import annotations

import numpy as np

PIECES = (64, 16, 4, 1)
PAIRS = 16  #: pairs of equal pieces for each item; with more the automaton is used


def pieces(items: np.ndarray) -> dict[int, np.ndarray]:
    """For each size the numbers of the pieces that start at each item; equal pieces have equal numbers."""
    out, size, number = {1: items}, 1, items
    while size < min(PIECES[0], len(items)):
        pairs = number[: len(number) - size] * (int(number.max()) + 1) + number[size:] if len(number) > size else np.zeros(0, np.int64)
        number, size = np.unique(pairs, return_inverse=True)[1] if len(pairs) else pairs, 2 * size
        if size in PIECES:
            out[size] = number
    return out


def by_automaton(x: list, y: list) -> tuple[int, int, int]:
    """The first longest common run (i, j, size) of x and y, by the suffix automaton of y."""
    following, link, length, first_end, last = [{}], [-1], [0], [-1], 0
    for end, item in enumerate(y):
        new = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        first_end.append(end)
        p, last = last, new
        while p >= 0 and item not in following[p]:
            following[p][item] = new
            p = link[p]
        if p >= 0:
            q = following[p][item]
            if length[q] > length[p] + 1:  # the shorter ones end in more places: they get a state of their own
                split = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first_end.append(first_end[q])
                link[q] = split
                while p >= 0 and following[p].get(item) == q:
                    following[p][item] = split
                    p = link[p]
                q = split
            link[new] = q
    best, state, size = (0, 0, 0), 0, 0
    for i, item in enumerate(x):
        while state and item not in following[state]:
            state = link[state]
            size = length[state]
        if item in following[state]:
            state, size = following[state][item], size + 1
        if size > best[2]:
            best = (i - size + 1, first_end[state] - size + 1, size)
    return best


def by_table(x: list, y: list) -> tuple[int, int, int]:
    """The same for short sequences, by the lengths of runs that end at each pair."""
    best, above = (0, 0, 0), {}
    for i, item in enumerate(x):
        here = {}
        for j, other in enumerate(y):
            if item == other:
                size = here[j] = above.get(j - 1, 0) + 1
                if size > best[2]:
                    best = (i - size + 1, j - size + 1, size)
        above = here
    return best


def longest(numbers: dict[int, np.ndarray], offset: int, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    """The first longest run of the ranges a0:a1 and b0:b1 (i, j, size); the second sequence lies behind `offset` items."""
    if (a1 - a0) * (b1 - b0) <= 200:
        i, j, size = by_table(numbers[1][a0:a1].tolist(), numbers[1][offset + b0 : offset + b1].tolist())
        return a0 + i, b0 + j, size
    for piece in PIECES:
        if piece > min(a1 - a0, b1 - b0) or piece not in numbers:
            continue
        x, y = numbers[piece][a0 : a1 - piece + 1], numbers[piece][offset + b0 : offset + b1 - piece + 1]
        order = np.argsort(y, kind="stable")
        low, high = np.searchsorted(y[order], x), np.searchsorted(y[order], x, "right")
        n = high - low
        total = int(n.sum())
        if not total:
            continue
        if total > PAIRS * (len(x) + len(y)):
            i, j, size = by_automaton(numbers[1][a0:a1].tolist(), numbers[1][offset + b0 : offset + b1].tolist())
            return a0 + i, b0 + j, size
        i = np.repeat(np.arange(len(x)), n)
        j = order[np.arange(total) + np.repeat(low - (np.cumsum(n) - n), n)]
        along = np.lexsort((i, i - j))
        i, j = i[along], j[along]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
        sizes = np.diff(np.append(starts, total))
        top = starts[sizes == sizes.max()]
        at = top[np.lexsort((j[top], i[top]))[0]]
        return a0 + int(i[at]), b0 + int(j[at]), int(sizes.max()) + piece - 1
    return a0, b0, 0


def marks(items: np.ndarray, size: int) -> np.ndarray:
    """A number for the piece of this size (a power of two) that starts at each item; equal pieces have equal ones, others hardly ever."""
    n = min(size, 8) if items.itemsize == 1 else 1
    if n > 1:  # bytes that follow each other are a number as they lie
        number = np.ndarray((len(items) - n + 1,), f"<u{n}", items, strides=(1,)).astype(np.uint64)
    else:
        number = items.astype(np.uint64)
    number *= np.uint64(0x9E3779B97F4A7C15)
    number ^= number >> np.uint64(29)
    while n < size:
        number = number[: len(number) - n] * np.uint64(0xD6E8FEB86659FD93 + 2 * n) + number[n:]
        n *= 2
    return number


def in_place(x: np.ndarray, y: np.ndarray, size: int) -> bool:
    """Whether pieces of this size that x and y share lie in the same place of both, and nowhere else in y.

    Pieces with one number count as equal, so that a chance meeting of numbers can only deny it.
    """
    number, n = marks(np.concatenate([x, y]), size), len(x)
    here, there = number[: n - size + 1], number[n:]
    order = np.sort(there)
    if (order[1:] == order[:-1]).any():
        return False
    moved = here[here != there]
    at = order.searchsorted(moved)
    return not (order.take(at, mode="clip") == moved).any()


def kept(x: np.ndarray, y: np.ndarray, same: np.ndarray) -> list[tuple[int, int]] | None:
    """Runs (from, to) in the same place of two sequences of one length that are all taken; None where no size of pieces tells.

    If all common pieces of a size lie in place, so do all common runs of that size or more: each of them is the longest of some
    range at its turn.
    """
    ended = np.zeros(len(same) + 2, dtype=bool)
    ended[1:-1] = same
    edges = np.flatnonzero(ended[1:] != ended[:-1]).reshape(-1, 2)
    sizes = edges[:, 1] - edges[:, 0]
    most = int(sizes.max(initial=0))
    for size in (16, 64) if most >= 16 else (8, 4) if most >= 8 else (4,):
        if size <= most and in_place(x, y, size):
            return edges[sizes >= size].tolist()
    return None


def ranged(items: np.ndarray, offset: int) -> list[tuple[int, int, int]]:
    """Common runs of items[:offset - 1] and items[offset:], by the longest of each range."""
    numbers = pieces(items)
    found, open_ = [], [(0, offset - 1, 0, len(items) - offset)]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 < a1 and b0 < b1:
            i, j, size = longest(numbers, offset, a0, a1, b0, b1)
            if size:
                found.append((i, j, size))
                open_ += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
    return found


def short(x: list, y: list) -> list[tuple[int, int, int]]:
    """The same for short sequences."""
    found, open_ = [], [(0, len(x), 0, len(y))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        i, j, size = by_table(x[a0:a1], y[b0:b1])
        if size:
            i, j = a0 + i, b0 + j
            found.append((i, j, size))
            open_ += [r for r in ((a0, i, b0, j), (i + size, a1, j + size, b1)) if r[0] < r[1] and r[2] < r[3]]
    return found


def alike(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """The same for two sequences of one length, most of which is in place: gaps between what is kept are done in turn."""
    same, found, open_ = x == y, [], [(0, len(x))]
    while open_:
        a, z = open_.pop()
        if z - a == 1:
            found += [(a, a, 1)] if same[a] else []
            continue
        if (z - a) ** 2 <= 200:
            found += [(a + i, a + j, size) for i, j, size in short(x[a:z].tolist(), y[a:z].tolist())]
            continue
        runs_ = kept(x[a:z], y[a:z], same[a:z])
        if runs_ is None:
            found += [(a + i, a + j, size) for i, j, size in ranged(joined(x[a:z], y[a:z]), z - a + 1)]
            continue
        at = a
        for i, k in runs_:
            found.append((a + i, a + i, k - i))
            open_ += [(at, a + i)] if at < a + i else []
            at = a + k
        open_ += [(at, z)] if at < z else []
    return found


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both, parted by an item that neither holds."""
    return np.concatenate([x.astype(np.int64) + 1, [0], y.astype(np.int64) + 1])


def numbered(a: list | str, b: list | str) -> tuple[np.ndarray, np.ndarray]:
    """Items as numbers: characters by their codes, in bytes where these suffice."""
    if isinstance(a, str) and isinstance(b, str):
        try:
            return np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return tuple(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))
    names = {x: n for n, x in enumerate(dict.fromkeys([*a, *b]))}
    return tuple(np.fromiter(map(names.__getitem__, s), dtype=np.uint8 if len(names) < 256 else np.int64, count=len(s)) for s in (a, b))


def runs(a: list | str, b: list | str) -> list[tuple[int, int, int]]:
    """Common runs (i, j, size) in order; runs that touch on both sides are one. A string stands for its characters."""
    if type(a) is type(b) and a == b:
        return [(0, 0, len(a))] if a else []
    if set(a).isdisjoint(b):
        return []
    x, y = numbered(a, b)
    found = alike(x, y) if len(x) == len(y) else ranged(joined(x, y), len(x) + 1)
    out: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((i, j, size))
    return out


def steps(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """What makes b of a: (equal, replace, delete or insert, from and to in a, from and to in b)."""
    out, i, j = [], 0, 0
    for x, y, size in [*runs(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if size:
            out.append(("equal", x, x + size, y, y + size))
        i, j = x + size, y + size
    return out
