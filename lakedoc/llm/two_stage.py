"""Two-stage suffix sorting of many short byte strings, in numpy.

A suffix is of type B if it is smaller than the suffix after it, else of type A. Only
the type B suffixes are sorted directly. Then the buckets of equal first bytes are
scanned in ascending order: when a suffix is met whose predecessor in the text is of type
A, that predecessor goes to the next free place at the front of its own bucket. Each
bucket is handled as one array; only runs of one byte need a further round.
"""

from __future__ import annotations

import numpy as np


def suffix_order(
    text: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int
) -> np.ndarray:
    """Positions in suffix order, at least to ``depth`` bytes, of the asked ones and some more.

    ``text`` holds the strings as bytes plus 1 (uint16), each followed by a 0, and ``depth``
    more zeros at the end. Asked for are the positions ``first[i] .. last[i]`` inclusive;
    each string's positions after ``last`` are sorted only as far as induction needs them.
    """
    size = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    # equal neighbours have the type of the next unequal ones; ``at`` finds those
    at = np.where(step != 0, np.arange(size - 1), size - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(np.append(step, 0)[np.append(at, size - 1)] > 0, True)[:size]
    direct = smaller | (text == 0)  # type B, and the ends
    # the next directly sorted position at or after each position
    after = np.where(direct, np.arange(size), size - 1)
    after = np.minimum.accumulate(after[::-1])[::-1]
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, after[last] + 1, -1)
    needed = np.cumsum(edges[:-1]) > 0
    seeds = np.flatnonzero(needed & direct)
    seeds = seeds[_sorted_by_bytes(text, seeds, depth)]
    induced = needed & ~direct
    by_byte = np.searchsorted(text[seeds], np.arange(258))
    placed: list[list[np.ndarray]] = [[] for _ in range(258)]
    order = []
    for c in range(257):
        front = placed[c]
        wave = np.concatenate(front) if front else np.empty(0, np.int64)
        front = [wave]
        while len(wave):  # runs of c: predecessors within this bucket
            wave = wave[wave > 0] - 1
            wave = wave[induced[wave] & (text[wave] == c)]
            front.append(wave)
        bucket = np.concatenate([*front, seeds[by_byte[c] : by_byte[c + 1]]])
        if len(bucket) == 0:
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            head = text[before]
            stable = np.argsort(head, kind="stable")
            before, head = before[stable], head[stable]
            cuts = np.flatnonzero(np.diff(head)) + 1
            for part in np.split(before, cuts):
                placed[int(text[part[0]])].append(part)
        placed[c] = []
    return np.concatenate(order) if order else np.empty(0, np.int64)


def _sorted_by_bytes(text: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """Order of the positions by their next ``depth`` symbols.

    Sorts by a few symbols at a time; what is alone in its group is done.
    """
    n = len(positions)
    order = np.arange(n)
    if n < 2:
        return order
    nine = _nine(text)
    limit = len(text) - 1
    group = np.zeros(n, np.int64)  # by place: start of the group of equals
    open_ = np.arange(n)  # places whose group is not resolved
    for at in range(0, depth, 7):
        key = nine[np.minimum(positions[order[open_]] + at, limit)]
        own = np.lexsort((key, group[open_]))
        order[open_] = order[open_][own]
        key, groups = key[own], group[open_]
        new = np.append(True, (np.diff(key) != 0) | (np.diff(groups) != 0))
        starts = np.flatnonzero(new)
        group[open_] = open_[starts][np.cumsum(new) - 1]
        sizes = np.diff(np.append(starts, len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        if len(open_) == 0:
            break
    return order


def _nine(text: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits at each position, in one number."""
    n = len(text)
    wide = np.concatenate([text.astype(np.uint64), np.zeros(6, np.uint64)])
    packed = wide[:n].copy()
    for k in range(1, 7):
        packed <<= np.uint64(9)
        packed |= wide[k : n + k]
    return packed


def repeated_starts(
    bodies: list[bytes], counts: np.ndarray, length: int
) -> list[np.ndarray]:
    """For each body, which of its ``len - length + 1`` starts have a repeated string.

    Neighbours in suffix order whose common prefix reaches ``length`` are repeated.
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    text = np.zeros(int(sizes.sum()) + len(bodies) + length, np.uint16)
    first = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\0".join(bodies), np.uint8)
    text[: len(joined)] = joined
    text[: len(joined)] += 1
    text[first[1:] - 1] = 0
    last = first + counts - 1
    order = suffix_order(text, first, last, length)
    wanted = np.zeros(len(text) + 1, np.int32)
    wanted[first] += 1
    np.add.at(wanted, last + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    order = order[wanted[order]]
    marks = np.zeros(len(text), bool)
    left, right = order[:-1], order[1:]
    nine = _nine(text)
    for at in range(0, length - 6, 7):
        same = nine[left + at] == nine[right + at]
        left, right = left[same], right[same]
    rest = length - 7  # the last symbols, overlapping what is known to be equal
    same = nine[left + rest] == nine[right + rest]
    marks[left[same]] = True
    marks[right[same]] = True
    return [marks[a : a + n] for a, n in zip(first.tolist(), counts.tolist())]
