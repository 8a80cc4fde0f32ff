"""Matching blocks of word sequences, the ones of difflib without junk, for many pairs at once.

difflib takes the longest common run of a window (of equal ones the first in a, then in b) and goes on left and right of it.
Windows don't touch each other, so the same blocks come from taking runs by falling length, where a run that a block has cut
goes back with what is left of it. Runs are looked for by length: first those of GRAMS[0] words or more, then, in the gaps
that are left, shorter ones. So common words are only paired inside small gaps.
"""

from __future__ import annotations

import difflib
import heapq
import itertools
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np

#: Least lengths of the runs that are looked for, each a power of two and less than the one before.
GRAMS = (32, 8, 2, 1)
#: Pairs of places held at once (some 60 bytes each); a gap with more of them is split at its longest run.
PAIRS = 1_000_000
#: Words of both sides that are matched in one go, unless a single pair has more.
GROUP = 60_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

Gaps = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _single(words: np.ndarray) -> np.ndarray:
    return _mixed((words.astype(np.uint64) + np.uint64(1)) * _SPREAD)


def _joined(g: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of runs that are made of two shorter ones, the second starting `gap` words later."""
    return _mixed(g[: len(g) - gap] * _SPREAD + g[gap:])


def _grams(words: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all runs of each length in GRAMS."""
    g, n, out = _single(words), 1, {}
    while True:
        out[n] = g
        if n == GRAMS[0]:
            return {n: out[n] for n in GRAMS}
        g, n = _joined(g, min(n, len(g))), n * 2


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The first longest common run, by trying lengths: each takes n log n steps and pairs nothing."""
    doubled = [{1: _single(a)}, {1: _single(b)}]

    def runs(n: int) -> list[np.ndarray]:
        p = 1 << (n.bit_length() - 1)
        for d in doubled:
            while p not in d:
                q = max(d)
                d[2 * q] = _joined(d[q], q)
        return [_joined(d[p], n - p) for d in doubled]

    low, high, step = 0, min(len(a), len(b)), 1
    while low < high:
        n = min(low + step, high)
        if np.isin(*runs(n)).any():
            low, step = n, step * 2
        else:
            high, step = n - 1, max(1, (n - low) // 4)
    if not low:
        return 0, 0, 0
    x, y = runs(low)
    i = int(np.isin(x, y).argmax())
    return i, int((y == x[i]).argmax()), low


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers for each element, in a row."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _best(gap: tuple[int, ...], runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Blocks of one gap: its runs (-length, i, j) by falling length; what a block has cut goes back if it is still long enough."""
    a0, b0, a1, b1 = [gap[0]], [gap[2]], [gap[1]], [gap[3]]  # free ranges, in order
    heapq.heapify(runs)
    while runs:
        n, i, j = heapq.heappop(runs)
        n = -n
        k = bisect_right(a0, i) - 1
        if i + n <= a1[k] and b0[k] <= j and j + n <= b1[k]:
            a0.insert(k + 1, i + n)
            b0.insert(k + 1, j + n)
            a1.insert(k, i)
            b1.insert(k, j)
            continue
        while k < len(a0) and a0[k] < i + n:
            low, high = max(0, a0[k] - i, b0[k] - j), min(n, a1[k] - i, b1[k] - j)
            if high - low >= least:
                heapq.heappush(runs, (low - high, i + low, j + low))
            k += 1
    return [(i, j, end - i) for i, j, end in zip(a1, b1, a0[1:])]


def _runs(a: np.ndarray, b: np.ndarray, gap: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """gap, i, j, length of the longest runs that pairs of equal grams make."""
    code = (i - j + len(b)) * (len(a) + 1) + i
    order = np.argsort(code, kind="stable")
    code, gap, i, j = code[order], gap[order], i[order], j[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1] + 1) | (gap[1:] != gap[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(code))) + least - 1
    gap, i, j = gap[first], i[first], j[first]
    if not np.array_equal(a[_ranges(i, n)], b[_ranges(j, n)]):
        raise ArithmeticError("two runs of words share a hash")
    order = np.lexsort((j, i, gap))
    return gap[order], i[order], j[order], n[order]


def _blocks_of(a: np.ndarray, b: np.ndarray, gaps: Gaps, gap: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Blocks from runs in order of gap and place: runs that follow each other on both sides all stay, other gaps go one by one."""
    crossed = (gap[1:] == gap[:-1]) & ((i[1:] < i[:-1] + n[:-1]) | (j[1:] < j[:-1] + n[:-1]))
    mixed = np.zeros(len(gaps[0]), bool)
    mixed[gap[1:][crossed]] = True
    plain = ~mixed[gap]
    out = [np.stack([i[plain], j[plain], n[plain]], 1)]
    if crossed.any():
        gap, i, j, n = (x[~plain] for x in (gap, i, j, n))
        cuts = np.flatnonzero(np.diff(gap)) + 1
        runs = list(zip((-n).tolist(), i.tolist(), j.tolist()))
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(runs)]):
            out.append(np.array(_best(tuple(int(x[gap[s]]) for x in gaps), runs[s:e], least)))
    return np.concatenate(out)


def _step(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, gaps: Gaps, least: int) -> Iterator[np.ndarray]:
    """Blocks of `least` words or more in the gaps (a from, to, b from, to)."""
    while True:
        wide = np.minimum(gaps[1] - gaps[0], gaps[3] - gaps[2]) >= least
        gaps = tuple(x[wide] for x in gaps)
        if not wide.any():
            return
        na, nb = gaps[1] - gaps[0] - least + 1, gaps[3] - gaps[2] - least + 1
        number = np.arange(len(na))
        at_a, at_b, in_a = _ranges(gaps[0], na), _ranges(gaps[2], nb), np.repeat(number, na)
        salt = _mixed(~_single(number))  # not the hash of a word's number
        keys, found = gb[at_b] ^ np.repeat(salt, nb), ga[at_a] ^ salt[in_a]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        low = np.searchsorted(keys, found)
        hit = keys[np.minimum(low, len(keys) - 1)] == found
        at_a, in_a, low, found = at_a[hit], in_a[hit], low[hit], found[hit]
        n = np.searchsorted(keys, found, "right") - low
        total = np.bincount(in_a, n, len(na)).astype(np.int64)
        large = np.flatnonzero(total > PAIRS)
        todo = np.where(total > PAIRS, 0, total)
        part = (np.cumsum(todo) - 1) // PAIRS
        for p in np.unique(part[todo > 0]):
            use = (part[in_a] == p) & (todo[in_a] > 0)
            j = at_b[order[_ranges(low[use], n[use])]]
            i, gap = np.repeat(at_a[use], n[use]), np.repeat(in_a[use], n[use])
            yield _blocks_of(a, b, gaps, *_runs(a, b, gap, i, j, least), least)
        if not len(large):
            return
        cut = np.array([_longest(a[gaps[0][k] : gaps[1][k]], b[gaps[2][k] : gaps[3][k]]) for k in large])
        cut[:, 0] += gaps[0][large]
        cut[:, 1] += gaps[2][large]
        if any(not np.array_equal(a[i : i + n], b[j : j + n]) for i, j, n in cut):
            raise ArithmeticError("two runs of words share a hash")
        yield cut
        gaps = _left(tuple(x[large] for x in gaps), cut)


def _left(gaps: Gaps, blocks: np.ndarray) -> Gaps:
    """What the blocks leave of the gaps, in order."""
    i, j, n = blocks.T
    sides = ((gaps[0], i + n), (i, gaps[1]), (gaps[2], j + n), (j, gaps[3]))
    return tuple(np.sort(np.concatenate(s)) for s in sides)


def _matched(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
    ends = [np.cumsum([len(x) for x in side]) for side in zip(*pairs, strict=True)]
    starts = [e - [len(x) for x in side] for e, side in zip(ends, zip(*pairs, strict=True), strict=True)]
    gaps = (starts[0], ends[0], starts[1], ends[1])
    ga, gb = _grams(a), _grams(b)
    found = [np.empty((0, 3), np.int64)]
    for least in GRAMS:
        new = list(_step(a, b, ga[least], gb[least], gaps, least))
        if new:
            found += new
            gaps = _left(gaps, np.concatenate(new))
    blocks = np.concatenate(found)
    blocks = blocks[np.argsort(blocks[:, 0])]
    cuts = np.searchsorted(blocks[:, 0], ends[0])
    return [blocks[s:e] - [p, q, 0] for s, e, p, q in zip([0, *cuts[:-1]], cuts, *starts, strict=True)]


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    blocks = difflib.SequenceMatcher(a=a.tolist(), b=b.tolist(), autojunk=False).get_matching_blocks()
    return np.array(blocks[:-1], np.int64).reshape(-1, 3)


def matching_blocks(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """For each pair of arrays of word numbers its blocks (place in a, place in b, length), in order; adjacent ones may come apart."""
    group: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pair in itertools.chain(pairs, [None]):
        if group and (pair is None or size >= GROUP):
            try:
                yield from _matched(group)
            except ArithmeticError:  # 64 bits collide: not expected, but then word by word
                yield from (_plain(*p) for p in group)
            group, size = [], 0
        if pair is not None:
            group.append(pair)
            size += len(pair[0]) + len(pair[1])


def changes(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair what lies between its blocks: from and to in a, from and to in b; at least one of both is not empty."""
    sizes: deque[tuple[int, int]] = deque()

    def seen() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in pairs:
            sizes.append((len(a), len(b)))
            yield a, b

    for blocks in matching_blocks(seen()):
        i, j, n = blocks.T
        x, y = sizes.popleft()
        gaps = np.append(0, i + n), np.append(i, x), np.append(0, j + n), np.append(j, y)
        filled = (gaps[1] > gaps[0]) | (gaps[3] > gaps[2])
        yield tuple(g[filled] for g in gaps)
