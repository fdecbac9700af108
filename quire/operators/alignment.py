"""Alignment of two lists of words: rising anchors, common ends, and edit scripts in linear space."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa


def rising(row: Sequence[int]) -> list[bool]:
    """Which numbers are in the longest rising row (the one that ends lowest)."""
    if all(x < y for x, y in zip(row, row[1:], strict=False)):
        return [True] * len(row)
    lows: list[int] = []  # the lowest end of a rising row of each length, and which number it is
    ends: list[int] = []
    before: list[int] = []
    for i, x in enumerate(row):
        n = bisect_left(lows, x)
        before.append(ends[n - 1] if n else -1)
        lows[n : n + 1], ends[n : n + 1] = [x], [i]
    keep, i = [False] * len(row), ends[-1]
    while i >= 0:
        keep[i], i = True, before[i]
    return keep


def common_ends(x: Sequence[Hashable], y: Sequence[Hashable]) -> tuple[int, int]:
    """How many words two lists have in common at the front, and then at the back."""
    n = min(len(x), len(y))
    front = next((i for i in range(n) if x[i] != y[i]), n)
    left = n - front
    return front, next((i for i in range(left) if x[-1 - i] != y[-1 - i]), left)


def _lengths(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[int]:
    """The length of the longest common subsequence of a and of each prefix of b. A word of a costs a few operations on a
    whole number with a bit for each word of b."""
    where: dict[Hashable, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        match = row & where.get(x, 0)
        row = ((row + match) | (row - match)) & full
    out, found = [0], 0
    for bit in reversed(f"{row:0{len(b)}b}" if b else ""):
        found += bit == "0"
        out.append(found)
    return out


def matches(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in linear space: the first list is halved, and the second one where
    the lengths from the front and from the back add up to most (the first such place)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        front, back = common_ends(a[a0:a1], b[b0:b1])
        out += [(a0 + i, b0 + i) for i in range(front)] + [(a1 - 1 - i, b1 - 1 - i) for i in range(back)]
        a0, a1, b0, b1 = a0 + front, a1 - back, b0 + front, b1 - back
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            at = next((j for j in range(b0, b1) if b[j] == a[a0]), None)
            out += [] if at is None else [(a0, at)]
            continue
        middle = (a0 + a1) // 2
        fore, rear = _lengths(a[a0:middle], b[b0:b1]), _lengths(a[middle:a1][::-1], b[b0:b1][::-1])
        n = b1 - b0
        cut = b0 + max(range(n + 1), key=lambda j: (fore[j] + rear[n - j], -j))
        todo += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    return sorted(out)


def script(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[str, int, int, int, int]]:
    """(op, from_a, to_a, from_b, to_b) of what differs: replace, delete or insert between common words."""
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        i, j = x + 1, y + 1
    return out


def rising_lists(places: pa.Array) -> pa.Array:
    return pa.array([rising(row) for row in places.to_pylist()], pa.list_(pa.bool_()))


class Gaps(NamedTuple):
    """The gaps between anchors where two readings differ, in order of their documents and places: the document, where the gap
    starts in either reading and how many words of either it has; and these words, each gap's of the first reading, then
    each gap's of the second."""

    doc: np.ndarray
    start: tuple[np.ndarray, np.ndarray]
    size: tuple[np.ndarray, np.ndarray]
    code: tuple[np.ndarray, np.ndarray]


def _alone(gap: np.ndarray, second: np.ndarray, place: np.ndarray, code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows, the pairs of words that stand once in either reading of a gap, in order, as the longest row that rises in both."""
    if not len(rows):
        return rows, rows
    words, word = np.unique(gap[rows] * (int(code.max()) + 1) + code[rows], return_inverse=True)
    at, once = [], np.ones(len(words), dtype=bool)
    for mine in (~second[rows], second[rows]):
        once &= np.bincount(word[mine], minlength=len(words)) == 1
        at.append(np.zeros(len(words), np.int64))
        at[-1][word[mine]] = rows[mine]
    a, b = (x[once] for x in at)
    order = np.lexsort((place[a], gap[a]))
    a, b = a[order], b[order]
    row, to, keep = gap[a], place[b], np.ones(len(a), dtype=bool)
    for i in np.unique(row[1:][(row[1:] == row[:-1]) & (to[1:] <= to[:-1])]):
        here = slice(*np.searchsorted(row, (i, i + 1)))
        keep[here] = rising(to[here].tolist())
    return a[keep], b[keep]


def gaps(doc: np.ndarray, second: np.ndarray, pos: np.ndarray, code: np.ndarray, rounds: int = 1, small: int = 0) -> Gaps:
    """The gaps that differ of the words of whole documents, numbered from 0: which reading a word stands in, where, and its
    number, below 0 for none. Words unique in both readings of a document are anchors; then, in more rounds, those unique
    in both sides of a gap, if one of these has more than `small` words. All documents go through a round together."""
    order = np.lexsort((pos, second, doc))
    doc, second, pos, code = (x[order] for x in (doc, second, pos, code))
    place = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (second[1:] != second[:-1]) | (pos[1:] != pos[:-1])))[: len(doc)]
    gap, of = doc, np.arange(int(doc[-1]) + 1 if len(doc) else 0)
    start = [np.zeros(len(of), np.int64) for _ in "ab"]
    for n in range(rounds):
        sizes = [np.bincount(gap[second == side], minlength=len(of)) for side in (False, True)]
        wide = (np.minimum(*sizes) > 0) & ((n == 0) | (np.maximum(*sizes) > small))
        pair = _alone(gap, second, place, code, np.flatnonzero(wide[gap] & (code >= 0)))
        if not len(pair[0]):
            break
        cut, many = gap[pair[0]], np.arange(len(of))
        before, free = np.zeros(len(gap), np.int64), np.ones(len(gap), dtype=bool)
        old, new = many + np.searchsorted(cut, many), cut + 1 + np.arange(len(cut))
        for side, at in enumerate(pair):
            mine, marks = np.flatnonzero(second == bool(side)), place[at]
            before[mine] = np.searchsorted(marks, place[mine], "right")
            free[mine] = (before[mine] == 0) | (marks[before[mine] - 1] != place[mine])
            starts = np.zeros(len(of) + len(cut), np.int64)
            starts[old], starts[new] = start[side], pos[at] + 1
            start[side] = starts
        docs = np.zeros(len(of) + len(cut), np.int64)
        docs[old], docs[new] = of, of[cut]
        gap, of = (gap + before)[free], docs
        second, pos, code, place = (x[free] for x in (second, pos, code, place))
    order = np.argsort(gap * 2 + second, kind="stable")
    gap, second, code = gap[order], second[order], code[order]
    size = [np.bincount(gap[second == side], minlength=len(of)) for side in (False, True)]
    differs = size[0] != size[1]
    first = np.flatnonzero(~second & ~differs[gap])
    differs[gap[first[code[first] != code[first + size[0][gap[first]]]]]] = True
    found, kept = np.flatnonzero(differs), differs[gap]
    return Gaps(of[found], *((x[0][found], x[1][found]) for x in (start, size)), (code[kept & ~second], code[kept & second]))


def carried_breaks(doc: np.ndarray, own: np.ndarray, line: np.ndarray, pos: np.ndarray, tok: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of whole documents, numbered from 0 and those of each together, own ones (of the target) and others (of the
    source): the rows of own words where a line breaks, and whether the document's lines are reversed there. Words unique on
    both sides are aligned if they rise with the lines, or with the lines reversed if more do; documents that rise as they
    stand are found all at once."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    coded = tok.dictionary_encode()
    size, docs = len(coded.dictionary), int(doc[-1]) + 1
    code = coded.indices.fill_null(size).to_numpy(zero_copy_only=False).astype(np.int64)
    words, word = np.unique(doc * (size + 1) + code, return_inverse=True)
    mine, theirs = np.flatnonzero(own), np.flatnonzero(~own)
    matched = theirs[code[theirs] < size]
    at_a, at_b = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    at_a[word[mine]], at_b[word[matched]] = mine, matched
    alone = np.bincount(word[mine], minlength=len(words)) == 1
    shared = np.flatnonzero(alone & (np.bincount(word[matched], minlength=len(words)) == 1))
    a, b = at_a[shared], at_b[shared]
    order = np.lexsort((pos[a], doc[a]))
    a, b = a[order], b[order]
    row, at_line, at_pos = doc[a], line[b], pos[b]
    keep, turned = np.ones(len(row), dtype=bool), np.zeros(docs, dtype=bool)
    ends = np.searchsorted(row, np.arange(docs + 1))
    rises = (row[1:] != row[:-1]) | (at_line[1:] > at_line[:-1]) | ((at_line[1:] == at_line[:-1]) & (at_pos[1:] > at_pos[:-1]))
    for i in np.unique(row[1:][~rises]):
        here = slice(ends[i], ends[i + 1])
        both = [rising([turn * n * (1 << 40) + p for n, p in zip(at_line[here].tolist(), at_pos[here].tolist(), strict=True)]) for turn in (1, -1)]
        turned[i] = sum(both[1]) > sum(both[0])
        keep[here] = both[int(turned[i])]
    enough = np.bincount(row[keep], minlength=docs) >= least * np.bincount(words[alone] // (size + 1), minlength=docs)
    kept = np.flatnonzero(keep & enough[row])
    new = kept[1:][(row[kept[1:]] == row[kept[:-1]]) & (at_line[kept[1:]] != at_line[kept[:-1]])]
    lines, number = np.unique(line[theirs], return_inverse=True)
    starts, start = np.unique(doc[theirs] * len(lines) + number, return_inverse=True)
    first = np.full(len(starts), np.iinfo(np.int64).max)
    np.minimum.at(first, start, pos[theirs])
    begins = first[start[np.searchsorted(theirs, b[new])]] == at_pos[new]
    return a[new[begins]], turned[row[new[begins]]]
