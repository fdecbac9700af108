"""The nearest points of many pages, by arrays."""

from __future__ import annotations

import numpy as np


def nearest_points(page: np.ndarray, seg: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of points of whole pages, numbered from 0 and those of each together, segs and tokens: the rows of a seg and of the token
    that it keeps, and their squared distance. A token goes to its page's nearest seg, of several the one of the least id; a
    seg keeps the nearest of its tokens, again that of the least id. Some `most` pairs are compared at a time."""
    s, t = (rows[np.lexsort((ids[rows], page[rows]))] for rows in (np.flatnonzero(seg), np.flatnonzero(~seg)))
    many = np.bincount(page[s], minlength=int(page[-1]) + 1 if len(page) else 0)
    begin = np.cumsum(many) - many
    t = t[many[page[t]] > 0]
    n = many[page[t]]
    upto = np.append(0, np.cumsum(n))
    nearest, d2, i = np.zeros(len(t), np.int64), np.zeros(len(t), np.result_type(x, y)), 0
    while i < len(t):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        of, first = np.repeat(np.arange(i, j), n[i:j]), upto[i:j] - upto[i]
        to = begin[page[t[of]]] + np.arange(len(of)) - first[of - i]
        dx, dy = x[t[of]] - x[s[to]], y[t[of]] - y[s[to]]
        d = dx * dx + dy * dy
        d2[i:j] = np.minimum.reduceat(d, first)
        found = np.flatnonzero(d == d2[of])
        nearest[i:j] = to[found[np.append(True, of[found[1:]] != of[found[:-1]])]]
        i = j
    owner = np.cumsum(np.append(True, (page[s[1:]] != page[s[:-1]]) | (ids[s[1:]] != ids[s[:-1]])))[nearest]
    order = np.lexsort((d2, owner))
    kept = order[np.append(True, owner[order[1:]] != owner[order[:-1]])[: len(order)]]
    return s[nearest[kept]], t[kept], d2[kept]
