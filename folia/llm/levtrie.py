"""Levenshtein automata run over a trie, for many queries at a time.

The trie is a sorted array of distinct strings: a node is a range of entries that share a prefix. Each query is the
bit-parallel automaton of its Levenshtein neighbourhood (one 64-bit word for each number of errors; neighbour
transpositions count as one error). A depth-first walk carries the states of all queries still alive as numpy arrays, so a
step costs a few vector operations for all of them together. Strings over 62 characters take an equal scalar automaton.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

LIMIT = 62
ONE = np.uint64(1)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with neighbour transpositions; most + 1 if it is larger."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if a == b:
        return 0
    start, short = 0, min(n, m)
    while start < short and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    n, m = n - start, m - start
    a, b = a[start : start + n], b[start : start + m]
    if not n or not m:
        found = n + m
    elif n == m == 1 or (n == m == 2 and a[0] == b[1] and a[1] == b[0]):
        found = 1
    elif most < 2 or max(n, m) == 2:
        found = 2
    elif len(set(a).difference(b)) > most or len(set(b).difference(a)) > most:  # an error changes a letter at most
        found = most + 1
    else:
        found = _bit_distance(a, b)
    return min(found, most + 1)


def _bit_distance(a: str, b: str) -> int:
    """The same without a bound, a column of the table in a few steps on whole numbers."""
    n = len(a)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, same, before, found = full, 0, 0, 0, n
    for y in b:
        here = places.get(y, 0)
        swapped = ((~same & here) << 1) & before
        same = ((((here & up) + up) ^ up) | here | down | swapped) & full
        more, less = down | (~(same | up) & full), same & up
        found += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down, before = less | (~(same | more) & full), more & same, here
    return found


class LevTrie:
    def __init__(self, entries: list[str]):
        self.entries = sorted(set(entries))
        self.long = [i for i, x in enumerate(self.entries) if len(x) > LIMIT]
        chars = sorted({c for x in self.entries for c in x})
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        n = len(self.entries)
        width = min(max(map(len, self.entries), default=0), LIMIT) + 1
        self.e = np.zeros((n, width), np.int32)
        for i, x in enumerate(self.entries):
            if len(x) <= LIMIT:
                self.e[i, : len(x)] = [self.code[c] for c in x]
        keep = np.array([len(x) <= LIMIT for x in self.entries], bool) if n else np.zeros(0, bool)
        self.ids = np.flatnonzero(keep)
        short = self.e[self.ids]
        order = np.lexsort(short.T[::-1]) if len(short) else np.zeros(0, np.int64)
        self.ids, self.e = self.ids[order], short[order]
        self.len = (self.e > 0).sum(1)

    def search(self, queries: list[str], k: np.ndarray, chunk: int = 20000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, entry number, distance) of every entry within k[query] errors of its query."""
        k = np.asarray(k)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for errors in np.unique(k):
            at = np.flatnonzero(k == errors)
            for i in range(0, len(at), chunk):
                part = at[i : i + chunk]
                q, e, d = self._search([queries[j] for j in part], int(errors))
                out.append((part[q], e, d))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]

    def _search(self, queries: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.array([len(q) for q in queries])
        scalar = [(i, j) for i in np.flatnonzero(lens > LIMIT) for j in range(len(self.entries))] + [(i, j) for j in self.long for i in np.flatnonzero(lens <= LIMIT)]
        extra = [(i, j, d) for i, j in scalar if (d := distance(queries[i], self.entries[j], k)) <= k]
        qs = np.flatnonzero(lens <= LIMIT)
        q, e, d = self._walk(qs, queries, k)
        if extra:
            x = np.array(extra)
            q, e, d = np.concatenate([q, x[:, 0]]), np.concatenate([e, x[:, 1]]), np.concatenate([d, x[:, 2]])
        return q, e, d

    def _walk(self, qs: np.ndarray, queries: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, int)
        if not len(qs) or not len(self.ids):
            return none, none, none
        n = len(qs)
        qlen = np.array([len(queries[i]) for i in qs])
        width = max(int(qlen.max()), 1)
        codes = np.zeros((n, width), np.int32)
        get = self.code.get
        for r, i in enumerate(qs):
            codes[r, : qlen[r]] = [get(c, -1) for c in queries[i]]
        mask = np.zeros((len(self.code) + 1, n), np.uint64)
        rows = np.arange(n)
        for p in range(width):
            c = codes[:, p]
            ok = c > 0
            mask[c[ok], rows[ok]] |= ONE << np.uint64(p)
        full = (ONE << (qlen + 1).astype(np.uint64)) - ONE
        last = ONE << qlen.astype(np.uint64)
        start = [np.minimum(np.full(n, (1 << (j + 1)) - 1, np.uint64), full) for j in range(k + 1)]
        cand: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        zero = [np.zeros(n, np.uint64)] * (k + 1)
        # a frame: entries lo..hi, depth, living queries, states, states one step before, code of the last character
        stack = [(0, len(self.ids), 0, rows, start, zero, 0)]
        e = self.e
        width_e = e.shape[1]
        while stack:
            lo, hi, depth, alive, r, r1, before = stack.pop()
            if hi - lo == 1:
                near = np.abs(qlen[alive] - self.len[lo]) <= k
                cand.append((alive[near], np.full(int(near.sum()), lo)))
                continue
            col = e[lo:hi, depth] if depth < width_e else np.zeros(hi - lo, np.int32)
            edges = [0, *(np.flatnonzero(col[1:] != col[:-1]) + 1).tolist(), hi - lo]
            bm = mask[before][alive] if before else None
            fl = full[alive]
            for s, t in pairwise(edges):
                c = int(col[s])
                if c == 0:
                    hit = np.full(len(alive), k + 1)
                    for j in range(k, -1, -1):
                        hit[(r[j] & last[alive]) != 0] = j
                    ok = hit <= k
                    found.append((alive[ok], np.full(int(ok.sum()), lo + s), hit[ok]))
                    continue
                b = mask[c][alive]
                new = [(r[0] & b) << ONE]
                for j in range(1, k + 1):
                    x = ((r[j] & b) << ONE) | r[j - 1] | (r[j - 1] << ONE) | (new[j - 1] << ONE)
                    if bm is not None:
                        x |= (((r1[j - 1] & b) << ONE) & bm) << ONE
                    new.append(x & fl)
                live = new[k] != 0
                if k:
                    for j in range(k):
                        live |= new[j] != 0
                if live.all():
                    stack.append((lo + s, lo + t, depth + 1, alive, new, r, c))
                elif live.any():
                    stack.append((lo + s, lo + t, depth + 1, alive[live], [x[live] for x in new], [x[live] for x in r], c))
        if cand:
            q = np.concatenate([x for x, _ in cand])
            ent = np.concatenate([x for _, x in cand])
            for i in range(0, len(q), 200_000):
                d = self._along(q[i : i + 200_000], ent[i : i + 200_000], mask, qlen, full, last, k)
                ok = d <= k
                found.append((q[i : i + 200_000][ok], ent[i : i + 200_000][ok], d[ok]))
        if not found:
            return none, none, none
        q, ent, d = (np.concatenate([f[i] for f in found]) for i in range(3))
        return qs[q], self.ids[ent], d

    def _along(self, q: np.ndarray, ent: np.ndarray, mask: np.ndarray, qlen: np.ndarray, full: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
        """The automata of q run along single entries, from the start."""
        n = len(q)
        fl, lens = full[q], self.len[ent]
        r = [np.minimum(np.full(n, (1 << (j + 1)) - 1, np.uint64), fl) for j in range(k + 1)]
        r1 = [np.zeros(n, np.uint64)] * (k + 1)
        bm = np.zeros(n, np.uint64)
        for depth in range(int(lens.max()) if n else 0):
            on = lens > depth
            b = mask[self.e[ent, depth], q]
            new = [np.where(on, (r[0] & b) << ONE, r[0])]
            for j in range(1, k + 1):
                x = ((r[j] & b) << ONE) | r[j - 1] | (r[j - 1] << ONE) | (new[j - 1] << ONE) | ((((r1[j - 1] & b) << ONE) & bm) << ONE)
                new.append(np.where(on, x & fl, r[j]))
            r1, r, bm = r, new, b
        d = np.full(n, k + 1)
        for j in range(k, -1, -1):
            d[(r[j] & last[q]) != 0] = j
        return d
