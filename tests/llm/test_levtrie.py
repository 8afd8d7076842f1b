from __future__ import annotations

import random

import numpy as np

from folia.llm.levtrie import LevTrie, distance


def brute(a: str, b: str) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_search_is_the_same_as_brute_force():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    entries = [word(rng.randint(0, 9)) for _ in range(200)] + [word(70) for _ in range(3)]
    queries = [word(rng.randint(0, 9)) for _ in range(150)] + ["", "zzz", entries[-1][:-1], word(61)]
    k = np.array([rng.randint(0, 3) for _ in queries])
    trie = LevTrie(entries)
    got = {(int(q), trie.entries[e]): int(d) for q, e, d in zip(*trie.search(queries, k), strict=True)}
    want = {(i, e): d for i, q in enumerate(queries) for e in trie.entries if abs(len(q) - len(e)) <= k[i] and (d := brute(q, e)) <= k[i]}
    assert got == want


def test_distance():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in "ab")
        assert distance(a, b, 9) == brute(a, b)
        assert distance(a, b, 1) == min(brute(a, b), 2)


def test_empty():
    assert all(len(x) == 0 for x in LevTrie([]).search(["a"], np.array([1])))
    assert all(len(x) == 0 for x in LevTrie(["a"]).search([], np.array([], int)))
