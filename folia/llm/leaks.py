"""Problem 9: evaluation texts that leaked into training text.

Method: a positional inverted index distributed by document. Every task stores the postings (term, position) of its
documents; for each run of three item words the list of its rarest term is shifted by the term's offset and intersected
with the lists of the other two. Exact phrases appear as hits on one diagonal; the hits of a document and an item are
chained in order into proximity matches that bear exchanged, dropped and added words and an interruption of any length; each of
the two parts around an interruption must hold a run of three item words to be seen.

The index never leaves the task that built it, so nothing is shuffled but the matches. The test items go to every task:
up to ITEM_LIMIT characters of them at once, more in blocks of about that size. An item is judged by its own words alone, so
neither the other items nor the blocks change what is found.

Defined cases: a NULL or empty text carries nothing; an item of fewer than `least` words can't be carried; repeated rows
give one row; texts of any length are searched whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM_LIMIT = 8_000_000  # characters of items that are sent to every task at once
LEAST = 14  # words of the item that a stretch spans
EDITED = 7  # one word in so many may be exchanged, dropped or added
SEEDS = 5  # of LEAST item words in a row, those in exact runs of three: two edits and an interruption, or three edits, leave so many
MISSING = 3  # words that the best LEAST item words in a row of any stretch lack at most
GAP_ITEM, GAP_TEXT = 4, 5  # steps over missing words and over added ones; more added words are an interruption
_TOKEN = re.compile(r"\w+|\x00")
_CHUNK = 3_000_000


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


class Items:
    """The item side: term numbers and all runs of three terms."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.terms: dict[str, int] = {}
        self.words = [[self.terms.setdefault(w, len(self.terms)) for w in words(t or "")] for _, t in items]
        grams = [(*ws[p : p + 3], k, p) for k, ws in enumerate(self.words) for p in range(len(ws) - 2)]
        g = np.array(grams, np.int64).reshape(-1, 5)
        self.grams, self.item, self.at = g[:, :3], g[:, 3], g[:, 4]
        self.offset = np.r_[0, np.cumsum([len(ws) for ws in self.words])].astype(np.int64)
        self.where = [defaultdict(list) for _ in items]
        for k, ws in enumerate(self.words):
            for p, t in enumerate(ws):
                self.where[k][t].append(p)


def positions(texts: list[str], terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term number at each position of the joined texts (-1: no item has it, -2: between texts), and the text it is in."""
    get = (terms | {"\x00": -2}).get
    tokens = _TOKEN.findall(" \x00 ".join(t.replace("\x00", " ") for t in texts).lower())
    t = np.array([get(w, -1) for w in tokens], np.int32)
    return t, np.cumsum(t == -2)


def phrase_hits(t: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(position, number of the item's run of three terms) of every exact run."""
    n_terms = len(items.terms)
    at = np.flatnonzero(t >= 0)
    order = at[np.argsort(t[at], kind="stable")]  # postings by term, positions ascending
    count = np.bincount(t[at], minlength=n_terms)
    first = np.r_[0, np.cumsum(count)]
    lens = count[items.grams]
    rare = lens.argmin(1)
    rows = np.arange(len(rare))
    size = lens[rows, rare]
    start = first[items.grams[rows, rare]]
    todo = np.flatnonzero(size)
    out_p, out_g = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    padded = np.r_[t, [-2, -2, -2]]
    done = 0
    while done < len(todo):
        stop = done + max(1, int(np.searchsorted(np.cumsum(size[todo[done:]]), 4_000_000)))
        g = todo[done:stop]
        done = stop
        gram = np.repeat(g, size[g])
        inside = np.arange(len(gram)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
        p = order[start[gram] + inside] - rare[gram]
        ok = p >= 0
        p, gram = p[ok], gram[ok]
        for k in range(3):
            ok = padded[p + k] == items.grams[gram, k]
            p, gram = p[ok], gram[ok]
        out_p.append(p)
        out_g.append(gram)
    return np.concatenate(out_p), np.concatenate(out_g)


State = tuple[int, int, int, int]  # item words spanned, score, of them matched, whether an interruption has been passed


def _front(states: list[State]) -> list[State]:
    """The chains that no other one beats in words spanned (beyond LEAST all count alike), score and interruptions."""
    out: list[State] = []
    for x in sorted(states, key=lambda x: (-min(x[0], LEAST), -x[1], x[3])):
        if not any(y[1] >= x[1] and y[3] <= x[3] for y in out):
            out.append(x)
    return out


def stretch(points: list[tuple[int, int]]) -> tuple[int, int]:
    """Of sorted (text position, item position) points: (item words spanned, of them matched) of the best chain in order.

    A chain scores the item words it spans less EDITED for each word exchanged, dropped or added; an interruption of any length counts
    as one edit, a further one as two. No chain is given up while it may still reach LEAST words with a score of 0 or more.
    """
    recent: dict[int, list[tuple[int, list[State]]]] = {}
    far: dict[int, list[State]] = {}  # best chains by the item position they end at, more than GAP_TEXT words back
    top: State = (0, -1, 0, 0)
    for d, i in points:
        states: list[State] = [(1, 1, 1, 0)]
        for di in range(1, min(GAP_ITEM, i) + 1):
            near = recent.get(i - di)
            if near is None:
                continue
            while near and d - near[0][0] > GAP_TEXT:
                far[i - di] = _front(far.get(i - di, []) + near.pop(0)[1])
            for dd, chains in near:
                if d > dd:
                    gain = di - EDITED * max(di - 1, d - dd > 1)
                    states += [(span + di, score + gain, matched + 1, f) for span, score, matched, f in chains if score + gain > -LEAST]
            if di <= 2 and i - di in far:
                gain = di - EDITED * di
                states += [(span + di, score + gain - EDITED * f, matched + 1, 1) for span, score, matched, f in far[i - di] if score + gain - EDITED * f > -LEAST]
        if len(states) > 1:
            states = _front(states)
        recent.setdefault(i, []).append((d, states))
        if states[0][0] >= LEAST and states[0][1] > top[1]:
            top = states[0]
    return top[0], top[2]


def _dense(places: np.ndarray) -> int:
    """Most of the sorted places within LEAST of each other."""
    return int((np.searchsorted(places, places + LEAST) - np.arange(len(places))).max(initial=0))


def _search(batches: Iterator[pd.DataFrame], items: Items) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, texts = list(b["id"]), list(b["text"])
        lo = 0
        while lo < len(ids):
            hi, size = lo, 0
            while hi < len(ids) and (hi == lo or size + len(texts[hi]) <= _CHUNK):
                size += len(texts[hi])
                hi += 1
            found = _search_shard(texts[lo:hi], items)
            if found:
                yield pd.DataFrame({"id": [ids[lo + d] for d, *_ in found], "item_id": [items.ids[k] for _, k, *_ in found], "words": [s for *_, s, _ in found], "matched": [m for *_, m in found]})
            lo = hi


def _search_shard(texts: list[str], items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, item words spanned, matched) of the texts of one shard."""
    t, text_of = positions(texts, items.terms)
    if not len(t) or not len(items.grams):
        return []
    p, g = phrase_hits(t, items)
    if not len(p):
        return []
    pair = text_of[p].astype(np.int64) * len(items.ids) + items.item[g]
    order = np.argsort(pair, kind="stable")
    pair, p, g = pair[order], p[order], g[order]
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    ends = np.r_[starts[1:], len(pair)]
    number = np.repeat(np.arange(len(starts)), ends - starts)
    places = items.offset[items.item[g]] + items.at[g]
    total = int(items.offset[-1])
    covered = np.unique(np.concatenate([number * total + places + k for k in range(3)]))
    dense = np.searchsorted(covered, covered + LEAST) - np.arange(len(covered))
    most = np.zeros(len(starts), np.int64)
    np.maximum.at(most, covered // total, dense)
    out = []
    near = np.zeros(len(items.terms) + 2, bool)  # with room for the two marks at its end
    edge = np.r_[np.flatnonzero(t == -2), len(t)]
    for n in np.flatnonzero(most >= SEEDS):
        s, e = starts[n], ends[n]
        doc, item = divmod(int(pair[s]), len(items.ids))
        left = int(edge[doc - 1]) + 1 if doc else 0
        right = int(edge[doc])
        around = (p[s:e, None] + np.arange(-20, 23)).ravel()
        around = around[(around >= left) & (around < right)]
        near[t[around]] = True
        met = near[items.words[item]]
        near[t[around]] = False
        if _dense(np.flatnonzero(met)) < LEAST - MISSING:
            continue
        where = items.where[item]
        top = stretch([(d, i) for d in np.unique(around).tolist() for i in where.get(int(t[d]), ())])
        if top[0] >= LEAST:
            out.append((doc, item, *top))
    return out


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, words, matched): which document carries which item, and how long the stretch is."""
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null and text != ''")
    listed = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    size = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_LIMIT))
    found = None
    for b in range(blocks):
        block = listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = Items([(r[0], r[1]) for r in block.collect()])
        one = docs.mapInPandas(lambda it, index=index: _search(it, index), "id long, item_id long, words int, matched int")
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("words", "matched")).alias("m")
    return found.groupBy(F.col("id").alias(doc_id), "item_id").agg(best).select(doc_id, "item_id", "m.words", "m.matched")
