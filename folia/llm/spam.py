"""Problem 10: keyword-stuffed and link-list pages.

Method: every token becomes a function-word class or a word class (suffix, capital, number, link, tag, punctuation mark).
A trigram model over these classes is trained on the prose sentences of the whole corpus. A sentence or line whose
perplexity is abnormally high or low for its length, under the model's own mean and spread, isn't prose; so is a passage
whose content words have an abnormally low perplexity under the passage itself, that is, which repeats a few words, and that isn't
held together by function words. A page is flagged when more than half of its words stand in such lines, lines of honest
records (numbered affiliations, cited works, index and contents entries, rows of readings) not counted: their form is checked
on the abnormal lines only.

The model is a table of at most CLASSES ** 3 counts, whatever the corpus; that is all that reaches the driver.

Defined cases: a NULL or blank text is no page and is never flagged; so is a text without words; repeated rows give one row;
texts of any length are read whole; a corpus without any prose flags nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words by class (fixed values).
FUNCTION_WORDS = {
    "det": "the a an this these those that each every no some any all both either neither such another its our their his her my your",
    "prep": "of in on by for with from at under over between within into onto through during before after against about above below along across near to as per via without until since upon among despite toward towards off out up down",
    "conj": "and or but nor yet so plus",
    "pron": "we it they he she i you us them him who which what whom one ones there here itself themselves",
    "aux": "is are was were be been being has have had do does did may might can could should would will shall must",
    "sub": "when while where whereas why how if than whether because though although unless once however thus",
    "adv": "not very also only far most more less least rather still often rarely always never again too almost just even roughly usually",
    "fdet": "der die das den dem des ein eine einen einer eines el la los las un una unos unas le les une l'",
    "fprep": "im in von vom mit nach bei für aus auf zu zur zum über unter zwischen bis en de del con por para entre desde sobre dans du des avec pour par sur entre à au aux",
    "faux": "ist sind war waren wurde wurden wird werden hat haben es son fue fueron está están se ha han est sont été ont a",
    "fconj": "und oder aber sich nicht nur danach sowie y o e que no et ou ne pas qui",
}
SUFFIXES = [("ing", "ing"), ("ed", "ed"), ("ly", "ly"), ("tion", "noun"), ("ment", "noun"), ("ity", "noun"), ("ness", "noun"), ("ous", "adj"), ("al", "adj"), ("ic", "adj"), ("ive", "adj"), ("able", "adj"), ("s", "plural")]
MARKS = ",;:.?!()[]|/·•-–—\"'“”#%=<>*+&_"
_NAMES = ["<s>", *FUNCTION_WORDS, "ing", "ed", "ly", "noun", "adj", "plural", "word", "cap", "upper", "code", "num", "dec", "url", "tag", "leader", "other", *(f"m{c}" for c in MARKS)]
CLASS = {n: i for i, n in enumerate(_NAMES)}
CLASSES = len(_NAMES)
_FUNCTION = {w: CLASS[k] for k, ws in reversed(FUNCTION_WORDS.items()) for w in ws.split()}
_TOKEN = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]|]+|[a-z][\w-]*+(?:\.[a-z][\w-]++)++(?:/[^\s<>\"')\]|]*)?|#\w+|\.{3,}|…|\d+(?:[.,]\d+)*|[^\W\d_][\w'’-]*|\S|\n")
_END = re.compile(r"(?<=[.?!])[\"'”)]*\s+(?=[\"'“(\[#<]*[^\W\d_a-zà-ÿ])|\n+")
_PROSE = re.compile(r"^[\"'“(]*[^\W\d_].*[.?!][\"'”)]*$", re.S)
HIGH, LOW = 3.0, 5.0  # standard deviations above and below the mean surprise of prose
SLACK = 0.45  # bits that topics and styles of prose differ by
SHARE = 0.5
SHORT = 8
WORDED = 0.22  # share of function words from which an unusual line is still language
PASSAGE, PRIOR = 80, 10  # tokens of a passage at least; content words that stand for the rest of the language
OWN_WORDS, SAID = 12.0, 0.35  # perplexity of the content words of a passage given the others of it; share of function words from which a repeated passage is language
# Forms of honest records, by line.
RECORDS = [
    re.compile(r"(?:\.{3,}|…|\s{2,})\s*\d+$"),  # a contents entry and its page
    re.compile(r"^[^\W\d_][\w'’. -]+,[^\d,;]+(?:[,;]\s*\d+(?:-\d+)?)+$"),  # a name and its pages
    re.compile(r"^(?:\[?\d+[\])]?[.:]?\s)?.*\b[^\W\d_]\.(?:.*\(\d{4}\)|.*\bpp?\.\s*\d)"),  # a cited work
    re.compile(r"^[\[(]?[\da-z*†][\])]?\s+\S.*,\s*[^\W\d_].*$"),  # a numbered affiliation
    re.compile(r"^[^;|\t]{1,40}(?:[;|\t]\s*[-+]?\d+(?:[.,]\d+)?\s*[^\W\d_]{0,4}){2,}$"),  # a row of readings
]


def token_class(token: str) -> int:
    low = token.lower()
    if low in _FUNCTION:
        return _FUNCTION[low]
    first = token[0]
    if first.isalpha():
        if "." in token:
            return CLASS["url"]
        if any(c.isdigit() for c in token):
            return CLASS["code"]
        if token.isupper():
            return CLASS["upper"] if len(token) > 1 else CLASS["cap"]
        if first.isupper():
            return CLASS["cap"]
        for suffix, name in SUFFIXES:
            if token.endswith(suffix) and len(token) > len(suffix) + 2:
                return CLASS[name]
        return CLASS["word"]
    if first.isdigit():
        return CLASS["dec"] if len(token) > 1 and not token.isdigit() else CLASS["num"]
    if first == "#" and len(token) > 1:
        return CLASS["tag"]
    if token.startswith("...") or first == "…":
        return CLASS["leader"]
    return CLASS.get("m" + token, CLASS["other"])


_CONTENT = np.array([n in {"ing", "ed", "ly", "noun", "adj", "plural", "word", "cap"} for n in _NAMES])


class Known(dict):
    """Tokens met so far: class, and from the ninth bit on the number of the word in lower case; forgotten between batches when there are too many."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        value = self[token] = token_class(token) | self.words.setdefault(token.lower(), len(self.words)) << 8
        return value

    def trim(self) -> None:
        if len(self) > 300_000:
            self.clear()
            self.words.clear()


def segments(text: str) -> list[str]:
    """Sentences and lines of a text."""
    return [x for x in map(str.strip, _END.split(text)) if x]


def _is_prose(segment: str) -> bool:
    return bool(_PROSE.match(segment)) and segment.count(" ") >= 6 and "http" not in segment


def _ids(segment: str, known: Known) -> list[int]:
    return [0, 0, *map(known.__getitem__, _TOKEN.findall(segment))]


def count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, total = Known(), np.zeros(CLASSES**3, np.int64)
    for b in batches:
        known.trim()
        ids = 255 & np.array([i for t in b["text"] for s in segments(t) if _is_prose(s) for i in _ids(s, known)], np.int64)
        if len(ids) > 2:
            key = (ids[:-2] * CLASSES + ids[1:-1]) * CLASSES + ids[2:]
            total += np.bincount(key[ids[2:] != 0], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"key": at, "n": total[at]})


class Model:
    """Interpolated trigram model; surprise in bits."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        ratio = lambda a, b: a / np.maximum(b, 1e-9)
        p = 0.7 * ratio(three, three.sum(2, keepdims=True)) + 0.2 * ratio(two, two.sum(1, keepdims=True))[None] + 0.07 * ratio(one, one.sum()) + 0.03 / CLASSES
        self.bits = -np.log2(p)
        total = max(three.sum(), 1.0)
        self.mean = float((three * self.bits).sum() / total)
        self.spread = float(np.sqrt((three * (self.bits - self.mean) ** 2).sum() / total))


def judge(texts: list[str], model: Model, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """For each text (words, words in abnormal lines that are no records)."""
    parts = [(d, s) for d, t in enumerate(texts) for s in segments(t)]
    if not parts:
        return np.zeros(len(texts)), np.zeros(len(texts))
    tokens = [_TOKEN.findall(s) for _, s in parts]
    length = np.array([len(x) for x in tokens])
    known.trim()
    codes = np.fromiter(chain.from_iterable([0, 0, *map(known.__getitem__, x)] for x in tokens), np.int64, int(length.sum()) + 2 * len(parts))
    ids = codes & 255
    bits = np.zeros(len(ids))
    bits[2:] = model.bits[ids[:-2], ids[1:-1], ids[2:]]
    bits[ids == 0] = 0.0
    starts = np.r_[0, np.cumsum(length + 2)[:-1]]
    doc = np.array([d for d, _ in parts])
    # short lines without a full stop are weighed together with their like that stand next to them
    short = (length <= SHORT) & np.array([s[-1] not in ".?!" for _, s in parts])
    group = np.cumsum(np.r_[True, ~(short[1:] & short[:-1] & (doc[1:] == doc[:-1]))]) - 1
    size = np.maximum(np.bincount(group, length), 1)
    mean = (np.bincount(group, np.add.reduceat(bits, starts)) / size)[group]
    sigma = (model.spread / np.sqrt(size))[group]
    function = np.add.reduceat((ids > 0) & (ids <= len(FUNCTION_WORDS)), starts, dtype=float)
    own, said = _own_words(codes, length, doc, function)
    narrow = (own < OWN_WORDS) & (said < SAID)
    worded = (np.bincount(group, function) / size)[group] >= WORDED
    odd = ((mean > model.mean + HIGH * sigma + SLACK) & ~worded) | (mean < model.mean - LOW * sigma - SLACK) | narrow
    for k in np.flatnonzero(odd):
        odd[k] = not any(r.search(parts[k][1]) for r in RECORDS)
    return np.bincount(doc, length, len(texts)), np.bincount(doc, length * odd, len(texts))


def _own_words(codes: np.ndarray, length: np.ndarray, doc: np.ndarray, function: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the perplexity of the content words of its passage, each drawn from the others and PRIOR unseen ones, and the share of function words.

    A passage is a run of whole lines of one page with PASSAGE tokens or more, the rest of the page joining the last one.
    """
    first = np.r_[True, doc[1:] != doc[:-1]]
    ends = np.cumsum(length)
    start = np.maximum.accumulate(np.where(first, ends - length, 0))  # tokens before the page
    of_page = np.bincount(doc, length)[doc]
    number = np.minimum((ends - length - start) // PASSAGE, np.maximum(of_page // PASSAGE - 1, 0)).astype(np.int64)
    passage = np.cumsum(np.r_[True, (np.diff(doc) != 0) | (np.diff(number) != 0)]) - 1
    line = np.repeat(np.arange(len(length)), length)
    codes = codes[codes != 0]
    content = _CONTENT[codes & 255]
    at = passage[line[content]]
    pair, count = np.unique(at * (1 << 32) + (codes[content] >> 8), return_counts=True)
    own = pair >> 32
    n = np.bincount(at, minlength=passage[-1] + 1).astype(float)
    again = np.bincount(own, count * (count - 1), len(n)) / np.maximum(n * (n - 1 + PRIOR), 1)
    said = np.bincount(passage, function) / np.maximum(np.bincount(passage, length), 1)
    return (1 / np.maximum(again, 1e-9))[passage], said[passage]


def train(documents: DataFrame, text: str = "text") -> Model:
    """The class model of the prose in all documents."""
    counted = documents.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(count_trigrams, "key int, n long")
    counts = np.zeros(CLASSES**3)
    for key, n in counted.groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most CLASSES ** 3 rows
        counts[key] = n
    return Model(counts)


def score_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, odd): the words of each page and how many of them stand in lines that are neither prose nor records."""
    model = train(documents, text)
    pages = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    return pages.mapInPandas(_scorer(model), "id long, words long, odd long").withColumnRenamed("id", doc_id)


def _scorer(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known()
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                words, odd = judge(list(part["text"]), model, known)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "words": words.astype("int64"), "odd": odd.astype("int64")})

    return run


def find_spam(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of the pages that consist mainly of keywords, links or tags."""
    return score_pages(documents, doc_id, text).filter((F.col("words") > 0) & (F.col("odd") > SHARE * F.col("words"))).select(doc_id).distinct()
