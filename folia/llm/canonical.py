"""Problem 2: values typed freely, led to the entry of a reference list they mean.

Method: the reference entries with their alias paths (word orders, codes, names in other languages, abbreviated words) stand
in tries that Levenshtein automata search for all entries within a length-dependent distance; every word must be near
too, so that two entries that differ in one word aren't confused. The nearest entry wins, ties by the smaller id.

Alias paths come from the table `aliases`; for countries the names of the Java locale data and COUNTRY_ALIASES, a default list that
the table extends, count too.

A field's list of up to LIST_LIMIT entries goes to the workers as a whole; a longer one goes in blocks of that size, each with the words
of the whole list, and the nearest entry over all blocks is kept, so the result doesn't depend on the limit. Lists of countries
are bounded by nature and go whole.

Defined cases: NULL, blank values and the sentinels are left out; each distinct value gives one row, however often it occurs;
a value without any letter, or without an entry in reach, gets item_id -1; an empty list gives -1 for all; values of any
length are searched whole. Input columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.text import fold_py
from folia.llm.levtrie import LevTrie, distance

LIST_LIMIT = 50_000
SENTINELS = ("", "unknown", "Unknown", "empty")
# Names of listed countries and of their parts that no locale table holds (fixed values).
COUNTRY_ALIASES = {
    "United Kingdom": "uk, gb, gbr, great britain, britain, england, wales, scotland, northern ireland, north ireland, n ireland, utd kingdom, reino unido, royaume uni",
    "United States": "usa, us, u s a, united states of america, states, america, estados unidos, etats unis, vereinigte staaten, estados unidos de america, hawaii, alaska, puerto rico",
    "China": "pr china, p r china, peoples r china, peoples republic of china, zhongguo, hong kong, macau, macao, chine",
    "Russian Federation": "russia, rossiya, rossija, ussr",
    "Viet Nam": "vietnam, sr vietnam",
    "Czech Republic": "czechia, ceska republika, cesko, czech rep, cr",
    "Turkey": "turkiye, turkye, tuerkiye",
    "South Korea": "korea, republic of korea, korea republic of, korea south, hanguk, s korea, rok",
    "Netherlands": "holland, nederland, the netherlands",
    "Germany": "deutschland, bundesrepublik deutschland, federal republic of germany, w germany, west germany, east germany, brd, frg",
    "France": "french republic, republique francaise, fr, guadeloupe, martinique, french guiana, reunion, corsica",
    "Greece": "hellas, hellenic republic, ellada",
    "Italy": "italian republic, italia, repubblica italiana, sicily, sardinia",
    "Spain": "espana, kingdom of spain, reino de espana, canary islands, catalonia",
    "Portugal": "portuguese republic, port, madeira, azores",
    "Ireland": "eire, irish republic",
    "Japan": "nippon, nihon",
    "Egypt": "misr, arab republic of egypt",
    "India": "bharat",
    "South Africa": "rsa, s africa",
    "United Arab Emirates": "u arab emirates, uae, emirates, dubai, abu dhabi",
    "Taiwan": "taiwan roc, chinese taipei",
    "Switzerland": "swiss confederation, confoederatio helvetica, schweiz, suisse, svizzera",
    "Austria": "oesterreich, republik osterreich",
    "Iran": "islamic republic of iran, iran islamic republic of, persia",
    "Argentina": "argentine republic, argentine",
    "Brazil": "brasil, federative republic of brazil",
    "Poland": "polska",
    "Hungary": "magyarorszag",
    "Sweden": "sverige",
    "Norway": "norge, svalbard",
    "Denmark": "danmark, greenland, faroe islands",
    "Finland": "suomi, aland",
    "Belarus": "byelarus, belorussia",
    "Ukraine": "ukraina",
    "Morocco": "maroc, kingdom of morocco, al maghrib",
    "Slovakia": "slovak republic",
    "Saudi Arabia": "ksa",
    "Iceland": "island",
}
LANGUAGES = ("en", "fr", "de", "es", "it", "pt", "nl", "da", "sv", "pl", "cs", "hu", "ro", "tr", "fi")
# Kinds of institution as a list writes them, and their words elsewhere (fixed values).
KIND_WORDS = {"univ": "univ university universite universitat universidad universita universiteit universidade u", "lab": "lab laboratory laboratoire laboratories"}
LONG_KINDS = {"research technology organisation": "rto", "national research organisation": "nro", "research site": "site", "cnrs lab": "cnrslab"}
KIND_PARTS = ("research", "technology", "organisation", "national", "site", "university", "universite", "universitat", "universidad", "laboratory")
NOISE_WORDS = ("main", "campus")
STOP = {"of", "de", "the", "for", "at", "and", "in", "on", "a", "la", "du", "des"}
SHORT_KINDS = ("rto", "nro", "site", "univ", "lab")
_WORD = re.compile(r"[^\W_]+")


def _is_stop(word: str) -> bool:
    """A stop word, or a short word one error away from one and from no kind of institution."""
    if word in STOP:
        return True
    if not 3 <= len(word) <= 4 or any(distance(word, k, 1) <= 1 for k in SHORT_KINDS):
        return False
    return any(len(x) > 1 and distance(word, x, 1) <= 1 for x in STOP)


def within(length: int) -> int:
    """Errors allowed in a text of this length."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 16 else 3


STRICT, EASY = (3, 8, 99), (3, 4, 7)  # word lengths from which one, two and three errors are allowed


def _words_near(a: str, b: str, steps: tuple[int, int, int]) -> bool:
    x, y = a.split(), b.split()
    return len(x) != len(y) or all(distance(p, q, 3) <= sum(max(len(p), len(q)) >= n for n in steps) for p, q in zip(x, y, strict=True))


def nearest(trie: LevTrie, ids: dict[str, int], keys: list[str], steps: tuple[int, int, int] = STRICT) -> list[tuple[int, int]]:
    """For each key (distance, id) of the nearest alias within reach, (99, -1) if there is none."""
    best = [(99, -1)] * len(keys)
    ask = np.array([within(len(x)) for x in keys], int)
    for q, e, d in zip(*trie.search(keys, ask), strict=True):
        entry = trie.entries[e]
        new = (int(d), ids[entry])
        if new < best[q] and (d == 0 or _words_near(keys[q], entry, steps)):
            best[q] = new
    return best


def locale_names(spark: SparkSession) -> dict[str, set[str]]:
    """ISO code of each country: its names in several languages and its codes, from the Java locale data."""
    locale = spark._jvm.java.util.Locale
    own = defaultdict(set)
    for x in locale.getAvailableLocales():
        own[x.getCountry()].add(x.getLanguage())
    out = {}
    for code in locale.getISOCountries():
        place = locale("", code)
        langs = {x for x in own[code] if len(x) == 2} | set(LANGUAGES)
        out[code] = {place.getDisplayCountry(locale(x)) for x in langs} | {code, place.getISO3Country()}
    return out


def country_aliases(names: list[str], places: dict[str, set[str]]) -> dict[str, str | None]:
    """Folded alias: the listed country it means, None for a country that isn't listed."""
    listed = {fold_py(x): x for x in names}
    hand = {fold_py(a.strip()): c for c, text in COUNTRY_ALIASES.items() if fold_py(c) in listed for a in text.split(",")}
    out: dict[str, str | None] = {}
    for code, words in places.items():
        keys = {" ".join(_WORD.findall(fold_py(w))) for w in words} - {""}
        target = next((t for k in sorted(keys, key=len, reverse=True) if (t := listed.get(k) or (hand.get(k) if len(k) > 3 else None))), None)
        for k in keys:
            if k in out and out[k] != target:
                out[k] = out[k] if len(k) <= 3 and k == code.lower() else out[k] or target
            else:
                out[k] = target
    return out | hand | {k: listed[k] for k in listed}


def _country_keys(raw: str) -> list[str]:
    """Forms of a typed country, the most literal first."""
    text = fold_py(raw)
    flat = " ".join(_WORD.findall(re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", text).replace("'", "")))
    out = [flat]
    bare = re.sub(r"\([^)]*\)|\[[^]]*\]", " ", text)
    bare = re.sub(r"^[a-z]{1,3}\s*-\s*(?=[a-z]{4})", "", bare)
    words = [w for w in _WORD.findall(bare.replace("'", "")) if not any(c.isdigit() for c in w)]
    out.append(" ".join(words))
    if len(words) > 1 and any(c.isdigit() for c in bare) and all(len(w) <= 2 for w in words[:-1]):
        out.append(words[-1])
    trimmed = [w for w in words if w not in {"the", "republic", "rep", "of", "kingdom", "state", "federal"}]
    if trimmed and trimmed != words:
        out.append(" ".join(trimmed))
    return list(dict.fromkeys(x for x in out if x))


Entries = list[tuple[int, str]]
Matcher = Callable[[list[str]], list[tuple[int, int]]]
SECOND = 100  # added to the distance of entries that are only looked for where no entry is within reach


def country_matcher(entries: Entries, aliases: Entries, places: dict[str, set[str]]) -> Matcher:
    ids = {c: i for i, c in sorted(entries, reverse=True)}
    alias = {k: -1 if v is None else ids[v] for k, v in country_aliases(list(ids), places).items()}
    alias |= {" ".join(_WORD.findall(fold_py(a))): i for i, a in sorted(aliases, reverse=True)}
    fuzzy = LevTrie([k for k in alias if len(k) > 3])
    full = [k for k in alias if alias[k] >= 0 and len(k) > 3]

    def match(values: list[str]) -> list[tuple[int, int]]:
        keys = [_country_keys(v) for v in values]
        flat = sorted({k for ks in keys for k in ks if k not in alias})
        near = dict(zip(flat, nearest(fuzzy, alias, flat), strict=True))
        out = []
        for v, ks in zip(values, keys, strict=True):
            hit = next(((0, alias[k]) for k in ks if k in alias), None)
            if hit is None and ks and v.rstrip().endswith(".") and 3 <= len(ks[0]) and " " not in ks[0]:
                cut = {alias[k] for k in full if k.startswith(ks[0]) and " " not in k}
                hit = (0, cut.pop()) if len(cut) == 1 else None
            out.append(hit or min((near[k] for k in ks), default=(99, -1)))
        return out

    return match


_KINDS = {w: k for k, ws in KIND_WORDS.items() for w in ws.split()}


def _kind_settled(words: list[str]) -> list[str]:
    text = " " + " ".join(_KINDS.get(w, w) for w in words) + " "
    for long, short in LONG_KINDS.items():
        text = text.replace(f" {long} ", f" {short} ")
    return text.split()


def institution_words(canonical: str) -> list[str]:
    """The word between the town and the kind of a listed institution, which may be shortened."""
    words = _kind_settled([w for w in _WORD.findall(fold_py(canonical)) if w not in STOP])
    return words[1:2] if len(words) == 3 else []


def institution_matcher(entries: Entries, aliases: Entries, listed: set[str]) -> Matcher:
    """Matcher of institutions; listed: institution_words of the whole list."""
    kinds, fields, settle = _KINDS, listed, _kind_settled
    vocabulary = LevTrie([*KIND_PARTS, *NOISE_WORDS])
    seen: dict[str, str] = {}
    alias: dict[str, int] = {}

    def words_of(text: str) -> list[str]:
        return [w for w in _WORD.findall(fold_py(text)) if w not in STOP]

    for i, c in sorted([*entries, *aliases], reverse=True):
        words = settle(words_of(c))
        for order in permutations(words) if len(words) < 5 else [tuple(words)]:
            alias[" ".join(order)] = i
    trie = LevTrie(list(alias))

    def skeleton(raw: str) -> str:
        out = []
        for m in re.finditer(r"([^\W_]+)(\.?)", fold_py(raw)):
            w = m[1]
            if _is_stop(w):
                continue
            if m[2] and w not in kinds and 2 < len(w) < 8:
                full = [f for f in fields if f.startswith(w)]
                w = full[0] if len(full) == 1 else w
            out.append(seen.get(w, w))
        if "campus" in out:
            at = out.index("campus")
            out = [w for k, w in enumerate(out) if k != at and not (k == at - 1 and distance(w, "main", 2) <= 2)]
        words = settle([w for w in out if w not in NOISE_WORDS])
        return " ".join(w for w in words if len(w) > 1 or len(words) < 3)

    def match(values: list[str]) -> list[tuple[int, int]]:
        new = sorted({w for v in values for w in _WORD.findall(fold_py(v)) if len(w) > 3} - seen.keys())
        seen.update((w, w) for w in new)
        q, e, d = vocabulary.search(new, np.array([0 if w in kinds else 1 if len(w) < 8 else 2 for w in new], int))
        for i in np.argsort(-d, kind="stable"):
            seen[new[q[i]]] = vocabulary.entries[e[i]]
        keys = [skeleton(v) for v in values]
        flat = sorted(set(keys))
        near = dict(zip(flat, nearest(trie, alias, flat, EASY), strict=True))
        return [near[k] for k in keys]

    return match


def journal_words(canonical: str) -> list[str]:
    """The words of a listed name, each of which may be cut off from its third letter on or to its first."""
    return [w for w in _WORD.findall(fold_py(canonical)) if w not in STOP]


def journal_matcher(entries: Entries, aliases: Entries, listed: set[str]) -> Matcher:
    """Matcher of journals and of other names of several words; listed: journal_words of the whole list."""
    starts = {w[:n] for w in listed for n in (1, *range(3, len(w) + 1))}

    def words_of(text: str) -> list[str]:
        return [w for w in _WORD.findall(text) if w not in STOP]

    alias: dict[str, int] = {}
    holds: dict[tuple[int, int, str], set[int]] = defaultdict(set)
    paths: dict[str, set[str]] = defaultdict(set)
    for i, c in sorted([*entries, *aliases], reverse=True):
        words = words_of(fold_py(c))
        alias[" ".join(words)] = i
        for p, w in enumerate(words):
            holds[len(words), p, w].add(i)
            for n in range(3, len(w) + 1):
                paths[w[:n]].add(w)
            paths[w[:1]].add(w)
    trie = LevTrie(list(alias))
    cuts = LevTrie([p for p in paths if len(p) > 2])

    def skeleton(raw: str) -> str:
        text = re.sub(r"\([^)]*\)|\[[^]]*\]|,?\s*\bvol\b\.?\s*\w+\s*$", " ", fold_py(raw))
        head, comma, tail = text.strip(" .,;").rpartition(",")
        text = f"{tail} {head}" if comma and not any(c.isdigit() for c in tail) else text
        words = words_of(text)
        return " ".join(w for k, w in enumerate(words) if k == 0 or (len(w) > 2 and (w in starts or not _is_stop(w))))

    def match(values: list[str]) -> list[tuple[int, int]]:
        keys = [skeleton(v) for v in values]
        flat = sorted(set(keys))
        near = dict(zip(flat, nearest(trie, alias, flat, EASY), strict=True))
        open_keys = [k for k in flat if near[k][1] < 0 and k]
        words = sorted({w for k in open_keys for w in k.split()})
        reach: dict[str, dict[str, int]] = {w: dict.fromkeys(paths.get(w, ()), 0) for w in words}
        asked = np.array([0 if len(w) < 3 else 1 for w in words], int)
        for q, e, d in zip(*cuts.search(words, asked), strict=True):
            for full in paths[cuts.entries[e]]:
                old = reach[words[q]].get(full, 9)
                reach[words[q]][full] = min(old, int(d))
        for k in open_keys:
            parts = k.split()
            cost: dict[int, int] = {}
            for p, w in enumerate(parts):
                step: dict[int, int] = {}
                for full, d in reach[w].items():
                    for i in holds.get((len(parts), p, full), ()):
                        step[i] = min(step.get(i, 9), d)
                cost = step if p == 0 else {i: c + step[i] for i, c in cost.items() if i in step}
                if not cost:
                    break
            if cost and len(parts) > 1:
                near[k] = min((SECOND + c, i) for i, c in cost.items())
        return [near[k] for k in keys]

    return match


def _matcher(field: str, entries: Entries, aliases: Entries, listed: set[str] | None, places: dict[str, set[str]]) -> Matcher:
    if field == "country":
        return country_matcher(entries, aliases, places)
    words, make = (institution_words, institution_matcher) if field == "institution" else (journal_words, journal_matcher)
    return make(entries, aliases, {w for _, c in [*entries, *aliases] for w in words(c)} if listed is None else listed)


def map_to_list(values: DataFrame, reference: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """values (field_name, raw_value) and reference (item_id, field_name, canonical) to (field_name, raw_value, item_id).

    aliases (item_id, field_name, alias): further spellings of listed entries.
    """
    spark = values.sparkSession
    listed = reference.select("item_id", "field_name", "canonical").filter("canonical is not null")
    values = values.select("field_name", "raw_value").filter(F.col("raw_value").isNotNull() & ~F.trim("raw_value").isin(*SENTINELS)).distinct()
    known = listed.select("field_name", F.col("canonical").alias("raw_value"))
    values = values.join(known, ["field_name", "raw_value"], "left_anti")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    values = values.repartition(parts, F.xxhash64("field_name", "raw_value"))
    places = locale_names(spark)
    spelled = listed.withColumn("extra", F.lit(False))
    if aliases is not None:
        spelled = spelled.unionByName(aliases.select("item_id", "field_name", F.col("alias").alias("canonical"), F.lit(True).alias("extra")).filter("canonical is not null"))
    sizes = {r[0]: r[1] for r in spelled.filter("field_name != 'country'").groupBy("field_name").count().collect()}  # one row a field
    long = sorted(f for f, n in sizes.items() if n > LIST_LIMIT)
    short = F.coalesce(~F.col("field_name").isin(long), F.lit(True))
    found = values.filter(short).mapInPandas(_searcher(spelled.filter(short).collect(), {}, places), _FOUND)
    for field in long:
        words = _listed_words(spelled.filter(F.col("field_name") == field), field)
        blocks = -(-sizes[field] // LIST_LIMIT)
        for b in range(blocks):
            block = spelled.filter((F.col("field_name") == field) & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).collect()
            found = found.unionByName(values.filter(F.col("field_name") == field).mapInPandas(_searcher(block, {field: words}, places), _FOUND))
    if not long:
        return found.select("field_name", "raw_value", "item_id")
    best = F.min(F.struct(F.when(F.col("item_id") < 0, 9999).otherwise(F.col("distance")).alias("d"), "item_id")).alias("m")
    return found.groupBy("field_name", "raw_value").agg(best).select("field_name", "raw_value", F.col("m.item_id").alias("item_id"))


_FOUND = "field_name string, raw_value string, distance int, item_id long"


def _listed_words(spelled: DataFrame, field: str) -> set[str]:
    """The distinct words of a long list."""
    words = institution_words if field == "institution" else journal_words

    @F.pandas_udf("array<string>")
    def read(c: pd.Series) -> pd.Series:
        return c.map(words)

    return {r[0] for r in spelled.select(F.explode(read("canonical")).alias("w")).distinct().collect()}


def _searcher(rows: list, listed: dict[str, set[str]], places: dict[str, set[str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    entries: dict[str, Entries] = defaultdict(list)
    aliases: dict[str, Entries] = defaultdict(list)
    for item_id, field, text, extra in rows:
        (aliases if extra else entries)[field].append((item_id, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Matcher] = {}
        for batch in batches:
            for field, part in batch.groupby("field_name"):
                if field not in made:
                    made[field] = _matcher(field, entries.get(field, []), aliases.get(field, []), listed.get(field), places)
                hits = made[field](list(part["raw_value"]))
                yield pd.DataFrame({"field_name": field, "raw_value": part["raw_value"], "distance": [d for d, _ in hits], "item_id": [i for _, i in hits]})

    return run
