"""Problem 5: variant spellings of names typed by people.

Method: trie join. Names are folded and parted into surname and given names; surnames are sharded by their first and their
last letters into tries, which Levenshtein automata traverse to enumerate the neighbours within one error (a neighbour
transposition is one); then the orders of the name's parts are checked: both orders of a name without initials, either half of a
double surname, and given names against initials.

Which kinds of neighbours are slips of the pen is learned from the corpus: for each kind of error, whether it breaks the letter
sequences of the corpus, and how rare the rarer form is, the share of pairs whose given names agree is compared with the share
among neighbours that no slip explains. A kind is taken when more than half of its agreements are beyond chance.

Shards with more than BLOCK surnames are cut into blocks that meet each other pairwise, so no task holds more than two blocks.
What reaches the driver is bounded: the letter table (at most 29 ** 3 counts) and a few hundred counts of kinds.

Defined cases: NULL, blank and sentinel names take no part; a name without letters matches nothing; equal strings make no
pair; repeated rows count as one spelling; names of any length are compared whole; a table without names gives no pair.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from folia.functions.text import fold_py
from folia.llm.levtrie import LevTrie, distance
from folia.runtime import cut

BLOCK = 20_000
NICK_LIMIT = 100_000
FEW = 30  # names of a shard that meet each other without a trie
BELIEF = 0.5
PARTICLES = {"von", "van", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "al", "el", "ter", "ten", "zu", "zur", "dos", "das", "bin", "ibn", "st"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md"}
GROUP_WORDS = {"collaboration", "collab", "consortium", "group", "team", "the", "working", "study"}
DIGRAPHS = {"ä": "ae", "ö": "oe", "ü": "ue", "ø": "oe", "å": "aa", "æ": "ae", "Ä": "ae", "Ö": "oe", "Ü": "ue", "Ø": "oe", "Å": "aa", "Æ": "ae"}
# Short forms and the given name they stand for, the default of the table `nicknames` (fixed values).
NICKNAMES = {
    "liz": "elizabeth", "beth": "elizabeth", "eliza": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert",
    "bill": "william", "will": "william", "billy": "william", "liam": "william", "dick": "richard", "rick": "richard", "rich": "richard", "jim": "james", "jimmy": "james", "jamie": "james",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kathryn": "katherine", "cathy": "catherine", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margareta",
    "tony": "anthony", "fred": "frederick", "freddy": "frederick", "nick": "nicholas", "mike": "michael", "mick": "michael", "tom": "thomas", "tommy": "thomas", "ted": "edward", "ned": "edward", "ed": "edward", "eddie": "edward",
    "jo": "josephine", "josie": "josephine", "fran": "francesca", "chris": "christopher", "sue": "susan", "suzie": "susan", "ben": "benjamin", "sam": "samuel", "dan": "daniel", "danny": "daniel", "dave": "david", "steve": "stephen",
    "joe": "joseph", "jack": "john", "johnny": "john", "harry": "henry", "hank": "henry", "charlie": "charles", "chuck": "charles", "andy": "andrew", "drew": "andrew", "alex": "alexander", "sasha": "alexander", "sandy": "alexander",
    "matt": "matthew", "greg": "gregory", "jeff": "jeffrey", "ken": "kenneth", "larry": "lawrence", "pat": "patrick", "pete": "peter", "phil": "philip", "ray": "raymond", "ron": "ronald", "tim": "timothy", "vicky": "victoria",
    "becky": "rebecca", "debbie": "deborah", "jenny": "jennifer", "jen": "jennifer", "mandy": "amanda", "nan": "nancy", "patty": "patricia", "trish": "patricia", "sally": "sarah", "theo": "theodore", "abby": "abigail", "gus": "gustav", "max": "maximilian", "bella": "isabella", "cesca": "francesca", "bea": "beatriz", "andi": "andreas", "vic": "viktor", "lex": "alexander", "nadi": "nadia", "hans": "johannes", "sepp": "josef", "toni": "antonio", "pepe": "jose", "paco": "francisco", "lupe": "guadalupe",
}
_INITIALS = re.compile(r"^(?:[^\W\d_]\.-?)+[^\W\d_]?\.?$")
_KEYS = {c: (r, k + 0.4 * r) for r, row in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for k, c in enumerate(row)}


def _letters(text: str) -> str:
    return text if text.isalpha() else "".join(c for c in text if c.isalpha())


def _ways(name: str) -> tuple[list[tuple[list[str], list[str], int]], str]:
    """(words of the surname, words of the given names, whether the order is open) for each way to read a name; the key of a group, which has none."""
    text = fold_py(name).replace("`", "'")
    raw = re.split(r"\s+", re.sub(r"\s*,\s*", " , ", text).strip())
    if any(w.strip(".") in {"collaboration", "collab", "consortium"} for w in raw):
        key = _letters("".join(w for w in raw if w.strip(".,") not in GROUP_WORDS))
        return [], key
    upper = name.split()
    words = [w for w in raw if w.rstrip(".") not in TITLES]
    while len(words) > 2 and words[-1] in PARTICLES:  # a particle moved to the end
        words = [words[-1], *words[:-1]]
    if "," in words:
        k = words.index(",")
        out = [(words[:k], [w for w in words[k + 1 :] if w != ","], 0)]
    else:
        short = [bool(_INITIALS.match(w)) or len(_letters(w)) == 1 for w in words]
        if len(words) > 1 and not any(short) and len(upper[-1]) <= 3 and upper[-1].isupper() and len(upper[0]) > 3:
            short[-1] = True
        if not any(short):
            cuts = _joined(words)
            if len(cuts) < 2:
                out = [(words, [], 0)]
            else:
                out = [(cuts[-1], sum(cuts[:-1], []), 1), (cuts[0], sum(cuts[1:], []), 1)]
        elif short[-1]:
            k = len(words)
            while k and short[k - 1]:
                k -= 1
            out = [(words[:k], words[k:], 0)]
        elif short[0]:
            k = next(i for i, s in enumerate(short) if not s)
            out = [(words[k:], words[:k], 0)]
        else:
            k = max(i for i, s in enumerate(short) if s)
            out = [(words[k + 1 :], words[: k + 1], 0)]
    return out, ""


def surname_keys(name: str) -> list[str]:
    """The surnames of parse()."""
    ways, group = _ways(name)
    return [key for key in ([group] if group else [_letters("".join(surname)) for surname, _, _ in ways]) if key]


def parse(name: str, nick: dict[str, str] = NICKNAMES) -> list[tuple[str, str, str, str, int]]:
    """Ways to read a name: (surname, halves of a double surname, given names, initials, whether the order is open); the given names 'g' mark a group."""
    out, group = _ways(name)
    if group:
        return [(group, "", "", "*", 0)]
    upper = name.split()
    found = []
    for surname, given, order in out:
        key = _letters("".join(surname))
        plain = [w for w in surname if w not in PARTICLES]
        halves = [h for h in (_letters(x) for w in plain for x in w.split("-")) if len(h) > 3]
        full = [_letters(g) for g in given if not _INITIALS.match(g) and len(_letters(g)) > 1 and not (len(g) <= 3 and g not in nick and _is_upper(g, upper))]
        initials = "".join(p[0] if len(_letters(p)) > 1 and not _is_upper(p, upper) else _letters(p) for g in given for p in re.split(r"[-.]", g) if _letters(p))
        if key:
            found.append((key, " ".join(halves) if len(halves) > 1 else "", full[0] if full else "", initials, order))
    return list(dict.fromkeys(found))


def _is_upper(word: str, originals: list[str]) -> bool:
    """A short word of capitals only is a run of initials."""
    return len(word) <= 3 and any(o.isupper() and fold_py(o).strip(",.") == word for o in originals) and any(len(o) > 3 and not o.isupper() for o in originals)


def _joined(words: list[str]) -> list[list[str]]:
    out: list[list[str]] = []
    for w in words:
        if out and out[-1][-1] in PARTICLES:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def umlaut_key(name: str, surname: str) -> str:
    """The surname with digraphs for its umlauts, if it has any."""
    if not any(c in DIGRAPHS for c in name):
        return ""
    wide = _letters(fold_py("".join(DIGRAPHS.get(c, c) for c in name)))
    for k in range(len(wide)):  # the surname with some letters spelled out
        for n in range(len(surname) + 1, len(surname) + 4):
            part = wide[k : k + n]
            if part != surname and _reduced(part) == _reduced(surname) and len(part) > len(surname):
                return part
    return ""


def _reduced(text: str) -> str:
    return text.replace("ae", "a").replace("oe", "o").replace("ue", "u").replace("aa", "a")


def _near_key(a: str, b: str) -> bool:
    p, q = _KEYS.get(a), _KEYS.get(b)
    return p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.2


def slip(base: str, typed: str) -> str:
    """The kind of slip that turns base into typed, '' if none does; slips of the first letter are kinds of their own."""
    kind = _slip(base, typed)
    return f"first {kind}" if kind and base[0] != typed[0] else kind


def _slip(base: str, typed: str) -> str:
    if len(base) == len(typed):
        d = [i for i in range(len(base)) if base[i] != typed[i]]
        if len(d) == 2 and d[1] == d[0] + 1 and base[d[0]] == typed[d[1]] and base[d[1]] == typed[d[0]]:
            return "swap"
        return "key" if len(d) == 1 and _near_key(base[d[0]], typed[d[0]]) else ""
    if len(typed) == len(base) + 1:
        k = next((i for i in range(len(base)) if base[i] != typed[i]), len(base))
        if k and typed[k] == typed[k - 1]:
            return "double"
        return "extra" if (k and _near_key(typed[k], typed[k - 1])) or (k + 1 < len(typed) and _near_key(typed[k], typed[k + 1])) else ""
    return "lost" if len(typed) + 1 == len(base) else ""


def agree(full_1: str, initials_1: str, full_2: str, initials_2: str, nick: dict[str, str] = NICKNAMES) -> int:
    """How far given names agree: 0 not, 1 one abbreviates the other, 2 one equal initial, 3 two equal initials, 4 equal given names."""
    return agree_any([(full_1, initials_1)], [(full_2, initials_2)], nick)


def agree_any(ones: list[tuple[str, str]], others: list[tuple[str, str]], nick: dict[str, str] = NICKNAMES) -> int:
    """The furthest that any of some (given names, initials) agree with any of others, short forms read both ways; by sets, so in proportion to both."""
    x, y = ([(f, i) for f, i in side if i] for side in (ones, others))
    if any(i == "*" for _, i in x) or any(i == "*" for _, i in y):
        return 2 * (("*" in {i for _, i in x}) and ("*" in {i for _, i in y}))
    x, y = (side + [(nick[f], nick[f][0] + i[1:]) for f, i in side if f in nick] for side in (x, y))
    a, b = ({f for f, _ in side if f} for side in (x, y))
    if a & b or _any_near(a, b):
        return 4
    bare_x, bare_y = ({i for f, i in side if not f} for side in (x, y))
    all_x, all_y = ({i for _, i in side} for side in (x, y))
    equal = (bare_x & all_y) | (all_x & bare_y)
    if equal:
        return 3 if any(len(i) > 1 for i in equal) else 2
    starts = lambda side: {i[:n] for i in side for n in range(1, len(i))}
    if (starts(bare_x) & all_y) | (starts(all_x) & bare_y) | (bare_x & starts(all_y)) | (all_x & starts(bare_y)):
        return 1
    cut_off = lambda p, q: any(f[:n] in p for f in q for n in range(3, len(f)))
    alike = {f[:3] for f in a if len(f) in (3, 4)} & {f[:3] for f in b} | {f[:3] for f in a} & {f[:3] for f in b if len(f) in (3, 4)}
    return int(bool(alike) or cut_off(a, b) or cut_off(b, a))


def _any_near(a: set[str], b: set[str]) -> bool:
    """Whether any word of over three letters is within one error of one of the others: both lose one letter and are compared then."""
    less: dict[str, list[str]] = defaultdict(list)
    for x in a:
        if len(x) > 3:
            for k in {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}:
                less[k].append(x)
    for y in b:
        if len(y) > 3:
            for k in {y, *(y[:i] + y[i + 1 :] for i in range(len(y)))}:
                if any(distance(x, y, 1) <= 1 for x in less.get(k, ())):
                    return True
    return False


def read_names(names: DataFrame, nick: dict[str, str] = NICKNAMES) -> DataFrame:
    """names (name, n) to one row per way to read each: (name, n, surname, halves, wide, full, initials, open)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, n, s, h, umlaut_key(name, s), f, i, o) for name, n in zip(b["name"], b["n"], strict=True) for s, h, f, i, o in parse(name, nick)]
            yield pd.DataFrame(rows, columns=["name", "n", "surname", "halves", "wide", "full", "initials", "open"])

    return names.mapInPandas(run, "name string, n long, surname string, halves string, wide string, full string, initials string, open int")


def settle_order(ways: DataFrame) -> DataFrame:
    """Of the two readings of a name without initials, the one whose surname is the rarer given name in the corpus."""
    given = ways.filter("open = 0 and full != ''").groupBy(F.col("full").alias("w")).agg(F.sum("n").alias("g"))
    family = ways.filter("open = 0").groupBy(F.col("surname").alias("w")).agg(F.sum("n").alias("f"))
    known = given.join(family, "w", "full")
    undecided = ways.filter("open = 1")
    scored = undecided.join(known, F.col("surname") == F.col("w"), "left").withColumn("s", F.coalesce("f", F.lit(0)) - F.coalesce("g", F.lit(0))).drop("w", "f", "g")
    best = scored.groupBy("name").agg(F.max_by(F.struct("n", "surname", "halves", "wide", "full", "initials", "open"), F.struct("s", "surname")).alias("b"))
    return ways.filter("open = 0").unionByName(best.select("name", "b.*"))


def trie_join(surnames: DataFrame) -> DataFrame:
    """(a, b), a < b: the surnames within one error of each other, of a table with the distinct column `surname`.

    One error leaves the first or the last letters of five or more. Shorter surnames, where it may leave neither, also meet under their
    forms with one letter less and, for a swap, under their letters in order.
    """
    s, size = F.col("surname"), F.length("surname")
    places = F.sequence(F.lit(1), size)
    less = F.transform(places, lambda k: F.concat(F.lit("d"), F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, size)))
    letters = F.array_join(F.array_sort(F.transform(places, lambda k: F.substring(s, k, F.lit(1)))), "")
    tiny = F.when(size <= 4, F.array_distinct(F.concat(less, F.array(F.concat(F.lit("d"), s), F.concat(F.lit("o"), letters))))).otherwise(F.array().cast("array<string>"))
    keys = F.array_compact(
        F.array(
            F.when((size >= 3) & (size <= 8), F.concat(F.lit("p2"), F.substring(s, 1, 2))),
            F.when((size >= 3) & (size <= 8), F.concat(F.lit("s2"), F.right(s, F.lit(2)))),
            F.when(size >= 7, F.concat(F.lit("p3"), F.substring(s, 1, 3))),
            F.when(size >= 7, F.concat(F.lit("s3"), F.right(s, F.lit(3)))),
        )
    )
    sharded = surnames.select(s, F.explode(F.concat(keys, tiny)).alias("shard"))
    blocks = sharded.groupBy("shard").agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("size > 1").drop("size")
    placed = sharded.join(blocks, "shard").withColumn("own", F.pmod(F.xxhash64("surname"), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("own", b).alias("e"), F.greatest("own", b).alias("q")))
    grid = placed.select("shard", "surname", "own", F.inline(meet))

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        shard, e, q = key
        if len(part) <= FEW:  # a trie would cost more than it saves
            names = sorted(set(part["surname"]))
            close = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if abs(len(a) - len(b)) < 2 and distance(a, b, 1) <= 1]
            return pd.DataFrame(close, columns=["a", "b"], dtype=object)
        turn = (lambda x: x[::-1]) if shard[0] == "s" else (lambda x: x)
        entries = [turn(x) for x in part.loc[part["own"] == e, "surname"]]
        queries = [turn(x) for x in part.loc[part["own"] == q, "surname"]]
        trie = LevTrie(entries)
        i, j, _ = trie.search(queries, np.ones(len(queries), int))
        pairs = {(min(a, b), max(a, b)) for x, y in zip(i, j, strict=True) if (a := turn(queries[x])) != (b := turn(trie.entries[y]))}
        return pd.DataFrame(sorted(pairs), columns=["a", "b"], dtype=object)

    parts = 4 * max(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), grid.sparkSession.sparkContext.defaultParallelism)
    spread = grid.repartition(parts, "shard", "e", "q")  # small data, much work: not to be put together into few tasks
    return spread.groupBy("shard", "e", "q").applyInPandas(search, "a string, b string").distinct()


def letter_model(surnames: DataFrame) -> dict[str, float]:
    """Log probability of each letter after the two before it, from surnames met at least three times."""
    plain = F.concat(F.lit("^^"), F.regexp_replace("surname", "[^a-z]", "?"), F.lit("$"))
    grams = surnames.filter("n >= 3").select(F.explode(F.transform(F.sequence(F.lit(1), F.length(plain) - 2), lambda i: F.substring(plain, i, F.lit(3)))).alias("g"))
    three = {r[0]: r[1] for r in grams.groupBy("g").count().collect()}  # at most 29 ** 3 rows
    two: dict[str, int] = defaultdict(int)
    for g, n in three.items():
        two[g[:2]] += n
    return {g: float(np.log((n + 0.1) / (two[g[:2]] + 2.7))) for g, n in three.items()} | {g + "*": float(np.log(0.1 / (n + 2.7))) for g, n in two.items()}


def oddness(model: dict[str, float], surname: str) -> float:
    text = "^^" + re.sub("[^a-z]", "?", surname) + "$"
    return min(model.get(text[i : i + 3], model.get(text[i : i + 2] + "*", -3.3)) for i in range(len(text) - 2))


def _evidence(model: dict[str, float], nick: dict[str, str]):
    @F.pandas_udf("kind string, odd int, rare int, level int, flip boolean")
    def run(a: pd.Series, na: pd.Series, ga: pd.Series, b: pd.Series, nb: pd.Series, gb: pd.Series) -> pd.DataFrame:
        out = []
        for x, nx, gx, y, ny, gy in zip(a, na, ga, b, nb, gb, strict=True):
            # the rarer form was typed; of two equally rare ones that with the odder letters
            flip = ny > nx or (ny == nx and (oddness(model, y), x) > (oddness(model, x), y))
            base, typed, n = (y, x, nx) if flip else (x, y, ny)
            kind = slip(base, typed)
            if not kind and nx == ny and (kind := slip(typed, base)):
                flip, base, typed = not flip, typed, base
            level = agree_any([(p["full"], p["initials"]) for p in gx], [(p["full"], p["initials"]) for p in gy], nick)
            out.append((kind, int(oddness(model, typed) < oddness(model, base) - 1.5), min(int(n), 3), level, flip))
        return pd.DataFrame(out, columns=["kind", "odd", "rare", "level", "flip"])

    return run


def _believed(counts: list) -> set[tuple[str, int, int, int]]:
    """Kinds of pairs of which more than BELIEF agree beyond chance; chance as among neighbours that no slip explains."""
    table: dict[tuple[str, int, int], dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for kind, odd, rare, level, n in counts:
        table[kind, odd, rare][level] += n
    chance: dict[int, dict[int, float]] = {}
    for rare in (1, 2, 3):
        none: dict[int, int] = defaultdict(int)
        for (kind, _, r), levels in table.items():
            if kind == "" and r == rare:
                for level, n in levels.items():
                    none[level] += n
        chance[rare] = {level: (none[level] + 0.5) / (none[0] + 10.0) for level in (1, 2, 3, 4)}
    out = set()
    for (kind, odd, rare), levels in table.items():
        for level in (1, 2, 3, 4):
            n = levels.get(level, 0)
            if kind and n and 1 - (levels.get(0, 0) * chance[rare][level] + 1.0) / n > BELIEF:
                out.add((kind, odd, rare, level))
    return out


def link_surnames(ways: DataFrame, nick: dict[str, str] = NICKNAMES) -> DataFrame:
    """(surname, root): the surname that each slip of the pen stands for; surnames that are no slip aren't listed."""
    people = ways.filter("initials != '*'")
    table = people.groupBy("surname").agg(F.sum("n").alias("n"), F.collect_set(F.struct("full", "initials")).alias("given"))
    groups = ways.filter("initials = '*'").groupBy("surname").agg(F.sum("n").alias("n"), F.collect_set(F.struct("full", "initials")).alias("given"))
    table = cut(table.withColumn("group", F.lit(False)).unionByName(groups.withColumn("group", F.lit(True))))
    model = letter_model(table)
    near = trie_join(table.select("surname").distinct())
    one, two = (table.select(*[F.col(c).alias(f"{c}_{k}") for c in table.columns]) for k in "ab")
    pairs = near.join(one, F.col("a") == F.col("surname_a")).join(two, (F.col("b") == F.col("surname_b")) & (F.col("group_a") == F.col("group_b")))
    judged = cut(pairs.select("a", "b", "n_a", "n_b", "group_a", _evidence(model, nick)("a", "n_a", "given_a", "b", "n_b", "given_b").alias("e")).select("*", "e.*").drop("e"))
    counts = judged.filter("not group_a").groupBy("kind", "odd", "rare", "level").count().collect()  # a few hundred rows
    believed = _believed([tuple(r) for r in counts])
    taken = F.struct("kind", "odd", "rare", "level").isin([F.struct(*[F.lit(x) for x in k]) for k in sorted(believed)]) if believed else F.lit(False)
    good = judged.filter((~F.col("group_a") & taken) | (F.col("group_a") & (F.col("kind") != "") & (F.col("odd") == 1)))
    links = good.select(
        F.when(F.col("flip"), F.col("a")).otherwise(F.col("b")).alias("surname"),
        F.when(F.col("flip"), F.col("b")).otherwise(F.col("a")).alias("root"),
        F.when(F.col("flip"), F.col("n_b")).otherwise(F.col("n_a")).alias("n"),
        "level", "odd",
    )
    best = links.groupBy("surname").agg(F.max_by("root", F.struct("odd", "level", "n", "root")).alias("root"))
    second = best.select(F.col("surname").alias("root"), F.col("root").alias("root_2"))
    return best.join(second, "root", "left").select("surname", F.coalesce("root_2", "root").alias("root"))


def link_halves(ways: DataFrame, nick: dict[str, str] = NICKNAMES) -> DataFrame:
    """(name, surname): halves of double surnames under which the same given names are met, as further surnames of the name."""
    halves = ways.filter("halves != ''").select("name", "n", "full", "initials", "surname", F.explode(F.split("halves", " ")).alias("half"))
    single = ways.filter("initials != '*'").select(F.col("surname").alias("half"), F.col("initials").alias("i2"), F.col("full").alias("f2")).distinct()
    met = halves.join(single, "half").withColumn("level", _agreement(nick)("full", "initials", "f2", "i2"))
    good = met.filter(F.col("level") >= 2)
    return good.select("name", F.col("half").alias("surname")).distinct()


def _agreement(nick: dict[str, str]):
    @F.pandas_udf(IntegerType())
    def run(f1: pd.Series, i1: pd.Series, f2: pd.Series, i2: pd.Series) -> pd.Series:
        return pd.Series([agree(*x, nick) for x in zip(f1, i1, f2, i2, strict=True)], dtype="int32")

    return run


def link_names(names: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """names (name) to (name_1, name_2): spellings of one author, name_1 < name_2 by code point.

    nicknames (short, full), a table of short forms of given names, goes to every task and replaces the default list NICKNAMES; it may
    have up to NICK_LIMIT rows.
    """
    nick = NICKNAMES
    if nicknames is not None:
        listed = nicknames.select("short", "full").filter("short != '' and full != ''").distinct().limit(NICK_LIMIT + 1).collect()
        if len(listed) > NICK_LIMIT:
            raise ValueError(f"more than {NICK_LIMIT} short forms")
        nick = {_letters(fold_py(a)): _letters(fold_py(b)) for a, b in sorted(listed)}
    counted = names.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))
    ways = cut(settle_order(read_names(counted, nick)))
    roots = link_surnames(ways, nick)
    wide = ways.filter("wide != ''").select("name", F.col("wide").alias("surname"))
    wide = wide.unionByName(ways.filter("surname like '%rn%'").select("name", F.replace("surname", F.lit("rn"), F.lit("m")).alias("surname")))
    # a name stands under its surname, the digraph form of it where somebody writes so, and halves under which it is met
    used = ways.select("surname").distinct()
    more = wide.join(used, "surname", "left_semi").unionByName(link_halves(ways, nick).select("name", "surname"))
    under = ways.select("name", "surname").unionByName(more.select("name", "surname")).distinct()
    given = ways.select("name", "full", "initials")
    rooted = under.join(roots, "surname", "left").select("name", F.coalesce("root", "surname").alias("root")).distinct().join(given, "name")
    first = F.array_distinct(F.array(F.substring("initials", 1, 1), F.substring(_full_form(nick)("full"), 1, 1)))
    placed = rooted.select("name", "root", "full", "initials", F.explode(F.filter(first, lambda c: c != "")).alias("first"))
    # spellings of equal given names are one form: forms meet first, their spellings last
    placed = cut(placed.withColumn("form", F.xxhash64("root", "first", "full", "initials")))
    forms = placed.select("root", "first", "full", "initials", "form").distinct()
    other = forms.select("root", "first", F.col("full").alias("f2"), F.col("initials").alias("i2"), F.col("form").alias("form_2"))
    alike = forms.join(other, ["root", "first"]).filter("form <= form_2").filter(_agreement(nick)("full", "initials", "f2", "i2") > 0).select("form", "form_2")
    one, two = placed.select("form", F.col("name").alias("x")), placed.select(F.col("form").alias("form_2"), F.col("name").alias("y"))
    met = alike.join(one, "form").join(two, "form_2").filter("x != y")
    return met.select(F.least("x", "y").alias("name_1"), F.greatest("x", "y").alias("name_2")).distinct()


def _full_form(nick: dict[str, str]):
    @F.pandas_udf(StringType())
    def run(full: pd.Series) -> pd.Series:
        return full.map(lambda x: nick.get(x, x))

    return run


def names_with_affiliations(cell: Column) -> Column:
    """The names of a cell of authors with their affiliations."""
    entry = F.split(cell, "; ")
    return F.transform(entry, lambda e: F.when(F.substring_index(e, ",", 1).contains("."), F.substring_index(e, ",", 1)).otherwise(F.array_join(F.slice(F.split(e, ",\\s*"), 1, 2), ", ")))


__all__ = ["agree", "link_names", "names_with_affiliations", "parse", "slip", "trie_join"]
