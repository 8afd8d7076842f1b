"""Problem 7: text that looks the same but differs in its characters.

Method: script-aware repair. Blanks, hyphens, full-width forms, combining accents and characters without width are brought
to their ordinary form at once. Then the dominant script of every token is taken; letters of another script that only look
like it are substituted in mixed-script tokens when the result is a word of the corpus vocabulary, the words of all cells
that aren't themselves in question. A mixed token that the vocabulary doesn't hold (a name met once) is still repaired when every pair of
neighbouring letters of the result stands in a word of the vocabulary. Beyond the method a token wholly in another script than
the rest of its cell (an initial, a short word) is repaired too, if the vocabulary knows the result.

Defined cases: a NULL text has no ordinary form and is never found; an empty text is ordinary; repeated rows give one row;
a text in Greek, Cyrillic or Chinese script is ordinary as long as its own letters are; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folia.functions.text import BLANKS, HYPHENS, INVISIBLE, LOOKALIKE_CYRILLIC, LOOKALIKE_GREEK
from folia.runtime import cut

#: A cell without any of these needs no closer look: ASCII and composed Latin letters.
SUSPECT = r"[^\x20-\x7E¡-¬®-ɏḀ-ỿ‘-‟…⁰-ₜ一-鿿]"
WORD = r"\p{L}+"
_CANDIDATES = "array<struct<word:string,plain:string,mixed:boolean>>"
# Letters of rarer scripts that are drawn like a Latin one (fixed values).
LOOKALIKE_RARE = dict(zip("ɑɡɩᴄᴏᴠᴡᴢՕօոսհցՏᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏴⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "agicovwzOonuhgSDRTiAJEWMHGZRWVSLCPKBBHIKMNOPCTYXopc", strict=True))
# Ranges of letters that belong to a script with look-alikes (fixed values).
_SCRIPTS = [(0x250, "LATIN"), (0x2B0, "PHONETIC"), (0x370, "LATIN"), (0x400, "GREEK"), (0x530, "CYRILLIC"), (0x590, "ARMENIAN"), (0x13A0, "OTHER"), (0x1400, "CHEROKEE"), (0x1D00, "OTHER"), (0x1DC0, "PHONETIC"), (0x1E00, "OTHER"), (0x1F00, "LATIN"), (0x2000, "GREEK"), (0x2C80, "OTHER"), (0x2D00, "COPTIC")]
_STARTS, _NAMES = [code for code, _ in _SCRIPTS], [name for _, name in _SCRIPTS]


@lru_cache(1)
def _tables() -> tuple[dict[int, str | None], dict[str, dict[str, str]]]:
    simple: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    simple |= {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in HYPHENS}
    simple |= {code: unicodedata.normalize("NFKC", chr(code)) for code in range(0x2160, 0x2180)}  # Roman numerals in one character
    to_latin = LOOKALIKE_CYRILLIC | LOOKALIKE_GREEK | LOOKALIKE_RARE
    back = {
        "LATIN": to_latin,
        "CYRILLIC": {v: k for k, v in reversed(LOOKALIKE_CYRILLIC.items()) if v.isalpha()},
        "GREEK": {v: k for k, v in reversed(LOOKALIKE_GREEK.items())},
    }
    back["CYRILLIC"] |= {g: back["CYRILLIC"][v] for g, v in LOOKALIKE_GREEK.items() if v in back["CYRILLIC"]}
    back["GREEK"] |= {c: back["GREEK"][v] for c, v in LOOKALIKE_CYRILLIC.items() if v in back["GREEK"]}
    return simple, back


def script(ch: str) -> str:
    at = bisect_right(_STARTS, ord(ch))
    return _NAMES[at] if at < len(_NAMES) else "OTHER"


def plain_form(text: str) -> str:
    """All substitutions that need no vocabulary."""
    simple, _ = _tables()
    if any("一" <= c <= "鿿" for c in text):  # full-width punctuation belongs to that script
        text = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" and chr(ord(c) - 0xFEE0).isalnum() else c for c in text)
    else:
        text = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text)
    text = text.translate(simple)
    text = "".join(unicodedata.normalize("NFKC", c) if "ﬀ" <= c <= "ﬆ" or "\U0001d400" <= c <= "\U0001d7ff" else c for c in text)
    return unicodedata.normalize("NFC", text)


_WORDS = re.compile(r"[^\W\d_]+")


def candidates(text: str) -> list[tuple[str, str, bool]]:
    """(token, token with look-alikes of its dominant script, whether it mixes scripts) for the tokens of a plain text."""
    tokens = [m.group() for m in _WORDS.finditer(text)]
    counts: dict[str, int] = {}
    for t in tokens:
        for c in t:
            counts[script(c)] = counts.get(script(c), 0) + 1
    home = max(sorted(counts), key=lambda s: (counts[s], s == "LATIN")) if counts else "LATIN"
    _, tables = _tables()
    out = []
    for t in dict.fromkeys(tokens):
        own: dict[str, int] = {}
        for c in t:
            own[script(c)] = own.get(script(c), 0) + 1
        mixed = len(own) > 1
        if not mixed and home in own:
            continue
        main = max(sorted(own), key=lambda s: (own[s], s == home)) if mixed else home
        ways = [main] + [s for s in own if s not in (main, "OTHER") and mixed]
        for way in ways if home not in ways else [home, *[w for w in ways if w != home]]:
            table = tables.get(way)
            if table and all(script(c) == way or c in table for c in t):
                plain = "".join(c if script(c) == way else table[c] for c in t)
                single = len(t) == 1
                if single and not t.isupper():
                    continue
                out.append((t, plain, mixed))
                break
    return out


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        plain = [plain_form(x) for x in b["text"]]
        found = [candidates(x) for x in plain]
        own = [sorted({w.lower() for w in _WORDS.findall(x)} - {t.lower() for t, _, _ in f}) for x, f in zip(plain, found, strict=True)]
        yield pd.DataFrame({"text": b["text"], "plain": plain, "found": found, "own": own})


def _pairs(c: Column) -> Column:
    """The pairs of neighbouring letters of a word, its ends marked."""
    word = F.concat(F.lit("^"), c, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))


def _suspect(c: Column) -> Column:
    """Whether a text needs a closer look; plain ASCII, told by its bytes, never does."""
    return (F.octet_length(c) > F.length(c)) & c.rlike(SUSPECT)


def repair_lookalikes(cells: DataFrame, text: str = "text") -> DataFrame:
    """Adds to each distinct text that isn't in ordinary form its ordinary form: columns (text, plain)."""
    texts = cells.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells.sparkSession.sparkContext.defaultParallelism)
    odd = texts.filter(_suspect(F.col("text"))).distinct().repartition(parts, F.xxhash64("text"))
    suspects = cut(odd.mapInPandas(_inspect, f"text string, plain string, found {_CANDIDATES}, own array<string>"))
    asked = suspects.select("text", F.inline("found")).withColumn("w", F.lower("plain"))
    pieces = texts.filter(~_suspect(F.col("text"))).select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    vocabulary = pieces.select(F.explode(F.regexp_extract_all("w", F.lit(WORD), F.lit(0))).alias("w"))
    vocabulary = cut(vocabulary.unionByName(suspects.select(F.explode("own").alias("w"))).distinct())
    known = vocabulary.join(asked.select("w").distinct(), "w", "left_semi").withColumn("known", F.lit(True))
    judged = cut(asked.join(known, "w", "left"))
    # names met once: their letter sequences instead of the whole word
    once = judged.filter("known is null and mixed").select("w").distinct().select("w", F.explode(F.array_distinct(_pairs(F.col("w")))).alias("pair"))
    met = once.select("pair").distinct().join(vocabulary.select(F.explode(_pairs(F.col("w"))).alias("pair")).distinct(), "pair").withColumn("met", F.lit(True))
    likely = once.join(met, "pair", "left").groupBy("w").agg(F.bool_and(F.coalesce("met", F.lit(False))).alias("likely"))
    taken = judged.join(likely, "w", "left").filter("known or (mixed and likely)")
    swaps = taken.groupBy("text").agg(F.map_from_entries(F.collect_set(F.struct("word", F.col("plain").alias("to")))).alias("swap"))
    return suspects.join(swaps, "text", "left").select("text", _swap("plain", "swap").alias("plain")).filter("text != plain")


def find_lookalikes(cells: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, text, plain) of the cells that aren't in ordinary form."""
    odd = cells.select(*keys, F.col(text).alias("text")).filter(_suspect(F.col("text")))
    return odd.join(repair_lookalikes(cells, text), "text").select(*keys, "text", "plain").distinct()


@F.pandas_udf(StringType())
def _swap(plain: pd.Series, swap: pd.Series) -> pd.Series:
    return pd.Series([x if not m else _WORDS.sub(lambda w, m=dict(m): m.get(w.group(), w.group()), x) for x, m in zip(plain, swap, strict=True)], dtype=object)
