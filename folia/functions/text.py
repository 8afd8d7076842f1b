"""Character folding as native column expressions; every table is derived from Unicode data or listed once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter (fixed values).
LOOKALIKE_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗԛԝаеѕіјорсухһԁԚԜҮ", "ABESIJKMHOPCTYX3qwaesijopcyxhdQWY", strict=True))
LOOKALIKE_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc", strict=True))
LOOKALIKES = LOOKALIKE_CYRILLIC | LOOKALIKE_GREEK
# Characters without width and blanks other than the plain one (fixed values).
INVISIBLE = "\u00ad\u034f\u061c\u115f\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
SPECIAL_LETTERS = dict(zip("øØłŁđĐðÐıħĦ", "oOlLdDdDihH", strict=True))


@lru_cache(1)
def ascii_map() -> tuple[str, str]:
    """Characters of the basic plane whose canonical decomposition starts with an ASCII character, and that character."""
    pairs = {}
    for code in range(0x80, 0x10000):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[:1]
        if base != ch and base.isascii():
            pairs[ch] = base
    return "".join(pairs), "".join(pairs.values())


@lru_cache(1)
def fold_map() -> tuple[str, str]:
    """Accents, look-alikes, full-width forms, blanks and hyphens to plain lower-case characters; the longer first string deletes invisibles and combining marks."""
    source, target = ascii_map()
    pairs = dict(zip(source, target, strict=True)) | LOOKALIKES | SPECIAL_LETTERS
    pairs |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    pairs |= dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-") | {"’": "'", "‘": "'", "ʼ": "'", "\t": " ", "\n": " ", "\r": " "}
    pairs |= {chr(c): chr(c + 32) for c in range(65, 91)}
    pairs = {k: v.lower() for k, v in pairs.items()}
    gone = INVISIBLE + "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(pairs) + gone, "".join(pairs.values())


def fold(c: Column) -> Column:
    """Lower-case plain form of a text for comparisons; letters of foreign scripts without a Latin look-alike stay."""
    source, target = fold_map()
    return F.trim(F.replace(F.translate(c, source, target), F.lit("ß"), F.lit("ss")))


@lru_cache(1)
def _fold_table() -> dict[int, str | None]:
    source, target = fold_map()
    table: dict[int, str | None] = {ord(ch): (target[i] if i < len(target) else None) for i, ch in enumerate(source)}
    table[ord("ß")] = "ss"
    return table


def fold_py(text: str) -> str:
    """fold() for use inside Arrow functions; equal to it on every string."""
    if text.isascii():
        return text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").strip(" ")
    return text.translate(_fold_table()).strip(" ")
