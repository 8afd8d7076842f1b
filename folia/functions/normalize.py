"""Scalar normalisers as native column expressions; every function maps one column to one column."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folia.functions.text import ascii_map

UNKNOWN, EMPTY, NO_COUNTRY, PARTIAL = "unknown", "empty", "Unknown", "partial"

# Characters replaced in names, titles and addresses (fixed values).
DASHES = {"‐": "-", "—": "-", "–": "-"}
QUOTES = {"”": "'", "’": "'", '"': "'", "“": "'"}
LANGUAGE_LETTERS = {"Ł": "L", "ł": "l", "ı": "i", "Đ": "D", "&": ""}
PUNCTUATION = {".": "", ",": "", ";": ""}
DROPPED_SYMBOLS = {"'": " ", "*": " ", "#": " ", "|": " "}
CHUNK_SYMBOLS = {"&": "and", "’": "'", ".": "", "-": " ", "§": " ", "(": " ", ")": " ", "/": " ", "'": " "}

# Words of an address written in several ways, and the patterns of those ways (fixed values).
ADDRESS_WORDS = {
    "University": r"\b[a-z]?Univ[aàäcdeéirstyz]{0,8}\b\.?",
    "Laboratory": r"'?\bLab\b\.?|'?\bLabor[aeimorstuy]{0,7}\b\.?",
    "Center": r"\b[CZ]ent[erum]{1,3}\b\.?",
    "Department": r"\bD[eé]{1}p[artemnot]{0,9}\b\.?",
    "Institute": r"\bInst[ituteosky]{0,7}\b\.?|\bIstituto\b",
    "Faculty": r"\bFac[lutey]{0,4}\b\.?",
    "School": r"\bSch[ol]{0,3}\b\.?",
}

# Journal name parts replaced one after the other in this order (fixed values).
JOURNAL_PARTS = [
    ("proceedings of", ""), ("conference record of", ""), ("proceedings", ""), ("communications", ""), ("conference proceedings", ""), ("ieee", ""),
    ("international", "int"), ("conference", "conf"), ("journal of", "j"), ("transactions on", "trans"), ("science", "sci"), ("technology", "tech"), ("engineering", "eng"),
    ("&", "and"), (":", " "), ("-", " "), (",", " "), ("(", " "), (")", " "), ("/", " "), (";", " "),
]

# Document types and their spellings (fixed values).
DOCUMENT_TYPES = {
    "Article": ["Article"],
    "Article; early access": ["Article; Early Access"],
    "Book": ["Book"],
    "Book chapter": ["Book Chapter", "Article; Book Chapter"],
    "Conference paper": ["Conference Paper", "Proceedings Paper", "Article; Proceedings Paper"],
    "Data paper": ["Data Paper", "Article; Data Paper"],
    "Correction": ["Correction"],
    "Editorial material": ["Editorial Material", "Editorial Material; Book Chapter"],
    "Erratum": ["Erratum"],
    "Letter": ["Letter"],
    "Meeting Abstract": ["Meeting Abstract"],
    "Note": ["Note"],
    "Review": ["Review"],
    "Review; early access": ["Review; Early Access"],
    "Short survey": ["Short survey"],
}

# Countries known to the engine by default; a lookup table may replace them.
COUNTRIES = [
    "France", "Germany", "United Kingdom", "United States", "Sweden", "China", "Italy", "Spain", "Japan", "Netherlands", "Switzerland", "Belgium", "Austria", "Australia", "Canada",
    "Brazil", "India", "Russian Federation", "Turkey", "South Korea", "Poland", "Portugal", "Norway", "Denmark", "Finland", "Greece", "Ireland", "Czech Republic", "Slovakia", "Slovenia",
    "Hungary", "Romania", "Bulgaria", "Ukraine", "Viet Nam", "United Arab Emirates", "Mexico", "Argentina", "Chile", "Colombia", "Egypt", "Morocco", "Algeria", "Tunisia", "Iran", "Iraq",
    "Saudi Arabia", "Israel", "Pakistan", "Indonesia", "Malaysia", "Thailand", "Taiwan", "Singapore", "New Zealand", "South Africa", "Niger", "Nigeria", "Belarus", "Iceland", "Palestinian Territory",
]
# Spellings of countries, first match first: (how to compare, spelling, country) (fixed values).
COUNTRY_RULES = [
    *[("is", a, "United Kingdom") for a in ("England", "Wales", "North Ireland", "Scotland")],
    ("has", "Netherlands", "Netherlands"),
    *[("is", a, "United States") for a in ("UNITED STATES", "United States of America", "USA")],
    ("has", "USA", "United States"),
    ("has", "china", "China"),
    ("has", "China", "China"),
    ("is", "Russia", "Russian Federation"),
    ("is", "U Arab Emirates", "United Arab Emirates"),
    ("is", "Vietnam", "Viet Nam"),
    ("is", "Palestine", "Palestinian Territory"),
    *[("is", a, "France") for a in ("FRANCE", "FR", "Fr")],
    *[("is", a, "Belarus") for a in ("BELARUS", "BLR")],
    ("is", "Turkiye", "Turkey"),
]


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def replace_chars(c: Column, table: dict[str, str]) -> Column:
    """Characters replaced by others or deleted; a replacement longer than one character is made first."""
    for old, new in table.items():
        if len(new) > 1:
            c = F.replace(c, F.lit(old), F.lit(new))
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if v == ""]
    return F.translate(c, "".join(single) + "".join(gone), "".join(single.values()))


def to_ascii(c: Column) -> Column:
    """Accents off; other characters outside ASCII are dropped."""
    source, target = ascii_map()
    return F.regexp_replace(F.translate(c, source, target), r"[^\x00-\x7F]", "")


@F.pandas_udf(StringType())
def without_accents(c: pd.Series) -> pd.Series:
    """Compatibility forms taken apart and accents dropped; other characters stay."""
    fold = lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)).strip()
    return c.map(lambda x: x if x is None or x.isascii() else fold(x), na_action="ignore")


def standard_string(c: Column) -> Column:
    """Dashes and quotes unified, symbols to blanks, ASCII only."""
    return to_ascii(replace_chars(replace_chars(replace_chars(c, DASHES), QUOTES), DROPPED_SYMBOLS))


def normalize_country(c: Column, countries: list[str] | None = None) -> Column:
    """The listed country that a spelling means; `Unknown` if none."""
    out = F.when(c.isin(countries or COUNTRIES), c)
    for how, text, country in COUNTRY_RULES:
        out = out.when(c == text if how == "is" else c.contains(text), country)
    return out.otherwise(NO_COUNTRY)


def _address_words(c: Column) -> Column:
    text = standard_string(c)
    for word, pattern in ADDRESS_WORDS.items():
        text = F.regexp_replace(text, f"(?U){pattern}", f"{word} ")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)\s,", ",")


def _with_country(text: Column, add_unknown_country: bool, countries: list[str] | None) -> Column:
    chunks = F.split(text, ",")
    last = F.element_at(F.split(F.element_at(chunks, -1), " - "), -1)
    country = normalize_country(strip(last), countries)
    head = F.array_join(F.slice(chunks, 1, F.size(chunks) - 1), ",")
    known = F.when(F.size(chunks) > 1, F.concat(head, F.lit(", "), country)).otherwise(F.concat(F.lit(" "), country))
    unknown = F.concat(text, F.lit(", "), country) if add_unknown_country else text
    return F.when(country != NO_COUNTRY, known).otherwise(unknown)


def standard_addresses(values: Column, add_unknown_country: bool = True, countries: list[str] | None = None) -> Column:
    """standard_address of every element of an array."""
    return F.transform(F.transform(values, _address_words), lambda t: _with_country(t, add_unknown_country, countries))


def standard_address(c: Column, add_unknown_country: bool = True, countries: list[str] | None = None) -> Column:
    """Words of an address in one writing, and its country by its listed name at the end."""
    return F.get(standard_addresses(F.array(c), add_unknown_country, countries), F.lit(0))  # the words are found once, not in each of their uses


def normalize_journal(c: Column) -> Column:
    """A journal name in lower case with its usual parts shortened."""
    text = F.lower(F.concat(F.lit(" "), c, F.lit(" ")))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s\d{4}\s", " "), r"(?U)\s\d+th\s|\s\d+nd\s", " ")
    for old, new in JOURNAL_PARTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_town(c: Column) -> Column:
    """A town name in lower case with blanks for hyphens and quotes and its saints shortened."""
    text = F.translate(F.lower(c), "-'", "  ")
    return strip(F.replace(F.replace(text, F.lit(" lez "), F.lit(" les ")), F.lit("saint "), F.lit("st ")))


def normalize_type(c: Column, lower: bool = False) -> Column:
    """The document type of a spelling; other types stay. With `lower` both sides are compared in lower case."""
    low = (lambda x: x.lower()) if lower else (lambda x: x)
    c = F.lower(c) if lower else c
    table = {low(s): low(t) for t, spellings in DOCUMENT_TYPES.items() for s in spellings}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[c], c)


def normalize_issn(c: Column) -> Column:
    """dddd-dddd of the digit groups of an ISSN, `unknown` if there is none."""
    digits = F.array_join(F.regexp_extract_all(c, F.lit(r"^\d{8}|\d{4}|\d{3}X"), F.lit(0)), "")
    return F.when(F.length(digits) > 0, F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 1000))).otherwise(UNKNOWN)


def normalize_year(c: Column) -> Column:
    """The year as a number, 0 if it is none."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(0))


def normalize_title(c: Column) -> Column:
    return replace_chars(replace_chars(replace_chars(c, DASHES), LANGUAGE_LETTERS), PUNCTUATION)


def unknown_address(index: Column, with_country: bool = False) -> Column:
    return F.concat(index.cast("string"), F.lit("_unknown, Unknown" if with_country else "_unknown"))


_PART = re.compile(r"[a-zA-Z]+(?=[-'\s])|(?<=[-'])[a-zA-Z]+")  # parts of a name beside a hyphen, a quote or a blank


def tidy_name(text: str, drop_punctuation: bool = True, last_name: bool = False, first_name: bool = False) -> str:
    """A person's name with capitals at the start of its parts, without accents and (by default) punctuation."""
    if "." not in text:
        text = " ".join(w.capitalize() for w in text.split(" "))
    tables = [DASHES, LANGUAGE_LETTERS] + ([PUNCTUATION] if drop_punctuation else [])
    for table in tables:
        text = text.translate(str.maketrans(table))
    text = unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode().strip()
    text = _PART.sub(lambda m: m.group().capitalize(), text)
    if not last_name:
        text = re.sub(r"\s[a-zA-Z]+-[a-zA-Z]+$", lambda m: m.group().upper(), text)
        if first_name:
            text = re.sub(r"[a-zA-Z]+-[a-zA-Z]+\.$|\s[a-zA-Z]+\.$", lambda m: m.group().upper(), text)
    return re.sub(r"^Mc[a-zA-Z]", lambda m: "Mc" + m.group()[2:].upper(), text)


@F.pandas_udf(StringType())
def normalize_name(c: pd.Series) -> pd.Series:
    return c.map(tidy_name, na_action="ignore")


def first_author(c: Column) -> Column:
    """The first of several authors, its initials in capitals; parted by `;`, or by `,` where a cell has none."""
    name = normalize_name(F.element_at(F.split(c, F.when(c.contains(";"), F.lit(";")).otherwise(F.lit(","))), 1))
    words = F.split(name, " ")
    return F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(F.upper(F.element_at(words, -1)))), " ")
