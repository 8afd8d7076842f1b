"""Institutions of addresses: an address is cut into chunks, the chunks that name places are dropped, the rest is matched with a dictionary.

Distinct addresses are resolved once. The dictionary, the towns and the types are lookup tables of a checked size.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folia.functions.normalize import ADDRESS_WORDS, CHUNK_SYMBOLS, DASHES, DROPPED_SYMBOLS, EMPTY, QUOTES, normalize_country, normalize_town, replace_chars, strip, without_accents
from folia.operators.aggregate import roll_up
from folia.runtime import cut, rows_and_bytes, store

LOOKUP_LIMIT = 64 << 20  # bytes of text in a lookup table that is broadcast; larger ones are joined by shuffle

# Words by which a chunk of an address is dropped or kept (fixed values).
DROP_SUFFIX = ["campus", "laan", "park", "platz", "staal", "strae", "strasse", "straße", "vej", "waldring", "weg", "schule", "-ku", "-cho", "-ken", "-shi", "-gun", "alleen", "vagen", "vei", "-gu", "-do", "-si", "shire"]
DROP_WORDS = [
    "alle", "alleen", "area", "avda", "avda.", "bd", "bldg", "box", "bp", "building", "c", "calla", "calle", "camino", "carrera", "carretera", "cesta", "cho", "circuito", "city", "ciudad", "complejo",
    "corso", "country", "ctra", "cubillos", "district", "edificio", "east", "esplanade", "estrada", "floor", "jardim", "jardins", "km", "ku", "lane", "largo", "linder", "mall", "marg", "p.", "p.le",
    "p.o.box", "parcella", "passeig", "pk", "playa", "plaza", "parc", "park", "parque", "piazza", "piazzale", "po", "pob", "pola", "pza", "pzza", "rambla", "rd", "rua", "road", "sec.", "sc", "s-n", "s/n",
    "sp", "st", "st.", "strada", "street", "str", "str.", "tietotie", "vei", "veien", "vej", "via", "viale", "vialle", "voc.", "w", "way", "west", "zona",
]
DROP_WORDS_FRANCE = [
    "allee", "antenne", "av", "av.", "ave", "avenue", "ba", "bat", "bat.", "batiment", "blv.", "blvd", "boulevard", "campus", "cedex", "ch.", "chemin", "complexe", "cours", "cs", "domaine", "esplanade",
    "foret", "immeuble", "montee", "no.", "p", "p°", "parcelle", "parvis", "pl", "pl.", "place", "parc", "plan", "pole", "quai", "r", "r.", "rambla", "region", "route", "rue", "site", "v.", "via", "villa",
    "voie", "zac", "zi", "z.i.", "zone",
]
KEEP_PREFIX = ["ea", "fr", "u", "ulr", "umr", "ums", "upr"]
KEEP_BASIC = ["beamline", "crg", "ea", "ed", "equipe", "ulr", "umr", "ums", "upr"]
KEEP_USER = ["cea", "cemhti", "cnrs", "esrf", "femto st", "imec", "ines", "insa", "inserm", "ircelyon", "ku leuven", "lamcos", "lepmi", "liten", "locie", "spline", "stmicroelectronics", "tno", "umi", "vtt"]
KEEP_GENERAL = [w.lower() for w in ADDRESS_WORDS]
SMALL_WORDS = ["the", "and", "of", "for", "de", "et", "la", "aux", "a", "sur", "pour", "en", "l", "d", "le"]
ACRONYMS = ["fr", "fre", "ulr", "umr", "ums", "u", "upr", "ur"]
# Patterns of postal codes, digits and boxes (fixed values).
ZIP_UK = r"^\s?[a-z]{1,2}\d{1,2}[a-z]{0,1}\s?\d{1,2}[a-z]{1,2}$"
ZIP_STATES = r"^\s?[a-z]{2}$|^\s?[a-z]{2}\s[a-z0-9]{3,4}\s[a-z0-9]{2,3}$"
DIGITS = r"\s?\d+(-\d+)?\b|\b[a-z]+(-)?\d{2,}\b"
BOX = r"\bbp\s?\d+[a-z]?\b|\b\d+bp\b"


def _any_word(words: list[str]) -> str:
    quoted = sorted({w.replace("\\", "").replace(".", r"\.").replace("/", r"\/") for w in words}, key=len, reverse=True)
    return r"(?U)(?<![\w])(?:" + "|".join(quoted) + r")(?=[\s)]|$|\b)"


def split_address(address: Column) -> tuple[Column, Column]:
    """(chunks, country): parted by comma, ` - ` and ` | `; of equal chunks the last stays; the last chunk is the country."""
    chunks = F.transform(F.split(address, ","), strip)
    n = F.size(chunks)
    last_of_each = F.filter(chunks, lambda x, i: ~F.array_contains(F.slice(chunks, i + 2, F.greatest(n - i - 1, F.lit(0))), x))
    country = F.element_at(last_of_each, -1)
    parts = F.flatten(F.transform(last_of_each, lambda x: F.split(x, r" - | \| ")))
    return F.transform(parts, strip), country


def chunk_flags(chunk: Column, country: Column, is_town: Column, zip_pattern: Column) -> Column:
    """What speaks for dropping or keeping a chunk (lower case, no accents). The patterns are fixed forms."""
    france = country == "France"
    prefix = chunk.rlike(r"\b(?:" + "|".join(KEEP_PREFIX) + r")-?\d{4}\b")
    zip_hit = F.when(country == "United Kingdom", chunk.rlike(ZIP_UK)).when(country.isin("United States", "Canada"), chunk.rlike(ZIP_STATES)).otherwise(F.coalesce(F.expr("false") | F.regexp_like(chunk, F.coalesce(zip_pattern, F.lit("(?!)"))), F.lit(False)))
    listed = country.isin("United Kingdom", "United States", "Canada") | zip_pattern.isNotNull()
    return F.struct(
        chunk.alias("text"),
        chunk.rlike(BOX).alias("bp"),
        (listed & ~prefix & (zip_hit | chunk.rlike(DIGITS))).alias("digits"),
        chunk.rlike(r"(?:\B(?:" + "|".join(DROP_SUFFIX) + r")\b)|(?:\b(?:" + "|".join(s for s in DROP_SUFFIX if s[0] != "-") + r")\b)").alias("suffix"),
        is_town.alias("town"),
        (chunk.rlike(_any_word(DROP_WORDS_FRANCE)) | (~france & chunk.rlike(_any_word(DROP_WORDS)))).alias("words"),
        (france & chunk.rlike(r"\b(?:" + "|".join(KEEP_PREFIX) + r")[\s-]?\d{3,4}\b")).alias("prefix"),
        chunk.rlike(_any_word(KEEP_GENERAL)).alias("gen"),
        chunk.rlike(_any_word(KEEP_BASIC)).alias("basic"),
        chunk.rlike(_any_word(KEEP_USER)).alias("user"),
    )


def keep_chunks(flags: Column, country: Column, n: Column) -> Column:
    """Numbers of the chunks that stay: one pass over the n flags with a bit that stops it."""
    local = country.isin("France", "Algeria")
    indexed = F.transform(flags, lambda f, i: F.struct(f.alias("f"), i.alias("i")))

    def step(state: Column, e: Column) -> Column:
        f, i = e["f"], e["i"]
        kept = f["gen"] | f["basic"] | f["user"]
        strong = f["gen"] | f["user"]
        none = ~(f["bp"] | f["digits"] | f["suffix"] | f["town"] | f["words"])
        digits_stop = f["digits"] & F.when(local, ~f["prefix"] & ~kept).otherwise(~strong | f["words"])
        after_digits = f["digits"] & ~digits_stop
        town_stop = f["town"] & (n - i - 1 <= 2)
        suffix_stop = ~f["town"] & f["suffix"] & ~strong
        words_keep = ~f["town"] & ~f["suffix"] & f["words"] & kept & ~f["digits"]
        words_stop = ~f["town"] & ~f["suffix"] & f["words"] & ~words_keep
        stop = f["bp"] | digits_stop | town_stop | suffix_stop | words_stop
        keep = none | (~f["bp"] & ~digits_stop & ((after_digits & ~words_stop) | (~f["town"] & f["suffix"] & strong) | words_keep))
        short = F.length(f["text"]) <= 3
        first = i == 0
        add = first | (~state["stopped"] & ~short & keep)
        return F.struct(
            (state["stopped"] | (~first & ~short & stop)).alias("stopped"),
            F.when(add, F.concat(state["out"], F.array(i))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(False).alias("stopped"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(indexed, start, step, lambda s: s["out"])


def words_of(alias: Column) -> Column:
    """The sets of words that an alias asks for: its words without small ones, and glued together if it is an acronym and a number."""
    text = without_accents(alias)
    for word, pattern in ADDRESS_WORDS.items():
        text = F.regexp_replace(text, f"(?U){pattern}", f"{word} ")
    text = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)\s,", ","))
    text = replace_chars(replace_chars(replace_chars(replace_chars(text, DASHES), QUOTES), CHUNK_SYMBOLS), DROPPED_SYMBOLS)
    words = F.array_distinct(F.split(strip(text), " "))
    plain = F.filter(words, lambda w: ~w.isin(*SMALL_WORDS) & (w != ""))
    glued = (F.size(words) == 2) & F.exists(words, lambda w: w.isin(*ACRONYMS))
    both = F.array(plain, F.array(F.regexp_replace(strip(text), " ", "")))
    return F.when(glued, both).otherwise(F.array(plain))


def dictionary(affiliations: DataFrame) -> DataFrame:
    """(country, norm_aff, words) of a table (country, norm_aff, alias); blank aliases are skipped."""
    return affiliations.filter("alias is not null and trim(alias) != ''").select("country", "norm_aff", F.explode(words_of(F.col("alias"))).alias("words"))


def unpivot(table: DataFrame, country: str, norm: str, aliases: list[str]) -> DataFrame:
    """(country, norm_aff, alias) of a wide table with one column per alias."""
    return table.select(F.col(country).alias("country"), F.col(norm).alias("norm_aff"), F.explode(F.array(*aliases)).alias("alias")).filter("alias is not null")


def small(table: DataFrame) -> DataFrame:
    """A lookup table, stored, and broadcast if its size is within LOOKUP_LIMIT."""
    table = cut(table)
    return F.broadcast(table) if rows_and_bytes(table)[1] <= LOOKUP_LIMIT else table


@F.pandas_udf(ArrayType(StringType()))
def _fold_chunks(chunks: pd.Series) -> pd.Series:
    import unicodedata

    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).strip().lower()
    return chunks.map(lambda row: [fold(x) for x in row], na_action="ignore")


def affiliations_of(addresses: DataFrame, towns: DataFrame, zips: DataFrame, drop: bool = True) -> DataFrame:
    """(address, country, affiliations): the kept chunks of each distinct standardised address.

    towns (country, town) and zips (country, pattern) are lookup tables.
    """
    chunks, country = split_address(F.col("address"))
    distinct = addresses.select("address").filter(F.col("address").isNotNull()).distinct()
    cut_up = store(distinct.withColumns({"chunks": chunks, "country": country}).withColumn("folded", _fold_chunks("chunks")))
    # every chunk of a country is looked up and tested once
    each = cut_up.select("address", "country", F.posexplode("folded").alias("pos", "chunk"))
    listed = towns.select("country", normalize_town(F.col("town")).alias("town")).distinct().withColumn("is_town", F.lit(True))
    asked = each.select("country", "chunk").distinct().withColumn("town", F.translate("chunk", "-'", "  ")).join(small(zips), "country", "left").join(small(listed), ["country", "town"], "left")
    flags = chunk_flags(F.col("chunk"), F.col("country"), F.coalesce("is_town", F.lit(False)), F.col("pattern"))
    tested = each.join(asked.select("country", "chunk", flags.alias("f")), ["country", "chunk"])
    lists = tested.groupBy("address").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]).alias("flags"))
    cut_up = cut_up.join(lists, "address").withColumn("n", F.size("chunks"))
    cut_up = cut_up.withColumn("kept", keep_chunks(F.col("flags"), F.col("country"), F.col("n")) if drop else F.sequence(F.lit(0), F.col("n") - 1))
    aliases = F.array(F.col("country"), *[F.lit(a) for a in ("England", "Wales", "North Ireland", "Scotland")])
    named = F.filter(F.transform("kept", lambda i: F.get("chunks", i)), lambda c: ~F.array_contains(aliases, c) & (c != ""))
    return cut_up.select("address", "country", named.alias("affiliations"))


def match_institutions(affiliations: DataFrame, words: DataFrame, types: DataFrame, separator: str = "; ") -> DataFrame:
    """(address, country, norm_institutions, raw_institutions): normalised names in order of their type's level, and chunks without one."""
    chunk = replace_chars(F.col("chunk"), CHUNK_SYMBOLS)
    each = affiliations.select("address", "country", F.posexplode_outer("affiliations").alias("pos", "chunk"))
    tokens = F.array_distinct(F.filter(F.split(F.lower(without_accents(chunk)), r"[\s)]+"), lambda t: t != ""))
    each = each.withColumn("tokens", tokens)
    # every set of words is met through its longest word, the others are checked on the few pairs that share it
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = small(words.filter(F.size("words") > 0).withColumn("token", longest))
    met = each.select("address", "country", "pos", "tokens", F.explode("tokens").alias("token")).join(keyed, ["country", "token"])
    found = met.filter(F.size(F.array_except("words", "tokens")) == 0).select("address", "pos", "norm_aff").distinct()
    level = F.element_at(F.split("norm_aff", " "), -1).alias("abbreviation")
    leveled = found.withColumn("abbreviation", level).join(small(types.select("abbreviation", "level")), "abbreviation", "left")
    norms = leveled.groupBy("address").agg(F.array_sort(F.collect_set(F.struct("level", "norm_aff"))).alias("n"))
    names = F.transform("n", lambda x: x["norm_aff"])
    paris = F.size(F.filter(names, lambda x: x.contains("Univ") & x.contains("Paris"))) > 1
    norms = norms.select("address", F.when(paris, F.array_remove(names, "Paris-Cité Univ")).otherwise(names).alias("norm"))
    unknown = each.filter(F.col("chunk").isNotNull()).join(found.select("address", "pos").distinct(), ["address", "pos"], "left_anti")
    known_country = words.select("country").distinct().withColumn("_known", F.lit(True))
    unknown = unknown.join(small(known_country), "country", "left").withColumn("raw", F.when(F.col("_known"), chunk).otherwise(F.col("chunk")))
    raws = unknown.groupBy("address").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("r")).select("address", F.transform("r", lambda x: x["raw"]).alias("raw"))
    joined = lambda c: F.coalesce(F.nullif(F.array_join(c, separator), F.lit("")), F.lit(EMPTY))
    out = affiliations.select("address", "country").join(norms, "address", "left").join(raws, "address", "left")
    return out.select("address", "country", joined("norm").alias("norm_institutions"), joined("raw").alias("raw_institutions"))


class Lookups(NamedTuple):
    """The lookup tables that institutions are resolved with."""

    words: DataFrame  # (country, norm_aff, words), as dictionary() gives it
    types: DataFrame  # (abbreviation, level)
    towns: DataFrame  # (country, town)
    zips: DataFrame  # (country, pattern)


def build_institutions(addresses: DataFrame, lookups: Lookups) -> dict[str, DataFrame]:
    """countries, norm_institutions, raw_institutions of an address table (pub_id, idx_address, address), addresses standardised."""
    addresses = store(addresses)
    resolved = match_institutions(cut(affiliations_of(addresses, lookups.towns, lookups.zips)), cut(lookups.words), lookups.types)
    rows = addresses.join(resolved, "address")
    return {
        "countries": rows.select("pub_id", "idx_address", normalize_country(F.col("country")).alias("country")),
        "norm_institutions": rows.select("pub_id", "idx_address", F.col("norm_institutions").alias("institution")),
        "raw_institutions": rows.select("pub_id", "idx_address", F.col("raw_institutions").alias("institution"), "address"),
    }


def author_institutions(rows: DataFrame, lookups: Lookups | None) -> DataFrame:
    """rows (pub_id, idx_author, address, country) with norm_institutions and raw_institutions, one row per author, sorted.

    No chunk of an address is dropped here. Without lookups both are `empty`.
    """
    if lookups is None:
        named = rows.withColumns({"norm_institutions": F.lit(EMPTY), "raw_institutions": F.lit(EMPTY)})
    else:
        rows = store(rows)
        chunks = cut(affiliations_of(rows, lookups.towns, lookups.zips, drop=False))
        resolved = match_institutions(chunks, cut(lookups.words), lookups.types, ";").drop("country")
        named = rows.join(resolved, "address", "left")
    return roll_up(named).sort("pub_id", "idx_author")


def flag_author_institutions(rows: DataFrame, flags: list[tuple[str, str]] | None) -> DataFrame:
    """The table of author institutions with a 0/1 column for each (name, column) asked for; all its columns are kept."""
    return flag_institutions(rows, flags, list(rows.columns)) if flags else rows


def flag_institutions(rows: DataFrame, flags: list[tuple[str, str]], keep: list[str], norm: str = "norm_institutions") -> DataFrame:
    """The first columns with a 0/1 column for each (name, column) that the normalised names hold."""
    return rows.select(*keep, *[F.coalesce(F.contains(norm, F.lit(name)), F.lit(False)).cast("int").alias(column) for name, column in flags])
