"""One row per element of packed cells: authors, keywords, subjects, addresses and cited references of the two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.normalize import EMPTY, NO_COUNTRY, PARTIAL, UNKNOWN, normalize_country, normalize_name, standard_addresses, strip, unknown_address

SKIPPED_AUTHORS = ("Dr", "Pr", "Dr ", "Pr ")
# Bracketed authors and the address behind them, matched together (fixed form).
BRACKETS = r"\[([^\]]*)\]\s*([^;\[]*)"


def authors_a(rows: DataFrame, pub_id: str, cell: str) -> DataFrame:
    """(pub_id, idx_author, co_author): parted by `;`, or by `,` where a cell has none; full stops dropped, blanks kept."""
    c = F.col(cell)
    parts = F.when(c.contains(";"), F.split(c, ";")).otherwise(F.split(c, ","))
    kept = F.filter(F.transform(parts, lambda x: F.replace(x, F.lit("."), F.lit(""))), lambda x: ~x.isin(*SKIPPED_AUTHORS))
    return rows.select(pub_id, F.posexplode(kept).alias("idx_author", "co_author"))


def authors_b(rows: DataFrame, pub_id: str, cell: str) -> DataFrame:
    """(pub_id, idx_author, co_author): parted by `;`, names normalised, initials in capitals."""
    kept = F.filter(F.split(cell, ";"), lambda x: ~x.isin(*SKIPPED_AUTHORS))
    names = rows.select(pub_id, F.posexplode(kept).alias("idx_author", "raw")).withColumn("name", normalize_name("raw"))
    words = F.split("name", " ")
    full = F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(F.upper(F.element_at(words, -1)))), " ")
    return names.select(pub_id, "idx_author", full.alias("co_author"))


def keywords(rows: DataFrame, pub_id: str, cell: str) -> DataFrame:
    """(pub_id, keyword): parted by `;`, lower case, trimmed; `null` means unknown; empty ones are dropped, repeated ones kept."""
    word = strip(F.lower(F.col("raw")))
    out = rows.select(pub_id, F.explode(F.split(F.coalesce(cell, F.lit(UNKNOWN)), ";")).alias("raw"))
    return out.select(pub_id, F.when(word == "null", UNKNOWN).otherwise(word).alias("keyword")).filter("keyword != ''")


def parted(rows: DataFrame, pub_id: str, cell: str, name: str) -> DataFrame:
    """(pub_id, name): subjects and the like, parted by `;` and trimmed."""
    return rows.filter(F.col(cell).isNotNull()).select(pub_id, F.explode(F.transform(F.split(cell, ";"), strip)).alias(name)).filter(F.col(name) != "")


def _chunks(c: Column) -> Column:
    return F.transform(F.split(c, ","), strip)


def _address_tables(listed: DataFrame, pub_id: str) -> dict[str, DataFrame]:
    chunks = _chunks(F.col("address"))
    institution = F.coalesce(F.get(F.filter(chunks, lambda x: x != ""), F.lit(0)), F.lit(""))
    return {
        "addresses": listed.select(pub_id, "idx_address", "address"),
        "countries": listed.select(pub_id, "idx_address", normalize_country(F.element_at(chunks, -1)).alias("country")),
        "institutions": listed.select(pub_id, "idx_address", institution.alias("institution")),
    }


def valid_affiliations(cell: Column, strict: bool = False) -> Column:
    """Affiliations that end with a country, joined again; `unknown` if none is left. Unless strict a country that isn't known counts too."""
    last = lambda x: normalize_country(strip(F.element_at(F.split(x, ", "), -1)))
    kept = F.filter(F.split(cell, "; "), lambda x: (last(x) != NO_COUNTRY) | F.lit(not strict))
    return F.coalesce(F.nullif(F.array_join(kept, "; "), F.lit("")), F.lit(UNKNOWN))


def _entries(texts: Column) -> Column:
    """(name, rest) of standardised entries of authors with affiliations, the name ending at the first or second comma."""

    def read(entry: Column) -> Column:
        parts = F.split(entry, ",")
        n = F.when(F.element_at(parts, 1).contains("."), 1).otherwise(2)
        return F.struct(strip(F.array_join(F.slice(parts, 1, n), ",")).alias("name"), F.array_join(F.slice(parts, n + 1, F.size(parts)), ",").alias("rest"))

    return F.transform(texts, read)


def _numbered(entries: Column) -> Column:
    """(i, rest): entries with the number of their author; neighbours of one name share it."""
    new = F.transform(entries, lambda e, k: F.when((k > 0) & (e["name"] == F.get(entries, k - 1)["name"]), 0).otherwise(1))
    number = lambda k: F.aggregate(F.slice(new, 1, k + 1), F.lit(-1), lambda x, y: x + y)
    return F.transform(entries, lambda e, k: F.struct(number(k).alias("i"), e["rest"].alias("rest")))


def _cells_a(rows: DataFrame, pub_id: str, affiliations: str, authors: str) -> DataFrame:
    """(pub_id, _raw, _bare, _authors): listed affiliations, their standard form without unknown countries, authors' entries; NULL means unknown."""
    known = rows.select(pub_id, *[F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN)).alias(n) for c, n in ((affiliations, "_f"), (authors, "_t"))])
    parts = known.select(pub_id, F.split("_f", ";").alias("_raw"), standard_addresses(F.split("_t", ";"), False).alias("_texts"))
    held = parts.select(pub_id, "_raw", standard_addresses(F.col("_raw"), False).alias("_bare"), _entries(F.col("_texts")).alias("_e"))
    return held.select(pub_id, "_raw", "_bare", _numbered(F.col("_e")).alias("_authors"))


def _own(rest: Column, bare: Column) -> Column:
    """Whether an author's text holds a listed affiliation; a blank one belongs to nobody."""
    return rest.contains(bare) & (F.trim(bare) != "")


# The arrays below are never empty; the outer forms of explode keep Spark from testing that by computing them twice.


def addresses_a(rows: DataFrame, pub_id: str, affiliations: str, authors: str) -> dict[str, DataFrame]:
    """addresses, countries, institutions of the first source; an author without a listed affiliation gets an unknown address."""
    cells = _cells_a(rows, pub_id, affiliations, authors)
    lost = F.filter("_authors", lambda e: ~F.exists("_bare", lambda s: _own(e["rest"], s)))
    every = F.concat("_raw", F.transform(lost, lambda e: unknown_address(e["i"])))
    return _address_tables(cells.select(pub_id, F.posexplode_outer(every).alias("idx_address", "address")), pub_id)


def _bracketed(c: Column) -> Column:
    """(authors, address) of each bracket of a cell."""
    groups = F.arrays_zip(F.regexp_extract_all(c, F.lit(BRACKETS), F.lit(1)).alias("authors"), F.regexp_extract_all(c, F.lit(BRACKETS), F.lit(2)).alias("address"))
    return F.transform(groups, lambda g: F.struct(F.transform(F.split(g["authors"], ";"), strip).alias("authors"), strip(g["address"]).alias("address")))


def addresses_b(rows: DataFrame, pub_id: str, cell: str, full_names: str) -> dict[str, DataFrame]:
    """addresses, countries, institutions of the second source, with or without bracketed authors; NULL means unknown."""
    known = rows.select(pub_id, F.coalesce(F.nullif(cell, F.lit("")), F.lit(UNKNOWN)).alias("_c"), F.coalesce(full_names, F.lit(UNKNOWN)).alias("_n"))
    read = known.select(pub_id, "_c", _bracketed(F.col("_c")).alias("_b"), F.transform(F.split("_n", ";"), strip).alias("_n"))
    named = F.flatten(F.transform("_b", lambda g: g["authors"]))
    missing = F.filter(F.transform("_n", lambda x, i: F.struct(x.alias("n"), i.alias("i"))), lambda e: ~F.array_contains(named, e["n"]))
    with_brackets = F.concat(F.transform("_b", lambda g: g["address"]), F.transform(missing, lambda e: unknown_address(e["i"])))
    parts = F.when(F.col("_c").contains("["), with_brackets).otherwise(F.transform(F.split("_c", ";"), strip))
    return _address_tables(read.select(pub_id, F.posexplode_outer(standard_addresses(parts, False)).alias("idx_address", "address")), pub_id)


def author_addresses_a(rows: DataFrame, pub_id: str, affiliations: str, authors: str) -> DataFrame:
    """(pub_id, idx_author, address, country): the affiliations that each author's text holds, standardised."""
    cells = _cells_a(rows, pub_id, affiliations, authors).withColumn("_full", standard_addresses(F.col("_raw")))
    listed = F.arrays_zip("_bare", "_full")
    each = cells.select(pub_id, listed.alias("_l"), F.explode_outer("_authors").alias("_a"))
    own = F.transform(F.filter("_l", lambda x: _own(F.col("_a.rest"), x["_bare"])), lambda x: x["_full"])
    held = each.select(pub_id, F.col("_a.i").alias("idx_author"), own.alias("_own"))
    out = held.select(pub_id, "idx_author", F.explode_outer(F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.array(unknown_address(F.col("idx_author"), True)))).alias("address"))
    return out.withColumn("country", normalize_country(F.element_at(_chunks(F.col("address")), -1)))


def author_addresses_b(rows: DataFrame, pub_id: str, cell: str, full_names: str) -> DataFrame:
    """(pub_id, idx_author, address, country) of the bracketed authors, and unknown addresses of the others; without brackets one unknown row."""
    known = rows.select(pub_id, F.coalesce(F.nullif(cell, F.lit("")), F.lit(UNKNOWN)).alias("_c"), F.coalesce(full_names, F.lit(UNKNOWN)).alias("_n"))
    read = known.select(pub_id, "_c", _bracketed(F.col("_c")).alias("_b"), F.transform(F.split("_n", ";"), strip).alias("_n"))
    given = read.filter(F.col("_c").contains("[")).select(pub_id, "_n", "_b", standard_addresses(F.transform("_b", lambda g: g["address"])).alias("_s"))
    pairs = F.flatten(F.transform("_b", lambda g, k: F.transform(g["authors"], lambda a: F.struct((F.array_position("_n", a) - 1).cast("int").alias("idx_author"), F.get("_s", k).alias("address")))))
    placed = given.select(pub_id, "_n", F.filter(pairs, lambda e: e["idx_author"] >= 0).alias("_p"))
    lost = F.filter(F.transform("_n", lambda n, i: i), lambda i: ~F.exists("_p", lambda e: e["idx_author"] == i))
    every = F.concat("_p", F.transform(lost, lambda i: F.struct(i.cast("int").alias("idx_author"), unknown_address(i, True).alias("address"))))
    listed = placed.select(pub_id, F.inline_outer(every)).withColumn("country", normalize_country(F.element_at(_chunks(F.col("address")), -1)))
    none = read.filter(~F.col("_c").contains("[")).select(pub_id, F.lit(0).alias("idx_author"), F.lit(UNKNOWN).alias("address"), F.lit(UNKNOWN).alias("country"))
    return listed.unionByName(none)


# The patterns of the fields of citations below are fixed forms.


def references_a(rows: DataFrame, pub_id: str, cell: str) -> DataFrame:
    """(pub_id, author, year, journal, volume, page) of the first source's citations; what can't be read is unknown or 0."""
    each = rows.select(pub_id, F.explode(F.split(cell, ";")).alias("r")).filter("trim(r) != ''").withColumn("r", F.ltrim("r"))
    r = F.col("r")
    pick = lambda pattern, group=0: F.nullif(F.regexp_extract(r, f"(?U){pattern}", group), F.lit(""))
    recent = r.rlike(r"(?U)\(\d{4}\)(\s)?$")
    year = pick(r"(?<=\()\d{4}(?=\))")
    author = F.when(recent, pick(r"^[^,0-9:]*,")).otherwise(pick(r"^[^,0-9:]*,[^,0-9:]*,"))
    new_journal = pick(r"(?<=,\s)[^,]*,\s+\d+,")
    journal_new, volume_new = F.element_at(F.split(new_journal, ","), 1), F.element_at(F.split(new_journal, ","), 2)
    proceedings, titled = pick("[Pp]roceedings.*"), pick(r"\(\d{4}\)\s+[^,]*,|\(\d{4}\)\s+[^,]*$")
    titled = F.regexp_replace(F.substring(titled, 7, 10000), ",$", "")
    journal = F.when(recent, journal_new).otherwise(F.coalesce(proceedings, titled))
    volume_old = F.nullif(F.regexp_extract(F.coalesce(pick(r",\s+\d{1,6},|,\s+\d{1,6}\s\(|,\s+\d{1,6}$"), F.lit("")), r"\d{1,6}", 0), F.lit(""))
    volume = F.when(recent, volume_new).otherwise(volume_old)
    page_new, page_old = pick(r"\s+[p]{1,2}\.\s+[a-zA-Z0-9]{1,9}-[a-zA-Z0-9]{1,9}"), pick(r"\s+[p]{1,2}\.\s+[a-zA-Z0-9]{1,9}")
    page = F.element_at(F.split(F.when(recent, page_new).otherwise(page_old), r"p\."), 2)
    fields = {"author": normalize_name(author), "year": year, "journal": strip(journal), "volume": strip(volume), "page": strip(page)}
    read = each.select(pub_id, *[c.alias(n) for n, c in fields.items()])
    whole = F.col("author").isNotNull() & F.col("journal").isNotNull()
    return read.select(
        pub_id, F.when(whole, F.col("author")).otherwise(PARTIAL).alias("author"), F.coalesce("year", F.lit("0")).alias("year"),
        F.coalesce("journal", F.lit(UNKNOWN)).alias("journal"), F.coalesce("volume", F.lit("0")).alias("volume"), F.coalesce("page", F.lit("0")).alias("page"),
    )


def references_b(rows: DataFrame, pub_id: str, cell: str) -> DataFrame:
    """(pub_id, author, year, journal, volume, page) of the second source's citations that name an author and a journal."""
    each = rows.select(pub_id, F.explode(F.split(cell, ";")).alias("r")).filter("trim(r) != ''").withColumn("r", F.ltrim("r"))
    pick = lambda pattern: F.nullif(F.regexp_extract("r", f"(?U){pattern}", 0), F.lit(""))
    year = strip(F.substring(pick(r",\s\d{4},"), 2, 5))
    journal = strip(pick(r"(?<=,)\s[A-Z]{2}[0-9A-Z&\s\-\.\[\]]+(?=,)|(?<=,)\s[A-Z]{2}[0-9A-Z&\s\-\.\[\]]+$"))
    digits = lambda pattern: F.nullif(F.regexp_extract(F.coalesce(pick(pattern), F.lit("")), r"\d+", 0), F.lit(""))
    author = F.regexp_replace(pick("^[^,0-9:]*,"), ",$", "")
    read = each.select(pub_id, normalize_name(author).alias("author"), year.alias("year"), journal.alias("journal"), digits(r",\s+V\d{1,6}").alias("volume"), digits(r",\s+P\d{1,6}").alias("page"))
    return read.filter("author is not null and journal is not null").na.fill("0", ["year", "volume", "page"])


__all__ = ["EMPTY", "NO_COUNTRY", "addresses_a", "addresses_b", "author_addresses_a", "author_addresses_b", "authors_a", "authors_b", "keywords", "parted", "references_a", "references_b"]
