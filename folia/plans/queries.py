"""Queries of the core operators, bound to the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import normalize as N
from folia.operators import aggregate, dedup, explode, institutions, joins, repair
from folia.operators.packed import unpack
from folia.plans.lookups import affiliation_table, category_table, journal_table, town_table, type_table, zip_table
from folia.runtime import read
from folia.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(read(spark, sf_dir, "scopus_rawdata"), "eid", ["author_keywords", "affiliations", "cited_refs"], "loaded_at")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "scopus_rawdata")


def exp_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.authors_a(_raw(spark, sf_dir).select("pub_id", "authors").na.fill("unknown"), "pub_id", "authors")


def exp_authors_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.authors_b(_raw(spark, sf_dir).select("pub_id", "authors").na.fill("unknown"), "pub_id", "authors")


def exp_author_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.keywords(_raw(spark, sf_dir), "pub_id", "author_keywords")


def exp_index_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.keywords(_raw(spark, sf_dir), "pub_id", "index_keywords")


def exp_parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.parted(_raw(spark, sf_dir), "pub_id", "index_keywords", "subject")


def _address_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("pub_id", "affiliations", "authors_with_affiliations")


def exp_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.addresses_a(_address_rows(spark, sf_dir), "pub_id", "affiliations", "authors_with_affiliations")["addresses"]


def exp_address_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.addresses_a(_address_rows(spark, sf_dir), "pub_id", "affiliations", "authors_with_affiliations")["countries"]


def exp_address_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.addresses_a(_address_rows(spark, sf_dir), "pub_id", "affiliations", "authors_with_affiliations")["institutions"]


def exp_author_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.author_addresses_a(_address_rows(spark, sf_dir), "pub_id", "affiliations", "authors_with_affiliations")


def exp_author_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions of authors end to end: addresses of authors, their institutions, one row per author."""
    rows = explode.author_addresses_a(_address_rows(spark, sf_dir), "pub_id", "affiliations", "authors_with_affiliations")
    return institutions.author_institutions(rows, _lookups(spark, sf_dir))


def _bracket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records in the second source's notation: bracketed full names before each affiliation, every third record without brackets."""
    raw = _raw(spark, sf_dir).select("pub_id", "author_full_names", "affiliations")
    names, places = F.split("author_full_names", "; "), F.split("affiliations", ";")
    cell = F.transform(places, lambda p, i: F.concat(F.lit("["), F.get(names, i), F.lit("] "), F.trim(p)))
    return raw.select("pub_id", "author_full_names", F.when(F.col("pub_id") % 3 == 0, F.col("affiliations")).otherwise(F.array_join(cell, "; ")).alias("addresses"))


def exp_addresses_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.addresses_b(_bracket_rows(spark, sf_dir), "pub_id", "addresses", "author_full_names")["addresses"]


def exp_author_addresses_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.author_addresses_b(_bracket_rows(spark, sf_dir), "pub_id", "addresses", "author_full_names")


def exp_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.references_a(_raw(spark, sf_dir).select("pub_id", "cited_refs").na.fill("unknown"), "pub_id", "cited_refs")


def exp_references_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in the second source's notation, made from the articles."""
    a = read(spark, sf_dir, "articles")
    cite = F.concat_ws(", ", F.regexp_replace("authors", ",", ""), F.col("year").cast("string"), F.upper(F.regexp_replace("journal", "[^A-Za-z ]", "")), F.concat(F.lit("V"), "volume"), F.concat(F.lit("P"), "page"))
    return explode.references_b(a.select("pub_id", cite.alias("cr")), "pub_id", "cr")


def _scalar(table: str, column: str, key: list[str], out: str, f: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).filter(F.col(column).isNotNull()).select(*key, f(F.col(column)).alias(out))

    return query


def _keyword_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("pub_id", F.coalesce("author_keywords", F.lit("")).alias("keyword"))


def agg_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _keyword_items(spark, sf_dir)
    return aggregate.success(items, "pub_id", "keyword", items)


def agg_success_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate over rows instead of publications."""
    items = _keyword_items(spark, sf_dir)
    return aggregate.success(items, "pub_id", "keyword", items, distinct=False)


def agg_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.failed(_keyword_items(spark, sf_dir), "pub_id", "keyword")


def flt_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.non_empty(_keyword_items(spark, sf_dir), "keyword")


def agg_author_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.roll_up(read(spark, sf_dir, "address_inst"))


def agg_title_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.title_keywords(read(spark, sf_dir, "articles"), "pub_id", "title")


def agg_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.word_counts(read(spark, sf_dir, "articles").filter("title is not null"), "title")


def agg_first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "articles").select("pub_id", F.coalesce("norm_journal", F.lit("unknown")).alias("norm_journal"), F.coalesce("issn", F.lit("unknown")).alias("issn"), F.coalesce("authors", F.lit("unknown")).alias("authors"))
    return a.groupBy("norm_journal").agg(aggregate.first_known("issn", ["pub_id"]).alias("issn"), aggregate.first_known("authors", ["pub_id"], longest=True).alias("longest_author"))


def agg_wrong_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "address_inst").filter("norm_institutions is not null and country is not null").select("country", F.trim("norm_institutions").alias("norm_aff")).distinct()
    return aggregate.wrong_types(rows, type_table(spark)).select("country", F.array_join("types", ",").alias("types"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "articles").drop("db", "indexed_at", "loaded_at")


def dedup_issn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.same_issn(dedup.prepare(_articles(spark, sf_dir))).select("pub_id", "issn")


def dedup_doi_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.same_doi_by_title(dedup.prepare(_articles(spark, sf_dir))).select("pub_id", "doi")


def dedup_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.same_type(dedup.prepare(_articles(spark, sf_dir))).select("pub_id", "document_type")


def dedup_type_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.same_type(dedup.prepare(_articles(spark, sf_dir)), compat=True).select("pub_id", "document_type")


def dedup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(_articles(spark, sf_dir))


def dedup_dropped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return dedup.dropped_ids(a, dedup.deduplicate(a))


def dedup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of the publications that survive."""
    a = _articles(spark, sf_dir)
    return dedup.drop_ids(read(spark, sf_dir, "address"), dedup.dropped_ids(a, dedup.deduplicate(a)))


def dedup_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with similar journals and titles taken for one."""
    return dedup.deduplicate_similar(_articles(spark, sf_dir))


def similar_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.canonical(read(spark, sf_dir, "articles"), "norm_journal", "pub_id")


def set_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir).select("pub_id", "title", "doi")
    w = read(spark, sf_dir, "wos_articles").select(F.substring("ut", 5, 20).cast("long").alias("pub_id"), "title", "doi")
    return joins.concatenate(a, w, joins.offset_of(a))


def set_concat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora in one: articles, keywords and addresses of all publications, the second corpus being the raw records."""
    raw = _raw(spark, sf_dir)
    keyed = explode.keywords(raw, "pub_id", "author_keywords")
    first = {"articles": _articles(spark, sf_dir).select("pub_id", "title"), "keywords": keyed.filter("pub_id % 2 = 0"), "addresses": read(spark, sf_dir, "address").select("pub_id", "idx_address", "address")}
    listed = raw.select("pub_id", F.lit(0).alias("idx_address"), F.col("affiliations").alias("address"))
    both = joins.concatenate_corpora(first, {"articles": raw.select("pub_id", "title"), "keywords": keyed, "addresses": listed})
    values = {"articles": F.col("title"), "keywords": F.col("keyword"), "addresses": F.concat_ws(" ", "idx_address", "address")}
    parts = [both[n].select(F.lit(n).alias("item"), "pub_id", v.alias("value")) for n, v in values.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles without a raw record."""
    return dedup.dropped_ids(read(spark, sf_dir, "articles"), _raw(spark, sf_dir))


def flt_drop_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose article isn't in a group of copies."""
    return readers.drop_listed(_raw(spark, sf_dir).select("eid", "pub_id"), "pub_id", read(spark, sf_dir, "article_groups"))


def fill_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("pub_id", "journal", "doi", "issn", "volume").na.fill("unknown")


def pivot_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "address_inst")
    return institutions.flag_author_institutions(rows, [("Univ", "is_univ"), ("Rto", "is_rto")])


def join_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = joins.journal_categories(read(spark, sf_dir, "articles").select("pub_id", "journal", "issn"), journal_table(spark), "pub_id", "journal", "issn")
    return joins.subjects(coded, category_table(spark), "pub_id")


def join_sub_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = joins.journal_categories(read(spark, sf_dir, "articles").select("pub_id", "journal", "issn"), journal_table(spark), "pub_id", "journal", "issn")
    return joins.sub_subjects(coded, category_table(spark), "pub_id")


def inst_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, country = institutions.split_address(F.col("address"))
    rows = read(spark, sf_dir, "address").filter("address is not null").select("address").distinct()
    return rows.select("address", F.array_join(chunks, "|").alias("chunks"), country.alias("country"))


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "address").filter("address is not null")
    return rows.select("pub_id", "idx_address", N.standard_address(F.col("address")).alias("address")).distinct()


def inst_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each standardised address that name institutions."""
    out = institutions.affiliations_of(_standard(spark, sf_dir), town_table(spark, sf_dir), zip_table(spark))
    return out.select("address", "country", F.array_join("affiliations", "|").alias("affiliations"))


def _lookups(spark: SparkSession, sf_dir: str) -> institutions.Lookups:
    words = institutions.dictionary(affiliation_table(spark, sf_dir))
    return institutions.Lookups(words, type_table(spark), town_table(spark, sf_dir), zip_table(spark))


def _institutions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return institutions.build_institutions(_standard(spark, sf_dir), _lookups(spark, sf_dir))


def inst_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of words that the aliases of institutions ask for."""
    words = institutions.dictionary(affiliation_table(spark, sf_dir))
    return words.select("country", "norm_aff", F.array_join(F.array_sort("words"), " ").alias("words"))


def inst_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _institutions(spark, sf_dir)["norm_institutions"]


def inst_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _institutions(spark, sf_dir)["raw_institutions"]


def inst_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _institutions(spark, sf_dir)["countries"]


def sort_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sort_item("addresses", read(spark, sf_dir, "address"))


def sort_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sort_item("authors_institutions", read(spark, sf_dir, "address_inst"))


def sort_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_word_counts(spark, sf_dir).orderBy(F.desc("n"), "keyword")


def top_first_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the exploded authors of each record."""
    rows = _raw(spark, sf_dir).select("eid", "authors").na.fill("unknown", ["authors"])
    return explode.authors_a(rows, "eid", "authors").filter("idx_author = 0").select("eid", F.col("co_author").alias("author"))


def fix_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["authors", "affiliations", "authors_with_affiliations"]
    return repair.repair_separators(_raw(spark, sf_dir).select("eid", "loaded_at", *columns).na.fill("unknown", columns))


def fix_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["authors", "author_full_names", "affiliations", "authors_with_affiliations"]
    out = repair.repair_initials(_raw(spark, sf_dir).select("eid", "loaded_at", *columns).na.fill("unknown", columns))
    return out.withColumn("changed", F.array_join(F.transform("changed", lambda p: F.concat_ws(" > ", p["old"], p["new"])), "; "))


flt_valid_affiliations_strict = _scalar("scopus_rawdata", "affiliations", ["eid"], "affiliations", lambda c: explode.valid_affiliations(c, strict=True))
flt_valid_affiliations = _scalar("scopus_rawdata", "affiliations", ["eid"], "affiliations", explode.valid_affiliations)
norm_issn = _scalar("articles", "issn", ["pub_id"], "issn", N.normalize_issn)
norm_year = _scalar("articles", "year", ["pub_id"], "year", N.normalize_year)
norm_year_text = _scalar("articles", "volume", ["pub_id"], "number", N.normalize_year)
norm_journal = _scalar("articles", "journal", ["pub_id"], "journal", N.normalize_journal)
norm_type = _scalar("articles", "document_type", ["pub_id"], "document_type", N.normalize_type)
norm_type_lower = _scalar("articles", "document_type", ["pub_id"], "document_type", lambda c: N.normalize_type(c, lower=True))
norm_title = _scalar("articles", "title", ["pub_id"], "title", N.normalize_title)
norm_country = _scalar("country", "country", ["pub_id", "idx_address"], "country", N.normalize_country)
norm_town = _scalar("address_inst", "norm_institutions", ["pub_id", "idx_author"], "town", N.normalize_town)
norm_name = _scalar("articles", "authors", ["pub_id"], "author", N.normalize_name)
first_author = _scalar("scopus_rawdata", "authors", ["eid"], "author", N.first_author)
str_ascii = _scalar("articles", "title", ["pub_id"], "title", N.to_ascii)
str_standard = _scalar("address", "address", ["pub_id", "idx_address"], "address", N.standard_string)
str_without_accents = _scalar("articles", "authors", ["pub_id"], "author", N.without_accents)
std_address = _scalar("address", "address", ["pub_id", "idx_address"], "address", N.standard_address)
unknown_address = _scalar("address", "idx_address", ["pub_id"], "address", lambda c: N.unknown_address(c, True))


def queries() -> dict[str, Query]:
    prefixes = ("p3_", "exp_", "agg_", "dedup_", "similar_", "set_", "flt_", "fill_", "pivot_", "join_", "inst_", "norm_", "first_", "str_", "std_", "unknown_", "fix_", "sort_", "top_")
    return {name: f for name, f in globals().items() if name.startswith(prefixes) and callable(f)}


def oracle_sql() -> dict[str, str]:
    from folia.plans.sql import SQL

    return dict(SQL)
