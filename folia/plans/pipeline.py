"""Whole corpora: parse both sources, concatenate, deduplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.normalize import first_author, normalize_issn, normalize_title, normalize_type, normalize_year, standard_address
from folia.operators import dedup, explode
from folia.operators.aggregate import failed, success, title_keywords, wrong_types
from folia.operators.institutions import Lookups, author_institutions, build_institutions, flag_author_institutions
from folia.operators.joins import concatenate_corpora, journal_categories, sub_subjects, subjects
from folia.runtime import cut, store
from folia.sources.layout import Layout
from folia.sources.readers import read_corpus_a, read_corpus_b
from folia.sources.sinks import write_ids, write_items, write_success

Items = dict[str, DataFrame]


def articles_of(rows: DataFrame, issn: bool) -> DataFrame:
    """The articles table of a checked export."""
    return rows.select(
        F.col("pub_id"), first_author(F.col("authors")).alias("authors"), normalize_year(F.col("year")).alias("year"), F.col("source_title").alias("journal"), "volume",
        F.col("page_start").alias("page"), "doi", normalize_type(F.col("document_type")).alias("document_type"), "language", normalize_title(F.col("title")).alias("title"),
        (normalize_issn(F.col("issn")) if issn else F.col("issn")).alias("issn"), "norm_journal",
    )


Flags = list[tuple[str, str]]


def _authors(rows: DataFrame, lookups: Lookups | None, flags: Flags | None) -> DataFrame:
    return flag_author_institutions(author_institutions(rows, lookups), flags)


def parse_a(rows: DataFrame, journals: DataFrame, codes: DataFrame, lookups: Lookups | None = None, flags: Flags | None = None) -> Items:
    """Item tables of the first source from its checked rows.

    lookups resolve the institutions of authors; flags (name, column) add 0/1 columns for the institutions asked for.
    """
    coded = journal_categories(rows, journals, "pub_id", "source_title", "issn")
    return {
        "articles": articles_of(rows, issn=True),
        "authors": explode.authors_a(rows, "pub_id", "authors"),
        **explode.addresses_a(rows, "pub_id", "affiliations", "authors_with_affiliations"),
        "authors_institutions": _authors(explode.author_addresses_a(rows, "pub_id", "affiliations", "authors_with_affiliations"), lookups, flags),
        "authors_keywords": explode.keywords(rows, "pub_id", "author_keywords"),
        "indexed_keywords": explode.keywords(rows, "pub_id", "index_keywords"),
        "title_keywords": title_keywords(rows, "pub_id", "title"),
        "subjects": subjects(coded, codes, "pub_id"),
        "sub_subjects": sub_subjects(coded, codes, "pub_id"),
        "references": explode.references_a(rows, "pub_id", "cited_refs"),
    }


def parse_b(rows: DataFrame, lookups: Lookups | None = None, flags: Flags | None = None) -> Items:
    """Item tables of the second source from its checked rows."""
    return {
        "articles": articles_of(rows, issn=False),
        "authors": explode.authors_b(rows, "pub_id", "author_full_names"),
        **explode.addresses_b(rows, "pub_id", "addresses", "author_full_names"),
        "authors_institutions": _authors(explode.author_addresses_b(rows, "pub_id", "addresses", "author_full_names"), lookups, flags),
        "authors_keywords": explode.keywords(rows, "pub_id", "author_keywords"),
        "indexed_keywords": explode.keywords(rows, "pub_id", "index_keywords"),
        "title_keywords": title_keywords(rows, "pub_id", "title"),
        "subjects": explode.parted(rows, "pub_id", "subjects", "subject"),
        "sub_subjects": explode.parted(rows, "pub_id", "sub_subjects", "sub_subject"),
        "references": explode.references_b(rows, "pub_id", "cited_refs"),
    }


_JUDGED = {"addresses": "address", "countries": "country", "institutions": "institution", "authors": "co_author", "authors_institutions": "norm_institutions", "authors_keywords": "keyword", "indexed_keywords": "keyword", "title_keywords": "keyword", "subjects": "subject", "sub_subjects": "sub_subject"}


def success_rates(items: Items, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, success_pct) of every item table with one value that counts, and (item, pub_id) of the publications without it."""
    rates, lost = None, None
    for name, column in _JUDGED.items():
        if name in items:
            rate = success(items[name], "pub_id", column, corpus).withColumn("item", F.lit(name))
            ids = failed(items[name], "pub_id", column).withColumn("item", F.lit(name))
            rates, lost = (rate, ids) if rates is None else (rates.unionByName(rate), lost.unionByName(ids))
    if rates is None:
        raise ValueError("no item table")
    return rates, lost


class WrongTypes(ValueError):
    """Normalised institutions end with a type that the table of types doesn't know."""


def concatenate_and_deduplicate(first: Items, second: Items, lookups: Lookups | None = None, flags: Flags | None = None, similar: bool = True) -> Items:
    """One corpus of two, duplicates dropped in every item table; similar journals and titles count as one.

    With lookups the institutions of the remaining addresses are added: norm_institutions and raw_institutions.
    """
    items = concatenate_corpora(first, second, flags)
    articles = cut(items["articles"])
    kept = cut(dedup.deduplicate_similar(articles) if similar else dedup.deduplicate(articles))
    dropped = cut(dedup.dropped_ids(articles, kept))
    out = {"articles": kept} | {name: dedup.drop_ids(rows, dropped) for name, rows in items.items() if name != "articles"}
    if lookups is not None:
        wrong = wrong_types(lookups.words.select("country", "norm_aff").distinct(), lookups.types).limit(20).collect()  # for the message only
        if wrong:
            raise WrongTypes("; ".join(f"{r['country']}: {', '.join(r['types'][:20])}" for r in wrong))
        standard = out["addresses"].select("pub_id", "idx_address", standard_address(F.col("address")).alias("address"))
        built = build_institutions(standard, lookups)
        out |= {name: built[name] for name in ("norm_institutions", "raw_institutions")}
    return out


def run_all(spark: SparkSession, layout: Layout, year: str, journals: DataFrame, codes: DataFrame, lookups: Lookups | None = None, flags: Flags | None = None, extent: str = "parquet", correct: bool = True) -> dict[str, Items]:
    """A whole year: reads both exports of its folders, parses, concatenates and deduplicates them, and writes every stage with its rates and ids."""
    a, b = (read(spark, layout.path(year, d, "rawdata")) for read, d in zip((lambda s, f: read_corpus_a(s, f, correct), read_corpus_b), layout.databases, strict=True))
    stages: dict[str, Items] = {}

    def keep(stage: str, items: Items) -> None:
        """Every stage is computed once: stored, and written from there, with the flags."""
        stages[stage] = {name: store(rows) for name, rows in items.items()}
        shown = dict(stages[stage])
        if "authors_institutions" in shown:
            shown["authors_institutions"] = flag_author_institutions(shown["authors_institutions"], flags)
        write_items(shown, layout.path(year, stage, "parsing"), extent)

    if a is not None:
        keep(layout.databases[0], parse_a(cut(a.rows), journals, codes, lookups))
    if b is not None:
        keep(layout.databases[1], parse_b(cut(b.rows), lookups))
    for database, corpus in zip(layout.databases, (a, b), strict=True):
        if corpus is not None:
            rates, lost = success_rates(stages[database], stages[database]["articles"])
            write_success(rates, lost, layout.path(year, database, "parsing"))
            write_ids(corpus.ids, layout.path(year, database, "parsing"), database)
    if a is not None and b is not None:
        first, second = (stages[d] for d in layout.databases)
        keep("concat", concatenate_corpora(first, second))
        keep("dedup", concatenate_and_deduplicate(first, second, lookups))
    return stages
