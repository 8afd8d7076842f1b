"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import sql
from folia.llm.canonical import map_to_list
from folia.llm.consensus import distinct_values, doi_value, drop_beginnings, issn_value, represent, represent_first, type_value
from folia.llm.leaks import find_leaks
from folia.llm.lookalikes import find_lookalikes
from folia.llm.matching import match_sources
from folia.llm.names import link_names, names_with_affiliations
from folia.llm.packing import pack_documents
from folia.llm.places import link_addresses, place_of
from folia.llm.spam import find_spam
from folia.runtime import read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # the public tokenizer of p8_pack


def _p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of each group with their precedence; the type as the list of types writes it."""
    articles = read(spark, sf_dir, "articles").select("pub_id", "title", "doi", "document_type", "issn", "db", "indexed_at")
    types = read(spark, sf_dir, "doc_types").select(type_value(F.col("alias")).alias("_alias"), F.col("document_type").alias("_type")).dropDuplicates(["_alias"])
    trust = read(spark, sf_dir, "source_trust")
    members = read(spark, sf_dir, "article_groups").select("group_id", "pub_id").distinct()
    rows = members.join(articles, "pub_id").withColumn("_alias", type_value(F.col("document_type")))
    return rows.join(types, "_alias", "left").join(trust, "db", "left").withColumn("trust_rank", F.coalesce("trust_rank", F.lit(2**31 - 1)))


def _p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that count of the three fields; trusted sources vote more."""
    fields = {"doi": doi_value(F.col("doi")), "document_type": F.col("_type"), "issn": issn_value(F.col("issn"))}
    recent = -F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**62)))
    values = distinct_values(_p1_rows(spark, sf_dir), "group_id", fields, [F.col("trust_rank"), recent, F.col("pub_id")], F.lit(1.0) / F.greatest("trust_rank", F.lit(1)))
    return drop_beginnings(values, "group_id", "doi")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of the fields is an order of precedence, which no vote gives (README)."""
    return represent_first(read(spark, sf_dir, "article_groups"), _p1_values(spark, sf_dir), "group_id", ["doi", "document_type", "issn"])


def p1_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields by token-level consensus."""
    return represent(read(spark, sf_dir, "article_groups"), _p1_values(spark, sf_dir), "group_id", ["doi", "document_type", "issn"])


def p1_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each group that is closest to the consensus of its copies, trusted sources voting more."""
    title = F.when(~F.trim("title").isin("", "unknown", "Unknown", "empty"), F.trim("title"))
    rows = _p1_rows(spark, sf_dir)
    values = distinct_values(rows, "group_id", {"title": title}, [F.col("trust_rank"), F.col("pub_id")], F.lit(1.0) / F.greatest("trust_rank", F.lit(1)))
    return represent(read(spark, sf_dir, "article_groups"), values, "group_id", ["title"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"country": ("country", "country"), "institution": ("address_inst", "norm_institutions"), "journal": ("articles", "journal")}
    parts = [read(spark, sf_dir, t).select(F.lit(name).alias("field_name"), F.col(c).alias("raw_value")) for name, (t, c) in columns.items()]
    return map_to_list(parts[0].unionByName(parts[1]).unionByName(parts[2]), read(spark, sf_dir, "canonical_values"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs with their confidence."""
    return match_sources(read(spark, sf_dir, "articles"), read(spark, sf_dir, "wos_articles"), "pub_id", "ut")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).filter("probability > 0.5").select("pub_id", "ut")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read(spark, sf_dir, "articles").select(F.col("authors").alias("name"))
    cells = read(spark, sf_dir, "scopus_rawdata").select("authors_with_affiliations").filter("authors_with_affiliations is not null")
    people = cells.select(F.explode(names_with_affiliations(F.col("authors_with_affiliations"))).alias("name"))
    names = articles.unionByName(people).filter(F.col("name").isNotNull() & ~F.trim("name").isin("", "unknown", "Unknown", "empty"))
    return link_names(names)


def _p6_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("address").isNotNull() & ~F.lower(F.trim("address")).rlike(r"^(?:\d+_)?unknown$|^empty$|^$")
    return read(spark, sf_dir, "address").select("address").filter(known)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_addresses(_p6_addresses(spark, sf_dir))


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address with the number of its place."""
    return place_of(_p6_addresses(spark, sf_dir))


def _p7_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, address = read(spark, sf_dir, "articles"), read(spark, sf_dir, "address")
    zero = F.lit(0).cast("int").alias("idx_address")
    parts = [articles.select(F.lit(c).alias("field_name"), "pub_id", zero, F.col(c).alias("text")) for c in ("authors", "title")]
    parts.append(address.select(F.lit("address").alias("field_name"), "pub_id", F.col("idx_address").cast("int").alias("idx_address"), F.col("address").alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_lookalikes(_p7_cells(spark, sf_dir), ["field_name", "pub_id", "idx_address"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_repaired(spark, sf_dir).select("field_name", "pub_id", "idx_address").distinct()


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "capacities"), vocabulary=VOCABULARY)


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "test_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spam(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": sql.P1_FOUND}
