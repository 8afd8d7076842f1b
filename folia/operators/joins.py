"""Lookup joins with fallbacks, and the union and difference of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.operators.institutions import flag_author_institutions, small


def journal_categories(rows: DataFrame, journals: DataFrame, pub_id: str, journal: str, issn: str) -> DataFrame:
    """(pub_id, codes): category codes by the journal's name, and only where no name fits by its ISSN without hyphen."""
    named = journals.groupBy(F.col("journal").alias("_j")).agg(F.first("codes").alias("_cj"))
    numbered = journals.groupBy(F.col("issn").cast("string").alias("_i")).agg(F.first("codes").alias("_ci"))
    bare = F.replace(F.col(issn), F.lit("-"), F.lit(""))
    first = rows.select(pub_id, F.col(journal).alias("_j"), bare.alias("_i")).join(small(named), "_j", "left")
    return first.join(small(numbered), "_i", "left").select(pub_id, F.coalesce("_cj", "_ci", F.array().cast("array<int>")).alias("codes"))


def subjects(coded: DataFrame, codes: DataFrame, pub_id: str) -> DataFrame:
    """(pub_id, subject): the main category of every code, without the word General; distinct."""
    main = coded.select(pub_id, F.explode("codes").alias("c")).select(pub_id, (F.floor(F.col("c") / 100) * 100).cast("int").alias("code"))
    named = main.join(small(codes), "code").select(pub_id, F.replace("category", F.lit("General"), F.lit("")).alias("subject"))
    return named.distinct().filter("subject != ''")


def sub_subjects(coded: DataFrame, codes: DataFrame, pub_id: str) -> DataFrame:
    """(pub_id, sub_subject): the category of every code; distinct."""
    return coded.select(pub_id, F.explode("codes").alias("code")).join(small(codes), "code").select(pub_id, F.col("category").alias("sub_subject")).distinct().filter("sub_subject != ''")


def offset_of(articles: DataFrame, pub_id: str = "pub_id") -> DataFrame:
    """One row: the number from which the publications of another corpus are numbered on."""
    return articles.agg(F.coalesce(F.max(pub_id) + 1, F.lit(0)).alias("_o"))


def concatenate(first: DataFrame, second: DataFrame, offset: DataFrame, pub_id: str = "pub_id") -> DataFrame:
    """Both item tables, the second's publications moved by the offset."""
    moved = second.crossJoin(F.broadcast(offset)).withColumn(pub_id, F.col(pub_id) + F.col("_o")).drop("_o")  # the offset is one row
    return first.unionByName(moved)


def concatenate_corpora(first: dict[str, DataFrame], second: dict[str, DataFrame], flags: list[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """The items that both corpora have; all of them are moved by one offset, that of the first's articles.

    flags (name, column): 0/1 columns of the institutions asked for, added to the table of author institutions.
    """
    offset = offset_of(first["articles"])
    out = {name: concatenate(first[name], second[name], offset) for name in first if name in second}
    if flags and "authors_institutions" in out:
        out["authors_institutions"] = flag_author_institutions(out["authors_institutions"], flags)
    return out
