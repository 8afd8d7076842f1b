"""Grouped operators: success rates, roll-ups of author institutions, title keywords, first known values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.normalize import EMPTY, UNKNOWN

# Words that carry no topic (fixed values).
STOP_WORDS = "a about after all also an and any are as at based be been between both by can during each for from further had has have how in into is it its more most near new non not of on or other our over per some such than that the their these this those through to toward towards under up use used using via was were what when which while with within without".split()
MIN_OCCURRENCES = 3


def success(items: DataFrame, pub_id: str, item: str, corpus: DataFrame, distinct: bool = True) -> DataFrame:
    """(item, success_pct): share of publications without an empty value of the item; `failed` lists the others."""
    total = corpus.agg(F.count_distinct(pub_id).alias("total"))
    bad = F.when(F.col(item) == "", F.col(pub_id))
    counted = items.agg((F.count_distinct(bad) if distinct else F.count(bad)).alias("bad"))
    share = F.round(100 * (1 - F.col("bad") / F.nullif("total", F.lit(0))), 4)
    return counted.crossJoin(total).select(F.lit(item).alias("item"), share.alias("success_pct"))  # one row each


def failed(items: DataFrame, pub_id: str, item: str) -> DataFrame:
    """(item, pub_id): the publications with an empty value of the item."""
    return items.filter(F.col(item) == "").select(F.lit(item).alias("item"), pub_id).distinct()


def non_empty(items: DataFrame, item: str) -> DataFrame:
    return items.filter(F.col(item) != "")


def roll_up(rows: DataFrame, pub_id: str = "pub_id", idx: str = "idx_author", order: str = "address") -> DataFrame:
    """One row per author: all addresses in order, and the distinct countries and institutions, joined by `; `."""
    filled = rows.select(pub_id, idx, *[F.coalesce(F.nullif(c, F.lit("")), F.lit(EMPTY)).alias(c) for c in ("address", "country", "norm_institutions", "raw_institutions")])
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    raw = F.array_join(F.array_sort(F.array_remove(F.collect_set("raw_institutions"), EMPTY)), "; ")
    many = F.count("*") > 1
    return filled.groupBy(pub_id, idx).agg(
        F.array_join(F.array_sort(F.collect_list("address")), "; ").alias("address"),
        distinct("country").alias("country"),
        distinct("norm_institutions").alias("norm_institutions"),
        F.when(many, raw).otherwise(F.first("raw_institutions")).alias("raw_institutions"),
    )


Tagger = Callable[[Column], Column]  # a title to the array of its words that count, in order, repeated ones too


def title_tokens(title: Column) -> Column:
    """Words of a title that carry a topic: letters, digits and inner hyphens and dots, three characters or more; plurals by their singular.

    The default of the hook `tagger`, where a column function that knows word classes may stand.
    """
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[a-z0-9]+(?:[-.][a-z0-9]+)*"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS) & ~w.rlike(r"^[0-9.-]+$"))
    return F.transform(kept, lambda w: F.when(w.rlike("(?:ss|us|is|[0-9.-])s?$"), w).otherwise(F.regexp_replace(F.regexp_replace(w, "(?<=[a-z]{2})ies$", "y"), "(?<=[a-z]{3})s$", "")))


def title_keywords(rows: DataFrame, pub_id: str, title: str, least: int = MIN_OCCURRENCES, tagger: Tagger = title_tokens) -> DataFrame:
    """(pub_id, keyword): the distinct words of a title that occur at least `least` times in all titles of the corpus."""
    words = rows.filter(F.col(title).isNotNull()).select(pub_id, F.explode(tagger(F.col(title))).alias("keyword"))
    kept = words.groupBy("keyword").count().filter(F.col("count") >= least).select("keyword")
    return words.join(kept, "keyword", "left_semi").select(pub_id, "keyword").distinct()


def word_counts(rows: DataFrame, title: str, tagger: Tagger = title_tokens) -> DataFrame:
    """(keyword, n): how often each word occurs in titles."""
    return rows.select(F.explode(tagger(F.col(title))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def first_known(column: str, order: list[str], longest: bool = False, unknown: str = UNKNOWN) -> Column:
    """Aggregate: the first value that isn't unknown, in order; or the longest, the first of its length."""
    known = F.when(F.col(column) != unknown, F.col(column))
    rank = F.struct(*([(-F.length(column)).alias("_l")] if longest else []), *order)
    return F.coalesce(F.min_by(known, F.when(known.isNotNull(), rank)), F.lit(unknown))


def wrong_types(norms: DataFrame, types: DataFrame, country: str = "country", norm: str = "norm_aff", abbreviation: str = "abbreviation") -> DataFrame:
    """(country, types): last words of normalised names that the table of types doesn't know."""
    last = norms.select(country, F.element_at(F.split(norm, " "), -1).alias(abbreviation))
    return last.join(types.select(abbreviation), abbreviation, "left_anti").groupBy(country).agg(F.array_sort(F.collect_set(abbreviation)).alias("types"))
