"""Repair of the first source's author and affiliation cells."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folia.functions.normalize import standard_string, strip, tidy_name, to_ascii

# Fixed forms.
STRAY = r"(?U)\w+;,\s\w+|\w+;\w+"  # a separator inside an affiliation
NO_FIRST_NAME = "Unknown First Name"


def _joined(values: Column) -> Column:
    return F.array_join(values, "; ")


def repair_separators(rows: DataFrame, authors: str = "authors", affiliations: str = "affiliations", both: str = "authors_with_affiliations") -> DataFrame:
    """Where authors and their entries differ in number: stray separators dropped in names and made commas in affiliations.

    Adds authors_status, affiliations_status and both_status, 1 where a cell was changed that way.
    """
    names, places, entries = (F.split(c, "; ") for c in (authors, affiliations, both))
    differ = F.size(names) != F.size(F.split(both, ";"))
    stray_name = F.exists(names, lambda x: x.contains(";"))
    without = lambda values: F.transform(values, lambda x: F.replace(x, F.lit(";"), F.lit("")))
    with_commas = lambda values: F.transform(values, lambda x: F.replace(F.replace(x, F.lit(";, "), F.lit(", ")), F.lit(";"), F.lit(", ")))
    stray = lambda values: F.exists(values, lambda x: x.rlike(STRAY))
    new_entries = F.when(stray_name, without(entries)).otherwise(entries)
    return rows.select(
        *[c for c in rows.columns if c not in (authors, affiliations, both)],
        F.when(differ & stray_name, _joined(without(names))).otherwise(F.col(authors)).alias(authors),
        F.when(differ & stray(places), _joined(with_commas(places))).otherwise(F.col(affiliations)).alias(affiliations),
        F.when(differ, _joined(F.when(stray(new_entries), with_commas(new_entries)).otherwise(new_entries))).otherwise(F.col(both)).alias(both),
        (differ & stray_name).cast("int").alias("authors_status"), (differ & stray(places)).cast("int").alias("affiliations_status"), (differ & stray(new_entries)).cast("int").alias("both_status"),
    )


def initials_name(full: str) -> str:
    """`Last F.M.` of a full name such as `Last, First Middle (id)`; a name without comma is a team's."""
    bare = full.split(" (")[0]
    last, comma, first = bare.partition(", ")
    first = tidy_name(first if comma else NO_FIRST_NAME, drop_punctuation=False, first_name=True)
    initials = "".join(p[0] + "." for p in re.split(r"[-. ]", first) if p)
    return f"{tidy_name(last, last_name=True)} {initials}"


@F.pandas_udf(ArrayType(StringType()))
def _initials(full: pd.Series) -> pd.Series:
    return full.map(lambda names: [initials_name(n) for n in names], na_action="ignore")


def repair_initials(rows: DataFrame, authors: str = "authors", full_names: str = "author_full_names", affiliations: str = "affiliations", both: str = "authors_with_affiliations") -> DataFrame:
    """Authors rebuilt from their full names, in the list and in the entries with affiliations; adds `changed`, the pairs (old, new).

    Names, full names and entries belong together by position, so two authors of one spelling stay two. What has no partner stays as it is.
    """
    parts = rows.withColumns({
        "_old": F.split(to_ascii(F.col(authors)), "; "), "_full": F.split(strip(to_ascii(F.col(full_names))), "; "), "_entry": F.split(strip(standard_string(F.col(both))), "; "),
    })
    n = F.least(F.size("_old"), F.size("_full"), F.size("_entry"))
    picked = parts.withColumn("_n", n).withColumn("_new", _initials(F.slice("_full", 1, F.col("_n"))))
    name = F.transform("_old", lambda a, i: F.coalesce(F.get("_new", i), a))
    entry = F.transform("_entry", lambda e, i: F.when(i < F.col("_n"), F.concat_ws(", ", F.get("_new", i), F.array_join(F.slice(F.split(e, ", "), 2, F.size(F.split(e, ", "))), ", "))).otherwise(e))
    pairs = F.transform("_old", lambda a, i: F.struct(a.alias("old"), F.coalesce(F.get("_new", i), a).alias("new")))
    return picked.select(
        *[c for c in rows.columns if c not in (authors, affiliations, both)],
        _joined(name).alias(authors), standard_string(F.col(affiliations)).alias(affiliations), _joined(entry).alias(both),
        F.filter(pairs, lambda p: p["old"] != p["new"]).alias("changed"),
    )
