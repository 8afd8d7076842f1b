"""Problem 1: the best representative of each group of copies.

Method (`represent`): token-level consensus. The values of a group that count are aligned progressively, the heaviest first; their
tokens vote with their value's weight in every column of the alignment; the existing value closest to the voted consensus is
kept. Weights are bounded, and equal values of several copies add up, so many copies outvote a single trusted one.

Where a field's rule is an order of precedence (trust, then recency, then the smallest key) no vote can give the required value: one
trusted copy must win over any number of others. `represent_first` follows such a rule; the README says how often votes differ.

Distinct values with their best precedence and their summed weight are found by a pre-aggregating shuffle; no group of copies is
ever gathered row by row.

Defined cases: a group without a value that counts gets `unknown`; a group whose members aren't in the table too; NULLs don't
count; repeated rows of one member add weight only where the caller keeps them; ties go to the better precedence, then the smaller
value; other columns are ignored.
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNKNOWN = "unknown"
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")


def align(columns: list[dict[str, float]], tokens: list[str], weight: float) -> list[dict[str, float]]:
    """Adds a value to an alignment: columns hold the votes for each token, '' being a gap."""
    total = sum(columns[0].values()) if columns else 0.0
    n, m = len(columns), len(tokens)
    score = np.zeros((n + 1, m + 1))
    score[:, 0], score[0, :] = -0.5 * np.arange(n + 1), -0.5 * np.arange(m + 1)
    for i in range(1, n + 1):
        votes = columns[i - 1]
        for j in range(1, m + 1):
            hit = votes.get(tokens[j - 1], 0.0) / total - 0.4
            score[i, j] = max(score[i - 1, j - 1] + hit, score[i - 1, j] - 0.5, score[i, j - 1] - 0.5)
    out: list[dict[str, float]] = []
    i, j = n, m
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (columns[i - 1].get(tokens[j - 1], 0.0) / total - 0.4):
            column = columns[i - 1]
            column[tokens[j - 1]] = column.get(tokens[j - 1], 0.0) + weight
            i, j = i - 1, j - 1
        elif i and score[i, j] == score[i - 1, j] - 0.5:
            column = columns[i - 1]
            column[""] = column.get("", 0.0) + weight
            i -= 1
        else:
            column = {tokens[j - 1]: weight}
            if total:
                column[""] = total
            j -= 1
        out.append(column)
    return out[::-1]


def consensus(values: list[str], weights: list[float]) -> str:
    """The value closest to the weighted consensus of all; ties go to the earlier value."""
    if len(values) == 1:
        return values[0]
    order = sorted(range(len(values)), key=lambda k: (-weights[k], k))
    tokens = [_TOKEN.findall(v) for v in values]
    columns: list[dict[str, float]] = []
    for k in order:
        columns = align(columns, tokens[k], weights[k])
    voted = [t for c in columns if (t := max(sorted(c), key=lambda x: c[x]))]
    return values[min(order, key=lambda k: (_token_distance(tokens[k], voted), order.index(k)))]


def _token_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@F.pandas_udf(StringType())
def _by_weight(values: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([consensus(list(v), list(w)) for v, w in zip(values, weights, strict=True)], dtype=object)


def distinct_values(rows: DataFrame, group: str, fields: dict[str, Column], precedence: list[Column], weight: Column | None = None) -> DataFrame:
    """(group, _field, _value, _rank, _weight): the distinct values that count, each with its best precedence (smaller is better)."""
    each = F.array(*[F.struct(F.lit(f).alias("_field"), c.alias("_value")) for f, c in fields.items()])
    named = [c.alias(f"_p{i}") for i, c in enumerate(precedence)]
    long = rows.select(group, F.struct(*named).alias("_rank"), (F.lit(1.0) if weight is None else weight).alias("_weight"), F.inline(each))
    return long.filter(F.col("_value").isNotNull()).groupBy(group, "_field", "_value").agg(F.min("_rank").alias("_rank"), F.sum("_weight").alias("_weight"))


def drop_beginnings(values: DataFrame, group: str, field: str) -> DataFrame:
    """Without the values of the field that are a cut-off beginning of another value of the same group."""
    w = Window.partitionBy(group, "_field", F.when(F.col("_field") == field, F.substring_index("_value", "/", 1))).orderBy("_value")
    cut = (F.col("_field") == field) & F.coalesce(F.startswith(F.lead("_value").over(w), F.col("_value")), F.lit(False))
    return values.withColumn("_cut", cut).filter(~F.col("_cut")).drop("_cut")


def represent(groups: DataFrame, values: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """One row per group with the consensus of each field: (group, fields); values as distinct_values gives them."""
    lists = values.groupBy(group, "_field").agg(F.sort_array(F.collect_list(F.struct("_rank", "_value", "_weight"))).alias("_l"))
    one = lists.filter(F.size("_l") == 1).select(group, "_field", F.col("_l")[0]["_value"].alias("_best"))
    more = lists.filter(F.size("_l") > 1).select(group, "_field", _by_weight("_l._value", "_l._weight").alias("_best"))
    wide = one.unionByName(more).groupBy(group).agg(*[F.max(F.when(F.col("_field") == f, F.col("_best"))).alias(f) for f in fields])
    return _all_groups(groups, wide, group, fields)


def represent_first(groups: DataFrame, values: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """One row per group with the value of the best precedence of each field: (group, fields)."""
    own = lambda f, c: F.when(F.col("_field") == f, F.col(c))
    wide = values.groupBy(group).agg(*[F.min_by(own(f, "_value"), F.when(F.col("_field") == f, F.struct("_rank", "_value"))).alias(f) for f in fields])
    return _all_groups(groups, wide, group, fields)


def _all_groups(groups: DataFrame, wide: DataFrame, group: str, fields: list[str]) -> DataFrame:
    return groups.select(group).filter(F.col(group).isNotNull()).distinct().join(wide, group, "left").select(group, *[F.coalesce(f, F.lit(UNKNOWN)).alias(f) for f in fields])


def doi_value(c: Column) -> Column:
    """A bare, whole and well formed DOI in lower case, else NULL."""
    bare = F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    bare = F.regexp_replace(bare, r"^(?:https?://)?(?:[a-z0-9-]+\.)*doi\.[a-z]+/|^doi[:.]?", "")
    bare = F.regexp_replace(bare, r"[.,;:)\]}>'\"]+$", "")
    return F.when(bare.rlike(r"^10\.\d{4,5}/.+$") & ~bare.startswith("10.0000/"), bare)


def issn_value(c: Column) -> Column:
    """An ISSN of eight places with the right check digit and not one digit throughout, as dddd-dddd, else NULL."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(c), r"(?U)^\s*(?:E-?|P-?)?ISSN[\s:]*", ""), r"(?U)[\s\-‐-―]+", "")
    ok = bare.rlike(r"^\d{7}[\dX]$")
    safe = F.when(ok, bare).otherwise(F.lit("00000000"))
    total = sum((F.substring(safe, i + 1, 1).cast("int") * (8 - i) for i in range(7)), F.lit(0))
    check = F.pmod(F.lit(11) - F.pmod(total, F.lit(11)), F.lit(11))
    last = F.when(F.substring(safe, 8, 1) == "X", 10).otherwise(F.try_to_number(F.substring(safe, 8, 1), F.lit("9")).cast("int"))
    good = ok & (check == last) & ~bare.rlike(r"^(\d)\1{7}$")
    return F.when(good, F.concat_ws("-", F.substring(bare, 1, 4), F.substring(bare, 5, 4)))


def type_value(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
