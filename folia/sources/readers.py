"""Readers of the raw exports and of lookup tables, and what is done to every corpus right after reading."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.functions.normalize import UNKNOWN, normalize_journal, normalize_town, strip, without_accents
from folia.operators import repair
from folia.operators.explode import valid_affiliations
from folia.operators.institutions import dictionary, unpivot
from folia.runtime import cut
from folia.schema import RAW_A, RAW_A_OPTIONAL, RAW_B, RAW_B_OPTIONAL


class MissingColumns(ValueError):
    """A raw export lacks columns that the engine needs."""


def latest_file(spark: SparkSession, folder: str, extension: str) -> str | None:
    """The newest file below a folder, None if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension.lstrip('.')}").load(folder)
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row["p"] if row else None


def read_export_a(spark: SparkSession, path: str) -> DataFrame:
    """The comma-separated export: quoted cells may hold line breaks and doubled quotes; all columns are text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("maxCharsPerColumn", -1).csv(path)


def read_export_b(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated export."""
    return spark.read.option("header", True).option("sep", "\t").option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("maxCharsPerColumn", -1).csv(path)


def drop_listed(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Without the records whose native id is listed."""
    return rows.join(dropped.select(key).distinct(), key, "left_anti")


def row_numbers(rows: DataFrame, name: str = "pub_id") -> DataFrame:
    """A dense number from 0 in file order: numbers within the stored partitions, moved by the rows of the partitions before."""
    kept = cut(rows.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))  # a row a partition
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return kept.join(F.broadcast(starts), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_before")).drop("_p", "_m", "_first", "_before")


def _select(rows: DataFrame, needed: dict[str, str], optional: dict[str, str]) -> DataFrame:
    missing = [c for c in needed if c not in rows.columns]
    if missing:
        raise MissingColumns(f"missing: {', '.join(missing)}")
    return rows.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in (needed | {k: v for k, v in optional.items() if k in rows.columns}).items()])


def check_a(raw: DataFrame) -> DataFrame:
    """Needed columns under their names here, numbered; what is missing is unknown; journal names normalised too."""
    rows = row_numbers(_select(raw, RAW_A, RAW_A_OPTIONAL))
    rows = rows.withColumn("affiliations", valid_affiliations(F.coalesce("affiliations", F.lit(UNKNOWN))))
    filled = rows.na.fill(UNKNOWN, [c for c in rows.columns if c not in ("pub_id", "year")])
    return filled.withColumn("norm_journal", normalize_journal(F.col("source_title")))


def check_b(raw: DataFrame) -> DataFrame:
    """The same for the second source: rows without any value are dropped, the ISSN may come from its electronic twin."""
    rows = row_numbers(_select(raw, RAW_B, RAW_B_OPTIONAL).dropna("all"))
    if "eissn" in rows.columns:
        rows = rows.withColumn("issn", F.coalesce("issn", "eissn")).drop("eissn")
    filled = rows.na.fill(UNKNOWN, [c for c in rows.columns if c not in ("pub_id", "year")])
    return filled.withColumn("norm_journal", normalize_journal(F.col("source_title")))


def native_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "pub_id")


@dataclass(frozen=True)
class Corpus:
    """A raw export as read: checked rows, native ids, and what the repair changed."""

    rows: DataFrame
    ids: DataFrame
    changed_authors: DataFrame | None = None  # (pub_id, old, new)
    changed_affiliations: DataFrame | None = None  # (pub_id, affiliations_before, affiliations, both_before, both)


def read_corpus_a(spark: SparkSession, folder: str, correct: bool = False, dropped: DataFrame | None = None) -> Corpus | None:
    """The newest comma-separated export below a folder without the listed records (eid), repaired if asked for, checked; None without a file."""
    path = latest_file(spark, folder, "csv")
    if path is None:
        return None
    raw = read_export_a(spark, path)
    if dropped is not None:
        raw = drop_listed(raw, "EID", dropped.select(F.col("eid").alias("EID")))
    rows = check_a(raw)
    ids = native_ids(rows, "eid") if "eid" in rows.columns else rows.select(F.lit(None).cast("string").alias("eid"), "pub_id")
    if not correct:
        return Corpus(rows, ids)
    if "author_full_names" not in rows.columns:
        raise MissingColumns("missing: Author full names, which the repair needs")
    parted = cut(repair.repair_separators(rows.withColumns({"affiliations_before": F.col("affiliations"), "both_before": F.col("authors_with_affiliations")})))
    moved = parted.filter("affiliations_status = 1 or both_status = 1").select("pub_id", "affiliations_before", "affiliations", "both_before", F.col("authors_with_affiliations").alias("both"))
    named = cut(repair.repair_initials(parted.drop("affiliations_before", "both_before", "authors_status", "affiliations_status", "both_status")))
    changed = named.select("pub_id", F.inline("changed"))
    return Corpus(named.drop("changed"), ids, changed, moved)


def read_corpus_b(spark: SparkSession, folder: str, dropped: DataFrame | None = None) -> Corpus | None:
    """The newest tab-separated export below a folder without the listed records (ut), checked; None without a file."""
    path = latest_file(spark, folder, "txt")
    if path is None:
        return None
    raw = read_export_b(spark, path)
    if dropped is not None:
        raw = drop_listed(raw, "UT", dropped.select(F.col("ut").alias("UT")))
    rows = check_b(raw)
    return Corpus(rows, native_ids(rows, "ut") if "ut" in rows.columns else rows.select(F.lit(None).cast("string").alias("ut"), "pub_id"))


def merge_files(spark: SparkSession, folder: str, extension: str, sep: str, target: str | None = None) -> DataFrame:
    """Rows of all files below a folder, columns that a file lacks being NULL; also written as one tab-separated table if a target is given.

    Files with one header are read together; the headers are read in one job.
    """
    files = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(folder)
    heads = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value").filter("at = 0")
    first = heads.withColumn("n", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "n").alias("head"))
    groups = first.groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("head").collect()  # a row for each kind of header
    read = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    out = None
    for g in groups:
        one = read.csv(g["paths"])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no .{extension} file below {PurePath(folder)}")
    if target is not None:
        out.write.mode("overwrite").option("header", True).option("sep", "\t").option("escape", '"').csv(target)
    return out


def read_countries(rows: DataFrame) -> DataFrame:
    """(country, code, latitude, longitude, pattern, continent) of a table (country, short_name, gps, zip_letters, zip_digits, continent).

    gps is written `(48.8, 2.3)`, the postal codes' letters `['f', 'fr']` and numbers of digits `[5]`; a country without them has a pattern that fits nothing.
    """
    texts = lambda c: F.coalesce(F.from_json(F.translate(c, "'()", '"[]'), "array<string>"), F.array().cast("array<string>"))
    place, letters, digits = texts("gps"), texts("zip_letters"), texts("zip_digits")
    escaped = F.array_join(F.transform(letters, lambda x: F.replace(F.lower(x), F.lit("."), F.lit("\\."))), "|")
    pattern = F.array_join(F.transform(digits, lambda d: F.concat(F.lit("\\b("), escaped, F.lit(")[\\s-]?(\\d{"), d, F.lit("})\\b"))), "|")
    return rows.select(
        "country", F.col("short_name").alias("code"), F.get(place, F.lit(0)).try_cast("double").alias("latitude"), F.get(place, F.lit(1)).try_cast("double").alias("longitude"),
        F.coalesce(F.nullif(pattern, F.lit("")), F.lit("(?!)")).alias("pattern"), "continent",
    )


def read_types(rows: DataFrame) -> DataFrame:
    """(abbreviation, level) of a table (Level, Abbreviation)."""
    return rows.select(strip(F.col("Abbreviation")).alias("abbreviation"), F.col("Level").try_cast("int").alias("level")).filter("abbreviation is not null").dropDuplicates(["abbreviation"])


def read_affiliations(rows: DataFrame, country: str = "country", norm: str = "Norm affiliations") -> DataFrame:
    """(country, norm_aff, words) of a wide table: a column with the country, one with the normalised name, and any number with aliases."""
    aliases = [f"`{c}`" for c in rows.columns if c not in (country, norm)]
    return dictionary(unpivot(rows, country, f"`{norm}`", aliases))


def read_towns(rows: DataFrame) -> DataFrame:
    """(country, town) of a lookup table, towns folded."""
    return rows.select("country", strip(without_accents(normalize_town(F.col("town")))).alias("town"))


def category_codes(rows: DataFrame) -> DataFrame:
    """(code, category); a category without a code has code 0."""
    return rows.select(F.coalesce(F.col("code").try_cast("int"), F.lit(0)).alias("code"), "category")


def journal_codes(rows: DataFrame) -> DataFrame:
    """(journal, issn, codes) of a table with codes such as `1210; 2210;`."""
    codes = F.filter(F.transform(F.split(F.coalesce("codes", F.lit("0")), ";"), lambda c: F.trim(c).try_cast("int")), lambda c: c.isNotNull())
    return rows.select("journal", F.coalesce(F.col("issn").cast("string"), F.lit("0")).alias("issn"), codes.alias("codes"))
