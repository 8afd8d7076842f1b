"""Small lookup tables made here for the queries; a user brings their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.runtime import read

TYPES = [("Nro", 1), ("Rto", 2), ("Univ", 3), ("CNRS-Lab", 4), ("Site", 5)]
JOURNALS = [
    ("Archive for Structural Biofilm Control", "00000001", [2501, 2502]), ("Letters in Digital Enzyme Kinetics", "00000002", [1303, 1500]),
    ("Advances in Comparative Thermal Storage", "00000003", [2102]), ("none", "90110072", [2100, 2502]), ("none either", "91121337", [1303]), ("Annals of Applied Citation Studies", "00000004", [3309]),
]
CATEGORIES = [
    (1300, "General Biochemistry"), (1303, "Biochemistry"), (1500, "General Chemical Engineering"), (2100, "General Energy"), (2102, "Energy Engineering"), (2500, "General Materials Science"),
    (2501, "Materials Science (miscellaneous)"), (2502, "Biomaterials"), (3300, "General Social Sciences"), (3309, "Library and Information Sciences"),
]


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPES, "abbreviation string, level int")


def journal_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JOURNALS, "journal string, issn string, codes array<int>")


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "code int, category string")


ZIP_PLAIN = r"\b([a-z]{1,2})?[\s-]?(\d{4,6})\b"
ZIP_COUNTRIES = ["France", "Germany", "Sweden", "China", "Italy", "Spain", "Japan", "Netherlands", "Switzerland", "Belgium", "Austria", "Greece", "Ireland", "Morocco", "Algeria", "Romania", "Portugal", "Hungary"]


def zip_table(spark: SparkSession) -> DataFrame:
    """Patterns of postal codes by country, for countries without a rule of their own."""
    return spark.createDataFrame([(c, ZIP_PLAIN) for c in ZIP_COUNTRIES], "country string, pattern string")


def town_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, town): first words of the listed institutions, each in the country where most of the test addresses place it."""
    towns = read(spark, sf_dir, "canonical_values").filter("field_name = 'institution'").select(F.element_at(F.split("canonical", " "), 1).alias("town")).distinct()
    placed = read(spark, sf_dir, "address_inst").filter("address is not null and country is not null").select("country", F.explode(F.array_distinct(F.split("address", r"[^\p{L}]+"))).alias("town"))
    met = placed.join(F.broadcast(towns), "town").groupBy("town", "country").agg(F.count("*").alias("n"))  # a list of fixed length
    return met.groupBy("town").agg(F.max_by("country", F.struct("n", "country")).alias("country")).select("country", "town")


def affiliation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, norm_aff, alias): the listed institutions in the country of their town, as listed and with the kind spelled out."""
    listed = read(spark, sf_dir, "canonical_values").filter("field_name = 'institution'").select(F.col("canonical").alias("norm_aff"), F.element_at(F.split("canonical", " "), 1).alias("town"))
    kind, n = F.element_at(F.split("norm_aff", " "), -1), F.size(F.split("norm_aff", " "))
    spelled = F.concat_ws(" ", F.slice(F.split("norm_aff", " "), 1, n - 1), F.when(kind == "Univ", F.lit("University")).otherwise(kind))
    return listed.join(town_table(spark, sf_dir), "town").select("country", "norm_aff", F.explode(F.array_distinct(F.array("norm_aff", spelled))).alias("alias"))
