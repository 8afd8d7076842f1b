"""Writers of item tables."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = {"parquet": {}, "dat": {"sep": "\t"}, "csv": {"sep": ","}}


# Second sort column of item tables; all are sorted by publication first (fixed values).
SORTS = {"authors": "idx_author", "addresses": "idx_address", "countries": "idx_address", "institutions": "idx_address", "authors_institutions": "idx_author", "norm_institutions": "idx_address", "raw_institutions": "idx_address"}


def sort_item(name: str, rows: DataFrame) -> DataFrame:
    keys = [c for c in ("pub_id", SORTS.get(name)) if c in rows.columns]
    return rows.orderBy(*keys) if keys else rows


def write_items(items: dict[str, DataFrame], folder: str, extent: str = "parquet") -> None:
    """Each item table below the folder, sorted, as parquet, tab-separated `dat` or comma-separated `csv`."""
    options = FORMATS[extent]
    for name, rows in items.items():
        writer = sort_item(name, rows).write.mode("overwrite")
        if extent == "parquet":
            writer.parquet(f"{folder}/{name}.parquet")
        else:
            writer.option("header", True).option("escape", '"').options(**options).csv(f"{folder}/{name}.{extent}")


def write_success(rates: DataFrame, lost: DataFrame, folder: str) -> None:
    """The rates, and the publications without a value in a table of their own."""
    rates.write.mode("overwrite").json(f"{folder}/failed.json")
    lost.write.mode("overwrite").parquet(f"{folder}/failed_ids.parquet")


def write_ids(ids: DataFrame, folder: str, name: str) -> None:
    ids.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_ids.csv")


def add_header(spark: SparkSession, source: str, target: str, schema: StructType) -> None:
    """A headerless tab-separated file with a header; an empty one becomes a header alone."""
    rows = spark.read.schema(schema).option("sep", "\t").csv(source)
    rows.select(*[F.col(c) for c in schema.names]).write.mode("overwrite").option("header", True).option("sep", "\t").csv(target)


def add_headers(spark: SparkSession, folder: str, target: str, schemas: dict[str, StructType], extension: str = "dat") -> list[str]:
    """All headerless item files below a folder whose names are known; the names of those written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(folder).select("path").collect()
    done = []
    for path in sorted(r[0] for r in files):  # a handful of item files
        name = PurePath(path).stem
        if name in schemas:
            add_header(spark, path, f"{target}/{name}.{extension}", schemas[name])
            done.append(name)
    return done
