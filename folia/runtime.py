"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_stored: dict[int, tuple[weakref.ref, str]] = {}


def ship(spark: SparkSession | None = None, module_name: str = "folia") -> None:
    """Makes this package known to Python workers: functions are pickled by value, and the rest is sent as a zip once per application."""
    from pyspark import cloudpickle

    package = sys.modules[module_name]
    cloudpickle.register_pickle_by_value(package)
    if spark is not None and spark.sparkContext.applicationId not in _shipped:
        home = os.path.dirname(os.path.abspath(package.__file__))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="folia-"), module_name), "zip", os.path.dirname(home), module_name)
        spark.sparkContext.addPyFile(made)
        _shipped.add(spark.sparkContext.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a local one is made only where none is set and all runs on one machine (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if known:
        if not context.getCheckpointDir():
            context.setCheckpointDir(known)
        return known
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "folia-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """The same as a compressed table in the shared folder, for wide rows; its columns are read as needed."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[id(out)] = (weakref.ref(out), path)
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of tables made inside are deleted as soon as a step on them ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(df: DataFrame) -> None:
    """Deletes the files of a result of cut() or store() that no later step reads, such as the last round's state."""
    spark, kept = df.sparkSession, _stored.pop(id(df), None)
    if kept and kept[0]() is df:
        name = kept[1]
    else:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRDD" or not plan.rdd().getCheckpointFile().isDefined():
            return
        name = plan.rdd().getCheckpointFile().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_and_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and bytes of its values as text."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    n, total = df.agg(F.count("*"), F.sum(size)).first()
    return n, total or 0
