"""Reading and writing panels."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import nan_to_null
from .schema import equity_flags, existing, missing


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the files' footers alone."""
    return spark.read.parquet(path).columns


def read_panel(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Columns of a Parquet panel (pruned in the scan), NaN as NULL."""
    df = spark.read.parquet(path)
    return nan_to_null(df if columns is None else df.select(*columns))


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """The row's place in its source as a sortable column: file and row number for a scan of files,
    which stays the same if a task is repeated.

    What is no scan (a frame after a shuffle) has no places; rows are then numbered as the plan
    brings them, and a repeated task may number them differently. Where rows can tie, name the row
    before anything shuffles, or write the frame and scan it."""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    if "_metadata" in {hidden.apply(i).name() for i in range(hidden.size())}:
        return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return df.withColumn(name, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")))


def write_panel(df: DataFrame, path: str, *order: str) -> None:
    """Written as Parquet, sorted by ``order`` over all files; what was there is replaced."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(path)


def _place(spark: SparkSession, path: str):
    """The file system of a path, whichever it is, and the path in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def rewrite_panel(spark: SparkSession, path: str, change) -> None:
    """Replace the panel at ``path`` by ``change`` of it: written beside it, then put in its place.

    The old panel is put back if the new one cannot take its place; if the program ends between the
    two steps it is found beside ``path`` (named .old-*), and the next call puts it back first."""
    path = path.rstrip("/")
    fs, place = _place(spark, path)
    if not fs.exists(place):
        for left in fs.globStatus(place.suffix(".old-*")) or []:
            if fs.rename(left.getPath(), place):
                break
    fresh, old = (place.suffix(f".{kind}-{uuid.uuid4().hex[:8]}") for kind in ("new", "old"))
    change(spark.read.parquet(path)).write.parquet(fresh.toString())
    if not fs.rename(place, old):
        raise OSError(f"could not set {path} aside")
    try:
        done = fs.rename(fresh, place)
    except Exception:
        fs.rename(old, place)
        raise
    if not done:
        fs.rename(old, place)
        raise OSError(f"could not put {fresh.toString()} in the place of {path}")
    fs.delete(old, True)


def missing_columns_csv(spark: SparkSession, path: str, requested: Iterable[str], source: Iterable[str]) -> None:
    """The requested columns that the source lacks: a heading, UTF-8 with byte order mark; on whatever
    file system the path names."""
    fs, place = _place(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(("missing_column\n" + "".join(f"{c}\n" for c in missing(requested, source))).encode("utf-8-sig")))
    finally:
        out.close()


def missing_columns(spark: SparkSession, requested: Iterable[str], source: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in missing(requested, source)], "missing_column string")


def extract_columns(df: DataFrame, requested: Iterable[str], flags=equity_flags) -> DataFrame:
    """The requested columns there are, then the source's flags."""
    return df.select(*existing([*requested, *flags(df.columns)], df.columns))
