"""Table sources and sinks: delimited text, Parquet, JDBC, and safe output paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import year_of
from ..session import nan_to_null


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Delimited text with a header and a declared schema; empty fields and NaN are NULL."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("nullValue", "").csv(paths))


def read_yearly(spark: SparkSession, patterns: list[str], schema: str) -> DataFrame:
    """All files of some patterns with ``year`` from the first four digits of each path; broken files are skipped.

    No match gives an empty table.
    """
    found = [p for p in patterns if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], f"{schema}, year int")
    d = spark.read.schema(schema).option("header", True).option("ignoreCorruptFiles", True).csv(found)
    return d.withColumn("year", year_of(F.input_file_name()))


def _path(spark: SparkSession, pattern: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, pattern: str) -> bool:
    p, fs = _path(spark, pattern)
    return bool(fs.globStatus(p))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, on any file system that Spark reads."""
    p, fs = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def read_folder(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """A table for each .csv file of a folder, by its name without the ending; unknown names have inferred types."""
    out = {}
    for path in list_files(spark, f"{folder.rstrip('/')}/*.csv"):
        name = path.rsplit("/", 1)[1][:-4]
        reader = spark.read.option("header", True)
        out[name] = nan_to_null((reader.schema(schemas[name]) if name in schemas else reader.option("inferSchema", True)).csv(path))
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC; ``partition`` (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def read_legend(spark: SparkSession, path: str) -> DataFrame:
    """Value, Label, Red, Green, Blue; header names are stripped, a missing one is refused."""
    d = spark.read.option("header", True).csv(path)
    d = d.toDF(*[c.strip() for c in d.columns])
    missing = [c for c in ("Value", "Label", "Red", "Green", "Blue") if c not in d.columns]
    if missing:
        raise ValueError(f"legend lacks {missing}")
    return d.select(*[F.col(c).cast("int") for c in ("Value",)], "Label", *[F.col(c).cast("int") for c in ("Red", "Green", "Blue")])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def free_path(spark: SparkSession, path: str, first: int = 1) -> str:
    """The path, or the first of path_1, path_2, ... that does not exist."""
    if not _exists(spark, path):
        return path
    stem, dot, ending = path.rpartition(".") if "." in path.rsplit("/", 1)[-1] else (path, "", "")
    k = first
    while _exists(spark, f"{stem}_{k}{dot}{ending}"):
        k += 1
    return f"{stem}_{k}{dot}{ending}"


def write_new(df: DataFrame, path: str) -> str:
    """Write where nothing is overwritten; returns the path taken."""
    path = free_path(df.sparkSession, path)
    df.write.mode("errorifexists").parquet(path)
    return path


def append_rows(df: DataFrame, path: str) -> None:
    """Append-only results table: one small file a call, whole after a crash."""
    df.coalesce(1).write.mode("append").parquet(path)
