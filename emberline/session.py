"""Session defaults and table schemas."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def session(cpus: int | str = "*", partitions: int | None = None, **config: str) -> SparkSession:
    """A local session with adaptive execution on and times in UTC; extra settings by keyword (dots as __)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("emberline")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions or os.cpu_count() or 8),
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in config.items()}
    for k, v in defaults.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes NULL, the engine's only spelling of a missing number."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The scratch folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder; any other is refused, since
    a folder of one machine can't be read on the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is not set; with the master {master} it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="emberline_")
        atexit.register(shutil.rmtree, _FALLBACK[app], ignore_errors=True)
    return _FALLBACK[app]


#: Bytes that a Parquet writer of a scratch table holds back, about: tasks of many columns or long texts stay small.
ROW_GROUP = 16 << 20


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends here, and a lost
    executor costs one re-read. Filters on the columns ``by`` read their own folders only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberline/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*by).option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
