"""Scratch tables in the folder that the cluster shares.

Intermediate results that are read more than once are written as Parquet under
``spark.checkpoint.dir``. A lost executor then costs one re-read, not a
recomputation, and no file lives on one machine only.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, staged

__all__ = ["clear", "lean", "pick", "shared_dir", "shielded", "staged", "table", "tune"]

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def _size(text: str) -> int:
    """A size as Spark's settings spell it (64m, 1gb, 4096) in bytes."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text}")
    return int(found[1]) * _UNITS[found[2]]


def tune(spark: SparkSession, rows: int = 1000, size: int = 1 << 22) -> None:
    """Keep Arrow batches small in rows and bytes, so that batches of long texts fit a Python worker.

    Smaller settings of the session stay; larger ones, and none at all (0 or less), are lowered. A
    plan reads them when it runs, which may be after the operator returned, so they stay lowered.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _size(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Arrow) -> Arrow:
    """``run`` in a worker that hands freed memory back to the system, during and after each task.

    Workers outlive tasks and share an executor's memory with its heap; what a pool keeps for
    them is lost to it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        try:
            for n, batch in enumerate(run(batches)):
                yield batch
                if trim and n % 16 == 15:
                    trim(0)
        finally:
            if trim:
                trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra columns can never clash with working ones."""
    return df.select(*[df[c] for c in columns])


def shielded(docs: DataFrame, needed: tuple[str, ...], work) -> DataFrame:
    """``work`` on ``docs`` with all columns but ``needed`` folded into one, and unfolded after.

    So no extra column can clash with a name that the work uses; the column order stays.
    """
    extra = [c for c in docs.columns if c not in needed]
    if not extra:
        return work(docs)
    folded = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c in needed], F.struct(*[docs[f"`{c}`"] for c in extra]).alias("__extra"))
    out = work(folded)
    return out.select(*[F.col(f"__extra.`{c}`").alias(c) if c in extra else out[f"`{c}`"] for c in docs.columns])


def clear(spark: SparkSession) -> None:
    """Remove the scratch tables; results that have not been written yet can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/emberline")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
