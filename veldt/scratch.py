"""Shared scratch space: lineage is cut by writing Parquet where every executor can read it.

The folder is ``spark.checkpoint.dir`` of the session, or the checkpoint folder of its context. Only where neither is
set and all runs in one machine's process (tests, a laptop) is a folder of our own chosen. What is written survives the loss of any executor and is removed when the JVM ends.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Paths made under a tag, until its next use.
_made: dict[str, list[str]] = {}
_tag: list[str] = []

#: Seconds between the driver's collections of garbage.
FREE_S = 3.0
_freed = [0.0]

#: Used only where the session names no shared folder.
OWN = "/tmp/checkpoints/veldt"


def folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = OWN
    return f"{base.rstrip('/')}/veldt-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path not used before, removed at the JVM's end."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if _tag:
        _made[_tag[-1]].append(path)
    return path


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """What is made inside goes when the tag is used again: for steps whose results are written before the next."""
    for path in _made.pop(tag, []):
        drop(spark, path)
    _made[tag] = []
    _tag.append(tag)
    try:
        yield
    finally:
        _tag.pop()


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, name: str, hashes: Sequence[str] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back; later stages never recompute it. ``hashes`` are columns, or
    paths in them, whose values hardly repeat: Parquet makes no dictionaries of them."""
    return kept_at(df, name, hashes)[0]


def kept_at(df: DataFrame, name: str, hashes: Sequence[str] = ()) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)
    # Shuffle files go when the driver has collected the plans that made them: don't wait for memory to run short.
    if time.monotonic() - _freed[0] > FREE_S:
        spark.sparkContext._jvm.System.gc()
        _freed[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path), path
