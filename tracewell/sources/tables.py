"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set by ``setCheckpointDir``.

    Where neither is set and all runs on this machine (tests), a fresh local
    folder is made and set; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        context.setCheckpointDir(found)
    return found


_owners = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Owns the tables that ``materialize`` writes within: they are removed at the end.

    What is returned is written once more, by the function that this gives,
    and stays; nothing else that reads the removed tables may be used after.
    """
    owners = _owners.__dict__.setdefault("stack", [])
    mine: list[str] = []
    owners.append(mine)

    def keep(df: DataFrame, *more: DataFrame, **options: str) -> DataFrame:
        owners.pop()
        try:
            return materialize(df, *more, **options)
        finally:
            owners.append(mine)

    try:
        yield keep
    finally:
        owners.pop()
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in mine:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


@contextmanager
def settings(spark: SparkSession, **values: bool | int) -> Iterator[None]:
    """Spark's settings ``spark.sql.<name>`` (``__`` for a dot) within; as before after."""
    names = {f"spark.sql.{name.replace('__', '.')}": str(value).lower() for name, value in values.items()}
    was = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


#: What a query shuffles is removed when it ends, and not first when the driver happens to collect its garbage.
TIDY = {"classic__shuffleDependency__fileCleanup__enabled": True}


def materialize(df: DataFrame, *more: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes ``df``, and ``more`` one after another, as a Parquet table in the shared folder and reads it back: lineage is cut by files that outlive executors."""
    path = os.path.join(shared_dir(df.sparkSession), f"tracewell-{uuid.uuid4().hex}")
    owners = _owners.__dict__.get("stack")
    if owners:
        owners[-1].append(path)
    with settings(df.sparkSession, **TIDY):
        for part in (df, *more):
            part.write.mode("append").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a part of a table holds, so that what it shuffles stays small; and the most parts, as each reads the table again.
PART, PARTS = 3_000_000, 16


def parts_of(rows: int) -> int:
    return max(1, min(PARTS, math.ceil(rows / PART)))


def parts(df: DataFrame, by: list[str], n: int) -> list[DataFrame]:
    """``df`` in ``n`` parts by the hash of ``by``."""
    return [df.filter(F.pmod(F.xxhash64(*by), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]
