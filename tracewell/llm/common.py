"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.tables import materialize, scratch, shared_dir  # noqa: F401  the operators have them from here

#: Rows and bytes of an Arrow batch, which Spark and Python both hold whole; documents can be long.
BATCH, BATCH_BYTES = 1_000, 8 << 20

#: Rows of an Arrow batch that Python hands back at most: Spark holds a batch outside its heap.
RETURNED = 10_000

#: Word and white-space classes of the contracts, as Java regular expressions.
WORD_SEP = r"[\x20\x09-\x0D]+"


def discard(*tables: DataFrame) -> None:
    """Removes what ``materialize`` wrote, once nothing that is still to run reads it."""
    for t in tables:
        jvm, context = t.sparkSession._jvm, t.sparkSession._jsc
        for folder in {os.path.dirname(f) for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Has the session hand Python at most ``BATCH`` rows and about ``BATCH_BYTES`` at a time, as settings: they outlive the call."""
    for setting, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        setting = f"spark.sql.execution.arrow.{setting}"
        if not 0 < int(spark.conf.get(setting).removesuffix("b")) <= most:
            spark.conf.set(setting, str(most))


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or some more, but for the last: for narrow rows, where ``BATCH`` is little."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, forget: Callable[[], None] | None = None, rows: int = 0) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size, whose tasks give back the memory they leave unused.

    Python workers outlive a task and serve later stages, so what each leaves
    behind (``forget`` empties its caches) would add up over a long job.
    ``rows`` asks for larger batches again.
    """
    bounded_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in run(regrouped(batches, rows) if rows else batches):
                yield from (b.slice(i, RETURNED) for i in range(0, max(1, b.num_rows), RETURNED))
        finally:
            if forget:
                forget()
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns free memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and \\t..\\r."""
    return F.filter(F.split(text, WORD_SEP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def met(members: DataFrame, hubs: DataFrame, n: int) -> DataFrame:
    """``members(hub, ...)`` with their hub's row of ``hubs(hub, of, ...)``; ``of`` is the hub's size, ``n`` the number of memberships.

    Of hubs with over a thousandth of all memberships there are less than a
    thousand: they go to every task and their members stay where they are.
    The others meet at the hub.
    """
    large = hubs.filter(F.col("of") * 1000 > n)
    names = F.broadcast(large.select("hub"))
    rest = members.join(names, "hub", "left_anti").join(hubs.filter(F.col("of") * 1000 <= n), "hub")
    return members.join(F.broadcast(large), "hub").unionByName(rest)
