"""Vectors prepared for what lacks them, by a supplied model ([D23], [D27], [D28])."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import retrieval
from tracewell.sources.tables import materialize

Embed = Callable[[list[str]], Sequence[Sequence[float]]]

#: Texts that the model is given at once.
BATCH = 64


def embedded(rows: DataFrame, embed: Embed, dimensions: int, batch: int = BATCH, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """``rows(id, checksum, text)`` with ``vector`` (unit length, single precision) or an ``error``.

    A task calls ``embed`` with at most ``batch`` texts.  A call that fails, or
    does not give a vector for each text, is tried again, ``tries`` times in
    all, and then costs its own texts only; a vector of other dimensions,
    of no length or not finite costs only itself.
    """

    def call(texts: list[str]) -> tuple[Sequence[Sequence[float]] | None, str | None]:
        error = None
        for attempt in range(tries):
            try:
                vectors = embed(texts)
                if len(vectors) == len(texts):
                    return vectors, None
                error = "vector_count_invalid"
            except Exception as e:  # whatever a model raises is told in the row
                error = f"model_failed: {type(e).__name__}"
            time.sleep(wait * 2**attempt)
        return None, error

    def unit(vector: Sequence[float]) -> tuple[list[float] | None, str | None]:
        x = np.asarray(vector, float)
        if x.shape != (dimensions,):
            return None, "dimensions_invalid"
        size = float(np.sqrt((x * x).sum()))
        if not 0 < size < np.inf:
            return None, "vector_invalid"
        return (x / size).astype("<f4").tolist(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                b = whole.slice(start, batch)
                vectors, error = call([t or "" for t in b.column("text").to_pylist()])
                made = [(None, error)] * b.num_rows if vectors is None else [unit(v) for v in vectors]
                yield pa.record_batch([b.column("id"), b.column("checksum"), pa.array([v for v, _ in made], pa.list_(pa.float32())), pa.array([e for _, e in made], pa.string())], ["id", "checksum", "vector", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "checksum"))
    return rows.select("id", "checksum", "text").mapInArrow(run, f"{kinds}, vector array<float>, error string")


def prepared(wanted: DataFrame, present: Callable[[], DataFrame], cache: DataFrame, embed: Embed, dimensions: int, batch: int = BATCH, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """The cache after all of ``wanted(id, user_id, checksum, text)`` that it lacks, or has for another text, is prepared; and each row's outcome.

    ``cache(id, checksum, vector)``.  The model is asked once a row, and what
    it gave is written down; ``present()`` is read after that, and a row that
    is gone or has another checksum by then is ``changed`` and not written.
    Outcomes are ``cached``, ``written``, ``changed`` or the error.
    """
    states = retrieval.cached(wanted, cache, ["id"])
    made = materialize(embedded(states.filter("state != 'valid'"), embed, dimensions, batch, tries))
    now = present().select("id", F.col("checksum").alias("now"))
    outcome = F.when(~F.col("now").eqNullSafe(F.col("checksum")), "changed").otherwise(F.coalesce("error", F.lit("written")))
    told = materialize(made.join(now, "id", "left").select("id", "checksum", "vector", outcome.alias("outcome")))
    fresh = told.filter("outcome = 'written'").select("id", "checksum", "vector")
    after = cache.join(fresh.select("id"), "id", "left_anti").select("id", "checksum", "vector").unionByName(fresh)
    outcomes = states.filter("state = 'valid'").select("id", F.lit("cached").alias("outcome")).unionByName(told.select("id", "outcome"))
    return after, outcomes
