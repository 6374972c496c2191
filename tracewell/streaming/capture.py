"""Keyed state machines over streams, and their batch twins."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIR = "conv_id bigint, turn bigint, user_text string, assistant_text string"
PAIR_STATE = "seen bigint, turn bigint, user_text string, answer string, dropping boolean"


def paired(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """[R3, R4, W6] A user turn with the last non-empty answer before the next user turn.

    Two user turns in a row are ambiguous and both dropped.
    """
    w = W.partitionBy(key).orderBy("turn")
    spoken = turns.filter("role in ('user', 'assistant')")
    run = spoken.withColumn("nth", F.count_if(F.col("role") == "user").over(w))
    asked = F.col("role") == "user"
    told = ~asked & (F.trim("text") != "")
    out = run.filter("nth > 0").groupBy(key, "nth").agg(
        F.min(F.when(asked, F.col("turn"))).alias("turn"),
        F.any_value(F.when(asked, F.col("text")), True).alias("user_text"),
        F.max_by(F.when(told, F.col("text")), F.when(told, F.col("turn"))).alias("assistant_text"),
    )
    late = W.partitionBy(key).orderBy("nth")
    open_ = F.col("assistant_text").isNull()
    out = out.withColumn("dropped", F.lag(open_).over(late))
    return out.filter(~open_ & ~F.coalesce("dropped", F.lit(False))).select(key, "turn", "user_text", "assistant_text")


def pair_machine(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, silent_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """[R3] One conversation's turns in order: the next user turn or a ``settle`` row gives the pending pair out.

    A turn at or below the last one seen comes too late and is dropped.  A
    conversation that is silent for ``silent_ms`` settles and is forgotten.
    """
    seen, turn, user, answer, dropping = state.get if state.exists else (-(1 << 62), None, None, None, False)
    out = []

    def settle() -> None:
        if user is not None and answer and not dropping:
            out.append((key[0], turn, user, answer))

    if state.hasTimedOut:
        settle()
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("turn")
        for t, role, text in zip(rows["turn"], rows["role"], rows["text"]):
            if t <= seen:
                continue
            seen = int(t)
            if role in ("user", "settle"):
                settle()
                dropping = role == "user" and user is not None and not answer
                turn, user, answer = (int(t), text, None) if role == "user" else (None, None, None)
            elif role == "assistant" and user is not None and (text or "").strip():
                answer = text
        state.update((seen, turn, user, answer, dropping))
        if silent_ms:
            state.setTimeoutDuration(silent_ms)
    yield pd.DataFrame(out, columns=["conv_id", "turn", "user_text", "assistant_text"])


def pair_stream(turns: DataFrame, silent_ms: int | None = None) -> DataFrame:
    """[R3] ``paired`` over a stream of ``conv_id, turn, role, text``; state is one pending pair a conversation.

    A stream that runs on should give ``silent_ms``, or state is kept for ever;
    one that ends with what is there cannot, as Spark waits for timeouts.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if silent_ms else GroupStateTimeout.NoTimeout

    def machine(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from pair_machine(key, batches, state, silent_ms)

    return turns.groupBy("conv_id").applyInPandasWithState(machine, PAIR, PAIR_STATE, "append", timeout)


def settled(turns: DataFrame) -> DataFrame:
    """Turns of conversations that are over once read, each followed by the row that settles them."""
    last = F.struct(F.lit(2**62).alias("turn"), F.lit("settle").alias("role"), F.lit(None).cast("string").alias("text"))
    own = F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return turns.select("conv_id", F.inline(F.array(own, last)))


def first_events(events: DataFrame, key: str = "event_fingerprint", at: str = "ts", within: str = "1 hour") -> DataFrame:
    """[R9, S2] A stream's events, each fingerprint once within the watermark."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def coalesced(deltas: DataFrame, keys: list[str], most: int = 5, order: str = "pos") -> DataFrame:
    """[R7] Waiting deltas of a key merged into one; the first ``most`` keys of a scope wait, others are dropped."""
    merged = deltas.groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("merged"), F.max(order).alias("last"))
    nth = F.row_number().over(W.partitionBy(keys[0]).orderBy("first"))
    return merged.withColumn("state", F.when(nth <= most, "queued").otherwise("dropped"))


def live_queue(batches: DataFrame, now: Column, ttl_seconds: int = 7200, keep: int = 20) -> DataFrame:
    """[R10] Distinct batches of a scope within their time to live, the newest ``keep``."""
    once = batches.groupBy("scope", "batch_id").agg(F.min("created_at").alias("created_at"))
    alive = once.filter(F.col("created_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    nth = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("created_at"), F.desc("batch_id")))
    return alive.withColumn("nth", nth).filter(F.col("nth") <= keep)


def drafts(events: DataFrame, ttl_seconds: int = 900) -> DataFrame:
    """[R11] Sessions of a scope's touches that are no more than the time to live apart."""
    w = W.partitionBy("scope").orderBy("ts", "pos")
    gap = F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)) > ttl_seconds, F.lit(True))
    marked = events.withColumn("session", F.sum(gap.cast("int")).over(w))
    return marked.groupBy("scope", "session").agg(F.min("ts").alias("opened"), F.max("ts").alias("touched"), F.count("*").alias("touches"))


def turn_deltas(turns: DataFrame, most: int = 4000) -> DataFrame:
    """[R12] Redacted, bounded, fingerprinted turns that no advisor caused."""
    from tracewell.functions import exprs as X

    text = X.truncated(F.col("text"), most)
    return turns.filter("not advisor").withColumns({"text": text, "fingerprint": X.event_fingerprint(F.col("conv_id"), F.col("turn"), text)})


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """[R5, R6] Run a stream over all that is there by now and return what it wrote; what comes later waits."""
    at = os.path.join(folder, f"stream-{uuid.uuid4().hex}")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def micro_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> None:
    """[R5, R8] Hand each micro-batch to ``step``; a batch that failed is given again, with its number."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parquet")
