"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import exprs as X


def selector(hits: DataFrame, stale: float = 0.8) -> DataFrame:
    """[A6] Injections, skips and the share of stale injections of each mode."""
    mode = F.coalesce("mode", F.when(F.col("model") == "lexical", "instant").otherwise("smart"))
    injected = (F.col("action") == "inject") & (F.col("selected") == 1)
    out = hits.groupBy(mode.alias("mode")).agg(
        F.count_if(injected).alias("inject"), F.count_if(F.col("action") == "skip").alias("skip"), F.count_if(injected & (F.coalesce("staleness", F.lit(0.0)) > stale)).alias("stale")
    )
    return out.withColumn("stale_hit_rate", F.when(F.col("inject") > 0, F.col("stale") / F.col("inject")).otherwise(0.0))


def action_counts(audits: DataFrame) -> DataFrame:
    """[A7]"""
    return audits.groupBy("action").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """[A8] Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def line_count(text: Column) -> Column:
    """[A22] Lines that are not blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("bigint")


def review_summary(habits: DataFrame) -> DataFrame:
    """[A9]"""
    status = lambda s: F.count_if(F.col("status") == s)
    return habits.groupBy("user_id").agg(
        status("candidate").alias("candidates"), status("active").alias("active"), F.count_if(F.col("review_status").startswith("approved_pending_")).alias("waiting"), F.count_if(F.col("review_status") == "duplicate_resolution").alias("duplicates")
    )


def receipts(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """[A13, S27] Sums and counts of a user's receipts, and their error codes."""
    codes = F.array_join(F.sort_array(F.collect_set("safe_code")), ",")
    return rows.groupBy(key).agg(
        F.sum("checked").alias("checked"), F.sum("new_suggestions").alias("new_suggestions"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.bool_or("queue_overflowed").alias("overflowed"), codes.alias("codes")
    )


def evictions(rows: DataFrame, cap: int, rank: str = "rank", key: str = "user_id", name: str = "name") -> DataFrame:
    """[T12, S25] What has to go so that one more fits under ``cap``: lowest rank first; unreadable rows never."""
    w = W.partitionBy(key)
    seen = rows.filter("readable").withColumn("n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(rank, name)))
    return seen.filter(F.col("nth") <= F.col("n") - cap + 1).drop("n", "nth")


def nearest_rank(samples: DataFrame, key: str, value: str, q: float = 0.95, bands: int = 32) -> DataFrame:
    """[A14] The value at rank ``ceil(n * q)``, not interpolated.

    Approximate quantiles cut each key's values into bands; the counts of
    bands tell which band holds the rank, and only its values are ordered.
    """
    cuts = samples.groupBy(key).agg(F.percentile_approx(value, [i / bands for i in range(1, bands)], 10_000).alias("cuts"), F.count(value).alias("n"))
    counted = samples.groupBy(key, value).agg(F.count("*").alias("c")).join(cuts, key).withColumn("band", F.size(F.filter("cuts", lambda x: x < F.col(value))))
    by = W.partitionBy(key).orderBy("band")
    sums = counted.groupBy(key, "band", "n").agg(F.sum("c").alias("in_band")).withColumn("upto", F.sum("in_band").over(by))
    rank = F.greatest(F.ceil(F.col("n") * q), F.lit(1))
    holds = sums.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("in_band") < rank)).select(key, "band", "n", (F.col("upto") - F.col("in_band")).alias("before"))
    ranked = counted.drop("n", "cuts").join(holds, [key, "band"]).withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy(key).orderBy(value)))
    return ranked.filter(F.col("upto") >= rank).groupBy(key).agg(F.min(value).alias("p95"), F.first("n").alias("n"))


def emitted(attempts: DataFrame, key: str = "event", order: str = "severity") -> DataFrame:
    """[T13, R9] The severest attempt of each event, the first of equals."""
    w = W.partitionBy(key).orderBy(F.desc(order), "pos")
    return attempts.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def oldest(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """[T14] The first of each scope."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(by, value)).alias(value), F.min(by).alias(by))


def recent_scopes(rows: DataFrame, key: str, by: str, keep: int = 128) -> DataFrame:
    """[T15] The scopes touched last."""
    return rows.groupBy(key).agg(F.max(by).alias(by)).orderBy(F.desc(by), key).limit(keep)


def diff_summary(proposals: DataFrame) -> DataFrame:
    """[A24] Counts of a batch's proposals and a checksum of their identities in order."""
    listed = F.array_join(F.array_sort(F.collect_list("proposal_id")), ",")
    return proposals.groupBy("batch_id").agg(F.count("*").alias("n"), X.checksum(listed).alias("checksum"))
