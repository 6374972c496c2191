"""Evidence of habits over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import exprs as X


def contradiction_days(evidence: DataFrame, key: str = "habit_id", strong_bp: int = 7500) -> DataFrame:
    """[A1, W7] Distinct days of contradiction after the last strong affirmation (all, if there was none).

    One aggregation: days are grouped first, so a hot key is summed in parts;
    a day counts if its last contradiction is later than the affirmation.
    """
    positive = (F.col("polarity") == 1) & (F.col("confidence_bp") >= strong_bp)
    daily = evidence.groupBy(key, X.utc_day(F.col("observed_at")).alias("day")).agg(
        F.max(F.when(positive, F.col("observed_at"))).alias("strong"),
        F.max(F.when(F.col("polarity") == -1, F.col("observed_at"))).alias("against"),
        F.max(F.when(F.col("polarity") == 1, F.col("observed_at"))).alias("affirmed"),
    )
    last = daily.groupBy(key).agg(F.max("strong").alias("last_strong"), F.max("affirmed").alias("last_affirmed"))
    counted = F.count_if(F.col("against").isNotNull() & (F.col("last_strong").isNull() | (F.col("against") > F.col("last_strong"))))
    return daily.join(last, key).groupBy(key, "last_strong", "last_affirmed").agg(counted.alias("contradiction_days"))


def staleness(evidence: DataFrame, now: Column, key: str = "habit_id") -> DataFrame:
    """[X19] Staleness of each habit at ``now``."""
    days = F.datediff(now, F.to_date("last_affirmed"))
    return contradiction_days(evidence, key).withColumn("staleness", X.staleness(F.coalesce(days, F.lit(0)), F.col("contradiction_days")))


def repetition(evidence: DataFrame, key: str = "habit_id", least: int = 3, days: int = 2) -> DataFrame:
    """[A2, A3] Whether a habit was seen often enough, on enough days; by distinct references."""
    daily = evidence.groupBy(key, X.utc_day(F.col("observed_at")).alias("day")).agg(F.count("*").alias("n"))
    return daily.groupBy(key).agg(F.sum("n").alias("n"), F.count("day").alias("days")).withColumn("eligible", (F.col("n") >= least) & (F.col("days") >= days))


def repeated_evidence(evidence: DataFrame, seen: DataFrame, key: str = "habit_id", least: int = 3, days: int = 2) -> DataFrame:
    """[A4, U5, U8] Own observations plus advisor events not seen before, with enough days."""
    unseen = evidence.filter("advisor").dropDuplicates([key, "fingerprint"]).join(seen, [key, "fingerprint"], "left_anti")
    rows = evidence.filter("not advisor").unionByName(unseen)
    return repetition(rows, key, least, days)


def split_metadata(evidence: DataFrame, key: str = "habit_id") -> DataFrame:
    """[A5, U6] First event of each fingerprint; sorted distinct days of the other references."""
    first = evidence.filter("advisor").groupBy(key, "fingerprint").agg(F.min_by("seq", F.struct("observed_at", "seq")).alias("seq"))
    events = first.groupBy(key).agg(F.count("*").alias("advisor_events"), F.min("seq").alias("first_seq"))
    dates = evidence.filter("not advisor").groupBy(key).agg(F.sort_array(F.collect_set(F.col("observed_at").cast("date").cast("string"))).alias("dates"))
    return dates.join(events, key, "full_outer")


def compact_context(evidence: DataFrame, key: str = "habit_id", last: int = 30, limit: int = 60) -> DataFrame:
    """[A10, T9] Habits by last sight, with counts and their last days, at most ``limit``."""
    daily = evidence.groupBy(key, F.to_date("observed_at").alias("day")).agg(
        F.count_if(~F.col("advisor")).alias("own"), F.count_if("advisor").alias("advised"), F.max("observed_at").alias("at")
    )
    days = F.sort_array(F.collect_list("day"))
    out = daily.groupBy(key).agg(F.sum("own").alias("refs"), F.sum("advised").alias("advisor_events"), F.max("at").alias("updated_at"), days.alias("days"))
    tail = F.slice("days", F.greatest(F.size("days") - last + 1, F.lit(1)), F.lit(last))
    return out.withColumn("days", tail).orderBy(F.desc("updated_at"), key).limit(max(1, min(100, limit)))


def last_ref(refs: DataFrame, key: str) -> DataFrame:
    """[A15] The reference of the highest sequence number."""
    return refs.groupBy(key).agg(F.max_by("checksum", "seq").alias("checksum"), F.max("seq").alias("seq"))


def merged(existing: DataFrame, incoming: DataFrame, key: str = "id", most: int = 64) -> DataFrame:
    """[A18-A20, D2, U4] Both versions of a record: greatest confidence, latest time, references united in order."""
    old, new = existing.alias("o"), incoming.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    empty = F.array().cast("array<string>")
    refs = F.array_distinct(F.concat(F.coalesce("o.refs", empty), F.coalesce("n.refs", empty)))
    return both.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key),
        F.greatest("o.confidence_bp", "n.confidence_bp").alias("confidence_bp"),
        F.greatest("o.last_confirmed", "n.last_confirmed").alias("last_confirmed"),
        F.slice(F.array_sort(refs), 1, most).alias("refs"),
        F.coalesce("o.review_status", "n.review_status").alias("review_status"),
        F.when(F.col(f"n.{key}").isNull(), "kept").when(F.col(f"o.{key}").isNull(), "inserted").otherwise("merged").alias("action"),
    )


def numbered_refs(refs: DataFrame, key: str, keep: int = 20, newest: bool = False, by: str = "observed_at") -> DataFrame:
    """[T10] The first or last rows of each key."""
    order = [F.desc(by), F.desc("seq")] if newest else [F.col(by), F.col("seq")]
    return refs.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("nth") <= keep)
