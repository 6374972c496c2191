"""The observation log and the ledger as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import exprs as X
from tracewell.functions import rules as R

OBSERVATION = "id string, seq bigint, user_id string, file_generation bigint, origin string, kind string, payload string, prev_pair_ref string, created_at timestamp, checksum string"
HABIT = (
    "id string, user_id string, record_kind string, schema_version int, status string, habit_id string, condition string, behavior string, polarity int, "
    "confidence_bp bigint, activation double, staleness double, review_status string, law_hash string, checksum string, created_at timestamp, updated_at timestamp"
)
EXPERIENCE = (
    "id string, user_id string, kind string, scope_kind string, scope_key string, authority string, status string, applicability string, content string, confidence_bp bigint, approved boolean, "
    "valid_from timestamp, expires_at timestamp, last_confirmed timestamp, supersedes array<string>, conflicts_with array<string>, provenance array<struct<source:string,host:string,evidence_id:string>>, checksum string"
)
TABLES = {"observations": OBSERVATION, "habits": HABIT, "experiences": EXPERIENCE}


def chained(rows: DataFrame, key: list[str], order: list[str], content: list[str], start: DataFrame | None = None) -> DataFrame:
    """[S1, S40] ``rows`` as log records: gapless ``seq`` for each key, checksum, reference to the record before.

    ``start(key, seq, checksum)`` is the log's present end; without it a log begins.
    """
    parts = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content))
    w = W.partitionBy(*key).orderBy(*order)
    out = rows.withColumn("seq", F.row_number().over(w).cast("bigint"))
    if start is not None:
        out = out.join(start.select(*key, F.col("seq").alias("_seq"), F.col("checksum").alias("_sum")), key, "left")
        out = out.withColumn("seq", F.col("seq") + F.coalesce("_seq", F.lit(0)))
    out = out.withColumn("checksum", X.checksum(F.concat_ws("|", F.col("seq").cast("string"), parts)))
    before = F.lag(F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("checksum"))).over(w)
    if start is not None:
        before = F.coalesce(before, F.concat(F.col("_seq").cast("string"), F.lit(":"), F.col("_sum")))
    return out.withColumn("prev_pair_ref", before).drop("_seq", "_sum")


def chain_errors(log: DataFrame, key: list[str]) -> DataFrame:
    """[S4, W1] Records that do not follow the one before them."""
    w = W.partitionBy(*key).orderBy("seq")
    expected = F.lag(F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("checksum"))).over(w)
    gap = F.col("seq") != F.coalesce(F.lag("seq").over(w) + 1, F.col("seq"))
    reason = R.first_match(None, (gap, "gap"), (~F.col("prev_pair_ref").eqNullSafe(expected), "reference"))
    return log.withColumn("reason", reason).filter("reason is not null")


def bounded(log: DataFrame, key: list[str], after: Column, through: Column, rows: int = 200, most_bytes: int = 80_000, size: str = "nbytes") -> DataFrame:
    """[S3, W2] The records of each key in ``(after, through]`` up to so many rows and bytes; the first overflow ends the read."""
    w = W.partitionBy(*key).orderBy("seq")
    seen = log.filter((F.col("seq") > after) & (F.col("seq") <= through))
    run = seen.withColumn("nth", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.filter((F.col("nth") <= rows) & (F.col("used") <= most_bytes)).drop("nth")


def coverage(reads: DataFrame, key: str = "user_id") -> DataFrame:
    """[A17, R2] Whether the reads of a log begin at 1, leave no gap and reach their last row."""
    w = W.partitionBy(key).orderBy("seq_start", "seq_end").rowsBetween(W.unboundedPreceding, -1)
    prev = F.coalesce(F.max("seq_end").over(w), F.lit(0))
    state = R.first_match("advance", (F.col("seq_start") > prev + 1, "gap"), (F.col("seq_end") <= prev, "no_op"))
    return reads.withColumn("state", state)


def watermarks(updates: DataFrame, key: str = "user_id") -> DataFrame:
    """[R1, S39] The furthest position of each key and what happened to each update on the way."""
    w = W.partitionBy(key).orderBy("pos", "seq").rowsBetween(W.unboundedPreceding, -1)
    top = F.max(F.struct("seq", "checksum")).over(w)
    state = R.first_match(
        "advance",
        (top.isNull(), "advance"),
        (F.col("seq") < top["seq"], "backward"),
        ((F.col("seq") == top["seq"]) & (F.col("checksum") != top["checksum"]), "collision"),
        (F.col("seq") == top["seq"], "no_op"),
    )
    return updates.withColumn("state", state)


def rotated(tails: DataFrame, marks: DataFrame, now: Column, days: int) -> DataFrame:
    """[S7] Generations read to their end, with the time at which their archive expires."""
    if days not in (7, 14, 30):
        raise ValueError("retention is 7, 14 or 30 days")
    done = tails.join(marks, ["file_generation", "seq"])
    return done.withColumn("expires_at", now + F.make_interval(days=F.lit(days)))


def expired(archives: DataFrame, now: Column) -> DataFrame:
    """[S8] Archives to drop: expiry reached, the moment itself included."""
    return archives.filter(F.col("expires_at") <= now)


def read_log(spark: SparkSession, path: str, schema: str = OBSERVATION) -> tuple[DataFrame, DataFrame]:
    """[S4, S5, S26] Records of JSON lines, and the lines that are none (kept, redacted)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _corrupt string", options).alias("r"))
    good = read.filter(F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")
    bad = read.filter(F.col("r._corrupt").isNotNull()).select(X.redact(F.col("value")).alias("line"))
    return good, bad


def write_log(records: DataFrame, path: str) -> None:
    """[S1, S7] Appended Parquet, a folder for each generation; Spark's commit protocol makes it atomic."""
    records.write.mode("append").partitionBy("file_generation").parquet(path)


def open_ledger(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """[S10] The ledger's tables under their fixed schemas; a missing folder is an error."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}


def rows_of(table: DataFrame, users: list[str] | None = None, kinds: list[str] | None = None, statuses: list[str] | None = None, ids: list | None = None) -> DataFrame:
    """[S12-S14, S17] Rows by user, kind, status and id; an empty list has no rows."""
    out = table
    for column, values in (("user_id", users), ("record_kind", kinds), ("status", statuses), ("id", ids)):
        if values is not None:
            out = out.filter(F.col(column).isin(values)) if values else out.filter(F.lit(False))
    return out


def active_rows(table: DataFrame, parts: list[str], strict: bool) -> DataFrame:
    """[S15, S16] Active rows that match their checksums; a bad row is dropped or, if ``strict``, fails the query."""
    ok = R.intact(F.col("checksum"), *(F.col(p) for p in parts))
    live = table.filter("status = 'active'")
    if strict:
        return live.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("row checksum mismatch")).cast("boolean")))
    return live.filter(ok)


def usable_records(records: DataFrame, now: Column, scope_kind: str | None = None, scope_key: str | None = None) -> DataFrame:
    """[S18] Records valid at a time, of the user's scope or of one exact scope."""
    scope = (F.col("scope_kind") == scope_kind) & F.col("scope_key").eqNullSafe(F.lit(scope_key)) if scope_kind else F.lit(True)
    return records.filter(R.valid_at(now) & scope)


def typed_rows(raw: DataFrame, schema: str, key: str = "data_json") -> DataFrame:
    """[S11, S32, U7] Typed columns from JSON, the unknown keys kept as a residual, bad rows marked."""
    known = T.StructType.fromDDL(schema).names
    parsed = raw.withColumn("r", F.from_json(key, schema)).withColumn("all", F.from_json(key, "map<string,string>"))
    residual = F.to_json(F.map_filter("all", lambda k, v: ~k.isin(known)))
    return parsed.select(*(c for c in raw.columns if c != key), "r.*", residual.alias("residual"), F.col("all").isNull().alias("quarantined"))


def audit(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """[S23, S24] Changed rows as before and after JSON, identified by their content."""
    image = lambda s: F.to_json(F.struct(*(F.col(f"{s}.{c}") for c in columns)))
    both = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}")).select(F.col(f"a.{key}").alias("target_id"), image("b").alias("before"), image("a").alias("after"))
    changed = both.filter("before != after")
    return changed.withColumn("id", X.stable_id("audit", F.concat_ws("|", F.col("target_id").cast("string"), "before", "after")))


def report(habits: DataFrame) -> DataFrame:
    """[S28] Each user's habits as one JSON array by status and id; rows with secrets are refused."""
    line = F.struct("status", "id", "condition", "behavior")
    out = habits.filter(~X.sensitive(F.concat_ws(" ", "condition", "behavior")))
    return out.groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list(line))).alias("report"))
