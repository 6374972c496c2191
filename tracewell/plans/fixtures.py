"""The driver's tables in the model's terms, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.sources import log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Habits: embeddings with derived status, polarity and times; 100 habits a user.
HABITS_SQL = """
habits as (
  select vec_id as id, vec_id // 100 as user_id, cast(label % 2 as int) as polarity,
    case vec_id % 5 when 0 then 'active' when 1 then 'active' when 2 then 'disabled' when 3 then 'candidate' else 'archived' end as status,
    cast((vec_id * 7919) % 10001 as bigint) as confidence_bp, ((vec_id * 31) % 100) / 100.0::double as staleness,
    case when vec_id % 3 = 0 then 'old' else 'law' end as law_hash, vec_id * 3600 as created_at,
    list_transform(embedding[1:32], lambda x: cast(x as double)) as condition, list_transform(embedding[33:64], lambda x: cast(x as double)) as behavior, label
  from embeddings)"""


def habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    status = F.when(v % 5 <= 1, "active").when(v % 5 == 2, "disabled").when(v % 5 == 3, "candidate").otherwise("archived")
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    return e.select(
        v.alias("id"),
        F.floor(v / 100).alias("user_id"),
        (F.col("label") % 2).cast("int").alias("polarity"),
        status.alias("status"),
        ((v * 7919) % 10001).cast("bigint").alias("confidence_bp"),
        (((v * 31) % 100) / 100.0).alias("staleness"),
        F.when(v % 3 == 0, "old").otherwise("law").alias("law_hash"),
        (v * 3600).alias("created_at"),
        half(1).alias("condition"),
        half(33).alias("behavior"),
        "label",
    )


COSINE_SQL = "cast(trunc(list_cosine_similarity({a}, {b}) * 10000) as bigint)"

#: Evidence: purchases and sign-ups affirm a user's habit, errors contradict it.
EVIDENCE_SQL = """
evidence as (
  select user_id as habit_id, event_id as seq, case event_type when 'error' then -1 else 1 end as polarity,
    least(10000, cast(round(value * 100) as bigint)) as confidence_bp, ts as observed_at,
    event_id % 7 = 0 as advisor, cast(event_id % 50 as varchar) as fingerprint
  from events where event_type in ('purchase', 'signup', 'error'))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup", "error"))
    return e.select(
        F.col("user_id").alias("habit_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", -1).otherwise(1).alias("polarity"),
        F.least(F.lit(10000), F.round(F.col("value") * 100).cast("bigint")).alias("confidence_bp"),
        F.col("ts").alias("observed_at"),
        (F.col("event_id") % 7 == 0).alias("advisor"),
        (F.col("event_id") % 50).cast("string").alias("fingerprint"),
    )


#: Selector log: purchases inject, views skip, errors diagnose; the mode is the parity of ``props.k``.
HITS_SQL = """
hits as (
  select event_id as seq, user_id as habit_id, user_id % 4 as user_id, ts as observed_at,
    case event_type when 'purchase' then 'inject' when 'view' then 'skip' else 'diagnostic' end as action,
    case when event_type = 'purchase' then 1 else 0 end as selected, event_type as reason,
    case when cast(json_extract_string(props, '$.k') as bigint) % 2 = 0 then 'instant' else 'smart' end as mode,
    ((event_id * 13) % 100) / 100.0::double as staleness, cast(round(value * 100) as bigint) as confidence_bp, event_id % 977 as latency_ms
  from events)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("habit_id"),
        (F.col("user_id") % 4).alias("user_id"),
        F.col("ts").alias("observed_at"),
        F.when(kind == "purchase", "inject").when(kind == "view", "skip").otherwise("diagnostic").alias("action"),
        (kind == "purchase").cast("int").alias("selected"),
        kind.alias("reason"),
        F.when(F.get_json_object("props", "$.k").cast("bigint") % 2 == 0, "instant").otherwise("smart").alias("mode"),
        F.lit(None).cast("string").alias("model"),
        (((F.col("event_id") * 13) % 100) / 100.0).alias("staleness"),
        F.round(F.col("value") * 100).cast("bigint").alias("confidence_bp"),
        (F.col("event_id") % 977).alias("latency_ms"),
    )


#: Conversation pairs and the log that they make; a user has many conversations.
PAIRS_SQL = """
spoken as (select conv_id, turn, role, text, count(*) filter (where role = 'user') over (partition by conv_id order by turn) as nth from conversations where role in ('user', 'assistant')),
asked as (
  select conv_id, nth, min(turn) filter (where role = 'user') as turn, min(text) filter (where role = 'user') as user_text,
    arg_max(text, turn) filter (where role = 'assistant' and trim(text) <> '') as assistant_text
  from spoken where nth > 0 group by conv_id, nth),
pairs as (
  select conv_id, turn, user_text, assistant_text from
    (select *, coalesce(lag(assistant_text is null) over (partition by conv_id order by nth), false) as dropped from asked)
  where assistant_text is not null and not dropped)"""

LOG_SQL = f"""
{PAIRS_SQL},
numbered as (
  select conv_id // 16 as user_id, conv_id, turn, user_text, assistant_text, strlen(user_text) + strlen(assistant_text) as nbytes,
    row_number() over (partition by conv_id // 16 order by conv_id, turn) as seq from pairs),
obs as (
  select user_id, conv_id, turn, nbytes, seq, sha256(concat_ws('|', cast(seq as varchar), cast(conv_id as varchar), cast(turn as varchar), user_text, assistant_text)) as checksum from numbered),
log as (select *, lag(cast(seq as varchar) || ':' || checksum) over (partition by user_id order by conv_id, turn) as prev_pair_ref from obs)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.streaming.capture import paired

    return paired(table(spark, sf_dir, "conversations"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("user_id", F.floor(F.col("conv_id") / 16))
    rows = rows.withColumn("nbytes", (F.octet_length("user_text") + F.octet_length("assistant_text")).cast("bigint"))
    return log.chained(rows, ["user_id"], ["conv_id", "turn"], ["conv_id", "turn", "user_text", "assistant_text"])


#: Texts: a document's first line is its condition, the rest its behavior.
TEXTS_SQL = r"""
texts as (
  select doc_id as id, coalesce(text, '') as text, split_part(coalesce(text, ''), chr(10), 1) as condition,
    substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) as behavior, source, lang
  from documents)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    first = F.substring_index(text, "\n", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), text.alias("text"), first.alias("condition"), F.substring(text, F.length(first) + 2, F.length(text)).alias("behavior"), "source", "lang"
    )


#: ``norm_text`` in DuckDB's words.
def norm_sql(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{X.SPACE}+', ' ', 'g')))"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def redact_sql(c: str) -> str:
    for p in X.REDACTIONS:
        c = f"regexp_replace({c}, {quoted(p)}, '{X.REDACTED}', 'g')"
    return c
