"""Ranking, vector joins and bounded context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.functions import free_json
from tracewell.functions import rules as R


def eligible_top(cands: DataFrame, min_confidence_bp: int, staleness_max: float, n: int = 100) -> DataFrame:
    """[F1, T1] The surest eligible candidates: confidence down, id up."""
    return cands.filter(R.eligible(min_confidence_bp, staleness_max)).orderBy(F.desc("confidence_bp"), "id").limit(n)


def preparation(cands: DataFrame, min_confidence_bp: int, staleness_max: float, law_hash: str, first: int = 100, n: int = 500) -> DataFrame:
    """[T2] Candidates of the current law first, at most ``first``, then any others up to ``n`` in all."""
    fresh = eligible_top(cands.filter(R.law_fresh(law_hash)), min_confidence_bp, staleness_max, first).withColumn("tier", F.lit(0))
    fill = eligible_top(cands, min_confidence_bp, staleness_max, n).withColumn("tier", F.lit(1))
    best = fresh.unionByName(fill).groupBy("id").agg(F.min("tier").alias("tier"), F.first("confidence_bp").alias("confidence_bp"))
    return best.orderBy("tier", F.desc("confidence_bp"), "id").limit(n)


def scored(cands: DataFrame, query: DataFrame, vector: str = "vector") -> DataFrame:
    """[J3] ``cands`` with ``similarity_bp`` to the one vector of ``query(query_vector)``."""
    one = query.limit(1).withColumn("query_norm", X.norm(F.col("query_vector")))
    similarity = X.cosine(F.col(vector), F.col("query_vector"), norm_b=F.col("query_norm"))
    return cands.crossJoin(F.broadcast(one)).withColumn("similarity_bp", X.basis_points(similarity)).drop("query_norm")


def top_k(ranked: DataFrame, floor: int = 1500, k: int = 12) -> DataFrame:
    """[T3] Similarity down, confidence down, id up."""
    return ranked.filter(F.col("similarity_bp") >= floor).orderBy(F.desc("similarity_bp"), F.desc("confidence_bp"), "id").limit(k)


def union_first(primary: DataFrame, secondary: DataFrame, order: list[Column], k: int = 12) -> DataFrame:
    """[U1] Primary rows in order, then secondary ones that are new, at most ``k``."""
    both = primary.withColumn("source", F.lit(0)).unionByName(secondary.withColumn("source", F.lit(1)))
    kept = both.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("source", *order))).filter("nth = 1").drop("nth")
    return kept.orderBy("source", *order).limit(k)


def tiered(activated: DataFrame, similar: DataFrame, floor: int = 1500, n: int = 8) -> DataFrame:
    """[T4, T5] Activated ids first, at full score, then by similarity."""
    first = activated.select("id", F.lit(10000).cast("bigint").alias("similarity_bp"), F.lit(0).alias("tier"))
    rest = similar.filter(F.col("similarity_bp") >= floor).select("id", "similarity_bp", F.lit(1).alias("tier"))
    best = first.unionByName(rest).groupBy("id").agg(F.min("tier").alias("tier"), F.max("similarity_bp").alias("similarity_bp"))
    return best.orderBy("tier", F.desc("similarity_bp"), "id").limit(n)


def cached(expectations: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """[S19, S20, J4] Expectations with ``state`` valid, missing or invalid (a checksum differs)."""
    found = cache.select(*keys, F.col("checksum").alias("found"), F.col("vector").alias("cached_vector"))
    state = R.first_match("valid", (F.col("found").isNull(), "missing"), (~F.col("found").eqNullSafe(F.col("checksum")), "invalid"))
    joined = expectations.join(found, keys, "left").withColumn("state", state)
    return joined.withColumn("cached_vector", F.when(F.col("state") == "valid", F.col("cached_vector"))).drop("found")


def both_fields(vectors: DataFrame) -> DataFrame:
    """[J5] Condition and behavior vectors of a habit in one row."""
    picked = {f: F.any_value(F.when(F.col("field") == f, F.col("vector")), True).alias(f) for f in ("condition", "behavior")}
    return vectors.groupBy("id").agg(*picked.values()).filter("condition is not null and behavior is not null")


def aliased(ranked: DataFrame, order: list[Column], prefix: str = "c", batch: str | None = None) -> DataFrame:
    """[W5] ``c1, c2 ...`` by rank, over the few rows of each batch."""
    w = W.partitionBy(batch) if batch else W.partitionBy(F.lit(0))
    return ranked.withColumn("alias", F.concat(F.lit(prefix), F.row_number().over(w.orderBy(*order))))


def packed(rows: DataFrame, by: str, order: list[Column], length: Column, budget: int, parts: int = 64) -> DataFrame:
    """[W3] The leading rows of each group whose summed lengths (none negative) stay within ``budget``; the first overflow ends it.

    A group is summed in ``parts`` first, dealt by a hash of the order: what
    comes after the first overflow of a part comes after the group's.
    """
    upto = lambda *keys: F.sum("_len").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    dealt = rows.withColumns({"_len": length, "_part": F.pmod(F.xxhash64(*order), F.lit(parts))})
    few = dealt.withColumn("_used", upto(by, "_part")).filter(F.col("_used") - F.col("_len") <= budget)
    return few.withColumn("used", upto(by)).filter(F.col("used") <= budget).drop("_len", "_part", "_used")


def context_text(turns: DataFrame, key: str = "conv_id", bytes_most: int = 120) -> DataFrame:
    """[W8] The current request and then its context with roles, newest first, in so many UTF-8 bytes."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("o"), "role", "text")))
    joined = turns.groupBy(key).agg(F.array_join(F.transform(listed, lambda t, i: F.concat(F.when(i == 0, "current_user").otherwise(t["role"]), F.lit(": "), t["text"])), "\n").alias("text"))
    return joined.select(key, X.utf8_prefix(F.col("text"), bytes_most).alias("text"))


def revalidated(chosen: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """[J15] ``chosen`` if each of its rows still is in ``current`` by all ``keys``, else nothing."""
    stale = chosen.join(current, keys, "left_anti").select(F.lit(1).alias("stale")).limit(1)
    return chosen.join(F.broadcast(stale), F.lit(True), "left_anti")


def selection(cands: DataFrame, requests: DataFrame, judge: Callable[[DataFrame], DataFrame], law_hash: str, policy: R.Policy, min_confidence_bp: int, staleness_max: float, most: int = 3, first: int = 100) -> DataFrame:
    """[D24, D30, J14] For every request, from its user's active candidates to those a judge picks.

    ``requests(batch_id, user_id, query_vector)``; ``judge(asked)`` returns
    ``batch_id, alias, applicable, confidence_bp, reason``.  The choice of a
    request of which one row has changed in the meantime falls whole.
    """
    surest = W.partitionBy("user_id").orderBy(F.desc("confidence_bp"), "id")
    fresh = cands.filter(R.law_fresh(law_hash) & R.eligible(min_confidence_bp, staleness_max)).withColumn("_nth", F.row_number().over(surest)).filter(F.col("_nth") <= first).drop("_nth")
    met = requests.join(fresh, "user_id").withColumn("similarity_bp", X.basis_points(X.cosine(F.col("vector"), F.col("query_vector")))).drop("query_vector", "vector")
    nearest = W.partitionBy("batch_id").orderBy(F.desc("similarity_bp"), F.desc("confidence_bp"), "id")
    asked = met.filter(F.col("similarity_bp") >= policy.floor).withColumn("_nth", F.row_number().over(nearest)).filter(F.col("_nth") <= policy.top_k)
    asked = asked.withColumn("alias", F.concat(F.lit("c"), "_nth")).drop("_nth")
    picked = R.judged(asked, judge(asked), most, min_confidence_bp)
    chosen = asked.join(picked.select("batch_id", "alias", F.col("confidence_bp").alias("judged_bp")), ["batch_id", "alias"])
    stale = chosen.join(cands.filter(R.law_fresh(law_hash)).select("id", "checksum"), ["id", "checksum"], "left_anti")
    return chosen.join(stale.select("batch_id").distinct(), "batch_id", "left_anti")


def due(expected: DataFrame, cache: DataFrame, keys: list[str], batch: int = 64) -> DataFrame:
    """[D23, D27, D28] Vectors that are missing or stale, numbered in batches of each user for the model."""
    rows = cached(expected, cache, keys).filter("state != 'valid'")
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(*keys))
    return rows.withColumn("batch", F.floor((nth - 1) / batch).cast("int")).drop("cached_vector")


def pooled(vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """[A21] The unit vector of each key's mean vector; zero means have none.

    Elements are averaged by place, so a hot key is summed in parts.
    """
    means = vectors.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.select(key, X.unit(F.col("mean")).alias("vector"))


# The longest query, and of each role's line in it.
QUERY_CHARS, ROLE_CHARS = 24_000, 11_999


def host_query(updates: DataFrame, key: str = "conv_id") -> DataFrame:
    """[X42] The newest user's and the newest assistant's text, each redacted, trimmed and cut to its ends; without either, a bounded reading of the last row.

    ``updates(key, turn, role, text)``; a role whose newest row has no text has no line.
    """
    newest = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("turn")))
    last = F.max_by(F.to_json(F.struct("role", F.col("text").alias("content"))), "turn")
    seen = updates.groupBy(key).agg(newest("user").alias("user"), newest("assistant").alias("assistant"), last.alias("last"))

    def line(role: str) -> Column:
        text = F.regexp_replace(X.redact(F.coalesce(F.col(role), F.lit(""))), f"^{X.SPACE}+|{X.SPACE}+$", "")
        most = ROLE_CHARS - len(role) - 2
        half = (most - 3) // 2
        ends = F.concat(F.substring(text, 1, half), F.lit("..."), F.right(text, F.lit(half)))
        return F.when(text != "", F.concat(F.lit(f"{role}: "), F.when(F.length(text) <= most, text).otherwise(ends)))

    said = seen.select(key, F.concat_ws("\n", line("user"), line("assistant")).alias("said"), "last")
    query = F.when(F.col("said") != "", F.col("said")).otherwise(free_json.bounded_json(F.when(F.col("said") == "", F.col("last"))))
    return said.select(key, F.substring(query, 1, QUERY_CHARS).alias("query"))


def hit_log(rows: DataFrame) -> DataFrame:
    """[S22] Clamped, cut and identified log rows."""
    out = rows.select(
        "user_id",
        "habit_id",
        "action",
        F.col("selected").cast("int").alias("selected"),
        F.substring("reason", 1, 160).alias("reason"),
        F.least(F.greatest(F.coalesce("confidence_bp", F.lit(0)), F.lit(0)), F.lit(10000)).cast("bigint").alias("confidence_bp"),
        F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(0)).cast("bigint").alias("latency_ms"),
    )
    parts = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in out.columns))
    return out.withColumn("checksum", X.checksum(parts)).withColumn("id", X.stable_id("selector-hit", F.concat(parts, F.lit("|"), F.col("checksum"))))


def last_user(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """[W9] Place and text of a conversation's last user row, and how many there are; none without one."""
    user = turns.filter("role = 'user'")
    return user.groupBy(key).agg(F.max("turn").alias("index"), F.count("*").alias("count"), F.max_by("text", "turn").alias("text"))
