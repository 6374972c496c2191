"""Queries over single records: scans, validity, wording, references and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.functions import rules as R
from tracewell.operators import dedupe, evidence, lifecycle, metrics, retrieval
from tracewell.plans import fixtures as fx
from tracewell.plans.catalogue import _PAIRS, _near, query
from tracewell.sources import log
from tracewell.streaming import capture

# --- scans ------------------------------------------------------------------


@query(f"with {fx.HABITS_SQL} select id, user_id, status, created_at from habits where polarity = 1 and status in ('active', 'candidate') and id % 7 < 5")
def scan_by_status(spark, sf_dir):
    """Of all users; positive habits are of kind ``habit``, the others of kind ``evidence``"""
    h = fx.habits(spark, sf_dir).withColumn("record_kind", F.when(F.col("polarity") == 1, "habit").otherwise("evidence"))
    found = log.rows_of(h.filter("id % 7 < 5"), kinds=["habit"], statuses=["active", "candidate"])
    return found.select("id", "user_id", "status", "created_at").orderBy("created_at", "id")


@query("select o_orderkey from orders where o_orderkey % 17 <> 0 and o_orderstatus <> 'F'")
def row_integrity(spark, sf_dir):
    """Active rows; those whose stored checksum was made of another total are found and left out"""
    o = fx.table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "archived").otherwise("active"))
    parts = ["o_orderkey", "o_custkey", "o_totalprice"]
    planted = F.when(F.col("o_orderkey") % 17 == 0, "0").otherwise(F.col("o_totalprice").cast("string"))
    stored = o.withColumn("checksum", X.event_fingerprint(F.col("o_orderkey"), F.col("o_custkey"), planted))
    return log.active_rows(stored, parts, strict=False).select("o_orderkey")


@query(
    """with r as (select o_orderkey as id, case when o_orderstatus = 'F' then 'disabled' else 'active' end as status, o_orderdate as valid_from, case when o_orderkey % 3 > 0 then o_orderdate + interval 400 day end as expires_at from orders)
    select id from r where status = 'active' and valid_from <= timestamp '1997-01-01' and (expires_at is null or expires_at > timestamp '1997-01-01') and id % 4 = 1"""
)
def valid_records(spark, sf_dir):
    """Records of one exact scope, of four that there are"""
    o = fx.table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    r = o.select(
        i.alias("id"), F.when(F.col("o_orderstatus") == "F", "disabled").otherwise("active").alias("status"), F.col("o_orderdate").alias("valid_from"), F.lit("workspace").alias("scope_kind"), F.concat(F.lit("w"), i % 4).alias("scope_key"),
        F.when(i % 3 > 0, F.col("o_orderdate") + F.expr("interval 400 days")).alias("expires_at"),
    )
    return log.usable_records(r, F.lit("1997-01-01").cast("timestamp_ntz"), "workspace", "w1").select("id")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as nth from events) where nth = 1")
def last_versions(spark, sf_dir):
    """S21, T11"""
    return dedupe.latest(fx.table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query(f"with {fx.HABITS_SQL} select id, user_id, status from habits order by case when status = 'active' then 0 else 1 end, created_at desc, id limit 50")
def status_priority(spark, sf_dir):
    """T8"""
    h = fx.habits(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    return h.orderBy(*lifecycle.status_order()).limit(50).select("id", "user_id", "status")


@query("select user_id, max(ts) as ts from events group by 1 order by 2 desc, 1 limit 128")
def recent_scopes(spark, sf_dir):
    """T15"""
    return metrics.recent_scopes(fx.table(spark, sf_dir, "events"), "user_id", "ts")


@query(
    f"""with {fx.HABITS_SQL} select 'typed' as origin, doc_id as id from documents where doc_id % 10 <> 0 and doc_id % 4 <> 0
    union all select 'habit', id from habits where status = 'active'"""
)
def approved_union(spark, sf_dir):
    """Migrated records are known by the migration table or by their provenance"""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    source = F.struct(F.when(F.col("id") % 4 == 0, "migration").otherwise("pair").alias("source"), F.concat(F.lit("legacy-habit:"), F.col("id")).alias("evidence_id"))
    typed = R.not_migrated(d.withColumn("provenance", F.array(source)), d.filter("id % 10 = 0"))
    habits = fx.habits(spark, sf_dir).filter("status = 'active'")
    return typed.select(F.lit("typed").alias("origin"), "id").unionByName(habits.select(F.lit("habit").alias("origin"), "id"))


# --- joins ------------------------------------------------------------------


@query(f'with {fx.HABITS_SQL} select id, condition[1] as "condition", behavior[1] as behavior from habits where id % 7 <> 0')
def both_vector_fields(spark, sf_dir):
    """Every seventh habit lacks its behavior's vector"""
    h = fx.habits(spark, sf_dir)
    rows = [h.select("id", F.lit(f).alias("field"), F.col(f).alias("vector")) for f in ("condition", "behavior")]
    met = retrieval.both_fields(rows[0].unionByName(rows[1].filter("id % 7 <> 0")))
    return met.select("id", F.col("condition")[0].alias("condition"), F.col("behavior")[0].alias("behavior"))


_WORDED = f"""worded as (select id, lang as user_id, {fx.norm_sql("condition")} as c, {fx.norm_sql("behavior")} as b from texts),
  single as (select user_id, c, b, min(id) as habit_id from worded where id % 2 = 0 group by 1, 2, 3 having count(*) = 1)"""


def _wordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even texts as active habits, odd ones as proposals."""
    t = fx.texts(spark, sf_dir).select("id", F.col("lang").alias("user_id"), "condition", "behavior")
    return t.filter("id % 2 = 0").withColumn("status", F.lit("active")), t.filter("id % 2 <> 0")


@query(f"with {fx.TEXTS_SQL}, {_WORDED} select w.id, s.habit_id from worded w join single s using (user_id, c, b) where w.id % 2 <> 0")
def exact_corrections(spark, sf_dir):
    """J12, J13"""
    habits, proposals = _wordings(spark, sf_dir)
    return lifecycle.exact_corrections(proposals, habits).select("id", "habit_id")


@query(
    f"""with {fx.TEXTS_SQL}, {_WORDED}, hit as (select distinct s.habit_id as id from worded w join single s using (user_id, c, b) where w.id % 2 <> 0 and w.id % 3 > 0 and w.id % 5 > 0 and (w.id * 7919) % 10001 >= 2000)
    select w.id, case when hit.id is null then 'active' else 'dormant' end as after from worded w left join hit using (id) where w.id % 2 = 0"""
)
def contradiction_suppression(spark, sf_dir):
    """D3"""
    habits, proposals = _wordings(spark, sf_dir)
    i = F.col("id")
    asked = proposals.withColumns({
        "role": F.when(i % 3 > 0, "old_negative").otherwise("new_positive"), "evidence_stage": F.lit("reviewable"), "advisor": i % 5 == 0, "confidence_bp": (i * 7919) % 10001,
    })
    return lifecycle.suppressed(habits, asked, 2000).select("id", "after")


@query(
    """with r as (select o_orderkey as id, case when o_orderpriority = '5-LOW' then 'episode' else o_orderpriority end as kind, o_orderstatus as scope_kind, case when o_custkey % 2 = 1 then 'k' end as scope_key, o_custkey as a, o_orderkey % 3 as content from orders)
    select p.id as id_p, string_agg(r.id, ',' order by r.id) as conflicts_with from r as p join r on p.kind = r.kind and p.scope_kind = r.scope_kind and p.scope_key is not distinct from r.scope_key and p.a = r.a and p.content <> r.content
    where p.kind <> 'episode' and p.id % 2 = 1 and r.id % 2 = 0 group by 1"""
)
def typed_conflicts(spark, sf_dir):
    """J11"""
    o = fx.table(spark, sf_dir, "orders")
    r = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "5-LOW", "episode").otherwise(F.col("o_orderpriority")).alias("kind"), F.col("o_orderstatus").alias("scope_kind"),
        F.when(F.col("o_custkey") % 2 == 1, "k").alias("scope_key"), F.col("o_custkey").cast("string").alias("applicability"), (F.col("o_orderkey") % 3).cast("string").alias("content"),
    )
    return lifecycle.typed_conflicts(r.filter("id % 2 = 1"), r.filter("id % 2 = 0")).select("id_p", F.array_join("conflicts_with", ",").alias("conflicts_with"))


@query(f"with {fx.HABITS_SQL}, {_PAIRS} select h.id, count(o.id) as blocking from habits h left join near n on n.id_a = h.id left join habits o on o.id = n.id_b and o.status = 'active' group by 1")
def active_conflict_count(spark, sf_dir):
    """J18"""
    listed = _near(spark, sf_dir).groupBy(F.col("id_a").alias("id")).agg(F.collect_list("id_b").alias("conflicts_with"))
    return lifecycle.active_conflicts(fx.habits(spark, sf_dir).select("id", "status").join(listed, "id", "left"))


@query(f"with {fx.HABITS_SQL} select 'fresh' as batch, id from habits where status = 'active'")
def snapshot_revalidation(spark, sf_dir):
    """Of two batches one has a row that has changed, and fails whole"""
    h = fx.habits(spark, sf_dir).select("id", "status", "law_hash")
    chosen = h.filter("status = 'active'")
    changed = chosen.withColumn("law_hash", F.when(F.col("id") == 0, "other").otherwise(F.col("law_hash")))
    of = lambda rows, name: retrieval.revalidated(rows, h, ["id", "status", "law_hash"]).select(F.lit(name).alias("batch"), "id")
    return of(chosen, "fresh").unionByName(of(changed, "changed"))


# --- groups -----------------------------------------------------------------


@query("select l_partkey, arg_max(cast(l_suppkey as varchar), l_orderkey * 10 + l_linenumber) as checksum, max(l_orderkey * 10 + l_linenumber) as seq from lineitem group by 1")
def last_source_ref(spark, sf_dir):
    """A15"""
    refs = fx.table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("checksum"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return evidence.last_ref(refs, "l_partkey")


@query("select l_orderkey as batch_id, count(distinct year(l_shipdate)) = 1 as single, min(year(l_shipdate)) as file_generation from lineitem group by 1")
def single_generation(spark, sf_dir):
    """A16"""
    return lifecycle.single_generation(fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.year("l_shipdate").cast("bigint").alias("file_generation")))


@query("select user_id as batch_id, count(*) as n, sha256(string_agg(cast(event_id as varchar), ',' order by cast(event_id as varchar))) as checksum from events group by 1")
def proposal_diff(spark, sf_dir):
    """A24"""
    return metrics.diff_summary(fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").cast("string").alias("proposal_id")))


@query("select conv_id, max(turn) as index, count(*) as count, arg_max(text, turn) as text from conversations where role = 'user' group by 1")
def last_user_boundary(spark, sf_dir):
    """W9"""
    return retrieval.last_user(fx.table(spark, sf_dir, "conversations"))


@query(
    r"""with c as (select *, row_number() over (partition by conv_id order by turn desc) as nth from conversations where text is not null),
    j as (select conv_id, string_agg(case when nth = 1 then 'current_user' else role end || ': ' || text, chr(10) order by turn desc) as t from c group by 1)
    select conv_id, regexp_replace(substr(t, 1, list_max(list_filter(range(0, 121), lambda k: strlen(substr(t, 1, k)) <= 120))), '\s+$', '') as text from j"""
)
def newest_first_context(spark, sf_dir):
    """W8, X23"""
    return retrieval.context_text(fx.table(spark, sf_dir, "conversations").filter("text is not null"))


# --- decisions and text forms -----------------------------------------------


@query(
    r"""select conv_id, turn, case when turn % 5 = 4 then 'source_not_allowlisted' when conv_id % 7 = 0 then 'streaming_input_denied' when conv_id % 11 = 0 then 'images_denied' when conv_id % 13 = 0 then 'missing_capture_key'
      when regexp_full_match(coalesce(text, ''), '\s*') then 'empty_text_denied' when length(text) > 16384 then 'input_too_large' else 'allow' end as reason from conversations"""
)
def capture_origin_reasons(spark, sf_dir):
    """F9"""
    conv, turn = F.col("conv_id"), F.col("turn")
    reason = R.capture_origin(F.when(turn % 5 != 4, "interactive"), conv % 7 == 0, F.when(conv % 11 == 0, 1), F.when(conv % 13 != 0, "key"), F.col("text"))
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))


@query(
    """with e as (select event_id, event_id % 2 = 0 as can_append, event_id % 3 > 0 as can_steer, event_id % 5 > 0 as active, event_id % 7 = 0 as idle, event_id % 11 = 0 as cancelled, event_id % 13 = 0 as shutting_down from events)
    select event_id, case when shutting_down or not (can_append or can_steer) then 'visible_fallback' when (idle or not active) and can_append then 'append_now' when idle or not active then 'visible_fallback'
      when can_steer and not cancelled then 'steer' when can_append then 'append_when_settled' else 'visible_fallback' end as mode from e"""
)
def delivery_modes(spark, sf_dir):
    """F25"""
    i = F.col("event_id")
    state = {
        "can_append": i % 2 == 0, "can_steer": i % 3 > 0, "active": i % 5 > 0, "idle": i % 7 == 0, "cancelled": i % 11 == 0, "shutting_down": i % 13 == 0,
        "can_append_visible": F.lit(True), "terminal": F.lit(False), "plan_mode": F.lit("off"), "immune_turns": F.lit(0),
    }
    return fx.table(spark, sf_dir, "events").withColumns(state).select("event_id", R.delivery().alias("mode"))


_XML = "t"
for _raw, _entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
    _XML = f"replace({_XML}, '{_raw}', '{_entity}')"


@query(
    f"""with d as (select doc_id, coalesce(text, '') as t from documents)
    select doc_id, case when length(t) <= 65 then t else substr(t, 1, 32) || ' ' || right(t, 33) end as edges, sha256({_XML}) as escaped_sha256 from d"""
)
def text_forms(spark, sf_dir):
    """X24, X30"""
    t = F.coalesce("text", F.lit(""))
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.head_tail(t, 65).alias("edges"), F.sha2(X.xml_escape(t), 256).alias("escaped_sha256"))


@query(
    """with n as (select event_id, case event_id % 4 when 0 then '  ' when 1 then chr(9) || event_type || ' ' when 2 then event_type || '/' || user_id else '/' || event_type end as name from events)
    select event_id, case event_id % 4 when 0 then 'owner' when 1 then trim(name, chr(9) || ' ') end as user_name, case when event_id % 4 = 2 then split_part(name, '/', 1) end as provider, case when event_id % 4 = 2 then split_part(name, '/', 2) end as model_id from n"""
)
def safe_names(spark, sf_dir):
    """X33, X34"""
    i, kind = F.col("event_id") % 4, F.col("event_type")
    name = F.when(i == 0, "  ").when(i == 1, F.concat(F.lit("\t"), kind, F.lit(" "))).when(i == 2, F.concat(kind, F.lit("/"), F.col("user_id"))).otherwise(F.concat(F.lit("/"), kind))
    named = fx.table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return named.select("event_id", X.user_id(F.col("name")).alias("user_name"), X.provider_model(F.col("name"))["provider"].alias("provider"), X.provider_model(F.col("name"))["model_id"].alias("model_id"))


# --- validation and routing -------------------------------------------------


@query(
    """with m as (select conv_id as run_id, coalesce(string_agg(text, chr(10) order by turn) filter (where turn % 5 <> 1), '') as t, arg_max(turn % 7 = 5, turn) as failed from conversations where role = 'assistant' group by 1)
    select run_id, case when length(t) <= 65536 then t else '[truncated]' || chr(10) || right(t, 65524) end as text from m where not failed"""
)
def run_texts(spark, sf_dir):
    """F10, X25"""
    c = fx.table(spark, sf_dir, "conversations")
    m = c.select(F.col("conv_id").alias("run_id"), "role", "text", F.col("turn").alias("pos"), F.when(F.col("turn") % 7 == 5, "error").otherwise("stop").alias("stop_reason"), (F.col("turn") % 5 != 1).alias("display"))
    return R.successful_runs(m)


@query(
    """select event_id, concat_ws(',', case when event_type = 'view' then 'kind' end, case when event_type = 'error' and event_id % 2 = 0 or event_type = 'purchase' and event_id % 5 = 0 then 'origin' end, case when strlen(props) > 65536 then 'size' end) as errors
    from (select * from events)"""
)
def payload_errors(spark, sf_dir):
    """errors are findings, purchases are pairs, views are of no kind"""
    e, i = F.col("event_type"), F.col("event_id")
    kind = F.when(e == "error", "advisor_finding_v1").when(e != "view", "conversation_pair_v1")
    origin = F.when((e == "error") & (i % 2 == 0) | (e == "purchase") & (i % 5 == 0), "elsewhere").when(e == "error", "advisor").otherwise("local_interactive")
    rows = fx.table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), origin.alias("origin"), F.col("props").alias("payload"))
    return rows.select("event_id", F.array_join(R.payload_errors(), ",").alias("errors"))


@query(
    """with p as (select l_orderkey as batch_id, l_linenumber // 2 as proposal_id, l_linenumber, cast(l_quantity as int) % 4 - 1 as polarity, cast(l_extendedprice as bigint) % 12000 as confidence_bp, cast(l_quantity as int) % 23 as refs, year(l_shipdate) as gen from lineitem),
    w as (select *, count(*) over (partition by batch_id, proposal_id) as same, count(*) over (partition by batch_id) as n, min(gen) over (partition by batch_id) as low, max(gen) over (partition by batch_id) as high from p)
    select batch_id, l_linenumber, concat_ws(',', case when polarity not in (-1, 1) then 'polarity' end, case when confidence_bp > 10000 then 'confidence_bp' end, case when refs not between 1 and 20 then 'source_refs' end,
      case when same > 1 then 'proposal_id' end, case when n > 5 then 'too_many' end, case when low <> high then 'generation' end) as errors from w"""
)
def proposal_errors(spark, sf_dir):
    """F20, F21"""
    q = F.rint("l_quantity").cast("int")  # as the SQL's casts, halves to the even number
    p = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.floor(F.col("l_linenumber") / 2).alias("proposal_id"), "l_linenumber", (q % 4 - 1).alias("polarity"), (F.rint("l_extendedprice").cast("bigint") % 12000).alias("confidence_bp"),
        F.array_repeat(F.lit("ref"), q % 23).alias("source_refs"), F.year("l_shipdate").alias("file_generation"), F.lit("the build ends").alias("condition"), F.lit("say so").alias("behavior"),
    )
    return R.proposal_errors(p, most=5).select("batch_id", "l_linenumber", F.array_join("errors", ",").alias("errors"))


@query(
    """with b as (select user_id, cast(ts as date) as day, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_id % 97 = 0) as key_conflicts, count(*) filter (where event_type = 'purchase') as proposals, count(*) filter (where event_id % 4 = 0) as typed from events group by 1, 2)
    select user_id, day, case when errors > 2 then 'quarantine' when key_conflicts > 0 then 'pending_review' when proposals = 0 then 'coverage_only' when typed > 0 then 'typed' else 'legacy' end as route from b"""
)
def batch_routes(spark, sf_dir):
    """The events of a user and day are a batch"""
    i, kind = F.col("event_id"), F.col("event_type")
    b = fx.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.greatest(F.count_if(kind == "error") - 2, F.lit(0)).alias("errors"), F.count_if(i % 97 == 0).alias("key_conflicts"), F.count_if(kind == "purchase").alias("proposals"), F.count_if(i % 4 == 0).alias("typed")
    )
    return lifecycle.route(b).select("user_id", "day", "route")


@query(
    f"""with d as (select distinct lang as user_id, substr({fx.redact_sql("text")}, 1, 20000) as output from documents where text is not null)
    select user_id, length(output) as n_chars, sha256(output) as output_sha256, 'quarantine-' || substr(sha256(user_id || '|' || output), 1, 40) as id from d"""
)
def quarantine_rows(spark, sf_dir):
    """Every document"""
    d = fx.table(spark, sf_dir, "documents").filter("text is not null")
    rows = d.select(F.col("lang").alias("user_id"), F.col("text").alias("output"), F.lit("invalid_json").alias("reason"))
    return lifecycle.quarantined(rows).select("user_id", F.length("output").cast("bigint").alias("n_chars"), F.sha2("output", 256).alias("output_sha256"), "id")


@query(
    f"""with t as (select conv_id, turn, {fx.redact_sql("text")} as s from conversations where role <> 'system' and text is not null),
    c as (select conv_id, turn, case when length(s) <= 4000 then s else substr(s, 1, 4000) || '…' end as text from t)
    select conv_id, turn, text, sha256(conv_id || chr(31) || turn || chr(31) || text) as fingerprint from c"""
)
def turn_deltas(spark, sf_dir):
    """System rows stand for the advisor's"""
    c = fx.table(spark, sf_dir, "conversations").filter("text is not null").withColumn("advisor", F.col("role") == "system")
    return capture.turn_deltas(c).select("conv_id", "turn", "text", "fingerprint")
