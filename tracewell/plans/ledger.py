"""Queries over the ledger's writing side, validation, wording, vectors and whole paths."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import exprs as X
from tracewell.functions import free_json
from tracewell.functions import rules as R
from tracewell.operators import commit as committing
from tracewell.operators import dedupe, lifecycle, metrics, retrieval, vectors
from tracewell.plans import fixtures as fx
from tracewell.plans.catalogue import _PAIRS, _SENSITIVE_SQL, _cos, _near, _reviewed, query
from tracewell.sources import log, workspace
from tracewell.sources.tables import materialize, parts, parts_of, scratch, shared_dir
from tracewell.streaming import capture, folds


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


# --- rows and lines -----------------------------------------------------------


@query(
    """select event_id, case when event_id % 7 > 0 then cast(json_extract_string(props, '$.k') as bigint) end as k, case when event_id % 7 = 0 then null when event_id % 5 = 0 then '{"z":"1"}' else '{}' end as residual, event_id % 7 = 0 as quarantined from events"""
)
def typed_rows(spark, sf_dir):
    """Every fifth object has a key more than the schema, every seventh is no JSON"""
    i = F.col("event_id")
    raw = F.when(i % 7 == 0, "{broken").when(i % 5 == 0, F.regexp_replace("props", r"\}$", ', "z": 1}')).otherwise(F.col("props"))
    return log.typed_rows(fx.table(spark, sf_dir, "events").select(i, raw.alias("data_json")), "k bigint")


@query(
    """with e as (select user_id, event_id, event_id % 5 = 0 as plain, cast(event_id // 100 % 12 as varchar) as id, case when event_id // 100 % 12 % 3 > 0 then event_id // 100 % 12 % 3 end as f from events)
    select user_id, event_id, case when plain then 'appended' when row_number() over (partition by user_id, coalesce('f' || f, 'i' || id) order by event_id) > 1 then 'duplicate' else 'appended' end as outcome from e"""
)
def unique_appends(spark, sf_dir):
    """Four of five events are to be in their user's log once; a fingerprint stands for several ids, some have none"""
    i = F.col("event_id")
    name = F.floor(i / 100) % 12
    e = fx.table(spark, sf_dir, "events").select("user_id", i, name.cast("string").alias("id"), F.when(name % 3 > 0, (name % 3).cast("string")).alias("fingerprint"), (i % 5 != 0).alias("once"))
    return folds.fold(e, folds.UniqueAppend, "user_id", "event_id")


@query(
    """with e as (select user_id, event_id, event_id // 100 % 40 as event, event_id % 3 > 0 as valid, event_id % 3 = 2 as two from events), v as (select *, row_number() over (partition by user_id, event order by event_id) as nth from e where valid)
    select user_id, event_id, 'h1' as alias, case when two then 'blocker' else 'concern' end as severity from v where nth = 1"""
)
def emissions(spark, sf_dir):
    """An event lets out one attempt, the most severe; a third of the updates name no habit that is known"""
    i = F.col("event_id")
    attempt = lambda alias, severity: F.struct(F.lit(alias).alias("alias"), F.lit(severity).alias("severity"))
    tries = F.when(i % 3 == 0, F.array(attempt("h7", "blocker"))).when(i % 3 == 1, F.array(attempt("h1", "concern"), attempt("h7", "blocker"))).otherwise(F.array(attempt("h1", "concern"), attempt("h1", "blocker")))
    e = fx.table(spark, sf_dir, "events").select("user_id", i, (F.floor(i / 100) % 40).cast("string").alias("event"), tries.alias("attempts"), F.array(F.lit("h1"), F.lit("h2")).alias("aliases"))
    return folds.fold(e, folds.Emission, "user_id", "event_id")


@query(
    """select case when (conv_id * 31 + turn) % 10 = 0 then 'bad' else 'good' end as state, case when (conv_id * 31 + turn) % 10 > 0 then conv_id end as conv_id, case when (conv_id * 31 + turn) % 10 > 0 then turn end as turn from conversations"""
)
def log_lines(spark, sf_dir):
    """JSON lines of which every tenth is cut off"""
    c = fx.table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    cut = (F.col("conv_id") * 31 + F.col("turn")) % 10 == 0
    path = _folder(spark, "lines")
    c.select(F.when(cut, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    good, bad = log.read_log(spark, path, "conv_id bigint, turn bigint, role string, text string")
    none = F.lit(None).cast("bigint")
    return good.select(F.lit("good").alias("state"), "conv_id", "turn").union(bad.select(F.lit("bad"), none, none))


@query(f"with {fx.HABITS_SQL} select 'habits' as name, count(*) as n, count(law_hash) as filled from habits union all select 'observations', count(*), 0 from events union all select 'experiences', count(*), 0 from documents")
def ledger_tables(spark, sf_dir):
    """Tables written under the ledger's schemas are opened again; columns that the source lacks are null"""
    path = _folder(spark, "ledger")
    sources = {"habits": fx.habits(spark, sf_dir).drop("condition", "behavior"), "observations": fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), "user_id"), "experiences": fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("user_id"))}
    for name, df in sources.items():
        fields = T.StructType.fromDDL(log.TABLES[name]).fields
        df.select(*((F.col(f.name) if f.name in df.columns and f.name != "created_at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)).write.parquet(f"{path}/{name}")
    opened = log.open_ledger(spark, path)
    filled = {"habits": F.count("law_hash")}
    counts = [opened[n].agg(F.count("*").alias("n"), filled.get(n, F.lit(0).cast("bigint")).alias("filled")).select(F.lit(n).alias("name"), "n", "filled") for n in sources]
    return counts[0].union(counts[1]).union(counts[2])


_IMAGE = """'{{"status":"' || {s} || '","confidence_bp":' || confidence_bp || '}}'"""


@query(
    f"""with {fx.HABITS_SQL}, i as (select id, {_IMAGE.format(s="status")} as before, {_IMAGE.format(s="'archived'")} as after from habits where id % 4 = 1 and status <> 'archived')
    select id as target_id, before, after, 'audit-' || substr(sha256(id || '|' || before || '|' || after), 1, 40) as id from i"""
)
def audit_rows(spark, sf_dir):
    """S23, S24"""
    h = fx.habits(spark, sf_dir).select("id", "status", "confidence_bp")
    return log.audit(h, h.withColumn("status", F.when(F.col("id") % 4 == 1, "archived").otherwise(F.col("status"))), "id", ["status", "confidence_bp"])


@query(
    f"""with {fx.HABITS_SQL} select user_id, '[' || string_agg('{{"status":"' || status || '","id":' || id || ',"condition":"c' || id || '","behavior":"b' || id || '"}}', ',' order by status, id) || ']' as report from habits where id % 6 > 0 group by 1"""
)
def habit_report(spark, sf_dir):
    """Every sixth habit has an address in it and is left out"""
    i = F.col("id")
    h = fx.habits(spark, sf_dir).select("user_id", "status", i, F.concat(F.lit("c"), i).alias("condition"), F.when(i % 6 == 0, "mail a@b.org").otherwise(F.concat(F.lit("b"), i)).alias("behavior"))
    return log.report(h)


@query("select page_id, case when strlen(html) <= 2000 then sha256(html) end as sha256, len(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '')) as n_lines from pages")
def workspace_read(spark, sf_dir):
    """Pages within the bound, and how many lines of each are not blank"""
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", X.checksum(workspace.bounded_text(F.col("html"), 2000)).alias("sha256"), metrics.line_count(F.col("html")).alias("n_lines"))


@query("select distinct user_id || '-' || event_type as event_fingerprint from events")
def stream_first_events(spark, sf_dir):
    """Each event of a stream once"""
    e = capture.stream_of(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("event_fingerprint"), F.col("ts").cast("timestamp").alias("ts"))
    return capture.run_available(capture.first_events(e), shared_dir(spark)).select("event_fingerprint")


# --- validation ---------------------------------------------------------------


@query(
    """select o_orderkey as id, concat_ws(',', case when o_orderkey % 5 = 0 then 'kind' end, case when (o_orderkey % 3 = 0) <> (o_orderkey % 4 = 0) then 'scope_key' end, case when o_orderkey % 11 = 0 then 'content' end, case when o_orderkey % 17 = 0 then 'applicability' end,
      case when o_orderkey % 12000 > 10000 then 'confidence_bp' end, case when o_orderkey % 19 = 0 and o_orderkey % 23 > 0 then 'relations' end, case when o_orderkey % 23 = 0 then 'self_relation' end, case when o_orderkey % 13 = 0 and o_orderkey % 11 > 0 then 'sensitive' end) as errors from orders"""
)
def record_errors(spark, sf_dir):
    """F18, X40"""
    i = F.col("o_orderkey")
    r = fx.table(spark, sf_dir, "orders").select(
        i.alias("id"), F.when(i % 5 == 0, "other").otherwise("fact").alias("kind"), F.when(i % 3 == 0, "user").otherwise("workspace").alias("scope_kind"), F.when(i % 4 > 0, "k").alias("scope_key"), F.when(i % 11 == 0, "").when(i % 13 == 0, "mail a@b.org").otherwise("c").alias("content"),
        F.when(i % 17 > 0, "always").alias("applicability"), (i % 12000).alias("confidence_bp"), F.array(i + 1).alias("supersedes"), F.array(F.when(i % 23 == 0, i).when(i % 19 == 0, i + 1).otherwise(i + 2)).alias("conflicts_with"),
    )
    return r.select("id", F.array_join(R.record_errors(("fact", "episode"), ("user", "workspace")), ",").alias("errors"))


@query("""select event_id, concat_ws(',', case when event_id % 5 not in (1, 2, 3) then 'habits' end, case when event_id % 7 = 0 and event_id % 5 > 0 then 'wording' end, case when event_id % 2 = 1 then 'created_at' end) as errors from events""")
def steering_errors(spark, sf_dir):
    """F27, X21"""
    i = F.col("event_id")
    habit = F.struct(F.lit("c").alias("condition"), F.when(i % 7 == 0, "mail a@b.org").otherwise("do it").alias("behavior"))
    rows = fx.table(spark, sf_dir, "events").select(i, F.array_repeat(habit, (i % 5).cast("int")).alias("habits"), F.when(i % 2 == 0, "2024-01-02T03:04:05.678Z").otherwise("2024-01-02").alias("created_at"))
    return rows.select("event_id", F.array_join(R.steering_errors(), ",").alias("errors"))


@query(
    """with e as (select *, row_number() over (partition by user_id order by event_id) as nth from events),
    a as (select distinct user_id, event_id % 40 as c, event_id % 3 as b from events where event_id % 5 < 3 and event_id % 2 = 1),
    k as (select e.*, event_type = 'error' and (event_id * 37) % 10001 >= 8500 and event_id % 6 > 0 and a.c is not null as explicit_correction from e left join a on a.user_id = e.user_id and a.c = e.event_id % 40 and a.b = e.event_id % 3 where nth <= 50 and event_type <> 'view')
    select event_id, explicit_correction, case when explicit_correction or event_id % 4 = 0 then 'reviewable' else 'collecting' end as evidence_stage from k"""
)
def normalised_output(spark, sf_dir):
    """Errors are corrections, views are typed; what an event corrects is a habit of its user, active and affirmed or not"""
    i, kind = F.col("event_id"), F.col("event_type")
    e = fx.table(spark, sf_dir, "events")
    condition, behavior = F.concat(F.lit("When  "), i % 40), F.concat(F.lit("do "), i % 3)
    sources = F.when(i % 6 == 0, F.array(F.lit("advisor_finding"))).when(i % 6 == 1, F.array(F.lit("advisor_finding"), F.lit(None))).otherwise(F.array(F.lit("local_interactive")))
    raw = e.select(i, F.col("user_id").alias("batch_id"), "user_id", i.alias("pos"), F.when(kind == "error", "correction").when(kind == "view", "episode").otherwise("habit").alias("kind"), condition.alias("condition"), behavior.alias("behavior"), sources.alias("sources"), ((i * 37) % 10001).alias("confidence_bp"), (i % 4 == 0).alias("repeated"))
    habits = e.select("user_id", F.upper(condition).alias("condition"), behavior.alias("behavior"), F.when(i % 5 < 3, "active").otherwise("disabled").alias("status"), F.when(i % 2 == 1, 1).otherwise(-1).alias("polarity"))
    return lifecycle.normalised_output(raw, habits, kinds=("episode",)).select("event_id", "explicit_correction", "evidence_stage")


@query(f"with {fx.HABITS_SQL} select 'pending_review' as type, event_id as id from events where event_type = 'error' and event_id % 3 > 0 union all select 'candidate', id from habits where status = 'candidate' and id % 6 > 1")
def review_union(spark, sf_dir):
    """Open reviews but for those of a migration, then the candidates that a reviewer may see"""
    kind = F.when(F.col("event_id") % 3 == 0, "legacy_experience_migration").otherwise("proposal")
    pending = fx.table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("open").alias("status"), kind.alias("kind"))
    return lifecycle.review_items(pending, _reviewed(spark, sf_dir).select("id", "status", "review_status")).select("type", "id")


@query(
    f"""with {fx.HABITS_SQL}, {_PAIRS}, p as (select id, count(*) as n from (select id_a as id from near union all select id_b from near) group by 1)
    select h.id, case when p.n > 0 then 'duplicate_resolution' when h.id % 2 = 0 then 'awaiting_review' else 'collecting_evidence' end as review_status from habits h left join p using (id) where h.status = 'candidate'"""
)
def candidate_marks(spark, sf_dir):
    """Candidates enter and leave duplicate resolution by their pending relations"""
    held = F.when(F.col("id") % 2 == 0, "duplicate_resolution").otherwise("collecting_evidence")
    candidates = fx.habits(spark, sf_dir).filter("status = 'candidate'").select("id", held.alias("review_status"))
    return dedupe.restored(candidates, dedupe.relations(_near(spark, sf_dir), "m1")).select("id", "review_status")


@query(
    """with recursive p as (select p_partkey as loser, case when p_partkey % 50 = 3 then p_partkey + 1 when p_partkey % 50 = 4 then p_partkey - 1 else p_partkey - 1 - p_partkey % 5 end as survivor from part where p_partkey % 50 not in (0, 1, 2) and p_partkey % 7 > 0),
    r as (select loser, survivor, 1 as depth from p union all select r.loser, p.survivor, depth + 1 from r join p on p.loser = r.survivor where depth < 60),
    e as (select loser, arg_max(survivor, depth) as survivor, max(depth) = 60 as refused from r group by 1),
    k as (select loser, survivor from e where not refused and survivor in (select p_partkey from part)),
    s as (select coalesce(survivor, l_partkey) as id, count(*) as n from lineitem left join k on loser = l_partkey group by 1)
    select p_partkey as id, k.survivor as superseded_by, case when k.survivor is null then 'active' else 'archived' end as status, coalesce(n, 0) as evidence, least(64, 1 + case when k.survivor is null then (select count(*) from k as o where o.survivor = p_partkey) else 0 end) as refs
    from part left join k on k.loser = p_partkey left join s on s.id = p_partkey"""
)
def chained_merges(spark, sf_dir):
    """Parts merge into earlier ones, in chains; lines are their evidence; some run in a circle"""
    i = F.col("p_partkey")
    m = i % 50
    part = fx.table(spark, sf_dir, "part").select(i)
    survivor = F.when(m == 3, i + 1).when(m == 4, i - 1).otherwise(i - 1 - i % 5)
    plan = part.filter(~m.isin(0, 1, 2) & (i % 7 > 0)).select(i.alias("loser"), survivor.alias("survivor"))
    habits = part.select(i.alias("id"), F.lit("active").alias("status"), F.array(i.cast("string")).alias("refs"))
    after, moved = lifecycle.merged_chains(habits, fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("habit_id")), plan)
    counts = moved.groupBy(F.col("habit_id").alias("id")).agg(F.count("*").alias("n"))
    return after.join(counts, "id", "left").select("id", "superseded_by", "status", F.coalesce("n", F.lit(0)).alias("evidence"), F.size("refs").cast("bigint").alias("refs"))


# --- search and wording -------------------------------------------------------


def _search_sql(text: str, terms: list[str]) -> str:
    direct = " and ".join(f"contains({text}, '{t}')" for t in terms)
    near = " and ".join(f"regexp_matches({text}, '(?s){'.*?'.join(t)}')" for t in terms)
    return f"case when {direct} then 0 when {near} then 1 end as fuzzy"


@query(f"""with {fx.TEXTS_SQL}, s as (select id, {_search_sql("lower('active ' || condition || ' ' || behavior)", ["license", "the"])} from texts) select id, fuzzy from s where fuzzy is not null order by fuzzy, id limit 50""")
def approved_search(spark, sf_dir):
    """F12"""
    return R.search(fx.texts(spark, sf_dir).withColumn("status", F.lit("active")), " License the ").select("id", "fuzzy")


@query(f"""with s as (select p_name, p_partkey, {_search_sql("lower(p_name)", ["re", "l"])} from part) select p_partkey, fuzzy from s where fuzzy is not null order by fuzzy, p_partkey limit 25""")
def model_search(spark, sf_dir):
    """F13"""
    return R.search(fx.table(spark, sf_dir, "part"), "re l", ("p_name",), "p_partkey", 25).select("p_partkey", "fuzzy")


_SPACED = f"trim(regexp_replace(s, '{X.SPACE}+', ' ', 'g'))"


@query(
    rf"""with c as (select conv_id, turn, role, text, {fx.redact_sql("text")} as s from conversations where text is not null), f as (select *, s as t from c)
    select conv_id, turn, case when length(text) <= 2000 and not regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') and length({_SPACED}) between 1 and 1000 then sha256({_SPACED}) end as declared_sha256,
      sha256(nullif(substr({fx.norm_sql("text")}, 1, 5000), '')) as prompt_sha256, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as key_sha256,
      sha256('condition: ' || {fx.norm_sql("role")}) as condition_sha256, sha256({fx.norm_sql("role")} || chr(10) || {fx.norm_sql("text")}) as joint_sha256, length(s) <= 2000 and not ({_SENSITIVE_SQL}) as payload_ok from f"""
)
def wording_forms(spark, sf_dir):
    """X2, X29, X32, X36, X39"""
    t = F.col("text")
    inputs = X.embedding_inputs(F.col("role"), t)
    forms = {"declared": X.declared_wording(t), "prompt": X.prompt_input(t), "key": X.key_text(t), "condition": inputs["condition"], "joint": inputs["joint"]}
    c = fx.table(spark, sf_dir, "conversations").filter("text is not null")
    return c.select("conv_id", "turn", *(X.checksum(f).alias(f"{n}_sha256") for n, f in forms.items()), X.bounded_json(t, 2000).isNotNull().alias("payload_ok"))


@query(
    r"""with e as (select *, '"' || event_type || '"' || props as t from events) select event_id, '[REDACTED]' as token, 'mail [REDACTED]' as note, cast(event_id as varchar) as generation,
      case event_id % 3 when 0 then props when 1 then props end as part, substr(t, 1, list_max(list_filter(range(0, 13), lambda k: 2 + length(replace(substr(t, 1, k), '"', '\"')) <= 12))) as prefix from e"""
)
def json_forms(spark, sf_dir):
    """X4, X27, X31"""
    i, props = F.col("event_id"), F.col("props")
    value = F.to_json(F.struct(F.col("event_type").alias("Api_Token"), F.lit("mail a@b.org").alias("note"), i.cast("string").alias("file_generation")), {"ignoreNullFields": "false"})
    redacted = {c: F.get_json_object("redacted", f"$.{k}").alias(c) for c, k in (("token", "Api_Token"), ("note", "note"), ("generation", "file_generation"))}
    said = F.when(i % 3 == 0, F.concat(F.lit("so:\n```json\n"), props, F.lit("\n```\nthat"))).when(i % 3 == 1, F.concat(F.lit("it is "), props, F.lit(" then"))).otherwise("no more")
    part = F.nullif(X.json_part(said), F.lit(""))
    e = fx.table(spark, sf_dir, "events").withColumn("redacted", free_json.redact_json(value))
    return e.select(i, *redacted.values(), part.alias("part"), X.json_prefix(F.concat(F.lit('"'), "event_type", F.lit('"'), props), 12).alias("prefix"))


@query(
    f"""with c as (select *, cast(to_json(role) as varchar) as r, cast(to_json({fx.redact_sql("text")}) as varchar) as s, cast(to_json(text) as varchar) as t from conversations)
    select conv_id, turn, '{{"z":[{{"b":' || coalesce(s, 'null') || ',"access_token":"[REDACTED]"}},' || turn || '],"a":{{"file_generation":' || r || ',"Path":"[REDACTED]","n":' || conv_id || '.5}}}}' as redacted,
      sha256('{{"a":{{"Path":' || r || ',"file_generation":' || r || ',"n":' || conv_id || '.5}},"z":[{{"access_token":' || turn || ',"b":' || coalesce(t, 'null') || '}},' || turn || ']}}') as checksum from c"""
)
def free_json_forms(spark, sf_dir):
    """Objects in lists in objects"""
    text, role, turn = F.col("text"), F.col("role"), F.col("turn")
    inner = F.concat(F.lit('{"b": '), F.coalesce(F.to_json(F.array(text)), F.lit("[null]")), F.lit("}"))
    b = F.regexp_extract(inner, r"(?s)^\{\"b\": \[(.*)\]\}$", 1)
    value = F.concat(F.lit('{"z": [{"b": '), b, F.lit(', "access_token": '), turn, F.lit("}, "), turn, F.lit('.0], "a": {"file_generation": "'), role, F.lit('", "Path": "'), role, F.lit('", "n": '), F.col("conv_id"), F.lit(".50}}"))
    return fx.table(spark, sf_dir, "conversations").select("conv_id", turn, free_json.redact_json(value).alias("redacted"), free_json.checksum_json(value).alias("checksum"))


_PARTS_SQL = f"""parts as (
  select conv_id, turn, text, role, case turn % 5 when 0 then text when 1 then text
    when 2 then '[tool_call:grep] {{"query":' || cast(to_json({fx.redact_sql("text")}) as varchar) || ',"token":"[REDACTED]","at":[{{"path":"[REDACTED]","line":' || turn || '}}]}}'
    when 3 then '[tool_result:read file] ' || text else '[tool_error:tool] ' || text end as part from conversations where text is not null)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks: a text, a thought, a call, a result and an error in turn."""
    t, turn = F.col("text"), F.col("turn")
    kind = F.when(turn % 5 == 0, "text").when(turn % 5 == 1, "thinking").when(turn % 5 == 2, "tool_call").otherwise("tool_result")
    name = F.when(turn % 5 == 2, "grep").when(turn % 5 == 3, "read file")
    arguments = F.to_json(F.struct(t.alias("query"), F.col("role").alias("token"), F.array(F.struct(F.col("conv_id").alias("path"), turn.alias("line"))).alias("at")))
    c = fx.table(spark, sf_dir, "conversations").filter(t.isNotNull())
    return c.select("conv_id", turn, t, X.message_part(kind, t, name, arguments, turn % 5 == 4).alias("part"))


@query(
    f"""with {_PARTS_SQL}, g as (select *, 'Agent Experience approved habit guidance (bounded; not policy/law):' || chr(10) || '- When: it ends' || chr(10) || '  Do: ' || text || chr(10) || '- When: ' || turn || chr(10) || '  Do: say so' as whole from parts), f as (select *, substr(whole, 1, 2000) as t from g)
    select conv_id, turn, sha256(part) as part_sha256, sha256(case turn % 4 when 0 then text || 'end' when 1 then text when 2 then '' else '' end) as visible_sha256, case when not ({_SENSITIVE_SQL}) then sha256(t) end as guidance_sha256 from f"""
)
def message_forms(spark, sf_dir):
    """X35, X37, X41"""
    t, turn = F.col("text"), F.col("turn")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.when(turn % 4 == 0, F.array(block("text", t), block("image", F.lit("x")), block("text", F.lit("end"))))
    habit = lambda condition, behavior: F.struct(condition.alias("condition"), behavior.alias("behavior"))
    habits = F.array(habit(F.lit("it ends"), t), habit(turn.cast("string"), F.lit("say so")))
    forms = {"part": F.col("part"), "visible": X.visible_text(parts, F.when(turn % 4 < 3, F.when(turn % 4 > 0, t)), turn % 4 != 2), "guidance": X.guidance(habits)}
    return _parts(spark, sf_dir).select("conv_id", "turn", *(X.checksum(f).alias(f"{n}_sha256") for n, f in forms.items()))


def _spaces(c: str) -> str:
    return f"trim(regexp_replace({c}, '{X.SPACE}+', ' ', 'g'))"


_ENDS = "case when length({0}) <= 1200 then {0} else substr({0}, 1, 600) || ' ' || right({0}, 600) end"


@query(
    rf"""with {_PARTS_SQL}, d as (select conv_id, string_agg(part, chr(10) order by turn) as raw from parts group by 1),
    s as (select conv_id, {fx.redact_sql("case when length(raw) <= 24000 then raw else substr(raw, 1, 12000) || ' ' || right(raw, 12000) end")} as t from d),
    p as (select conv_id, t, string_split(regexp_replace(t, '(?i)(\[tool_(?:call|result|error):)', chr(1) || '\1', 'g'), chr(1)) as pieces from s where not ({_SENSITIVE_SQL})),
    n as (select conv_id, t, pieces[1] as before, list_filter(pieces[2:], lambda x: regexp_matches(x, '(?i)^\[tool_(?:call|result|error):[^\]\r\n]{{1,120}}\]')) as spans, list_filter(pieces[2:], lambda x: not regexp_matches(x, '(?i)^\[tool_(?:call|result|error):[^\]\r\n]{{1,120}}\]')) as others from p),
    u as (select conv_id, generate_subscripts(spans, 1) as nth, unnest(spans) as x from n),
    w as (select conv_id, nth, max(nth) over (partition by conv_id) as last, regexp_extract(x, '(?i)^\[tool_(call|result|error):', 1) as kind, {_spaces(r"regexp_extract(x, '^\[[^:]*:([^\]]*)\]', 1)")} as name, {_spaces(r"regexp_extract(x, '(?s)^\[[^\]]*\](.*)$', 1)")} as payload from u),
    l as (select conv_id, string_agg({_spaces("'tool ' || kind || ' ' || name || ' ' || " + _ENDS.format("payload"))}, chr(10) order by nth desc) as told from w where nth > last - 8 group by 1),
    r as (select conv_id, {_spaces(f"regexp_replace(before || ' ' || array_to_string(others, ' '), {fx.quoted(X.REQUEST_LINE)}, ' ', 'g')")} as reply from n),
    e as (select conv_id, right(reply, 1200) as tail, substr(reply, 1, 1200) as head from r)
    select conv_id, nullif(concat_ws(chr(10), told, case when tail <> '' then 'assistant action ' || tail end, case when head <> '' and head <> tail then 'assistant action ' || head end), '') as source from e left join l using (conv_id)"""
)
def behavior_queries(spark, sf_dir):
    """What each conversation did, before the budget of tokens (tests hold that)"""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda p: p["part"]), "\n")
    turns = _parts(spark, sf_dir).groupBy("conv_id").agg(joined.alias("turn"))
    return turns.select("conv_id", X.behavior_source(F.col("turn")).alias("source")).filter("source is not null")


@query(
    f"""with c as (select conv_id, max(turn) filter (where role = 'user') as u, max(turn) filter (where role = 'assistant') as a, max(turn) as z from conversations group by 1),
    t as (select c.conv_id, trim({fx.redact_sql("u.text")}, ' ' || chr(9) || chr(10) || chr(13)) as u, trim({fx.redact_sql("a.text")}, ' ' || chr(9) || chr(10) || chr(13)) as a, z.role, z.text as last
      from c left join conversations u on u.conv_id = c.conv_id and u.turn = c.u left join conversations a on a.conv_id = c.conv_id and a.turn = c.a join conversations z on z.conv_id = c.conv_id and z.turn = c.z),
    h as (select *, case when length(u) <= 11993 then u else substr(u, 1, 5995) || '...' || right(u, 5995) end as ub, case when length(a) <= 11988 then a else substr(a, 1, 5992) || '...' || right(a, 5992) end as ab from t)
    select conv_id, coalesce(nullif(concat_ws(chr(10), case when u <> '' then 'user: ' || ub end, case when a <> '' then 'assistant: ' || ab end), ''),
      {fx.redact_sql("'{\"role\":\"' || role || '\"' || case when last is null then '' else ',\"content\":' || cast(to_json(right(last, 2000)) as varchar) end || '}'")}) as query from h"""
)
def host_queries(spark, sf_dir):
    """X42"""
    c = fx.table(spark, sf_dir, "conversations")
    return retrieval.host_query(c)


# --- vectors ------------------------------------------------------------------


@query("select vec_id, cast(4 * len(embedding) as int) as n_bytes, true as same, true as refused, case when list_dot_product(embedding, embedding) > 0 then 1.0::double end as norm from embeddings")
def vector_codec(spark, sf_dir):
    """There and back, another number of dimensions refused; unit vectors have norm 1"""
    e = fx.table(spark, sf_dir, "embeddings")
    n = len(e.first().embedding)
    e = e.select("vec_id", "embedding", X.vector_blob("embedding").alias("blob"))
    unit = X.unit(F.col("embedding"))
    return e.select("vec_id", F.octet_length("blob").alias("n_bytes"), (X.blob_vector(F.col("blob"), n) == F.col("embedding")).alias("same"), X.blob_vector(F.col("blob"), n - 1).isNull().alias("refused"), F.round(F.sqrt(X.dot(unit, unit)), 4).alias("norm"))


@query(
    """with p as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings), m as (select label, pos, avg(x::double) as x from p group by 1, 2), n as (select label, sqrt(sum(x * x)) as norm from m group by 1)
    select label, cast(pos as int) as pos, round(x / norm, 4) as x from m join n using (label) where pos <= 3"""
)
def pooled_vectors(spark, sf_dir):
    """The first elements of each label's unit mean"""
    v = fx.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector"))
    first = retrieval.pooled(v, "label").select("label", F.posexplode(F.slice("vector", 1, 3)).alias("pos", "x"))
    return first.select("label", (F.col("pos") + 1).alias("pos"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query(
    f"""with {fx.HABITS_SQL}, e as (select * from habits where status = 'active' and law_hash = 'law' and confidence_bp >= 1000 and staleness <= 0.9), s as (select *, case when id % 3 = 1 then 'missing' when id % 13 = 0 then 'invalid' else 'valid' end as state from e)
    select id, user_id, state, cast((row_number() over (partition by user_id order by id) - 1) // 8 as int) as batch from s where state <> 'valid'"""
)
def vectors_due(spark, sf_dir):
    """Vectors that active rows of the present law lack or that have changed, in batches of eight"""
    h = fx.habits(spark, sf_dir)
    want = h.filter("status = 'active'").filter(R.law_fresh("law") & R.eligible(1000, 0.9)).select("id", "user_id", (F.col("id") % 11).alias("checksum"))
    have = h.filter("id % 3 != 1").select("id", F.when(F.col("id") % 13 == 0, -1).otherwise(F.col("id") % 11).alias("checksum"), F.col("condition").alias("vector"))
    return retrieval.due(want, have, ["id"], 8).select("id", "user_id", "state", "batch")


@query(
    f"""with {fx.HABITS_SQL} select id, case when id % 3 <> 1 and id % 13 > 0 then 'cached' when id % 11 = 0 then 'changed' when id % 17 = 0 then 'dimensions_invalid' else 'written' end as outcome,
      case when id % 3 <> 1 and id % 13 > 0 then 2 when id % 11 = 0 or id % 17 = 0 then case when id % 3 <> 1 then 2 end else 3 end as dimensions from habits"""
)
def vectors_prepared(spark, sf_dir):
    """Each third habit lacks a vector, each thirteenth has one of another text; some change meanwhile, some vectors are of no use"""
    i = F.col("id")
    h = fx.habits(spark, sf_dir).select("id", F.col("user_id").cast("string").alias("user_id"))
    rows = h.select("id", "user_id", i.cast("string").alias("checksum"), F.concat(F.lit("habit "), i).alias("text"))
    cache = h.filter("id % 3 != 1").select("id", F.when(i % 13 == 0, "old").otherwise(i.cast("string")).alias("checksum"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector"))
    now = rows.withColumn("checksum", F.when(i % 11 == 0, "new").otherwise(F.col("checksum")))
    after, outcomes = vectors.prepared(rows, lambda: now, cache, lambda texts: [[1.0, 2.0] if int(t[6:]) % 17 == 0 else [1.0, 2.0, 2.0] for t in texts], 3)
    return outcomes.join(after.select("id", F.size("vector").alias("dimensions")), "id", "left")


@query(
    f"""with {fx.HABITS_SQL}, q as (select user_id, behavior from habits where id % 100 = 0),
    f as (select *, row_number() over (partition by user_id order by confidence_bp desc, id) as nth from habits where status = 'active' and law_hash = 'law' and confidence_bp >= 1000 and staleness <= 0.9),
    s as (select f.user_id, f.id, f.confidence_bp, {_cos("f.condition", "q.behavior")} as similarity_bp from f join q using (user_id) where nth <= 100),
    k as (select *, row_number() over (partition by user_id order by similarity_bp desc, confidence_bp desc, id) as nth from s where similarity_bp >= 100), a as (select * from k where nth <= 12),
    p as (select *, id % 4 = 0 and (id * 37) % 10001 >= 1000 as picked from a), n as (select user_id, count(*) filter (where picked) as picks from p group by 1)
    select p.user_id as batch_id, 'c' || nth as alias, id, similarity_bp, cast((id * 37) % 10001 as bigint) as judged_bp from p join n using (user_id) where picked and picks <= 3"""
)
def selections(spark, sf_dir):
    """A request of each user, from active candidates to those that a judge of numbers picks"""
    h = fx.habits(spark, sf_dir)
    requests = h.filter("id % 100 = 0").select(F.col("user_id").alias("batch_id"), "user_id", F.col("behavior").alias("query_vector"))
    cands = h.filter("status = 'active'").select("id", "user_id", "law_hash", "confidence_bp", "staleness", F.col("id").alias("checksum"), F.col("condition").alias("vector"))

    def judge(asked: DataFrame) -> DataFrame:
        fits = F.col("id") % 4 == 0
        return asked.select("batch_id", "alias", fits.alias("applicable"), ((F.col("id") * 37) % 10001).alias("confidence_bp"), F.when(fits, "current_applicability").otherwise("not_applicable").alias("reason"))

    return retrieval.selection(cands, requests, judge, "law", R.Policy(floor=100), 1000, 0.9).select("batch_id", "alias", "id", "similarity_bp", "judged_bp")


# --- analyze --------------------------------------------------------------------

_ID = "'{0}-' || substr(sha256({1}), 1, 40)"
_WORDS = "'v2' || chr(10) || lower({0}) || chr(10) || lower({1}) || chr(10) || {2}"
_CANDIDATE = _ID.format("candidate", "u || '|' || sha256(" + _WORDS.format("c", "d", "pol") + ")")


@query(
    f"""with n as (select *, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_linenumber, l_returnflag, l_shipdate) as ln from lineitem),
    l as (select l_orderkey as ok, ln, 'u' || (l_orderkey % 40) as u, 'b' || l_orderkey as b, l_orderkey % 4 = 0 as typed, case when ln = 3 then 'episode' else 'fact' end as tkind, 'k' || (l_partkey % 50) as k, 'When ' || (l_partkey % 50) as c,
      'do ' || (l_suppkey % 3) as d, 'is ' || (l_suppkey % 3) as content, case when cast(l_quantity as int) % 4 = 0 then -1 else 1 end as pol, cast(l_quantity as int) % 2 = 0 as rev, cast(round(l_extendedprice) as bigint) % 10100 as conf, l_suppkey % 97 = 0 as broken, 'c' || l_suppkey as mode, l_returnflag = 'R' as adv from n),
    i as (select l.*, o.mode as mode1, o.adv and l.adv as advised, case when l.ok % 8 = 0 then 'workspace' else 'user' end as sk, case when l.ok % 8 = 0 then 'w' else '' end as sc,
      case when l.typed then sha256('experience' || chr(10) || l.tkind || chr(10) || case when l.ok % 8 = 0 then 'workspace' else 'user' end || chr(10) || case when l.ok % 8 = 0 then 'w' else '' end || chr(10) || lower(l.c) || chr(10) || l.content) else sha256({_WORDS.format("l.c", "l.d", "l.pol")}) end as ident
      from l join l o on o.ok = l.ok and o.ln = 1 where l.ln <= 3),
    r as (select *, case when conf > 10000 then ['confidence_bp'] else [] end || case when broken then ['source'] else [] end || case when typed and ok % 12 = 0 and advised then ['authority'] else [] end as errors, min(ident) over (partition by ok, k) <> max(ident) over (partition by ok, k) as clash from i),
    g as (select *, case when max(len(errors)) over (partition by ok) > 0 then 'quarantine' when bool_or(clash) over (partition by ok) then 'pending_review' when typed then 'typed' else 'legacy' end as route from r),
    h as (select 'h' || p_partkey as id, 'u' || (p_partkey % 40) as u, 'when ' || (p_partkey % 50) as c, 'do ' || (p_partkey % 3) as d, 1 as pol, p_partkey from part where p_partkey <= 900),
    e0 as (select case when p_partkey <= 600 then id else {_CANDIDATE} end as id, u, c, d, case when p_partkey <= 600 then 'active' else 'candidate' end as status from h),
    leg as (select *, {_CANDIDATE} as cid, 'n' || ok || '-' || ln as pid from g where route = 'legacy'),
    sup as (select leg.pid, e0.id as hid, row_number() over (partition by e0.id order by ok, b, ln) as nth from leg join e0 on e0.u = leg.u and e0.c = lower(leg.c) and e0.d = leg.d and e0.status = 'active' where leg.pol = -1 and rev and not advised and conf >= 8500),
    hit as (select pid, hid from sup where nth = 1),
    told as (select leg.*, hit.hid, coalesce(hit.hid, cid) as habit from leg left join hit using (pid)),
    new as (select cid as id, max(conf) as conf, bool_or(rev) as rev, count(distinct ref) as refs from (select cid, conf, rev, unnest(['1:' || (ok * 100 + ln) || ':' || mode, '1:' || (ok * 100 + 1) || ':' || mode1]) as ref from told where hid is null) group by 1),
    ty as (select *, {_ID.format("experience", "u || '|' || k || '|' || ident")} as xid from g where route = 'typed'),
    x as (select xid as id, any_value(u) as u, any_value(tkind) as tkind, any_value(sk) as sk, any_value(lower(c)) as c, any_value(content) as content from ty group by 1),
    x0 as (select 'x' || s_suppkey as id, 'u' || (s_suppkey % 40) as u, 'when ' || (s_suppkey % 50) as c, 'is ' || (s_suppkey % 3) as content from supplier)
    select 'habits' as name, e0.id, cast(greatest(5000, coalesce(conf, 0)) as bigint) as n, case when exists (select 1 from hit where hid = e0.id) then 'dormant' else status end || ' collecting ' || coalesce(refs, 0) as state from e0 left join new on new.id = e0.id
    union all select 'habits', id, conf, 'candidate ' || case when rev then 'candidate' else 'collecting' end || ' ' || refs from new where id not in (select id from e0)
    union all select 'evidence', habit, count(*), cast(sum(conf) as varchar) from told group by habit
    union all select 'experiences', x.id, (select count(*) from x0 where x.tkind = 'fact' and x.sk = 'user' and x0.u = x.u and x0.c = x.c and x0.content <> x.content), tkind || ' ' || sk from x
    union all select 'experiences', id, 0, 'fact user' from x0
    union all select 'reviews', b, count(*), route || ' ' || array_to_string(list_sort(list_distinct(flatten(list(errors || case when clash then ['candidate_key'] else [] end)))), ',') from g where route in ('quarantine', 'pending_review') group by b, route
    union all select 'watermarks', u || '|1|' || case route when 'typed' then 'read' else 'commit' end, max(ok * 100 + ln), null from g where route in ('typed', 'legacy') group by u, route
    union all select 'audits', b, count(*), route || ' ' || count(distinct case when route = 'typed' then xid else habit end) from (select b, route, xid, null as habit from ty union all select b, route, null, habit from told) group by b, route"""
)
def analyze_commit(spark, sf_dir):
    """Lines propose habits or records, three an order; what a batch leaves in each table, given twice"""
    k, order, nth = F.col, F.col("l_orderkey"), F.col("ln")
    lineitem = fx.table(spark, sf_dir, "lineitem")
    within = W.partitionBy(order).orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_shipdate")
    used = (order, F.row_number().over(within).alias("ln"), F.concat(F.lit("c"), F.first("l_suppkey").over(within)).alias("first_mode"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate")
    with scratch(spark) as keep:
        line = materialize(*(p.select(*used) for p in parts(lineitem, ["l_orderkey"], parts_of(lineitem.count() // 3))), compression="zstd")
        return _analyzed(spark, sf_dir, line, keep)


def _analyzed(spark, sf_dir, line, keep):
    k, order, nth = F.col, F.col("l_orderkey"), F.col("ln")
    user, mod = F.concat(F.lit("u"), order % 40), lambda t, c, n: F.concat(F.lit(t), k(c) % n)
    obs = line.select(user.alias("user_id"), F.lit(1).alias("file_generation"), (order * 100 + nth).alias("seq"), F.concat(F.lit("c"), "l_suppkey").alias("checksum"), F.when(k("l_returnflag") == "R", "advisor_finding").otherwise("local_interactive").alias("origin"), k("l_shipdate").cast("timestamp").alias("observed_at"))
    ref = lambda seq, checksum: F.struct(F.lit(1).alias("file_generation"), seq.alias("seq"), checksum.alias("checksum"))
    own = ref(order * 100 + nth, F.when(k("l_suppkey") % 97 == 0, "other").otherwise(F.concat(F.lit("c"), "l_suppkey")))
    quantity, typed, scoped = F.rint("l_quantity").cast("int"), order % 4 == 0, order % 8 == 0
    kind = F.when(~typed, "habit").when(nth == 3, "episode").otherwise("fact")
    proposals = line.filter(order.isNotNull() & (nth <= 3)).select(
        user.alias("user_id"), F.concat(F.lit("b"), order).alias("batch_id"), nth.alias("pos"), F.concat(F.lit("n"), order, F.lit("-"), nth).alias("proposal_id"), kind.alias("kind"), mod("k", "l_partkey", 50).alias("candidate_key"),
        F.when(~typed, mod("When ", "l_partkey", 50)).alias("condition"), F.when(~typed, mod("do ", "l_suppkey", 3)).alias("behavior"), F.when(~typed, F.when(quantity % 4 == 0, -1).otherwise(1)).alias("polarity"), F.when(quantity % 4 == 0, "old_negative").alias("role"), F.when(quantity % 2 == 0, "reviewable").otherwise("collecting").alias("evidence_stage"),
        F.when(scoped, "workspace").otherwise("user").alias("scope_kind"), F.when(scoped, "w").alias("scope_key"), F.when(order % 12 == 0, "explicit_user").otherwise("inferred").alias("authority"), mod("When ", "l_partkey", 50).alias("applicability"), mod("is ", "l_suppkey", 3).alias("content"),
        (F.round("l_extendedprice").cast("bigint") % 10100).alias("confidence_bp"), F.lit(1).alias("file_generation"), F.array(own, ref(order * 100 + 1, F.when((nth == 1) & (k("l_suppkey") % 97 == 0), "other").otherwise(k("first_mode")))).alias("source_refs"), F.timestamp_seconds(order).alias("created_at"),
    )
    part, u = k("p_partkey"), F.concat(F.lit("u"), k("p_partkey") % 40)
    wording = (mod("when ", "p_partkey", 50), mod("do ", "p_partkey", 3))
    known = part <= 600
    candidate = X.stable_id("candidate", F.concat_ws("|", u, X.identity("v2", *wording, F.lit("1"))))
    null = lambda t: F.lit(None).cast(t)
    habits = fx.table(spark, sf_dir, "part").filter("p_partkey <= 900").select(
        F.when(known, F.concat(F.lit("h"), part)).otherwise(candidate).alias("id"), u.alias("user_id"), null("string").alias("candidate_key"), wording[0].alias("condition"), wording[1].alias("behavior"), F.lit(1).alias("polarity"), F.lit(5000).alias("confidence_bp"),
        F.when(known, "active").otherwise("candidate").alias("status"), F.lit("collecting").alias("review_status"), null("timestamp").alias("last_confirmed"), F.array().cast("array<string>").alias("refs"), null("string").alias("superseded_by"),
    )
    sup = F.col("s_suppkey")
    empty = spark.createDataFrame([], committing.TABLES["experiences"]).columns
    fields = {"id": F.concat(F.lit("x"), sup), "user_id": F.concat(F.lit("u"), sup % 40), "kind": F.lit("fact"), "scope_kind": F.lit("user"), "applicability": mod("when ", "s_suppkey", 50), "content": mod("is ", "s_suppkey", 3), "status": F.lit("active"), "conflicts_with": F.array().cast("array<string>")}
    records = fx.table(spark, sf_dir, "supplier").select(*(fields.get(c, F.lit(None)).alias(c) for c in empty))
    store = committing.ledger(spark, _folder(spark, "commit"))
    store.commit(0, {"habits": habits, "experiences": records})
    for _ in range(2):
        committing.commit(store, 1, proposals, obs, ("fact", "episode"))
    rows = lambda name, key, n, state: store.table(name).select(F.lit(name).alias("name"), key, n.cast("bigint").alias("n"), state.alias("state"))
    evidence = store.table("evidence").groupBy(k("habit_id").alias("id")).agg(F.count("*").alias("n"), F.sum("confidence_bp").cast("string").alias("state")).select(F.lit("evidence").alias("name"), "id", "n", "state")
    made = F.when(k("action") == "committed", F.concat(F.lit("legacy "), F.size("habits"))).otherwise(F.concat(F.lit("typed "), F.size("experiences")))
    batch = k("batch_id").alias("id")
    reviews = rows("reviews", batch, F.lit(0), F.concat_ws(" ", "kind", F.array_join("reasons", ","))).drop("n")
    reviews = keep(reviews.join(proposals.groupBy(batch).agg(F.count("*").alias("n")), "id").select("name", "id", "n", "state"))
    return (
        rows("habits", k("id"), k("confidence_bp"), F.concat_ws(" ", "status", "review_status", F.size("refs")))
        .union(evidence)
        .union(rows("experiences", k("id"), F.size("conflicts_with"), F.concat_ws(" ", "kind", "scope_kind")))
        .union(reviews)
        .union(rows("watermarks", k("key").alias("id"), k("seq"), F.lit(None).cast("string")))
        .union(rows("audits", batch, k("proposals"), made))
    )
