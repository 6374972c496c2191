
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import exprs as X

# Wording that a habit may not have, matched on normalised text.
LAW_RULES = (
    "ignore .*safety",
    "bypass .*safety",
    "disable .*safety",
    "reveal .*secret",
    "store .*secret",
    "skip .*redaction",
    "bypass .*approval",
    r"write .*agents\.md",
    r"write .*claude\.md",
    "write .*law",
    "enable .*timer.*without .*approval",
    "enable .*live.*without .*approval",
    "inject .*report",
    "inject .*quarantine",
    "inject .*pending[- ]review",
)

# Pairs of wordings that oppose each other.
OPPOSITES = (
    (r"\bdo\b", r"\bdo not\b"),
    (r"\buse\b", r"\bdo not use\b"),
    (r"\binclude\b", r"\bdo not include\b"),
    (r"\bask\b", r"\bdo not ask\b"),
    (r"\balways\b", r"\bnever\b"),
    (r"\bprefer\b", r"\bavoid\b"),
    (r"\bverbose\b", r"\bconcise\b"),
    (r"\blong\b", r"\bshort\b"),
)

# Wording too close to one version, path or hash, and instructions from untrusted text.
OVERFIT = {
    "version": r"\bv?\d+\.\d+\.\d+(?:[-+][A-Za-z0-9._-]+)?\b",
    "path": r"""(^|[\s("'`])(?:~/|\.\.?/|/[A-Za-z0-9._-])""",
    "hash": r"(?i)\b[a-f0-9]{12,}\b",
}
UNTRUSTED = r"(?i)</?system|ignore\s+(?:all\s+|previous\s+)?instructions|tool\s+output\s+(?:says|instructs)"

# A message's error class, first match wins.
ERROR_CODES = (
    (r"(?i)pi_runtime|coding_agent_api|runtime_compat", "runtime_incompatible"),
    (r"(?i)auth|api.?key|credential", "model_auth_unavailable"),
    (r"(?i)model_(?:unavailable|not_found)|model is not available", "model_not_found"),
    (r"(?i)model_output|invalid_json|truncated|schema|proposal|source_ref", "model_output_invalid"),
    (r"(?i)\bacquir|\bowned\b|\block\b.*(?:timeout|stale|fail|error|active|ownership|changed)", "lock_io_error"),
    (r"(?i)sqlite|storage|observation|manifest|watermark|ledger|file|directory", "storage_io_error"),
)

# Review statuses that hide a candidate, those that mean approved and waiting, all statuses of a habit, and those that take part in conflicts.
HIDDEN_REVIEW = ("collecting_evidence", "approved_pending_eligibility", "approved_pending_conflict", "approved_pending_law_blocked", "duplicate_resolution")
WAITING_REVIEW = HIDDEN_REVIEW[1:4]
STATUSES = ("candidate", "active", "disabled", "archived", "dormant", "suppressed_by_law")
LIVE = ("candidate", "active", "disabled", "suppressed_by_law", "dormant")


@dataclass(frozen=True)
class Policy:
    """[X18] Thresholds in ten-thousandths; ``strong`` is never below ``review``."""

    review: int = 5500
    strong: int = 7000
    floor: int = 1500
    top_k: int = 12

    def clamped(self) -> Policy:
        within = lambda x: min(10000, max(0, int(x)))
        return Policy(within(self.review), max(within(self.review), within(self.strong)), within(self.floor), max(0, min(12, int(self.top_k))))


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)))


def first_match(otherwise: str | None, *pairs: tuple[Column, str]) -> Column:
    out = None
    for c, name in pairs:
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(otherwise) if otherwise is not None else out


def law_reasons(condition: Column, behavior: Column) -> Column:
    """The rules that the joint wording breaks; it is normalised once."""
    text = X.norm_text(F.concat_ws(" ", condition, behavior))
    return F.transform(F.array(text), lambda t: reasons(*((t.rlike(p), p) for p in LAW_RULES)))[0]


def opposed(a: Column, b: Column) -> Column:
    """Symmetric."""
    return any_of(*((a.rlike(x) & b.rlike(y)) | (a.rlike(y) & b.rlike(x)) for x, y in OPPOSITES))


def opposite_sides(c: Column) -> tuple[Column, Column]:
    """Bit sets of the first and of the second wordings of ``OPPOSITES`` that a text has.

    Two texts are opposed if one's first set meets the other's second.
    """
    bits = lambda side: sum((F.when(c.rlike(p[side]), 1 << i).otherwise(0) for i, p in enumerate(OPPOSITES)), F.lit(0))
    return bits(0), bits(1)


def overfit_reasons(text: Column, project_names: tuple[str, ...] = ()) -> Column:
    """[F7]"""
    pairs = [(text.rlike(p), name) for name, p in OVERFIT.items()]
    if project_names:
        pairs.insert(0, (text.rlike(r"(?i)\b(?:" + "|".join(project_names) + r")\b"), "project"))
    return reasons(*pairs)


def untrusted(text: Column) -> Column:
    """[F8]"""
    return text.rlike(UNTRUSTED)


def capture_origin(source: Column, streaming: Column, images: Column, key: Column, text: Column, longest: int = 16384) -> Column:
    """[F9]"""
    return first_match(
        "allow",
        (F.coalesce(source != "interactive", F.lit(True)), "source_not_allowlisted"),
        (F.coalesce(streaming, F.lit(False)), "streaming_input_denied"),
        (F.coalesce(images, F.lit(0)) > 0, "images_denied"),
        (key.isNull(), "missing_capture_key"),
        (F.coalesce(text, F.lit("")).rlike(r"^\s*$"), "empty_text_denied"),
        (F.length(text) > longest, "input_too_large"),
    )


def successful_runs(messages: DataFrame, key: str = "run_id", longest: int = 65536) -> DataFrame:
    """[F10, X25] Visible assistant text of each run that did not end in error, abort or overlength."""
    seen = messages.filter("role = 'assistant'").groupBy(key).agg(
        F.max_by("stop_reason", "pos").alias("stop_reason"),
        F.array_sort(F.collect_list(F.when(F.coalesce("display", F.lit(True)), F.struct("pos", "text")))).alias("parts"),
    )
    kept = seen.filter(~F.coalesce(F.col("stop_reason").isin("error", "aborted", "length"), F.lit(False)))
    return kept.select(key, X.tail_keep(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), longest).alias("text"))


def eligible(min_confidence_bp: int, staleness_max: float) -> Column:
    """Both bounds inclusive."""
    return (F.col("confidence_bp") >= min_confidence_bp) & (F.col("staleness") <= staleness_max)


def law_fresh(law_hash: str) -> Column:
    """[F2]"""
    return F.coalesce(F.col("law_hash") == law_hash, F.lit(False))


def valid_at(now: Column) -> Column:
    """Active, begun, not yet expired."""
    return F.coalesce((F.col("status") == "active") & (F.col("valid_from") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)), F.lit(False))


def in_scope(kinds: tuple[str, ...] | None, scope_kind: str | None, scope_key: str | None, min_confidence_bp: int) -> Column:
    """One of ``kinds``, of the user or of exactly this scope, approved and sure enough."""
    scope = F.col("scope_kind") == "user"
    if scope_kind:
        scope = scope | ((F.col("scope_kind") == scope_kind) & F.col("scope_key").eqNullSafe(F.lit(scope_key)))
    kind = F.col("kind").isin(*kinds) if kinds is not None else F.lit(True)
    return kind & scope & (F.col("confidence_bp") >= min_confidence_bp) & F.coalesce(F.col("approved"), F.lit(False))


def search(items: DataFrame, query: str, columns: tuple[str, ...] = ("status", "condition", "behavior"), order: str = "id", cap: int = 50) -> DataFrame:
    """Items that have all terms as substrings, then those that have each term's characters in order.

    An empty query gives the first items.  ``fuzzy`` is 0 for the former, 1
    for the latter; ties go by ``order``.
    """
    text = F.lower(F.concat_ws(" ", *(F.col(c) for c in columns)))
    terms = [t for t in query.lower().split() if t]
    direct, near = F.lit(True), F.lit(True)
    for t in terms:
        direct = direct & F.contains(text, F.lit(t))
        near = near & text.rlike("^" + "".join(rf"[^{re.escape(c)}]*+{re.escape(c)}" for c in t))  # possessive: no backtracking on long texts
    ranked = items.withColumn("fuzzy", F.when(direct, 0).when(near, 1)).filter("fuzzy is not null")
    return ranked.orderBy("fuzzy", order).limit(cap)


def review_visible() -> Column:
    """A missing review status is visible."""
    return ~F.coalesce(F.col("review_status").isin(*HIDDEN_REVIEW), F.lit(False))


def waiting_reason() -> Column:
    """Null unless approved and waiting."""
    return F.when(F.col("review_status").isin(*WAITING_REVIEW), F.regexp_replace("review_status", "^approved_pending_", ""))


def not_migrated(records: DataFrame, migrations: DataFrame) -> DataFrame:
    """[F16] Records that neither the migration table nor their provenance traces to a habit."""
    rest = records.join(migrations, "id", "left_anti")
    return rest.filter(~F.coalesce(F.exists("provenance", lambda p: (p["source"] == "migration") & F.startswith(p["evidence_id"], F.lit("legacy-habit:"))), F.lit(False)))


def intact(stored: Column, *parts: Column) -> Column:
    """The stored checksum is that of the row's parts."""
    return F.coalesce(X.event_fingerprint(*parts) == stored, F.lit(False))


def record_errors(kinds: tuple[str, ...], scopes: tuple[str, ...], longest: int = 2000) -> Column:
    """What is wrong with a typed record; empty for a valid one."""
    return reasons(
        (~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "kind"),
        (~F.coalesce(F.col("scope_kind").isin(*scopes), F.lit(False)), "scope"),
        ((F.col("scope_kind") == "user") != F.col("scope_key").isNull(), "scope_key"),
        (~F.coalesce(F.length("content").between(1, longest), F.lit(False)), "content"),
        (~F.coalesce(F.length("applicability").between(1, longest), F.lit(False)), "applicability"),
        (~F.coalesce(F.col("confidence_bp").between(0, 10000), F.lit(False)), "confidence_bp"),
        (F.arrays_overlap("supersedes", "conflicts_with"), "relations"),
        (F.array_contains("supersedes", F.col("id")) | F.array_contains("conflicts_with", F.col("id")), "self_relation"),
        (X.sensitive(F.col("content")), "sensitive"),
    )


def payload_errors(longest: int = 65536) -> Column:
    """What is wrong with an observation's origin and payload."""
    pair, finding = F.col("kind") == "conversation_pair_v1", F.col("kind") == "advisor_finding_v1"
    return reasons(
        (~F.coalesce(pair | finding, F.lit(False)), "kind"),
        (pair & (F.col("origin") != "local_interactive"), "origin"),
        (finding & (F.col("origin") != "advisor"), "origin"),
        (F.octet_length("payload") > longest, "size"),
        (X.sensitive(F.col("payload")), "sensitive"),
    )


def proposal_errors(proposals: DataFrame, most: int = 200) -> DataFrame:
    """``proposals`` with ``errors``, those of its batch included."""
    batch = W.partitionBy("batch_id")
    return proposals.withColumn(
        "errors",
        reasons(
            (~F.coalesce(F.col("polarity").isin(-1, 1), F.lit(False)), "polarity"),
            (~F.coalesce(F.col("confidence_bp").between(0, 10000), F.lit(False)), "confidence_bp"),
            (~F.coalesce(F.size("source_refs").between(1, 20), F.lit(False)), "source_refs"),
            (F.count("*").over(W.partitionBy("batch_id", "proposal_id")) > 1, "proposal_id"),
            (F.count("*").over(batch) > most, "too_many"),
            (F.min("file_generation").over(batch) != F.max("file_generation").over(batch), "generation"),
            (F.size(overfit_reasons(F.concat_ws(" ", "condition", "behavior"))) > 0, "overfit"),
            (untrusted(F.concat_ws(" ", "condition", "behavior")), "untrusted"),
        ),
    )


def split(checked: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Rows without and with errors."""
    return checked.filter(F.size(errors) == 0).drop(errors), checked.filter(F.size(errors) > 0)


def judged(candidates: DataFrame, judgments: DataFrame, most: int, least_bp: int, batch: str = "batch_id") -> DataFrame:
    """Selected judgments of each batch that covers its candidates exactly and selects no more than ``most``."""
    both = candidates.select(batch, "alias").withColumn("asked", F.lit(1)).join(judgments, [batch, "alias"], "full_outer")
    w = W.partitionBy(batch)
    picked = F.coalesce(F.col("applicable") & (F.col("confidence_bp") >= least_bp), F.lit(False))
    sane = F.coalesce((F.col("asked") == 1) & F.col("confidence_bp").between(0, 10000) & (F.col("applicable") == (F.col("reason") == "current_applicability")), F.lit(False))
    marked = both.withColumn("picked", picked).withColumn("sane", F.bool_and(sane).over(w)).withColumn("once", F.count("*").over(W.partitionBy(batch, "alias")) == 1)
    marked = marked.withColumn("fits", F.count_if("picked").over(w) <= most).withColumn("once", F.bool_and("once").over(w))
    return marked.filter("sane and once and fits and picked").select(batch, "alias", "confidence_bp")


def dismissal(method: str, review_bp: int) -> Column:
    """Why a pending relation no longer stands; null if it does."""
    states = ("active", "disabled", "candidate")
    return first_match(
        None,
        (F.col("method") != method, "obsolete_scoring_method"),
        (F.col("status_a").isNull() | F.col("status_b").isNull(), "missing_habit"),
        (~F.col("status_a").isin(*states) | ~F.col("status_b").isin(*states), "ineligible_habit_status"),
        ((F.col("status_a") == "candidate") & (F.col("status_b") == "candidate"), "candidate_pair_not_supported"),
        (F.col("polarity_a") != F.col("polarity_b"), "polarity_changed"),
        (~(F.col("wording_a").eqNullSafe(F.col("stored_a")) & F.col("wording_b").eqNullSafe(F.col("stored_b"))), "habit_wording_changed"),
        (F.col("similarity_bp") < review_bp, "below_current_review_threshold"),
    )


def context_turns(turns: DataFrame, key: str = "conv_id", last: int = 4, each: int = 300, total: int = 1200) -> DataFrame:
    """[F24, W4] The last visible turns before the newest user turn, cut short; over ``total`` in all none is left."""
    w = W.partitionBy(key)
    current = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)
    seen = turns.withColumn("current", current).filter("turn < current and role in ('user', 'assistant')")
    tail = seen.withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).filter(F.col("back") <= last)
    cut = tail.withColumn("text", F.substring("text", 1, each))
    return cut.withColumn("sum", F.sum(F.length("text")).over(w)).filter(F.col("sum") <= total).select(key, "turn", "role", "text", "back")


def delivery() -> Column:
    """How a finding reaches the host."""
    append, steer, visible = F.col("can_append"), F.col("can_steer"), F.col("can_append_visible")
    steerable = steer & ~F.col("cancelled") & ~F.col("terminal") & (F.col("plan_mode") == "off") & (F.col("immune_turns") <= 0)
    return first_match(
        "append_when_settled",
        (F.col("shutting_down") | (~append & ~steer), "visible_fallback"),
        ((F.col("idle") | ~F.col("active")) & append, "append_now"),
        (F.col("idle") | ~F.col("active"), "visible_fallback"),
        (steerable, "steer"),
        (append, "append_when_settled"),
        (visible, "visible_fallback"),
    )


def error_code(message: Column) -> Column:
    """[F26]"""
    return first_match("model_call_failed", *((message.rlike(p), code) for p, code in ERROR_CODES))


def steering_errors() -> Column:
    """What is wrong with a steering entry (array of habits, time)."""
    return reasons(
        (~F.coalesce(F.size("habits").between(1, 3), F.lit(False)), "habits"),
        (F.exists("habits", lambda h: X.sensitive(h["condition"]) | X.sensitive(h["behavior"])), "wording"),
        (~X.is_iso(F.col("created_at")), "created_at"),
    )
