"""Lifecycle decisions and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.functions import rules as R
from tracewell.sources.tables import materialize


def resolved_refs(proposals: DataFrame, observations: DataFrame) -> DataFrame:
    """[J1] Each source reference of each proposal with its observation and ``state``."""
    refs = proposals.select("proposal_id", F.explode("source_refs").alias("ref")).select("proposal_id", "ref.*")
    found = observations.select("file_generation", "seq", F.col("checksum").alias("found"))
    state = R.first_match("resolved", (F.col("found").isNull(), "missing"), (F.col("found") != F.col("checksum"), "changed"))
    return refs.join(found, ["file_generation", "seq"], "left").withColumn("state", state)


def missing_refs(refs: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """[J2] References that no observation answers."""
    return refs.join(observations, keys, "left_anti")


def conflicts(habits: DataFrame) -> DataFrame:
    """[J9] Ordered pairs of live habits of one user with equal normalised condition that contradict each other.

    Equal behavior conflicts only at opposite polarity; other behavior is
    opposed or divergent.  Habits of equal wording and polarity are one class
    (its smallest id), so copies are not paired with each other.  Texts are
    read once a habit: pairs meet by hashes of the wording and by which sides
    of the opposites each behavior has.
    """
    live = habits.filter(F.col("status").isin(*R.LIVE)).select("user_id", "id", "polarity", X.norm_text(F.col("condition")).alias("on"), X.norm_text(F.col("behavior")).alias("does"))
    left, right = R.opposite_sides(F.col("does"))
    hashed = live.select("user_id", "id", "polarity", X.checksum(F.col("on")).alias("on"), X.checksum(F.col("does")).alias("does"), left.alias("left"), right.alias("right"))
    classes = hashed.groupBy("user_id", "on", "does", "polarity").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    a, b = (classes.select("user_id", "on", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "does", "polarity", "n", "left", "right"))) for s in "ab")
    both = a.join(b, ["user_id", "on"]).filter("id_a < id_b")
    meet = F.col("left_a").bitwiseAND(F.col("right_b")).bitwiseOR(F.col("right_a").bitwiseAND(F.col("left_b")))
    reason = R.first_match("same_condition_divergent_behavior", ((F.col("does_a") == F.col("does_b")), "opposite_polarity"), (meet != 0, "opposed_behavior"))
    kept = both.filter((F.col("does_a") != F.col("does_b")) | (F.col("polarity_a") == -F.col("polarity_b")))
    return kept.select("user_id", "id_a", "id_b", "n_a", "n_b", reason.alias("reason"))


def conflict_links(habits: DataFrame) -> DataFrame:
    """[J9] Every live habit with its class of ``conflicts`` and how many classes contradict that, by reason; nothing is paired.

    Under a condition the classes of the same sides of the opposites are
    counted, and what a class meets follows from these few counts.
    """
    live = habits.filter(F.col("status").isin(*R.LIVE)).select("user_id", "id", "polarity", X.norm_text(F.col("condition")).alias("on"), X.norm_text(F.col("behavior")).alias("does"))
    left, right = R.opposite_sides(F.col("does"))
    hashed = materialize(live.select("user_id", "id", "polarity", X.checksum(F.col("on")).alias("on"), X.checksum(F.col("does")).alias("does"), left.alias("left"), right.alias("right")))
    one = ["user_id", "on", "does", "polarity"]
    classes = materialize(hashed.groupBy(*one).agg(F.min("id").alias("class_id"), F.first("left").alias("left"), F.first("right").alias("right")))
    sides = classes.groupBy("user_id", "on", "left", "right").agg(F.count("*").alias("n"))
    other = sides.select("user_id", "on", *(F.col(c).alias(f"{c}_b") for c in ("left", "right", "n")))
    meet = F.col("left").bitwiseAND(F.col("right_b")).bitwiseOR(F.col("right").bitwiseAND(F.col("left_b"))) != 0
    met = sides.join(other, ["user_id", "on"]).groupBy("user_id", "on", "left", "right").agg(F.sum("n_b").alias("all"), F.sum(F.when(meet, F.col("n_b")).otherwise(0)).alias("opposed"))
    same = classes.groupBy("user_id", "on", "does").agg(F.count("*").alias("same"))
    against = classes.select("user_id", "on", "does", (-F.col("polarity")).alias("polarity"), F.when(F.col("polarity") != 0, 1).otherwise(0).cast("bigint").alias("opposite_polarity"))
    seen = classes.join(met, ["user_id", "on", "left", "right"]).join(same, ["user_id", "on", "does"]).join(against, one, "left")
    own = F.when(F.col("left").bitwiseAND(F.col("right")) != 0, F.col("same")).otherwise(0)  # classes of its own wording, if that opposes itself
    opposed = F.col("opposed") - own
    counts = seen.select(*one, "class_id", F.coalesce("opposite_polarity", F.lit(0)).cast("bigint").alias("opposite_polarity"), opposed.alias("opposed_behavior"), (F.col("all") - F.col("same") - opposed).alias("divergent_behavior"))
    return hashed.select("id", *one).join(counts, one).select("user_id", "id", "class_id", "opposite_polarity", "opposed_behavior", "divergent_behavior")


def conflicted(habits: DataFrame) -> DataFrame:
    """[J9] ``id`` of every live habit that another of its user and normalised condition contradicts, copies included.

    Grouped, not paired: of the wordings and polarities under a condition a
    habit is contradicted if another wording is there, or its own at the
    opposite polarity.
    """
    live = habits.filter(F.col("status").isin(*R.LIVE)).select("user_id", "id", "polarity", X.checksum(X.norm_text(F.col("condition"))).alias("on"), X.checksum(X.norm_text(F.col("behavior"))).alias("does"))
    wordings = live.groupBy("user_id", "on", "does").agg(F.min("polarity").alias("low"), F.max("polarity").alias("high"))
    found = wordings.groupBy("user_id", "on").agg((F.min("does") != F.max("does")).alias("several"), F.bool_or((F.col("low") == -F.col("high")) & (F.col("low") != 0)).alias("both"))
    return live.join(found.filter("several or both").select("user_id", "on"), ["user_id", "on"], "left_semi").select("id")


def typed_conflicts(proposals: DataFrame, records: DataFrame) -> DataFrame:
    """[J11] Records of the same kind, scope and applicability with other content; episodes are exempt."""
    side = lambda df, s: df.select("kind", "scope_kind", "scope_key", X.norm_text(F.col("applicability")).alias("on"), F.col("id").alias(f"id_{s}"), X.norm_text(F.col("content")).alias(f"content_{s}"))
    p, r = side(proposals.filter("kind != 'episode'"), "p").alias("p"), side(records, "r").alias("r")
    same = (F.col("p.kind") == F.col("r.kind")) & (F.col("p.scope_kind") == F.col("r.scope_kind")) & F.col("p.scope_key").eqNullSafe(F.col("r.scope_key")) & (F.col("p.on") == F.col("r.on"))
    met = p.join(r, same & (F.col("content_p") != F.col("content_r")))
    return met.groupBy("id_p").agg(F.sort_array(F.collect_set("id_r")).alias("conflicts_with"))


def exact_corrections(proposals: DataFrame, habits: DataFrame) -> DataFrame:
    """[J12, J13] The one active habit of a proposal's wording; none where several match."""
    key = lambda df: df.withColumn("wording", X.identity("v1", F.col("condition"), F.col("behavior")))
    active = key(habits.filter("status = 'active'")).groupBy("user_id", "wording").agg(F.count("*").alias("n"), F.min("id").alias("habit_id"))
    return key(proposals).join(active.filter("n = 1").drop("n"), ["user_id", "wording"])


def folded_relations(records: DataFrame, edges: DataFrame) -> DataFrame:
    """[J16] Records with sorted arrays of what they supersede and conflict with."""
    of = lambda r: F.sort_array(F.collect_set(F.when(F.col("relation") == r, F.col("target_id"))))
    folded = edges.groupBy(F.col("source_id").alias("id")).agg(of("supersedes").alias("supersedes"), of("conflicts_with").alias("conflicts_with"))
    none = F.array().cast(f"array<{edges.schema['target_id'].dataType.simpleString()}>")
    return records.join(folded, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("supersedes", "conflicts_with")})


def active_conflicts(records: DataFrame) -> DataFrame:
    """[J18] How many of a record's conflicts are active."""
    active = records.filter("status = 'active'").select(F.col("id").alias("other"))
    listed = records.select("id", F.explode_outer("conflicts_with").alias("other"))
    return listed.join(active.withColumn("hit", F.lit(1)), "other", "left").groupBy("id").agg(F.count("hit").alias("blocking"))


def key_conflicts(proposals: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """[A11] Keys with more than one identity."""
    return proposals.groupBy(key).agg(F.count_distinct(*identity).alias("identities"), F.count("*").alias("n")).filter("identities > 1")


def single_generation(batches: DataFrame) -> DataFrame:
    """[A16] Whether a batch refers to exactly one generation."""
    return batches.groupBy("batch_id").agg((F.min("file_generation") == F.max("file_generation")).alias("single"), F.min("file_generation").alias("file_generation"))


def corrections(proposals: DataFrame) -> DataFrame:
    """[D4] A correction as its old, negative and its new, positive half."""
    half = lambda polarity, behavior, role: F.struct(F.lit(polarity).alias("polarity"), behavior.alias("behavior"), F.lit(role).alias("role"))
    both = F.array(half(-1, F.col("old_behavior"), "old_negative"), half(1, F.col("new_behavior"), "new_positive"))
    rest = [c for c in proposals.columns if c not in ("old_behavior", "new_behavior")]
    return proposals.select(*rest, F.inline(both))


def normalised_output(raw: DataFrame, habits: DataFrame, most: int = 50, habits_only: bool = True, kinds: tuple[str, ...] = ()) -> DataFrame:
    """[D5] The first proposals of a batch, with stage and whether an explicit correction applies.

    A correction is explicit if it is sure enough, has a source that is no
    advisor's (``sources``: the origins of its references), and what it
    corrects (condition, behavior, affirmed) is an active habit.
    ``habits(user_id, condition, behavior, polarity, status)``.
    """
    typed = F.col("kind").isin(*kinds) if kinds else F.lit(False)
    kept = raw.withColumn("nth", F.row_number().over(W.partitionBy("batch_id").orderBy("pos"))).filter(F.col("nth") <= most)
    kept = kept.filter(~typed) if habits_only else kept
    on = X.identity("context", F.col("condition"), F.col("behavior"))
    known = habits.filter("polarity = 1 and status = 'active'").select("user_id", on.alias("on")).distinct().withColumn("is_active", F.lit(True))
    seen = kept.withColumn("on", on).join(known, ["user_id", "on"], "left")
    own = F.exists("sources", lambda s: ~s.eqNullSafe(F.lit("advisor_finding")))
    explicit = (F.col("kind") == "correction") & (F.col("confidence_bp") >= 8500) & own & F.coalesce("is_active", F.lit(False))
    stage = F.when(explicit | F.col("repeated"), "reviewable").otherwise("collecting")
    return seen.withColumns({"explicit_correction": explicit, "evidence_stage": stage}).drop("on", "nth", "is_active")


def route(batches: DataFrame) -> DataFrame:
    """[D6] What happens to each batch of model output."""
    return batches.withColumn(
        "route",
        R.first_match(
            "legacy",
            (F.col("errors") > 0, "quarantine"),
            (F.col("key_conflicts") > 0, "pending_review"),
            (F.col("proposals") == 0, "coverage_only"),
            (F.col("typed") > 0, "typed"),
        ),
    )


def quarantined(outputs: DataFrame, longest: int = 20000) -> DataFrame:
    """[D8] Rejected output, redacted, bounded, identified by its content."""
    safe = F.substring(X.redact(F.col("output")), 1, longest)
    return outputs.select("user_id", safe.alias("output"), "reason", X.stable_id("quarantine", F.concat_ws("|", "user_id", safe)).alias("id")).dropDuplicates(["id"])


def activation(habits: DataFrame) -> DataFrame:
    """[D11, D12, D16, D17] Decision over ``repeated, law_ok, conflict_free, duplicate_free``, evidence first."""
    reason = R.first_match(
        None,
        (~F.col("duplicate_free"), "duplicate_resolution"),
        (~F.col("repeated"), "approved_pending_eligibility"),
        (~F.col("law_ok"), "approved_pending_law_blocked"),
        (~F.col("conflict_free"), "approved_pending_conflict"),
    )
    return habits.withColumn("review_status", F.coalesce(reason, F.lit("accepted_active"))).withColumn("status", F.when(reason.isNull(), "active").otherwise("candidate"))


def suppressed(habits: DataFrame, proposals: DataFrame, least_bp: int) -> DataFrame:
    """[D3] Active habits that a sure enough, reviewable old-negative proposal of no advisor contradicts go dormant."""
    against = proposals.filter((F.col("role") == "old_negative") & (F.col("evidence_stage") == "reviewable") & (F.col("confidence_bp") >= least_bp) & ~F.col("advisor"))
    hit = exact_corrections(against, habits).select(F.col("habit_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    joined = habits.join(hit, "id", "left")
    hit_now = F.coalesce("hit", F.lit(False)) & (F.col("status") == "active")
    return joined.withColumn("after", F.when(hit_now, "dormant").otherwise(F.col("status"))).drop("hit")


def status_moves(habits: DataFrame, requests: DataFrame) -> DataFrame:
    """[D9, D13, D22, R13] Requested moves that are allowed and whose checksum still is the row's.

    Only candidates are rejected, only active rows disabled, only disabled
    ones enabled; active and disabled rows can be archived.
    """
    allowed = (
        ((F.col("action") == "reject") & (F.col("status") == "candidate"))
        | ((F.col("action") == "disable") & (F.col("status") == "active"))
        | ((F.col("action") == "enable") & (F.col("status") == "disabled"))
        | ((F.col("action") == "archive") & F.col("status").isin("active", "disabled"))
    )
    to = R.first_match("archived", (F.col("action") == "disable", "disabled"), (F.col("action") == "enable", "active"))
    joined = habits.join(requests.withColumnRenamed("checksum", "expected"), "id")
    outcome = R.first_match("moved", (F.col("expected") != F.col("checksum"), "stale"), (~allowed, "not_allowed"))
    moved = joined.withColumn("outcome", outcome)
    return moved.withColumn("after", F.when(F.col("outcome") == "moved", to).otherwise(F.col("status")))


def duplicate_plan(relations: DataFrame) -> DataFrame:
    """[D14, A20] Survivor and fate of the other habit for each decided relation."""
    other = F.when(F.col("canonical_id") == F.col("id_a"), F.col("id_b")).otherwise(F.col("id_a"))
    survivor = F.when(F.col("action") == "supersede", other).otherwise(F.col("canonical_id"))
    loser = F.when(survivor == F.col("id_a"), F.col("id_b")).otherwise(F.col("id_a"))
    fate = R.first_match(None, (F.col("action").isin("merge", "supersede", "archive_duplicate"), "archived"))
    keeps = F.col("action") == "keep_separate"
    return relations.withColumns({"survivor": F.when(~keeps, survivor), "loser": F.when(~keeps, loser), "loser_status": fate, "merge_refs": F.col("action") == "merge"})


def last_survivors(plan: DataFrame) -> DataFrame:
    """[D14, A20] ``loser, survivor`` of decided pairs with chains followed to their end (a into b, b into c: a into c), and ``refused`` where they run in a circle.

    ``plan(loser, survivor)``; of several decisions over one loser that for
    the smallest survivor counts.  Pointers jump to where their targets point,
    so a chain of n takes log n rounds, each a join; a circle's never leave it.
    """
    first = materialize(plan.filter("loser is not null and survivor is not null").groupBy("loser").agg(F.min("survivor").alias("survivor")))
    pointers, n = first, first.count()
    for _ in range(max(1, n.bit_length())):
        to = pointers.select(F.col("loser").alias("survivor"), F.col("survivor").alias("next"))
        jumped = pointers.join(to, "survivor", "left")
        pointers, before = materialize(jumped.select("loser", F.coalesce("next", "survivor").alias("survivor"))), pointers
        if not pointers.join(before, ["loser", "survivor"], "left_anti").head(1):
            break
    inside = first.select(F.col("loser").alias("survivor"), F.lit(True).alias("refused"))
    return pointers.join(inside, "survivor", "left").select("loser", F.when(F.col("refused").isNull(), F.col("survivor")).alias("survivor"), F.coalesce("refused", F.lit(False)).alias("refused"))


def merged_chains(habits: DataFrame, evidence: DataFrame, plan: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """[D14, A20] ``habits(id, status, refs, ...)`` and ``evidence(habit_id, ...)`` after the merges of ``plan(loser, survivor)``.

    Losers are archived and name their last survivor, which takes over their
    evidence and, in order and up to ``most``, their references.  Habits of a
    refused circle stay as they are, and so do losers whose survivor is missing.
    """
    ends = last_survivors(plan).filter("not refused").select(F.col("loser").alias("id"), "survivor")
    ends = materialize(ends.join(habits.select(F.col("id").alias("survivor")), "survivor", "left_semi"))
    known = habits.join(ends, "id", "left")
    # Only the first references can stay, and each task already leaves the others out: a survivor may have any number of losers.
    ref = known.filter("survivor is not null").select(F.col("survivor").alias("id"), F.explode("refs").alias("ref")).distinct()
    nth = F.row_number().over(W.partitionBy("id").orderBy("ref"))
    given = ref.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("id").agg(F.collect_list("ref").alias("given"))
    refs = F.when(F.col("given").isNull(), F.col("refs")).otherwise(F.slice(F.array_sort(F.array_distinct(F.concat("refs", "given"))), 1, most))
    after = known.join(given, "id", "left").withColumns({"refs": refs, "status": F.when(F.col("survivor").isNull(), F.col("status")).otherwise("archived")})
    moved = evidence.join(ends.withColumnRenamed("id", "habit_id"), "habit_id", "left").withColumn("habit_id", F.coalesce("survivor", "habit_id"))
    return after.select(*habits.columns, F.col("survivor").alias("superseded_by")), moved.select(*evidence.columns)


def law_recheck(habits: DataFrame) -> DataFrame:
    """[D15] Active habits whose wording the law forbids are suppressed."""
    found = R.law_reasons(F.col("condition"), F.col("behavior"))
    seen = habits.withColumn("reasons", found)
    return seen.withColumn("after", F.when((F.col("status") == "active") & (F.size("reasons") > 0), "suppressed_by_law").otherwise(F.col("status")))


def explained(habits: DataFrame, evidence: DataFrame, hits: DataFrame, each: int = 20) -> DataFrame:
    """[J17, T10] A habit with its first evidence and its newest log rows."""
    from tracewell.operators.evidence import numbered_refs

    def folded(rows: DataFrame, newest: bool, name: str) -> DataFrame:
        kept = numbered_refs(rows, "habit_id", each, newest)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", "seq"))), lambda x: x["seq"])
        return kept.groupBy("habit_id").agg(listed.alias(name))

    out = habits.join(folded(evidence, False, "evidence"), "habit_id", "left")
    return out.join(folded(hits, True, "hits"), "habit_id", "left")


def review_items(pending: DataFrame, candidates: DataFrame) -> DataFrame:
    """[U2, U3, F14, D25, D26] Open reviews, then visible candidates, with their kind of row."""
    first = pending.filter("status = 'open' and kind != 'legacy_experience_migration'").withColumn("type", F.lit("pending_review"))
    second = candidates.filter("status = 'candidate'").filter(R.review_visible()).withColumn("type", F.lit("candidate"))
    return first.unionByName(second, allowMissingColumns=True)


def status_order() -> list[Column]:
    """[T8] Active rows first, newest first."""
    return [F.when(F.col("status") == "active", 0).otherwise(1), F.desc("updated_at"), F.col("id")]
