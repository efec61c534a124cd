"""The review decision log: overlays, overrides, states, versions, reversals, case keys, access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import skew
from tallyloom.session import cut_lineage

# Case statuses and the ones each may turn into.
TRANSITIONS = {
    "pending": ("in_review", "resolved", "superseded"),
    "in_review": ("awaiting_gestor_approval", "resolved", "conflicted"),
    "awaiting_gestor_approval": ("in_review", "resolved"),
    "resolved": ("reopened", "conflicted", "superseded"),
    "reopened": ("in_review", "resolved"),
    "conflicted": ("in_review", "resolved"),
}
LINKS = ("linked", "maintained_separate", "separated")
# Decision types by case type and action; a link takes the resolution if it is listed.
DECISIONS = {
    ("person_identity", "approve"): ("validated",), ("person_identity", "correct"): ("corrected",), ("person_identity", "link"): LINKS,
    ("author_identity", "approve"): ("validated",), ("author_identity", "correct"): ("corrected",), ("author_identity", "link"): LINKS,
    ("product", "approve"): ("validated",), ("product", "correct"): ("corrected",),
    ("project_director_relation", "approve"): ("validated",), ("project_director_relation", "correct"): ("corrected",), ("project_director_relation", "link"): LINKS,
    ("external_identity", "approve"): ("validated",), ("external_identity", "correct"): ("corrected",), ("external_identity", "link"): LINKS,
    ("possible_duplicate", "link"): ("merged", "maintained_separate", "separated"),
}
# Fields a decision writes besides the status, by case type.
DECISION_FIELDS = {
    "person_identity": ("canonical_identity_key", "canonical_name"), "author_identity": ("author_identity_key", "canonical_name"), "product": ("product_title",),
    "project_director_relation": ("project_director_identity_key", "project_director_relationship_status"), "external_identity": ("external_identity_key", "external_institution"),
    "possible_duplicate": (),
}
SCOPED_ACTIONS = ("apply_scientific", "revert_scientific", "view_audit", "view_foundations")
# Actions of the persisted capabilities.
CAPABILITY_ACTIONS = {
    "research_manager": ("apply_scientific", "propose_scientific", "revert_scientific", "view_audit", "view_foundations"),
    "system_admin": ("manage_technical_access", "view_audit", "view_foundations"),
}


def effective_overlay(cases: DataFrame) -> DataFrame:
    """Overlay of each target: only when exactly one active case has an approved, locked, well-formed decision; else none."""
    active = cases.filter("case_status <> 'superseded'")
    per = active.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("cases"), F.min("scientific_status").alias("scientific_status"), F.min("identity_key").alias("identity_key"),
        F.bool_and(F.col("approved") & F.col("locked") & F.col("snapshot_matches") & F.col("scientific_status").isNotNull()).alias("_ok"))
    state = F.when(F.col("cases") > 1, "ambiguous").when(~F.col("_ok"), "not_materialized").otherwise("effective")
    ok = state == "effective"
    return per.select("target_id", state.alias("overlay_state"), F.when(ok, F.col("scientific_status")).alias("scientific_status"), F.when(ok, F.col("identity_key")).alias("identity_key"))


def in_context(scope: str = "scope") -> Column:
    """Whether an override applies to a row, by its scope."""
    s = F.col(scope)
    return (
        F.when(s == "record", F.col("o_record").eqNullSafe(F.col("record_id"))).when(s == "document", F.col("o_document").eqNullSafe(F.col("document_id")))
        .when(s == "period", F.col("o_period").eqNullSafe(F.col("period_id"))).when(s == "relationship", F.col("o_relation").eqNullSafe(F.col("relation_key")))
        .when(s == "global_identity", F.lit(True)).otherwise(F.lit(False)))


def materialization(active: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per decision: whether its active override rows equal its snapshot (same contexts, once each, same values)."""
    keys = ["decision_id", "context"]
    a = active.groupBy(*keys).agg(F.count(F.lit(1)).alias("_an"), F.min("value").alias("_av"))
    s = snapshot.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sn"), F.min("value").alias("_sv"))
    same = (F.col("_an") == 1) & (F.col("_sn") == 1) & F.col("_av").eqNullSafe(F.col("_sv"))
    return a.join(s, keys, "full").groupBy("decision_id").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("materialized"), F.count(F.lit(1)).alias("contexts"))


def supersede(rows: DataFrame, context: list[str], order: str, slice_of: Column | None = None) -> DataFrame:
    """Override rows with ``superseded_by`` (the next row of the context) and ``is_active`` (the last one)."""
    after = skew.previous(rows, context, [-F.col(order)], slice_of, F.col(order), "superseded_by")
    return after.withColumn("is_active", F.col("superseded_by").isNull())


def derive_decisions(commands: DataFrame) -> DataFrame:
    """Adds the decision type of (case_type, action, resolution), or why there is none."""
    types = F.create_map(*[x for (case, action), v in DECISIONS.items() for x in (F.lit(f"{case}|{action}"), F.array(*map(F.lit, v)))])
    allowed = F.element_at(types, F.concat_ws("|", "case_type", "action"))
    link = F.col("action") == "link"
    kind = F.when(allowed.isNull(), F.lit(None)).when(~link & F.col("resolution").isNull(), F.get(allowed, F.lit(0))).when(
        link & F.array_contains(allowed, F.col("resolution")), F.col("resolution"))
    reason = F.when(allowed.isNull(), "action incompatible with case type").when(~link & F.col("resolution").isNotNull(), "resolution incompatible with action").when(
        link & F.col("resolution").isNull(), "link needs a resolution").when(link & ~F.coalesce(F.array_contains(allowed, F.col("resolution")), F.lit(False)), "resolution incompatible with case type")
    return commands.withColumn("decision_type", kind).withColumn("reject_reason", reason)


def reason_required(action: Column, decision_type: Column, normalized: Column, final: Column) -> Column:
    return (action != "approve") | decision_type.isin("merged", "maintained_separate", "separated") | ~normalized.eqNullSafe(final)


def transition_errors(log: DataFrame, slice_of: Column | None) -> DataFrame:
    """Steps of a case that its state machine does not allow."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, targets in TRANSITIONS.items() for b in targets])
    steps = skew.previous(log, ["case_id"], [F.col("seq")], slice_of, F.col("case_status"), "previous_status")
    return steps.filter(F.col("previous_status").isNotNull() & ~F.array_contains(pairs, F.concat_ws(">", "previous_status", "case_status"))).select(
        "case_id", "seq", "previous_status", "case_status")


def fold_versions(log: DataFrame, slice_of: Column | None) -> DataFrame:
    """Adds ``outcome``: an event is applied when the version it expects is the version of its case then.

    A case starts at version 1 and every applied event adds one. So after the first event that expects
    1, the next applied event is the first later one that expects 2, and so on. Each event points to
    the event that would follow it; the ones reached from the first are found by doubling the pointers,
    in as many rounds as the logarithm of the longest chain.
    """
    keys = ["case_id", "version"]
    asks = log.select("case_id", "seq", F.col("expected_version").alias("version"), F.col("seq").alias("target"))
    looks = log.select("case_id", "seq", (F.col("expected_version") + 1).alias("version"), F.lit(None).cast("int").alias("target"))
    events = asks.withColumn("asks", F.lit(True)).unionByName(looks.withColumn("asks", F.lit(False)))
    # walking backwards, the least sequence seen so far among the events that ask for the version
    nearest = skew.running(events, keys, [-F.col("seq"), F.col("asks").cast("int")], slice_of, F.col("target"), "next_seq", how=F.min)
    jump = cut_lineage(nearest.filter("NOT asks AND next_seq IS NOT NULL").select("case_id", "seq", "next_seq"))
    first = log.filter("expected_version = 1").groupBy("case_id").agg(F.min("seq").alias("seq"))
    reached = cut_lineage(first)
    while True:
        more = reached.join(jump, ["case_id", "seq"]).select("case_id", F.col("next_seq").alias("seq"))
        grown = cut_lineage(reached.union(more).distinct())
        if grown.count() == reached.count():
            break
        hop = jump.select("case_id", F.col("seq").alias("next_seq"), F.col("next_seq").alias("far"))
        reached, jump = grown, cut_lineage(jump.join(hop, ["case_id", "next_seq"]).select("case_id", "seq", F.col("far").alias("next_seq")))
    return log.join(reached.withColumn("_in", F.lit(True)), ["case_id", "seq"], "left").withColumn(
        "outcome", F.when(F.col("_in"), "applied").otherwise("conflict")).drop("_in")


def restore_values(log: DataFrame) -> DataFrame:
    """Adds ``effective_value``: a reversal restores the state before the decision it reverts, through chains of reversals."""
    own = log.select("case_id", "seq", F.when(F.col("reverts_seq").isNull(), F.col("seq")).otherwise(F.col("reverts_seq") - 1).alias("source"))
    sources = cut_lineage(own)
    while True:
        hop = sources.select("case_id", F.col("seq").alias("source"), F.col("source").alias("next"))
        moved = cut_lineage(sources.join(hop, ["case_id", "source"], "left").select(
            "case_id", "seq", F.coalesce("next", "source").alias("source"), (F.coalesce("next", "source") != F.col("source")).alias("moved")))
        sources = moved.select("case_id", "seq", "source")
        if not moved.filter("moved").limit(1).count():
            break
    values = log.select("case_id", F.col("seq").alias("source"), F.col("value").alias("effective_value"))
    return log.join(sources, ["case_id", "seq"]).join(values, ["case_id", "source"], "left")


def sequence_errors(log: DataFrame, slice_of: Column | None) -> DataFrame:
    """Decisions whose number does not follow the one before in their case."""
    steps = skew.previous(log, ["case_id"], [F.col("seq")], slice_of, F.col("seq"), "previous_seq")
    return steps.filter(F.col("seq") != F.coalesce(F.col("previous_seq"), F.lit(0)) + 1).select("case_id", "seq", "previous_seq")


def reversal_eligibility(log: DataFrame) -> DataFrame:
    """Why a reversal may not be restored; null when it may."""
    target = log.select("case_id", F.col("seq").alias("reverts_seq"), F.col("action").alias("_action"))
    done = log.filter("reverts_seq IS NOT NULL").groupBy("case_id", "reverts_seq").agg(F.min("seq").alias("_first"))
    rows = log.filter("action = 'revert'").join(target, ["case_id", "reverts_seq"], "left").join(done, ["case_id", "reverts_seq"], "left")
    reason = (
        F.when(F.col("reverts_seq").isNull(), "no target").when(F.col("_action").isNull(), "unknown target").when(F.col("reverts_seq") >= F.col("seq"), "target is later")
        .when(F.col("_first") < F.col("seq"), "already reverted").when(F.col("_action") == "revert", "target is a reversal"))
    return rows.select("case_id", "seq", "reverts_seq", reason.alias("reason"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object text with keys in order, strings escaped, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def stable_target_key(case_type: Column, locator: dict[str, Column], version: str = "b2b:v1") -> Column:
    return F.concat(F.lit(f"{version}:"), case_type, F.lit(":"), F.sha2(canonical_json({**locator, "case_type": case_type}), 256))


def decision_overrides(decisions: DataFrame) -> DataFrame:
    """One row per field a decision writes; a status is never global."""
    fields = F.create_map(*[x for case, names in DECISION_FIELDS.items() for x in (F.lit(case), F.array(*map(F.lit, names)).cast("array<string>"))])
    named = F.concat(F.coalesce(F.element_at(fields, F.col("case_type")), F.array().cast("array<string>")), F.array(F.lit("scientific_status")))
    rows = decisions.withColumn("field_path", F.explode(named))
    status = F.col("field_path") == "scientific_status"
    return rows.withColumn("field_scope", F.when(status & (F.col("scope") == "global_identity"), "record").otherwise(F.col("scope"))).withColumn(
        "value", F.when(status, F.when(F.col("decision_type") == "discarded", "discarded").otherwise("validated")).otherwise(F.col("payload_value")))


def merge_overrides(current: DataFrame, replacements: DataFrame, context: list[str]) -> DataFrame:
    """Current overrides whose context is not replaced, plus the replacements."""
    c, r = current.alias("c"), replacements.select(*context).distinct().alias("r")
    on = F.lit(True)
    for k in context:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}"))
    return c.join(r, on, "left_anti").unionByName(replacements)


def duplicate_resolution(cases: DataFrame) -> DataFrame:
    """Identity of a duplicate case: merged takes the counterpart's, maintained keeps its own if they differ, separated derives a new one when shared."""
    same = F.col("own_key") == F.col("counterpart_key")
    fresh = F.concat(F.lit("human:separated:"), F.sha2("target_key", 256))
    complete = F.col("own_key").isNotNull() & F.col("counterpart_key").isNotNull()
    key = (
        F.when(~complete, F.lit(None)).when(F.col("decision_type") == "merged", F.col("counterpart_key"))
        .when((F.col("decision_type") == "maintained_separate") & ~same, F.col("own_key")).when(F.col("decision_type") == "separated", F.when(same, fresh).otherwise(F.col("own_key"))))
    reason = F.when(~complete, "two identities needed").when((F.col("decision_type") == "maintained_separate") & same, "identities must differ")
    return cases.withColumn("result_key", key).withColumn("reject_reason", reason)


def command_outcome() -> Column:
    """Whether a command may run: same version and decision, case open, status pending."""
    return (
        F.when(F.col("expected_version") != F.col("version"), "version_conflict").when(~F.col("expected_decision").eqNullSafe(F.col("current_decision")), "decision_conflict")
        .when(~F.col("case_status").isin("pending", "reopened"), "incompatible_state").when(F.col("scientific_status") != "pending", "incompatible_status").otherwise("accepted"))


def classify_assignments(plan: DataFrame, users: DataFrame, active: DataFrame) -> DataFrame:
    """Action and reason for each planned capability assignment."""
    held = active.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.min("capability").alias("_held"))
    joined = plan.join(users.select("user_id", F.col("email").alias("_email"), "is_active", "role"), "user_id", "left").join(held, "user_id", "left")
    row = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(F.col("role").isNull(), row("conflict", "user_not_found")).when(F.col("_email") != F.col("email"), row("conflict", "email_mismatch"))
        .when(~F.col("is_active"), row("conflict", "user_inactive")).when(F.col("role") == "career_manager", row("conflict", "career_manager_denied"))
        .when(F.col("_n").isNull(), row("insert", "eligible_for_insert")).when(F.col("_n") != 1, row("conflict", "conflicting_active_assignments"))
        .when(~F.col("_held").isin(*CAPABILITY_ACTIONS), row("conflict", "active_capability_invalid"))
        .when(F.col("_held") == F.col("capability"), row("unchanged", "active_assignment_matches")).otherwise(row("conflict", "different_active_capability")))
    return joined.select("user_id", "capability", verdict.alias("v")).select("user_id", "capability", "v.*")


def effective_actions(users: DataFrame, active: DataFrame) -> DataFrame:
    """Sorted actions of each user: scoped role actions, plus those of the one capability held."""
    held = active.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.min("capability").alias("_c")).filter("_n = 1")
    joined = users.join(held, "user_id", "left")
    scoped = F.col("is_active") & (((F.col("role") == "faculty_admin") & F.col("faculty_id").isNotNull()) | ((F.col("role") == "career_manager") & F.col("career_id").isNotNull()))
    none = F.array().cast("array<string>")
    extra = F.element_at(F.create_map(*[x for k, v in CAPABILITY_ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("_c"))
    usable = scoped & (F.col("role") != "career_manager")
    actions = F.array_union(F.when(scoped, F.array(*map(F.lit, SCOPED_ACTIONS))).otherwise(none), F.when(usable, F.coalesce(extra, none)).otherwise(none))
    return joined.select("user_id", F.array_sort(actions).alias("actions"))


def first_owner(plan: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first decision in plan order owns an identity or alias."""
    return skew.pick(plan, keys, F.col(position), last=False)


# The payload each decision on a possible duplicate carries, and the cases whose decisions carry an identity.
DUPLICATE_PAYLOADS = {"merged": "identity_merge", "maintained_separate": "maintain_separate", "separated": "identity_separation", "discarded": "field_override"}
IDENTITY_CASES = ("person_identity", "author_identity", "external_identity")


def payload_fits_case(case_type: Column, decision_type: Column, kind: Column) -> Column:
    """Whether the kind of a payload is the one its case and decision call for."""
    of_duplicate = F.coalesce(*[F.when(decision_type == d, F.lit(k)) for d, k in DUPLICATE_PAYLOADS.items()])
    of_identity = F.when(decision_type == "discarded", "field_override").otherwise("identity")
    wanted = F.when(decision_type == "reverted", "decision_reversal").when(case_type == "possible_duplicate", of_duplicate)
    wanted = wanted.when(case_type.isin(*IDENTITY_CASES), of_identity).otherwise("field_override")
    return F.coalesce(kind == wanted, F.lit(False))


def payload_fits_snapshot(target: Column, payload: Column, snapshot: Column) -> Column:
    """Whether what a payload decides is what the snapshot after it shows, by kind.

    ``payload``: kind, identity_key, identity_name, identity_type, members (targets), assignments (target_key, identity_key,
    name), and of an override target_key, field, scope, value, context. ``snapshot``: identity (key, name, type; or null) and
    overrides (target_key, field, scope, value, context), which a null list has none of.
    """
    kind, identity = payload["kind"], snapshot["identity"]
    same = lambda a, b: a.eqNullSafe(b)
    whole = same(payload["identity_key"], identity["key"]) & same(payload["identity_name"], identity["name"]) & same(payload["identity_type"], identity["type"])
    merged = F.array_contains(payload["members"], target) & same(payload["identity_key"], identity["key"])
    own = F.filter(payload["assignments"], lambda a: a["target_key"] == target)
    first, last = F.get(own, F.lit(0)), F.element_at(F.when(F.size(own) > 0, own), -1)
    split = first.isNotNull() & same(first["identity_key"], identity["key"]) & same(first["name"], identity["name"])
    apart = last.isNotNull() & same(last["identity_key"], identity["key"])
    shown = F.exists(snapshot["overrides"], lambda o: same(o["field"], payload["field"]) & same(o["scope"], payload["scope"]) & same(o["value"], payload["value"])
                     & same(o["target_key"], F.coalesce(payload["target_key"], target)) & same(o["context"], payload["context"]))
    rules = {"identity": whole, "identity_merge": merged, "identity_separation": split, "maintain_separate": apart}
    verdict = F.when(kind == "decision_reversal", F.lit(True)).when(kind == "field_override", F.coalesce(shown, F.lit(False)))
    for name, rule in rules.items():
        verdict = verdict.when(kind == name, identity.isNotNull() & F.coalesce(rule, F.lit(False)))
    return F.coalesce(verdict, F.lit(False))
