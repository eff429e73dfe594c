"""Named queries over one scale-factor folder, wired from the library plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from accessloom.functions import text
from accessloom.operators import correlate as corr
from accessloom.operators import buckets, fuzzy, graph, keys, mentions, merge, quality, sheets
from accessloom.plans import campaign, evaluate, findings, ingest, lifecycle, roster, snapshot, triage
from accessloom.session import cut_by_slices, cut_lineage, prepare, released, shared_folder
from accessloom.sources import files, fixtures as fx
from accessloom.sources.fixtures import Fixtures


def _as_of() -> Column:
    return F.lit(fx.AS_OF).cast("timestamp")


def _graph(f: Fixtures) -> findings.Graph:
    return findings.Graph(f.identities(), f.accounts(), f.applications(), f.entitlements(), f.grants())


def _roster_records(f: Fixtures) -> DataFrame:
    return roster.standardise_roster(f.roster_raw(), fx.CORPORATE_DOMAIN)


def _people(f: Fixtures) -> ingest.Directory:
    """The standardised roster as a published snapshot, which every account feed correlates against."""
    records = cut_lineage(_roster_records(f))
    return ingest.Directory(
        roster.identities(records), roster.aliases(records), corr.CorrelationPolicy(fx.CORPORATE_DOMAINS))


def _text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def _ratio(column: str) -> Column:
    return F.round(column, 6).alias(column)


# ---- roster -------------------------------------------------------------------------------


def standardise_roster(f: Fixtures) -> DataFrame:
    return _roster_records(f).select(
        "source_line", "canonical_employee_id", "norm_id", "norm_name", "email", "email_localpart", _text("hire_date"),
        "hire_date_error", _text("termination_date"), "lifecycle_status", "manager_employee_id", "stage", "reason_code",
        "quarantine_status", F.coalesce(F.col("status_date_conflict").cast("int"), F.lit(0)).alias("status_date_conflict"))


def reconcile_roster(f: Fixtures) -> DataFrame:
    return quality.reconcile(_roster_records(f))


def roster_collisions(f: Fixtures) -> DataFrame:
    return roster.roster_collisions(f.roster_raw(), fx.CORPORATE_DOMAIN).select(
        "norm_id", "source_line", "group_index", "group_size", "emails", "names", F.col("resolvable").cast("int").alias("resolvable"))


def manager_link(f: Fixtures) -> DataFrame:
    return roster.identities(_roster_records(f)).select("identity_id", "manager_id", "source_line")


def roster_aliases(f: Fixtures) -> DataFrame:
    return roster.aliases(_roster_records(f))


def roster_quarantine(f: Fixtures) -> DataFrame:
    return roster.quarantine(_roster_records(f)).select("source_line", "reason_code", "status", "candidate_ids", "resolved_by")


def status_date_conflict(f: Fixtures) -> DataFrame:
    return roster.status_date_conflicts(roster.identities(_roster_records(f))).select(
        "identity_id", "name", _text("termination_date"), "lifecycle_status")


# ---- account feeds ------------------------------------------------------------------------


def _cloud(f: Fixtures) -> ingest.Ingest:
    return ingest.ingest_cloud_directory(f.cloud_raw(), _people(f))


def correlate_accounts(f: Fixtures) -> DataFrame:
    return _cloud(f).records.select(
        "source_line", "native_id", "decision", "best_score", "runner_up_score", "owner_identity_id", "ownership_status",
        F.col("enabled").cast("int").alias("enabled"),
        F.date_format("last_activity_at", "yyyy-MM-dd HH:mm:ss").alias("last_activity"), "stage", "reason_code",
        F.array_join("candidate_ids", ",").alias("candidate_ids"))


def reconcile_cloud(f: Fixtures) -> DataFrame:
    return quality.reconcile(_cloud(f).records)


def correlation_decisions(f: Fixtures) -> DataFrame:
    """Every shown candidate of the cloud directory with its score and rule."""
    records = _cloud(f).records
    return records.select(
        "source_line", "decision", F.posexplode("candidates").alias("position", "c")).select(
        "source_line", "decision", "position", F.col("c.identity_id").alias("identity_id"),
        F.col("c.score").alias("score"), F.col("c.rule").alias("rule"))


def _directory(f: Fixtures) -> ingest.Ingest:
    return ingest.ingest_directory(f.directory_raw(), _people(f))


def directory_classify(f: Fixtures) -> DataFrame:
    return _directory(f).records.select(
        "source_line", "native_id", "decision", "account_type", "owner_identity_id", "ownership_status",
        F.date_format("last_activity_at", "yyyy-MM-dd HH:mm:ss").alias("last_activity"), "stage", "reason_code")


def directory_accounts(f: Fixtures) -> DataFrame:
    return _directory(f).accounts.select(
        "native_id", "username", "account_type", "owner_identity_id", "ownership_status", "source_line")


def directory_grants(f: Fixtures) -> DataFrame:
    return _directory(f).grants.select("account_native_id", "entitlement_native_id")


def text_owner_mention(f: Fixtures) -> DataFrame:
    people = roster.identities(cut_lineage(_roster_records(f)))
    return mentions.first_mentioned(f.directory_raw().select(F.col("description").alias("text")), people)


def ingest_entitlements(f: Fixtures) -> DataFrame:
    return _directory(f).entitlements.select("application", "native_id", "name", "type", F.col("privileged").cast("int").alias("privileged"))


def ingest_twice(f: Fixtures) -> DataFrame:
    """Rows known after one load of the directory and after a second load of the same feed."""
    def stored(state: snapshot.State) -> snapshot.State:
        return snapshot.State(**{k: cut_lineage(v) for k, v in vars(state).items() if v is not None})

    feed, people = f.directory_raw(), _people(f)
    first = stored(snapshot.next_state(None, ingest.ingest_directory(feed, people), "directory"))
    second = snapshot.next_state(first, ingest.ingest_directory(feed, people), "directory")

    def counts(state: snapshot.State, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            df.agg(F.count("*").alias(name)).withColumn("part", F.lit(part)) for part, df in vars(state).items()])

    return counts(first, "first_load").join(counts(second, "second_load"), "part")


def ingest_next(f: Fixtures) -> DataFrame:
    """CRM accounts after a load of two thirds of the rows and one of another two thirds with enabled turned round."""
    feed, people, o = f.crm_raw(), _people(f), F.col("source_line") - 2
    changed = feed.filter(o % 3 != 1).withColumn("is_active", F.when(F.lower("is_active") == "true", "false").otherwise("true"))
    first = snapshot.next_state(None, ingest.ingest_crm(feed.filter(o % 3 != 0), people, fx.CORPORATE_DOMAIN), "crm")
    second = snapshot.next_state(first, ingest.ingest_crm(changed, people, fx.CORPORATE_DOMAIN), "crm")
    return second.accounts.select("native_id", F.col("enabled").cast("int").alias("enabled"), "source_line")


def crm_accounts(f: Fixtures) -> DataFrame:
    return ingest.ingest_crm(f.crm_raw(), _people(f), fx.CORPORATE_DOMAIN).records.select(
        "source_line", "native_id", "decision", "best_score", "owner_identity_id", "ownership_status",
        F.col("enabled").cast("int").alias("enabled"), "stage", "reason_code")


def crm_grants(f: Fixtures) -> DataFrame:
    return ingest.crm_access(f.crm_raw()).select(
        "account_native_id", "entitlement_native_id", "type", F.col("privileged").cast("int").alias("privileged")).distinct()


def iam_unique_owner(f: Fixtures) -> DataFrame:
    return ingest.ingest_cloud_iam(f.iam_users_raw(), f.iam_roles_raw(), _people(f)).records.select(
        "native_id", "username", "owner_identity_id", "account_type", "oldest_key_days", "holders", "stage", "reason_code")


def iam_role_edges(f: Fixtures) -> DataFrame:
    return ingest.role_edges(f.iam_roles_raw())


def iam_role_privilege(f: Fixtures) -> DataFrame:
    return f.iam_roles_raw().select(
        "role_name", F.exists("attached_policies", lambda p: p.isin(*ingest.ADMIN_POLICIES)).cast("int").alias("privileged"))


def sheet_header_detect(f: Fixtures) -> DataFrame:
    return sheets.detect_headers(f.cells_raw().unionByName(f.header_cells()))


def sheet_primary(f: Fixtures) -> DataFrame:
    return sheets.elect_primary(sheets.sheet_layout(f.cells_raw())).select(
        "sheet", "header_row", _text("max_date"), F.col("is_primary").cast("int").alias("is_primary"))


def sheet_name_match(f: Fixtures) -> DataFrame:
    return ingest.ingest_spreadsheet(f.cells_raw(), _people(f), fx.CONTEXT_DEPARTMENT).records.select(
        "sheet", "source_line", "raw_name", "role", "identity_id", "match_rule", "stage", "reason_code")


def fuzzy_name_match(f: Fixtures) -> DataFrame:
    """Every roster name against every cloud display name at 90 or more."""
    known = f.roster_raw().select(text.sort_tokens(text.normalize_name(F.col("full_name"))).alias("name"))
    asked = f.cloud_raw().select(text.sort_tokens(text.normalize_name(F.col("displayName"))).alias("name"))
    return fuzzy.similar_names(cut_lineage(asked), cut_lineage(known)).select("probe_name", "index_name", _ratio("ratio"))


def fuzzy_long_names(f: Fixtures) -> DataFrame:
    """Names followed by another person's, over 25 characters, on both sides at 90 or more."""
    second = fx.full_name(F.expr("(source_line - 2) div 8"))

    def named(feed: DataFrame, name: str) -> DataFrame:
        return feed.select(text.normalize_name(F.concat_ws(" ", F.col(name), second)).alias("name"))

    return fuzzy.similar_names(
        cut_lineage(named(f.cloud_raw(), "displayName")), cut_lineage(named(f.roster_raw(), "full_name"))).select(
        "probe_name", "index_name", _ratio("ratio"))


# ---- merges -------------------------------------------------------------------------------


def source_upsert(f: Fixtures) -> DataFrame:
    old, new = f.snapshots()
    return merge.merge_source_records(old, new).select("source_sheet", "source_line", "raw_hash", "run_id")


def quarantine_merge(f: Fixtures) -> DataFrame:
    old, new = f.quarantine_history()
    return merge.merge_quarantine(old, new, ["source_sheet", "source_line", "reason_code"])


def record_outcomes(f: Fixtures) -> DataFrame:
    old, _ = f.quarantine_history()
    o = F.col("o_orderkey")
    records = f.table("orders").select(F.when(o % 4 == 0, "sheet").alias("source_sheet"), (o + 2).alias("source_line"))
    return merge.record_outcomes(records, old, ["source_sheet", "source_line"])


def account_snapshot(f: Fixtures) -> DataFrame:
    """Accounts of the directory feed upserted over those of the CRM feed by owner handle."""
    old = f.crm_raw().select(text.email_local(F.col("email")).alias("native_id"), F.col("profile").alias("origin"), "source_line")
    new = f.directory_raw().select(F.lower("samAccountName").alias("native_id"), F.col("description").alias("origin"), "source_line")
    latest = merge.upsert(None, old, ["native_id"], [F.col("source_line")])
    return merge.upsert(latest, new, ["native_id"], [F.col("source_line")])


def account_snapshot_bucketed(f: Fixtures) -> DataFrame:
    """The accounts of ``account_snapshot``, kept in buckets of which the second load rewrites those it touches."""
    old = f.crm_raw().select(text.email_local(F.col("email")).alias("native_id"), F.col("profile").alias("origin"), "source_line")
    new = f.directory_raw().select(F.lower("samAccountName").alias("native_id"), F.col("description").alias("origin"), "source_line")
    table = buckets.BucketedSnapshot(f.spark, f"{shared_folder(f.spark).rstrip('/')}/accounts-{uuid.uuid4().hex}", ("native_id",), 32)
    table.create(old, [F.col("source_line")])
    table.upsert(new, [F.col("source_line")])
    return table.read().select("native_id", "origin", "source_line")


def application_keys(f: Fixtures) -> DataFrame:
    """Ids of brands as applications after a load of some parts and one of all: those known keep theirs."""
    def load(parts: DataFrame) -> DataFrame:
        return parts.select(F.col("p_brand").alias("application"), F.lit("parts").alias("source_system"))

    part = f.table("part")
    first = cut_lineage(keys.get_or_create(None, load(part.filter(F.substring("p_brand", 7, 1) < "4")), ("application",), "application_id"))
    second = cut_lineage(keys.get_or_create(first, load(part), ("application",), "application_id"))
    before = first.select("application", F.col("application_id").alias("before"))
    total = second.agg(F.countDistinct("application_id"), F.max("application_id")).first()
    return second.join(before, "application", "left").select(
        "application", F.col("before").isNotNull().cast("int").alias("known"),
        F.coalesce(F.col("before") == F.col("application_id"), F.lit(True)).cast("int").alias("same_id"),
        F.lit(int(total[0] == total[1])).alias("gapless"))


# ---- graph --------------------------------------------------------------------------------


def _access(f: Fixtures) -> DataFrame:
    return graph.effective_access(f.accounts(), f.grants(), f.entitlements(), f.edges())


def entitlement_closure(f: Fixtures) -> DataFrame:
    return graph.reachable(f.entitlements(), f.edges()).select(
        "root_id", "node_id", "depth", graph.path_text(F.col("path")).alias("path"))


def effective_access(f: Fixtures) -> DataFrame:
    return _access(f).select(
        "identity_id", "account_id", "application", "granted_id", "entitlement_id", "entitlement_type",
        F.col("privileged").cast("int").alias("privileged"), "grant_type", "depth",
        graph.path_text(F.col("path_names")).alias("path"))


def access_after_change(f: Fixtures) -> DataFrame:
    """Effective access after edges and grants changed, from the closure and access before the change."""
    shown = ["identity_id", "account_id", "granted_id", "entitlement_id", "grant_type", "depth"]
    closure = released(graph.reachable)(f.entitlements(), f.edges())
    access = cut_by_slices(
        lambda grants, reached: graph.effective_access(
            f.accounts(), grants, f.entitlements(), f.edges(),
            closure=reached.withColumnRenamed("entitlement_id", "root_id")).select(*shown, "path_names"),
        f.stored_grants(), closure.withColumnRenamed("root_id", "entitlement_id"), by="entitlement_id")
    after = graph.after_change(
        closure, access, f.accounts(), f.entitlements(), f.stored_grants(), f.changed_grants(), f.edges(), f.changed_edges())
    return after.access.select(*shown, graph.path_text(F.col("path_names")).alias("path"))


def why_entitlement(f: Fixtures) -> DataFrame:
    return triage.why(f.accounts(), f.grants(), f.entitlements(), f.edges(), "promo")


def identity_360(f: Fixtures) -> DataFrame:
    return triage.identity_360(f.identities(), f.accounts(), f.grants(), f.entitlements(), f.edges(), "alber")


def reviewer_routing(f: Fixtures) -> DataFrame:
    return graph.route_reviewers(f.identities()).select("identity_id", _text("reviewer_id"), "reviewer_route")


# ---- findings -----------------------------------------------------------------------------


def _account_rule(rule: str) -> Callable[[Fixtures], DataFrame]:
    def query(f: Fixtures) -> DataFrame:
        return findings.account_findings(
            findings.account_facts(_graph(f), rule in findings.OWNER_RULES), _as_of(), rules=(rule,))

    return query


def finding_peer_outlier(f: Fixtures) -> DataFrame:
    return findings.peer_outliers(_graph(f)).select(
        "subject_id", "entitlement_id", "severity", "risk_score", "holders_in_cohort", "cohort_size", _ratio("prevalence"),
        "explanation")


def finding_sod(f: Fixtures) -> DataFrame:
    return findings.sod_conflicts(_graph(f), fx.SOD_PAIRS).drop("pair")


def finding_missing_manager(f: Fixtures) -> DataFrame:
    return findings.missing_managers(_graph(f), fx.EXECUTIVE_DEPARTMENT)


def _findings(f: Fixtures) -> DataFrame:
    found = findings.all_findings(_graph(f), _as_of(), fx.SOD_PAIRS, fx.EXECUTIVE_DEPARTMENT)
    return findings.with_disposition(found, f.dispositions(), F.lit(fx.AS_OF).cast("timestamp_ntz"))


def findings_with_disposition(f: Fixtures) -> DataFrame:
    return _findings(f).select(
        "finding_key", "rule_code", "subject_type", "subject_id", "severity", "risk_score", *findings.TERM_COLUMNS, "status")


def findings_top(f: Fixtures) -> DataFrame:
    return findings.top_findings(_findings(f), 20).select("finding_key", "risk_score", "severity", "explanation")


def findings_by_rule(f: Fixtures) -> DataFrame:
    return findings.findings_by_rule(_findings(f))


def _findings_history(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    """An older finding table and the current one: the older lacks some, has others in other state and some that are gone."""
    current = cut_lineage(_findings(f)).select("finding_key", "rule_code", "risk_score", "status")
    age = F.pmod(F.ascii(F.substring("finding_key", -1, 1)), F.lit(4))
    older = current.filter(age != 0).withColumns({
        "risk_score": F.lit(1), "status": F.when(age == 1, "resolved").otherwise("open")})
    gone = f.table("customer").select(
        F.concat(F.lit("GONE:identity:"), F.col("c_custkey").cast("string")).alias("finding_key"), F.lit("GONE").alias("rule_code"),
        F.lit(2).alias("risk_score"), F.when(F.col("c_custkey") % 2 == 0, "open").otherwise("accepted").alias("status"))
    return older.unionByName(gone), current


def findings_upsert(f: Fixtures) -> DataFrame:
    old, new = _findings_history(f)
    return findings.upsert_findings(old, new)


def findings_upsert_resolved(f: Fixtures) -> DataFrame:
    old, new = _findings_history(f)
    return findings.upsert_findings(old, new, resolve_vanished=True)


def disposition_active(f: Fixtures) -> DataFrame:
    return findings.active_dispositions(f.dispositions(), F.lit(fx.AS_OF).cast("timestamp_ntz"))


# ---- lifecycle ----------------------------------------------------------------------------


def birthright(f: Fixtures) -> DataFrame:
    held = cut_lineage(lifecycle.held_entitlements(f.accounts(), f.grants()))
    return lifecycle.birthright(f.identities(), held).select("identity_id", "entitlement_id", _ratio("prevalence"))


def joiner_plan(f: Fixtures) -> DataFrame:
    return lifecycle.joiner_plan(
        f.identities(), f.accounts(), f.stored_grants(), f.entitlements(), f.provisioning_failures()).select(
        "identity_id", "entitlement_id", "application", "decision", "account_step", "grant_step", _text("account_id"),
        "rationale")


def mover_delta(f: Fixtures) -> DataFrame:
    return lifecycle.mover_delta(f.identities(), f.accounts(), f.grants()).select(
        "identity_id", "entitlement_id", "action", _text("account_id"))


def _joined(f: Fixtures) -> lifecycle.ChangeResult:
    return lifecycle.run_joiners(
        f.change_triggers("joiner"), f.identities(), f.accounts(), f.stored_grants(), f.entitlements(), f.provisioning_failures())


def joiner_runs(f: Fixtures) -> DataFrame:
    return _joined(f).runs


def joiner_audit(f: Fixtures) -> DataFrame:
    return _joined(f).audit.select("action", "object_id", "reason", "correlation_id")


def joiner_replay(f: Fixtures) -> DataFrame:
    """Requests left for a second attempt: those of runs that could not be applied, and of dry runs."""
    first = _joined(f)
    again = lifecycle.run_joiners(
        f.change_triggers("joiner"), f.identities(), f.accounts(), f.stored_grants(), f.entitlements(), f.provisioning_failures(),
        cut_lineage(first.steps))
    return again.requests.select("idempotency_key", "entitlement_id", "decision", "policy")


def _moved(f: Fixtures) -> lifecycle.ChangeResult:
    return lifecycle.run_movers(f.change_triggers("mover"), f.identities(), f.accounts(), f.stored_grants())


def mover_runs(f: Fixtures) -> DataFrame:
    return _moved(f).runs


def mover_audit(f: Fixtures) -> DataFrame:
    return _moved(f).audit.select("action", "object_id", "correlation_id")


def mover_grants(f: Fixtures) -> DataFrame:
    return _moved(f).grants


def leaver_both_modes(f: Fixtures) -> DataFrame:
    """Every trigger delivered as a dry run too: the real runs count."""
    both = f.triggers().unionByName(f.triggers().withColumn("mode", F.lit("dry_run")))
    return lifecycle.run_leavers(both, f.identities(), f.accounts(), f.grants(), f.disable_outcomes()).runs


def _first_leavers(f: Fixtures) -> lifecycle.LeaverResult:
    return lifecycle.run_leavers(f.triggers(), f.identities(), f.accounts(), f.grants(), f.disable_outcomes())


def leaver_plan(f: Fixtures) -> DataFrame:
    return _first_leavers(f).runs


def leaver_replay(f: Fixtures) -> DataFrame:
    """Step state after a second attempt that only redoes what failed."""
    first = _first_leavers(f)
    second = lifecycle.run_leavers(
        f.triggers(), f.identities(), cut_lineage(first.accounts), cut_lineage(first.grants), f.disable_outcomes(),
        cut_lineage(first.steps))
    return second.steps.select("idempotency_key", "step_name", "attempt", "status")


def leaver_remaining_grants(f: Fixtures) -> DataFrame:
    return _first_leavers(f).grants


def leaver_audit(f: Fixtures) -> DataFrame:
    return _first_leavers(f).audit.select("action", "object_type", "object_id", "before_state", "correlation_id")


def workflow_dedup(f: Fixtures) -> DataFrame:
    ordered = f.lifecycle_events().withColumn("_first", F.struct("created_at", "event_id"))
    return lifecycle.workflow_runs(ordered, "_first").select("idempotency_key", "workflow_type", "identity_id", "event_id")


# ---- campaign -----------------------------------------------------------------------------


def _items(f: Fixtures) -> DataFrame:
    return campaign.review_items(f.accounts(), f.grants(), f.identities(), fx.CAMPAIGN_APPLICATION)


def _decided(f: Fixtures) -> campaign.Decided:
    items = _items(f)
    return campaign.decide(items, f.decisions(items), _as_of())


def campaign_items(f: Fixtures) -> DataFrame:
    return _items(f).select("account_id", "entitlement_id", "identity_id", _text("reviewer_id"), "reviewer_route")


def campaign_launch_gate(f: Fixtures) -> DataFrame:
    return campaign.launch_gate(f.applications(), f.runs(), F.lit(fx.RUNS_AS_OF).cast("timestamp")).select(
        "application", "source_system", "watermark_run_id", F.round("hours_since_last_success", 4).alias("hours_since"),
        F.col("stale").cast("int").alias("stale"), "verdict")


def campaign_rejected(f: Fixtures) -> DataFrame:
    return _decided(f).rejected.select("account_id", "entitlement_id", "decision", "actor")


def campaign_progress(f: Fixtures) -> DataFrame:
    return campaign.progress(_decided(f).items)


def _decided_again(f: Fixtures) -> campaign.Decided:
    items = _items(f)
    return campaign.decide(items, f.repeated_decisions(items), _as_of(), ("decided_on",))


def campaign_redecided(f: Fixtures) -> DataFrame:
    """Items with their last decision."""
    return _decided_again(f).items.select("account_id", "entitlement_id", "decision", "reason", "actor")


def decision_audit(f: Fixtures) -> DataFrame:
    return _decided_again(f).audit.select("actor", "action", "object_id", "reason", _text("decided_on"))


def evidence_pack(f: Fixtures) -> DataFrame:
    decided = _decided(f)
    tasks, _ = campaign.execute_revocations(decided.revocations, f.grants(), _as_of())
    return campaign.evidence_pack(decided.items, f.identities(), f.entitlements(), tasks)


def evidence_head(f: Fixtures) -> DataFrame:
    """The first 30 rows of the evidence pack and the number of all."""
    return campaign.evidence_head(evidence_pack(f))


def execute_revocations(f: Fixtures) -> DataFrame:
    _, remaining = campaign.execute_revocations(_decided(f).revocations, f.grants(), _as_of())
    return remaining


def campaign_why_not(f: Fixtures) -> DataFrame:
    return triage.why_not(f.identities(), _items(f), f.accounts(), f.grants(), fx.CAMPAIGN_APPLICATION)


# ---- operations ---------------------------------------------------------------------------


def run_diff(f: Fixtures) -> DataFrame:
    """Each run of a source against the run of the day before."""
    metrics = quality.reconcile(f.run_records(), ["run_id"])
    days = f.runs().select("source_system", "run_id", F.to_date("started_at").alias("day"))
    later = days.select("source_system", F.col("run_id").alias("run_b"), F.date_sub("day", 1).alias("day"))
    pairs = days.withColumnRenamed("run_id", "run_a").join(later, ["source_system", "day"]).select("run_a", "run_b")
    return triage.diff_runs(metrics, pairs)


def metric_listing(f: Fixtures) -> DataFrame:
    return quality.ordered_metrics(quality.reconcile(f.run_records(), ["run_id"]), ["run_id"])


def run_metrics(f: Fixtures) -> DataFrame:
    """The directory load as a run: its metrics, counted while its rows were stored, and what its run row says."""
    feed = f.directory_raw()
    run = files.start_run(feed, "directory", "directory-1", F.lit(fx.AS_OF).cast("timestamp"))
    done = quality.store_run(_directory(f).records, run, ingest.DIRECTORY_OUTCOMES, _as_of())
    closed = done.run.first()
    return done.metrics.withColumns({c: F.lit(closed[c]) for c in ("rows_in", "rows_normalized", "rows_quarantined", "status")})


def run_reconcile(f: Fixtures) -> DataFrame:
    return quality.run_totals(f.run_records(), ["run_id"]).withColumn("invariant_ok", F.col("invariant_ok").cast("int"))


def source_health(f: Fixtures) -> DataFrame:
    health = quality.source_health(f.runs(), f.sources(), F.lit(fx.RUNS_AS_OF).cast("timestamp"))
    return health.select(
        "source_system", "last_run_status", F.date_format("last_completed_at", "yyyy-MM-dd HH:mm:ss").alias("last_completed_at"),
        F.round("hours_since_last_success", 4).alias("hours_since"), F.col("stale").cast("int").alias("stale"))


def overall_health(f: Fixtures) -> DataFrame:
    return quality.overall_health(quality.source_health(f.runs(), f.sources(), F.lit(fx.RUNS_AS_OF).cast("timestamp")))


def exec_value(f: Fixtures) -> DataFrame:
    return triage.executive_value(f.accounts(), f.identities(), _decided(f).items, _findings(f))


def correlation_eval(f: Fixtures) -> DataFrame:
    """Directory classification against the rule that generated each row."""
    o = F.col("o_orderkey")
    label = (
        F.when(o % 19 == 0, "contractor").when((o % 17).isin(1, 2), "service").when(o % 17 == 0, "orphan"))
    labels = f.table("orders").select((o + 2).alias("source_line"), label.alias("label")).filter("label is not null")
    return evaluate.classification_quality(_directory(f).records, labels).select(
        "label", "tp", "fp", "fn", _ratio("precision"), _ratio("recall"))


def label_eval(f: Fixtures) -> DataFrame:
    """Every kind of known answer against what the loads found, all kinds at once."""
    records = cut_lineage(_roster_records(f))
    people = ingest.Directory(roster.identities(records), roster.aliases(records), corr.CorrelationPolicy(fx.CORPORATE_DOMAINS))
    cloud = ingest.ingest_cloud_directory(f.cloud_raw(), people)
    directory = ingest.ingest_directory(f.directory_raw(), people)
    crm = ingest.ingest_crm(f.crm_raw(), people, fx.CORPORATE_DOMAIN).records
    sheet = ingest.ingest_spreadsheet(f.cells_raw(), people, fx.CONTEXT_DEPARTMENT).records
    without_id = f.cloud_raw().filter("employeeId IS NULL").select("source_line")
    owned = F.col("ownership_status").isin("service_owned", "service_owned_by_terminated")

    def found(df: DataFrame, condition: Column, label_set: str, entity: Column) -> DataFrame:
        return df.filter(condition).select(F.lit(label_set).alias("label_set"), entity.cast("string").alias("entity"))

    line, reason = F.col("source_line"), F.col("reason_code")
    predicted = [
        found(records, F.startswith(reason, F.lit("EMPLOYEE_ID_COLLISION")), "employee_id_collision", line),
        found(cloud.records.join(without_id, "source_line", "left_semi"), F.col("decision") == "auto_match", "null_employee_id", line),
        found(sheet, reason == "STALE_WORKSHEET_EXCLUDED", "stale_sheet", F.concat_ws(":", "sheet", line.cast("string"))),
        found(crm, reason == "CORRELATION_LEGACY_DOMAIN", "legacy_domain", line),
        found(directory.records, F.col("ownership_status") == "contractor", "contractor", line),
        found(directory.records, (F.col("account_type") == "service") & owned, "service_owner", line),
        found(evaluate.multi_account_people(cloud.accounts.unionByName(directory.accounts)), F.lit(True), "dual_account", F.col("owner_identity_id"))]
    return evaluate.judge(reduce(DataFrame.unionByName, predicted), f.known_answers()).select(
        "label_set", "tp", "fp", "fn", _ratio("precision"), _ratio("recall"))


def iam_eval(f: Fixtures) -> DataFrame:
    users = f.iam_users_raw()
    records = ingest.ingest_cloud_iam(users, f.iam_roles_raw(), _people(f)).records
    automation = users.filter(F.startswith("username", F.lit("automation-"))).select("username")
    return evaluate.no_human_quality(records, automation).select(
        "label", "tp", "fp", "fn", _ratio("precision"), _ratio("recall"))


def multi_account_people(f: Fixtures) -> DataFrame:
    people = _people(f)
    cloud = ingest.ingest_cloud_directory(f.cloud_raw(), people).accounts
    directory = ingest.ingest_directory(f.directory_raw(), people).accounts
    return evaluate.multi_account_people(cloud.unionByName(directory))


def reconcile_all(f: Fixtures) -> DataFrame:
    """Reason codes of all account feeds loaded in order."""
    feeds = {
        "cloud_directory": f.cloud_raw(), "directory": f.directory_raw(), "crm": f.crm_raw(),
        "iam_users": f.iam_users_raw(), "iam_roles": f.iam_roles_raw(), "cells": f.cells_raw()}
    loaded = ingest.ingest_all(feeds, _people(f), fx.CORPORATE_DOMAIN, fx.CONTEXT_DEPARTMENT)
    counted = [
        quality.reconcile(result.records).select(F.lit(source).alias("source"), "stage", "reason_code", "row_count")
        for source, result in loaded.items()]
    return reduce(DataFrame.unionByName, counted)


def quarantine_open(f: Fixtures) -> DataFrame:
    """The first 200 open quarantine rows."""
    return triage.open_quarantine(roster.quarantine(_roster_records(f))).select("reason_code", "source_line", "candidate_ids")


def quarantine_counts(f: Fixtures) -> DataFrame:
    return evaluate.quarantine_counts(roster.quarantine(_roster_records(f)))


def workflow_recent(f: Fixtures) -> DataFrame:
    """The latest 100 workflow runs."""
    ordered = f.lifecycle_events().withColumn("_first", F.struct("created_at", "event_id"))
    return lifecycle.recent_runs(lifecycle.workflow_runs(ordered, "_first"), "created_at").select(
        "idempotency_key", "workflow_type", "event_id")


QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {
    "finding_terminated_active": _account_rule("TERMINATED_WITH_ACTIVE_ACCESS"),
    "finding_orphaned": _account_rule("ORPHANED_ACCOUNT"),
    "finding_dormant": _account_rule("DORMANT_ACCOUNT"),
    "finding_unowned_nhi": _account_rule("UNOWNED_NON_HUMAN_IDENTITY"),
    **{q.__name__: q for q in (
        finding_peer_outlier, finding_sod, finding_missing_manager, findings_with_disposition, findings_top,
        findings_by_rule, findings_upsert, findings_upsert_resolved, disposition_active, ingest_entitlements, ingest_twice,
        ingest_next, joiner_runs, joiner_audit, joiner_replay, mover_runs, mover_audit, mover_grants, leaver_both_modes,
        campaign_redecided, decision_audit, standardise_roster, reconcile_roster, roster_collisions, manager_link,
        roster_aliases, roster_quarantine, status_date_conflict, correlate_accounts, reconcile_cloud,
        correlation_decisions, directory_classify, directory_accounts, directory_grants, text_owner_mention,
        crm_accounts, crm_grants, iam_unique_owner, iam_role_edges, iam_role_privilege, sheet_header_detect,
        sheet_primary, sheet_name_match, fuzzy_name_match, fuzzy_long_names, source_upsert, quarantine_merge, record_outcomes,
        account_snapshot, entitlement_closure, effective_access, why_entitlement, identity_360, reviewer_routing,
        birthright, joiner_plan, mover_delta, leaver_plan, leaver_replay, leaver_remaining_grants, leaver_audit,
        workflow_dedup, campaign_items, campaign_launch_gate, campaign_rejected, campaign_progress, evidence_pack,
        execute_revocations, campaign_why_not, run_diff, run_reconcile, source_health, overall_health, exec_value,
        correlation_eval, iam_eval, multi_account_people, reconcile_all, quarantine_open, quarantine_counts,
        workflow_recent, account_snapshot_bucketed, application_keys, access_after_change, evidence_head, metric_listing, run_metrics, label_eval)},
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Fixtures(prepare(spark), folder))
