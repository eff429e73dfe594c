"""Joiner, mover and leaver access changes, set-at-a-time, with replayable step state.

Connectors are outside: their answers come in as outcome tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.functions.scoring import percent
from accessloom.operators.rank import first_per_key
from accessloom.plans.findings import COHORT, same_columns
from accessloom.session import SMALL_TASKS, cut_lineage, under

BIRTHRIGHT_PREVALENCE = 0.6
MIN_PEERS = 3
STEP_KEYS = ("idempotency_key", "step_name")
CLOUD_SUFFIX = "onmicrosoft.com"


def idempotency_key() -> Column:
    return F.concat_ws(":", "workflow_type", F.col("identity_id").cast("string"), "trigger_event_id")


def workflow_runs(triggers: DataFrame, order: str | None = None) -> DataFrame:
    """One run per type, person and trigger; repeated deliveries fold into the first.

    A delivery to execute beats any dry run of the same trigger.
    """
    keyed = triggers.withColumn("idempotency_key", idempotency_key())
    first = [F.desc(F.col("mode") == "execute"), *([F.col(order)] if order else [])]
    return first_per_key(keyed, ["idempotency_key"], first)


def held_entitlements(accounts: DataFrame, grants: DataFrame) -> DataFrame:
    """(identity_id, entitlement_id, account_id): what a person holds, through the smallest account."""
    owned = accounts.filter(F.col("owner_id").isNotNull()).select("account_id", F.col("owner_id").alias("identity_id"))
    links = grants.select("account_id", "entitlement_id").join(owned, "account_id")
    return links.groupBy("identity_id", "entitlement_id").agg(F.min("account_id").alias("account_id"))


def _cohorts(identities: DataFrame, min_peers: int) -> DataFrame:
    """Cohorts with enough active people and their number."""
    active = identities.filter(F.col("lifecycle_status") == "active")
    return active.groupBy(*COHORT).agg(F.count("*").alias("active_count")).filter(F.col("active_count") >= min_peers)


def shareable_grants(
    identities: DataFrame, grants: DataFrame, prevalence: float = BIRTHRIGHT_PREVALENCE, min_peers: int = MIN_PEERS
) -> DataFrame:
    """The grants whose entitlement has enough grants in all to be birthright of any cohort.

    An entitlement has no more holders than grants, and the cohort that asks for the fewest asks for ``prevalence`` of its
    other active people. Where there is a tiny cohort nearly all grants stay.
    """
    fewest = _cohorts(identities, min_peers).agg(F.min(prevalence * (F.col("active_count") - 1))).first()[0]
    counted = grants.groupBy("entitlement_id").agg(F.count("*").alias("n")).filter(
        F.lit(False) if fewest is None else F.col("n") >= fewest)
    # Stored, so that its size is known to the join and grants move only if it is large.
    wide = cut_lineage(counted.select("entitlement_id"))
    return grants.select("account_id", "entitlement_id").alias("g").join(
        wide.alias("w"), same_columns("g", "w", ["entitlement_id"]), "left_semi")


def birthright(
    identities: DataFrame, held: DataFrame, prevalence: float = BIRTHRIGHT_PREVALENCE, min_peers: int = MIN_PEERS,
    asked: DataFrame | None = None,
) -> DataFrame:
    """(identity_id, entitlement_id, prevalence) held by enough active peers of the same cohort.

    ``asked`` (identity_id) confines the result to those people; peers are counted over all.

    Peers are the other active people of the (department, title) cohort; null equals null. Cohort
    counts minus the person's own share replace a peer-to-peer join.
    """
    people = identities.select("identity_id", *COHORT, (F.col("lifecycle_status") == "active").cast("int").alias("self"))
    active = people.filter("self = 1").select("identity_id", *COHORT)
    sizes = _cohorts(identities, min_peers)
    common = (
        held.select("identity_id", "entitlement_id").join(active, "identity_id")
        .groupBy(*COHORT, "entitlement_id").agg(F.count("*").alias("holders")))
    # No member can see more than holders / (active_count - 1), so rarer pairs are dropped early.
    reachable = common.alias("c").join(sizes.alias("s"), same_columns("c", "s", COHORT)).select(
        *[F.col(f"c.{x}").alias(x) for x in COHORT], "c.entitlement_id", "holders", "active_count",
    ).filter(F.col("holders") >= prevalence * (F.col("active_count") - 1))
    # A few rows per cohort, read three times below.
    reachable = cut_lineage(reachable)
    if asked is not None:
        people = people.join(asked.select("identity_id"), "identity_id", "left_semi")
    pairs = people.alias("p").join(reachable.alias("r"), same_columns("p", "r", COHORT)).select(
        "p.identity_id", "self", "r.entitlement_id", "holders", (F.col("active_count") - F.col("self")).alias("peers"))
    # Of what people hold only what some cohort shares can be asked for, so only that is moved.
    shared = held.select("identity_id", "entitlement_id").join(reachable.select("entitlement_id"), "entitlement_id", "left_semi")
    own = shared.select("identity_id", "entitlement_id", F.lit(1).alias("own"))
    rated = pairs.filter(F.col("peers") >= min_peers).join(own, ["identity_id", "entitlement_id"], "left")
    others = F.col("holders") - F.col("self") * F.coalesce("own", F.lit(0))
    rated = rated.withColumn("prevalence", others / F.col("peers"))
    return rated.filter(F.col("prevalence") >= prevalence).select("identity_id", "entitlement_id", "prevalence")


def held_links(accounts: DataFrame, grants: DataFrame) -> DataFrame:
    """(identity_id, entitlement_id, account_id): every link through which a person holds an entitlement."""
    owned = accounts.filter(F.col("owner_id").isNotNull()).select("account_id", F.col("owner_id").alias("identity_id"))
    return grants.select("account_id", "entitlement_id").join(owned, "account_id").select(
        "identity_id", "entitlement_id", "account_id").distinct()


def mover_delta(
    identities: DataFrame, accounts: DataFrame, grants: DataFrame, every_link: bool = True,
    asked: DataFrame | None = None, **options,
) -> DataFrame:
    """Entitlements to grant, revoke or keep per person; grants go to the smallest account.

    What a person holds through several accounts is a row for each, so that no link stays behind when it is revoked;
    without ``every_link`` only that of the smallest account is. A person without an account gets no grant and is
    reported as such. ``asked`` (identity_id) confines the result to those people; peers are counted over all.
    """
    shared = cut_lineage(held_entitlements(accounts, shareable_grants(identities, grants, **options)))
    target = birthright(identities, shared, asked=asked, **options)
    if asked is not None:
        accounts = accounts.join(asked.select(F.col("identity_id").alias("owner_id")), "owner_id", "left_semi")
    held = (held_links if every_link else held_entitlements)(accounts, grants)
    homes = accounts.filter(F.col("owner_id").isNotNull()).groupBy(F.col("owner_id").alias("identity_id")).agg(
        F.min("account_id").alias("home_account"))
    # Homes are needed for what is not held only, so they meet the target and not all links.
    both = held.join(target.join(homes, "identity_id", "left"), ["identity_id", "entitlement_id"], "full_outer")
    action = (
        F.when(F.col("prevalence").isNull(), "revoke").when(F.col("account_id").isNotNull(), "keep")
        .when(F.col("home_account").isNull(), "grant_without_account").otherwise("grant"))
    return both.select(
        "identity_id", "entitlement_id", action.alias("action"),
        F.coalesce("account_id", "home_account").alias("account_id"), "prevalence")


def apply_mover(delta: DataFrame, grants: DataFrame) -> DataFrame:
    """Next grants: revoked links removed, granted links added."""
    link = ["account_id", "entitlement_id"]
    kept = grants.join(delta.filter("action = 'revoke'").select(*link), link, "left_anti")
    return kept.select(*link).unionByName(delta.filter("action = 'grant'").select(*link)).distinct()


def joiner_plan(
    identities: DataFrame, accounts: DataFrame, grants: DataFrame, entitlements: DataFrame,
    provisioning_failures: DataFrame, mode: str = "execute", asked: DataFrame | None = None, **options,
) -> DataFrame:
    """One access request per birthright entitlement with the account and grant steps it implies, of ``asked`` people if given.

    A dry run yields the requests only. A failed account leaves its requests pending.
    """
    # Nothing else can be asked for, neither by a request nor by the links it may have already.
    grants = cut_lineage(shareable_grants(identities, grants, **options))
    target = birthright(identities, cut_lineage(held_entitlements(accounts, grants)), asked=asked, **options)
    people = identities.select("identity_id", "title", "department")
    requests = target.join(entitlements.select("entitlement_id", "application"), "entitlement_id").join(people, "identity_id")
    rationale = F.concat(
        percent(F.col("prevalence")), F.lit(" of active people who are "), "title", F.lit(" in "), "department", F.lit(" have it"))
    requests = requests.select("identity_id", "entitlement_id", "application", "prevalence", rationale.alias("rationale"))
    if mode == "dry_run":
        return requests.select(
            "*", F.lit("auto_approved").alias("decision"), F.lit("skipped").alias("account_step"),
            F.lit("skipped").alias("grant_step"), F.lit(None).cast(dict(accounts.dtypes)["account_id"]).alias("account_id"))
    homes = accounts.filter(F.col("owner_id").isNotNull()).groupBy(
        F.col("owner_id").alias("identity_id"), "application").agg(F.min("account_id").alias("account_id"))
    failures = provisioning_failures.select("identity_id", "application").distinct().withColumn("failed", F.lit(True))
    located = requests.join(homes, ["identity_id", "application"], "left").join(
        failures, ["identity_id", "application"], "left")
    # Only links that a request could ask for again.
    asked = located.filter(F.col("account_id").isNotNull()).select("account_id", "entitlement_id")
    links = grants.select("account_id", "entitlement_id").join(asked, ["account_id", "entitlement_id"], "left_semi")
    links = links.distinct().withColumn("linked", F.lit(True))
    located = located.join(links, ["account_id", "entitlement_id"], "left")
    account_step = (
        F.when(F.col("account_id").isNotNull(), "existing").when(F.col("failed"), "failed").otherwise("provision"))
    located = located.withColumn("account_step", account_step)
    blocked = F.col("account_step") == "failed"
    return located.select(
        "identity_id", "entitlement_id", "application", "prevalence", "rationale",
        F.when(blocked, "pending").otherwise("auto_approved").alias("decision"), "account_step",
        F.when(blocked, "deferred").when(F.col("linked"), "already_held").otherwise("grant").alias("grant_step"),
        "account_id")


@dataclass(frozen=True)
class ChangeResult:
    """Runs, their steps, what each run asks for, the next grants, and one audit row per grant and revoke."""

    runs: DataFrame
    steps: DataFrame
    requests: DataFrame
    grants: DataFrame
    audit: DataFrame


def _change_runs(triggers: DataFrame, workflow: str, identities: DataFrame, prior_steps: DataFrame | None) -> DataFrame:
    """Runs of known people with ``done`` where an earlier attempt already applied them."""
    runs = workflow_runs(triggers.filter(F.col("workflow_type") == workflow)).join(identities.select("identity_id"), "identity_id")
    if prior_steps is None:
        return runs.withColumn("done", F.lit(False))
    applied = prior_steps.filter("step_name = 'apply' and status = 'succeeded'").select("idempotency_key").distinct()
    return runs.join(applied.withColumn("_applied", F.lit(True)), "idempotency_key", "left").withColumn(
        "done", F.coalesce("_applied", F.lit(False))).drop("_applied")


def _change_steps(runs: DataFrame, counted: DataFrame, compute: str) -> tuple[DataFrame, DataFrame]:
    """(runs, steps) from the requests and open requests of each run."""
    joined = runs.join(counted, "idempotency_key", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("requested", "open")})
    apply = (
        F.when(F.col("done"), "succeeded").when(F.col("mode") == "dry_run", "skipped")
        .when(F.col("open") > 0, "pending").otherwise("succeeded"))
    rows = joined.withColumn("apply", apply)
    status = F.when(F.col("apply") == "pending", "partially_failed").otherwise("completed")
    steps = rows.select("idempotency_key", "identity_id", F.inline(F.array(
        F.struct(F.lit(compute).alias("step_name"), F.lit("succeeded").alias("status")),
        F.struct(F.lit("apply").alias("step_name"), F.col("apply").alias("status")))))
    return rows.select("idempotency_key", "identity_id", "mode", "requested", "open", status.alias("status")), steps


def _audit(rows: DataFrame, workflow: str, action: Column, reason: Column) -> DataFrame:
    return rows.select(
        F.lit(f"system:{workflow}_workflow").alias("actor"), action.alias("action"), F.lit("grant").alias("object_type"),
        F.concat_ws("/", F.coalesce(F.col("account_id").cast("string"), F.lit("new account")), "entitlement_id").alias("object_id"),
        reason.alias("reason"), F.col("idempotency_key").alias("correlation_id"))


@under(SMALL_TASKS)
def run_joiners(
    triggers: DataFrame, identities: DataFrame, accounts: DataFrame, grants: DataFrame, entitlements: DataFrame,
    provisioning_failures: DataFrame, prior_steps: DataFrame | None = None, **options,
) -> ChangeResult:
    """Joiner runs: requests from birthright, applied at once except where an account could not be made.

    A run applied in ``prior_steps`` is not done again; a dry run computes its requests and changes nothing. Each request
    carries the policy that approved it.
    """
    runs = cut_lineage(_change_runs(triggers, "joiner", identities, prior_steps))
    todo = runs.filter(~F.col("done")).select("idempotency_key", "identity_id", "mode")
    plan = joiner_plan(identities, accounts, grants, entitlements, provisioning_failures, asked=todo, **options)
    requests = cut_lineage(plan.join(todo, "identity_id").withColumn("policy", F.lit("birthright")))
    counted = requests.groupBy("idempotency_key").agg(
        F.count("*").alias("requested"), F.count_if((F.col("decision") == "pending") & (F.col("mode") == "execute")).alias("open"))
    all_runs, steps = _change_steps(runs, counted, "compute_birthright")
    granted = requests.filter("mode = 'execute' and grant_step = 'grant'")
    added = granted.filter(F.col("account_id").isNotNull()).select("account_id", "entitlement_id")
    link = ["account_id", "entitlement_id"]
    next_grants = grants.select(*link).unionByName(added.join(grants.select(*link), link, "left_anti").distinct())
    return ChangeResult(all_runs, steps, requests, next_grants, _audit(granted, "joiner", F.lit("grant_entitlement"), F.col("rationale")))


@under(SMALL_TASKS)
def run_movers(
    triggers: DataFrame, identities: DataFrame, accounts: DataFrame, grants: DataFrame,
    prior_steps: DataFrame | None = None, **options,
) -> ChangeResult:
    """Mover runs: the difference between what a person holds and what the new cohort holds, applied at once.

    A grant for a person without an account stays open. Replay and dry run are as for joiners.
    """
    runs = cut_lineage(_change_runs(triggers, "mover", identities, prior_steps))
    todo = runs.filter(~F.col("done")).select("idempotency_key", "identity_id", "mode")
    delta = mover_delta(identities, accounts, grants, asked=todo, **options)
    requests = cut_lineage(delta.join(todo, "identity_id").filter("action <> 'keep'"))
    counted = requests.groupBy("idempotency_key").agg(
        F.count("*").alias("requested"), F.count_if((F.col("mode") == "execute") & (F.col("action") == "grant_without_account")).alias("open"))
    all_runs, steps = _change_steps(runs, counted, "compute_diff")
    applied = requests.filter("mode = 'execute' and action <> 'grant_without_account'")
    reason = F.when(F.col("action") == "grant", "usual in the new cohort").otherwise("not usual in the new cohort")
    return ChangeResult(
        all_runs, steps, requests, apply_mover(applied, grants),
        _audit(applied, "mover", F.concat("action", F.lit("_entitlement")), reason))


def new_accounts(plan: DataFrame, identities: DataFrame) -> DataFrame:
    """Accounts a joiner plan provisions, one per person and application."""
    needed = plan.filter("account_step = 'provision'").select("identity_id", "application").distinct()
    return needed.join(identities.select("identity_id", "name", "email"), "identity_id").select(
        F.concat_ws(":", F.lit("joiner"), F.col("identity_id").cast("string"), "application").alias("native_id"),
        "application", F.coalesce("email", "name").alias("username"), F.lit("human").alias("account_type"),
        F.lit(True).alias("enabled"), F.col("identity_id").alias("owner_id"), F.lit("owned").alias("ownership_status"))


def connector(username: Column) -> Column:
    return F.when(F.contains(username, F.lit(CLOUD_SUFFIX)), "cloud").otherwise("directory")


@dataclass(frozen=True)
class LeaverResult:
    runs: DataFrame
    steps: DataFrame
    accounts: DataFrame
    grants: DataFrame
    audit: DataFrame


def run_leavers(
    triggers: DataFrame, identities: DataFrame, accounts: DataFrame, grants: DataFrame, outcomes: DataFrame,
    prior_steps: DataFrame | None = None,
) -> LeaverResult:
    """Disable every account of terminated people, then revoke the grants of disabled accounts.

    ``outcomes`` is (account_id, attempt, succeeded); a missing answer counts as success. Steps
    that succeeded in ``prior_steps`` are not redone, others run as the next attempt. An account
    whose disable failed keeps its grants and leaves the run partially failed, to be replayed.
    """
    runs = workflow_runs(triggers).join(
        identities.select("identity_id", "name", "lifecycle_status", "termination_date"), "identity_id")
    if prior_steps is None:
        runs = runs.withColumn("revoke_done", F.lit(False)).withColumn("revoke_attempt", F.lit(1))
    else:
        revoke = prior_steps.filter(F.col("step_name") == "revoke_entitlements").select(
            "idempotency_key", (F.col("status") == "succeeded").alias("_done"), F.col("attempt").alias("_attempt"))
        runs = runs.join(revoke, "idempotency_key", "left")
        runs = runs.withColumn("revoke_done", F.coalesce("_done", F.lit(False))).withColumn(
            "revoke_attempt", F.coalesce("_attempt", F.lit(0)) + F.when(F.col("_done"), 0).otherwise(1)).drop("_done", "_attempt")
    leaving = runs.filter(F.col("lifecycle_status") == "terminated")
    owned = accounts.filter(F.col("owner_id").isNotNull()).withColumnRenamed("owner_id", "identity_id")
    # Several triggers may name one person; each run has its own steps.
    todo = leaving.select("idempotency_key", "identity_id", "name", "termination_date", "mode", "revoke_done").join(
        owned.select("identity_id", "account_id", "username", "enabled", "account_type"), "identity_id")
    todo = todo.withColumn("step_name", F.concat(
        F.lit("disable_"), connector(F.col("username")), F.lit(":"), F.col("account_id").cast("string")))
    if prior_steps is None:
        todo = todo.withColumn("prior_status", F.lit(None).cast("string")).withColumn("prior_attempt", F.lit(0))
    else:
        before = prior_steps.filter(F.col("account_id").isNotNull()).select(
            *STEP_KEYS, F.col("status").alias("prior_status"), F.col("attempt").alias("prior_attempt"))
        todo = todo.join(before, list(STEP_KEYS), "left")
    done = F.coalesce(F.col("prior_status") == "succeeded", F.lit(False))
    attempt = F.coalesce("prior_attempt", F.lit(0)) + F.when(done, 0).otherwise(1)
    todo = todo.withColumn("done", done).withColumn("attempt", attempt.cast("int"))
    todo = todo.join(outcomes.select("account_id", "attempt", "succeeded"), ["account_id", "attempt"], "left")
    dry = F.col("mode") == "dry_run"
    status = (
        F.when(F.col("done"), "succeeded").when(dry, "skipped")
        .when(F.coalesce("succeeded", F.lit(True)), "succeeded").otherwise("failed"))
    steps = todo.withColumn("status", status).withColumn(
        "fresh", ~F.col("done") & (F.col("status") == "succeeded")).withColumn(
        "still_enabled", ~dry & F.col("enabled") & (F.col("status") != "succeeded"))
    # Every output below reads these steps, so they are written once.
    steps = cut_lineage(steps)

    per_account = grants.select("account_id", "entitlement_id").join(
        steps.select("account_id"), "account_id", "left_semi").groupBy("account_id").agg(F.count("*").alias("links"))
    detailed = steps.join(per_account, "account_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    summary = detailed.groupBy("idempotency_key").agg(
        F.count("*").alias("account_count"), F.count_if(F.col("status") == "succeeded").alias("disabled"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.when(~F.col("still_enabled") & ~F.col("revoke_done"), F.col("links"))).alias("entitlements_revoked"),
        F.count_if("still_enabled").alias("deferred_accounts"),
        F.count_if(F.col("account_type") == "service").alias("service_accounts"))
    joined = runs.join(summary, "idempotency_key", "left")
    for c in ("account_count", "disabled", "failed", "entitlements_revoked", "deferred_accounts", "service_accounts"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    open_work = (F.col("failed") > 0) | (F.col("deferred_accounts") > 0)
    joined = joined.select(
        "idempotency_key", "identity_id", "mode", "lifecycle_status", "account_count", "disabled", "failed",
        "entitlements_revoked", "deferred_accounts", "service_accounts", "revoke_done", "revoke_attempt",
        F.when(open_work, "partially_failed").otherwise("completed").alias("status"))

    account_steps = steps.select(*STEP_KEYS, "identity_id", "account_id", "attempt", "status")
    revoke_status = (
        F.when(F.col("revoke_done"), "succeeded").when(F.col("mode") == "dry_run", "skipped")
        .when(F.col("deferred_accounts") > 0, "pending").otherwise("succeeded"))
    run_steps = joined.filter(F.col("lifecycle_status") == "terminated").select("*", F.inline(F.array(
        F.struct(F.lit("discover").alias("step_name"), F.lit("succeeded").alias("step_status"), F.lit(1).alias("tries")),
        F.struct(F.lit("revoke_entitlements").alias("step_name"), revoke_status.alias("step_status"),
                 F.col("revoke_attempt").alias("tries")),
        F.struct(F.lit("flag_service_dependencies").alias("step_name"), F.lit("succeeded").alias("step_status"),
                 F.lit(1).alias("tries"))))).select(
        *STEP_KEYS, "identity_id", F.lit(None).cast(dict(accounts.dtypes)["account_id"]).alias("account_id"),
        F.col("tries").alias("attempt"), F.col("step_status").alias("status"))
    all_steps = account_steps.unionByName(run_steps)

    executed = steps.filter(~dry)
    closed = executed.filter(F.col("status") == "succeeded").select("account_id").distinct()
    next_accounts = accounts.join(closed.withColumn("_closed", F.lit(True)), "account_id", "left").withColumn(
        "enabled", F.when(F.col("_closed"), False).otherwise(F.col("enabled"))).drop("_closed")
    stripped = executed.filter(~F.col("still_enabled") & ~F.col("revoke_done")).select("account_id").distinct()
    next_grants = grants.join(stripped, "account_id", "left_anti")
    disable_events = executed.filter("fresh").select(
        F.lit("system:leaver_workflow").alias("actor"), F.lit("disable_account").alias("action"),
        F.lit("account").alias("object_type"), F.col("account_id").cast("string").alias("object_id"),
        F.concat(F.lit("account of "), "name", F.lit(", who left on "),
                 F.coalesce(F.col("termination_date").cast("string"), F.lit("a date not given"))).alias("reason"),
        F.concat(F.lit("enabled="), F.col("enabled").cast("string")).alias("before_state"),
        F.lit("enabled=false").alias("after_state"), F.col("idempotency_key").alias("correlation_id"))
    flag_events = joined.filter((F.col("service_accounts") > 0) & (F.col("mode") == "execute")).select(
        F.lit("system:leaver_workflow").alias("actor"), F.lit("flag_ownership_transfer_needed").alias("action"),
        F.lit("identity").alias("object_type"), F.col("identity_id").cast("string").alias("object_id"),
        F.concat(F.col("service_accounts").cast("string"), F.lit(" service account(s) need a new owner")).alias("reason"),
        F.lit(None).cast("string").alias("before_state"), F.lit(None).cast("string").alias("after_state"),
        F.col("idempotency_key").alias("correlation_id"))
    joined = joined.drop("revoke_done", "revoke_attempt")
    return LeaverResult(joined, all_steps, next_accounts, next_grants, disable_events.unionByName(flag_events))


def recent_runs(runs: DataFrame, order: str, n: int = 100) -> DataFrame:
    """Latest workflow runs, newest first."""
    return runs.orderBy(F.desc(order), "idempotency_key").limit(n)
