"""Risk findings over the resolved graph.

The four account rules share one pass over an account fact table; identity rules reuse the same
privileged-grant join. All thresholds, rule pairs and the as-of instant are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.functions import scoring
from accessloom.functions.dates import whole_days_between
from accessloom.functions.text import contains_ci
from accessloom.operators.joins import lookup
from accessloom.operators.merge import EXISTING
from accessloom.operators.rank import first_per_key
from accessloom.session import cut_lineage

TERM_COLUMNS = ("base_points", "privileged_points", "context_points", "extra_points")


@dataclass(frozen=True)
class Graph:
    """Resolved identity graph; see README for the expected columns."""

    identities: DataFrame
    accounts: DataFrame
    applications: DataFrame
    entitlements: DataFrame
    grants: DataFrame


def privileged_grants(g: Graph) -> DataFrame:
    """(account_id, entitlement_id) of privileged grants; the filter runs before any shuffle of grants."""
    privileged = g.entitlements.filter("privileged").select("entitlement_id")
    return g.grants.select("account_id", "entitlement_id").join(privileged, "entitlement_id", "left_semi")


def account_facts(g: Graph, with_owner: bool = True) -> DataFrame:
    """One row per account with its privilege flag, application criticality and owner attributes."""
    privileged = privileged_grants(g).select("account_id").distinct().withColumn("_priv", F.lit(True))
    facts = g.accounts.join(g.applications.select("application", "criticality"), "application", "left")
    facts = facts.join(privileged, "account_id", "left").withColumn("privileged", F.col("_priv").isNotNull()).drop("_priv")
    if not with_owner:
        return facts
    owners = g.identities.select(
        F.col("identity_id").alias("_owner"), F.col("name").alias("owner_name"),
        F.col("lifecycle_status").alias("owner_status"), F.col("termination_date").alias("owner_termination_date"))
    return lookup(facts, "owner_id", owners, "_owner", ["account_id"])


def _finding(rule: str, subject_type: str, subject: Column, terms: list[Column], explanation: Column) -> Column:
    score = scoring.capped_score(*terms)
    return F.struct(
        F.lit(rule).alias("rule_code"), F.lit(subject_type).alias("subject_type"),
        subject.cast("string").alias("subject_id"), scoring.severity(score).alias("severity"),
        score.alias("risk_score"),
        *[t.cast("int").alias(name) for t, name in zip(terms, TERM_COLUMNS)],
        explanation.alias("explanation"))


FINDING_TYPE = (
    "struct<rule_code:string,subject_type:string,subject_id:string,severity:string,risk_score:int,"
    "base_points:int,privileged_points:int,context_points:int,extra_points:int,explanation:string>")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts])


def _terminated(as_of: Column) -> tuple[Column, Column]:
    days = F.coalesce(F.datediff(as_of, F.col("owner_termination_date")), F.lit(0))
    applies = (F.col("owner_status") == "terminated") & F.col("enabled")
    return applies, _finding(
        "TERMINATED_WITH_ACTIVE_ACCESS", "account", F.col("account_id"),
        [F.lit(5), scoring.points(F.col("privileged"), 3), scoring.points(F.col("criticality") == "crown_jewel", 1),
         scoring.points(days > 30, 1)],
        _text(F.col("owner_name"), " was terminated on ", F.col("owner_termination_date"), " (", days,
              " days ago) but account ", F.col("username"), " in ", F.col("application"), " is enabled",
              F.when(F.col("privileged"), " with privileged access").otherwise(""), "."))


def _orphaned() -> tuple[Column, Column]:
    return F.col("ownership_status") == "orphan", _finding(
        "ORPHANED_ACCOUNT", "account", F.col("account_id"),
        [F.lit(4), scoring.points(F.col("privileged"), 2), scoring.points(F.col("enabled"), 2), F.lit(1)],
        _text("Account ", F.col("username"), " in ", F.col("application"), " has no known owner or purpose."))


def _dormant(as_of: Column, dormant_days: int) -> tuple[Column, Column]:
    idle = whole_days_between(F.col("last_activity_at"), as_of)
    applies = F.col("enabled") & F.col("last_activity_at").isNotNull() & (idle >= dormant_days)
    return applies, _finding(
        "DORMANT_ACCOUNT", "account", F.col("account_id"),
        [F.lit(3), scoring.points(F.col("privileged"), 2), F.lit(2), scoring.points(F.col("owner_id").isNull(), 2)],
        _text("Account ", F.col("username"), " in ", F.col("application"), " was idle for ", idle,
              f" days (threshold: {dormant_days})."))


def _unowned_non_human() -> tuple[Column, Column]:
    owner_left = F.coalesce(F.col("owner_status") == "terminated", F.lit(False))
    accountable = F.col("owner_name").isNotNull() & ~owner_left & (F.col("ownership_status") != "unresolved")
    return F.col("account_type").isin("service", "unknown") & ~accountable, _finding(
        "UNOWNED_NON_HUMAN_IDENTITY", "account", F.col("account_id"),
        [F.lit(4), scoring.points(F.col("privileged"), 2), F.lit(2), scoring.points(owner_left, 2)],
        _text("Non-human account ", F.col("username"), " in ", F.col("application"), " has no accountable owner (",
              F.when(owner_left, F.concat(F.lit("set up by "), F.col("owner_name"), F.lit(", since terminated")))
              .otherwise("no owner on record"), ")."))


OWNER_RULES = ("TERMINATED_WITH_ACTIVE_ACCESS", "UNOWNED_NON_HUMAN_IDENTITY")
ACCOUNT_RULES = ("TERMINATED_WITH_ACTIVE_ACCESS", "ORPHANED_ACCOUNT", "DORMANT_ACCOUNT", "UNOWNED_NON_HUMAN_IDENTITY")


def account_findings(
    facts: DataFrame, as_of: Column, dormant_days: int = 180, rules: tuple[str, ...] = ACCOUNT_RULES
) -> DataFrame:
    """The chosen account rules in one pass: each fact row yields one finding per rule that applies."""
    makers = {
        "TERMINATED_WITH_ACTIVE_ACCESS": lambda: _terminated(as_of), "ORPHANED_ACCOUNT": _orphaned,
        "DORMANT_ACCOUNT": lambda: _dormant(as_of, dormant_days), "UNOWNED_NON_HUMAN_IDENTITY": _unowned_non_human}
    built = [makers[r]() for r in rules]
    hits = [F.when(applies, finding).cast(FINDING_TYPE) for applies, finding in built]
    if len(rules) == 1:
        return facts.filter(built[0][0]).select(hits[0].alias("f")).select("f.*")
    return facts.select(F.inline(F.filter(F.array(*hits), lambda f: f.isNotNull())))


def _owned(g: Graph) -> DataFrame:
    return g.accounts.filter(F.col("owner_id").isNotNull()).select("account_id", F.col("owner_id").alias("identity_id"))


def holders(g: Graph, grants: DataFrame) -> DataFrame:
    """Distinct (identity_id, entitlement_id) held through owned accounts."""
    return grants.join(_owned(g), "account_id").select("identity_id", "entitlement_id").distinct()


COHORT = ("department", "title")


def peer_outliers(g: Graph, min_cohort_size: int = 8, prevalence_ceiling: float = 0.10) -> DataFrame:
    """Privileged entitlements that are rare in the holder's (department, title) cohort, one row each."""
    active = g.identities.filter((F.col("lifecycle_status") == "active") & (F.col("worker_type") == "employee"))
    sizes = active.groupBy(*COHORT).agg(F.count("*").alias("cohort_size")).filter(F.col("cohort_size") >= min_cohort_size)
    held = holders(g, privileged_grants(g)).join(active.select("identity_id", "name", *COHORT), "identity_id")
    counts = held.groupBy(*COHORT, "entitlement_id").agg(F.count("*").alias("holders_in_cohort"))
    rated = counts.alias("c").join(sizes.alias("s"), same_columns("c", "s", COHORT)).select(
        *[F.col(f"c.{x}").alias(x) for x in COHORT], "c.entitlement_id", "holders_in_cohort", "cohort_size",
        (F.col("holders_in_cohort") / F.col("cohort_size")).alias("prevalence"))
    rare = rated.filter(F.col("prevalence") <= prevalence_ceiling)
    names = g.entitlements.select("entitlement_id", F.col("name").alias("entitlement_name"))
    rare = rare.join(names, "entitlement_id")
    hit = held.alias("h").join(rare.alias("r"), same_columns("h", "r", [*COHORT, "entitlement_id"])).select(
        "h.identity_id", "h.name", *[F.col(f"h.{x}").alias(x) for x in COHORT], "h.entitlement_id",
        "entitlement_name", "holders_in_cohort", "cohort_size", "prevalence")
    text = _text(
        F.col("name"), " (", F.col("title"), ", ", F.col("department"), ") holds '", F.col("entitlement_name"),
        "', held by only ", F.col("holders_in_cohort"), " of ", F.col("cohort_size"), " peers (",
        scoring.percent(F.col("prevalence")), ").")
    finding = _finding(
        "PRIVILEGED_PEER_OUTLIER", "identity", F.col("identity_id"),
        [F.lit(3), F.lit(3), F.lit(2), F.lit(1)], text)
    return hit.select("*", finding.alias("f")).select(
        "f.*", "entitlement_id", "holders_in_cohort", "cohort_size", "prevalence")


def same_columns(left: str, right: str, columns) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def sod_conflicts(g: Graph, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """People holding both sides of a rule pair; ``pairs`` is (rule, left text, right text)."""
    sides = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.lit(side).alias("side"), contains_ci(F.col("name"), pattern).alias("hit"))
        for i, (_, left, right) in enumerate(pairs) for side, pattern in ((1, left), (2, right))])
    matching = (
        g.entitlements.select("entitlement_id", F.inline(sides)).filter("hit").select("entitlement_id", "pair", "side"))
    held = g.grants.select("account_id", "entitlement_id").join(matching, "entitlement_id").join(_owned(g), "account_id")
    both = (
        held.groupBy("identity_id", "pair").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        .filter((F.col("lo") == 1) & (F.col("hi") == 2)))
    rule = F.element_at(F.array(*[F.lit(p[0]) for p in pairs]), F.col("pair") + 1)
    hit = both.join(g.identities.select("identity_id", "name", "lifecycle_status"), "identity_id").withColumn("rule", rule)
    finding = _finding(
        "SOD_CONFLICT", "identity", F.col("identity_id"),
        [F.lit(5), F.lit(1), scoring.points(F.col("lifecycle_status") == "active", 2), F.lit(2)],
        _text(F.col("name"), " holds both sides of a separation-of-duties conflict: ", F.col("rule"), "."))
    return hit.select("pair", "rule", finding.alias("f")).select("f.*", "pair", "rule")


def missing_managers(g: Graph, executive_department: str) -> DataFrame:
    people = g.identities.filter(
        (F.col("lifecycle_status") == "active") & (F.col("worker_type") == "employee")
        & F.col("manager_id").isNull() & (F.col("department") != executive_department))
    privileged = (
        privileged_grants(g).select("account_id").distinct().join(_owned(g), "account_id")
        .select("identity_id").distinct().withColumn("_priv", F.lit(True)))
    hit = people.join(privileged, "identity_id", "left")
    finding = _finding(
        "MISSING_MANAGER", "identity", F.col("identity_id"),
        [F.lit(3), scoring.points(F.col("_priv").isNotNull(), 2), F.lit(0), F.lit(0)],
        _text(F.col("name"), " has no manager on record; reviews fall back to the IAM queue."))
    return hit.select(finding.alias("f")).select("f.*")


def with_notable_grants(g: Graph, sod_pairs: list[tuple[str, str, str]]) -> Graph:
    """The graph cut down to grants a rule can use: privileged ones and both sides of the rule pairs.

    All rules then read one small table written by a single pass over the grants.
    """
    notable = F.col("privileged")
    for _, left, right in sod_pairs:
        notable = notable | contains_ci(F.col("name"), left) | contains_ci(F.col("name"), right)
    chosen = g.entitlements.filter(notable).select("entitlement_id")
    grants = g.grants.select("account_id", "entitlement_id").join(chosen, "entitlement_id", "left_semi")
    return replace(g, grants=cut_lineage(grants))


FINDING_COLUMNS = ("rule_code", "subject_type", "subject_id", "severity", "risk_score", *TERM_COLUMNS, "explanation")


def collapse(detail: DataFrame, order: list[Column]) -> DataFrame:
    """One finding per (rule, subject): the first by ``order``."""
    keys = ["rule_code", "subject_type", "subject_id"]
    return first_per_key(detail, keys, order).select(*FINDING_COLUMNS)


def all_findings(
    g: Graph, as_of: Column, sod_pairs: list[tuple[str, str, str]], executive_department: str,
    dormant_days: int = 180, min_cohort_size: int = 8, prevalence_ceiling: float = 0.10,
) -> DataFrame:
    """Union of the seven rules at one row per (rule, subject)."""
    g = with_notable_grants(g, sod_pairs)
    outliers = collapse(
        peer_outliers(g, min_cohort_size, prevalence_ceiling), [F.col("prevalence"), F.col("entitlement_id")])
    sod = collapse(sod_conflicts(g, sod_pairs), [F.col("pair")])
    return (
        account_findings(account_facts(g), as_of, dormant_days)
        .unionByName(outliers).unionByName(sod).unionByName(missing_managers(g, executive_department)))


def active_dispositions(dispositions: DataFrame, as_of: Column) -> DataFrame:
    """Latest disposition per finding key, kept only while it is valid; ties go to the earlier expiry."""
    newest = [F.desc("created_at"), F.asc_nulls_last("expires_at"), F.col("action")]
    latest = first_per_key(dispositions, ["finding_key"], newest)
    return latest.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).select("finding_key", "action")


def with_disposition(findings: DataFrame, dispositions: DataFrame, as_of: Column) -> DataFrame:
    key = scoring.finding_key(F.col("rule_code"), F.col("subject_type"), F.col("subject_id"))
    status = F.when(F.col("action") == "accept", "accepted").when(F.col("action").isNotNull(), "suppressed").otherwise("open")
    joined = findings.withColumn("finding_key", key).join(active_dispositions(dispositions, as_of), "finding_key", "left")
    return joined.withColumn("status", status).drop("action")


def upsert_findings(existing: DataFrame, current: DataFrame, resolve_vanished: bool = False) -> DataFrame:
    """Next finding table: unresolved rows are refreshed in place, resolved history is kept.

    A finding whose condition vanished keeps its status unless ``resolve_vanished`` is set.
    """
    history = existing.filter(F.col("status") == "resolved")
    live = existing.filter(F.col("status") != "resolved").withColumn("_side", F.lit(EXISTING))
    stacked = live.unionByName(current.withColumn("_side", F.lit(EXISTING + 1)))
    merged = first_per_key(stacked, ["finding_key"], [F.desc("_side")])
    if resolve_vanished:
        gone = F.col("_side") == EXISTING
        merged = merged.withColumn("status", F.when(gone, "resolved").otherwise(F.col("status")))
    return history.unionByName(merged.drop("_side"))


def top_findings(findings: DataFrame, n: int, rule: str | None = None) -> DataFrame:
    """Highest-scored open findings; ties in key order."""
    chosen = findings.filter(F.col("status") == "open")
    if rule is not None:
        chosen = chosen.filter(F.col("rule_code") == rule)
    return chosen.orderBy(F.desc("risk_score"), "finding_key").limit(n)


def findings_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_code").agg(
        F.count("*").alias("findings"), F.count_if(F.col("status") == "open").alias("open_findings"),
        F.max("risk_score").alias("max_score"))
