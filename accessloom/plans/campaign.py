"""Access-review campaigns: launch gate, review items, decisions, revocations, progress, evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.operators.graph import route_reviewers
from accessloom.operators.joins import lookup
from accessloom.operators.quality import source_health
from accessloom.operators.rank import first_per_key
from accessloom.session import cut_lineage

# Fixed value: the label of the export.
UNASSIGNED = "UNASSIGNED -- IAM fallback queue"


def launch_gate(
    applications: DataFrame, runs: DataFrame, as_of: Column, sla_hours: float = 24, allow_stale: bool = False
) -> DataFrame:
    """Per application: the newest successful run of its source, and whether a campaign may start."""
    health = source_health(runs, applications.select("source_system").distinct(), as_of, sla_hours)
    stale, missing = F.col("stale"), F.col("watermark_run_id").isNull()
    verdict = (
        F.when(missing, "NO_SUCCESSFUL_RUN").when(stale & F.lit(not allow_stale), "STALE_SOURCE")
        .when(stale, "LAUNCH_STALE_OVERRIDE").otherwise("LAUNCH"))
    return applications.join(health, "source_system").select(
        "application", "source_system", "watermark_run_id", "hours_since_last_success", "stale", verdict.alias("verdict"))


def require_launchable(gate: DataFrame, application: str) -> None:
    """Raise unless the gate lets a campaign on ``application`` start."""
    row = gate.filter(F.col("application") == application).select("verdict").first()
    if row is None or not row["verdict"].startswith("LAUNCH"):
        raise ValueError(f"campaign on {application} refused: {row['verdict'] if row else 'UNKNOWN_APPLICATION'}")


def review_items(accounts: DataFrame, grants: DataFrame, identities: DataFrame, application: str) -> DataFrame:
    """One item per grant of an owned account of the application, routed to its reviewer.

    A campaign reviews the population at launch, so its items are written once as a table.
    """
    scoped = accounts.filter((F.col("application") == application) & F.col("owner_id").isNotNull()).select(
        "account_id", F.col("owner_id").alias("identity_id"))
    items = grants.select("account_id", "entitlement_id").join(scoped, "account_id").distinct()
    return cut_lineage(items.join(route_reviewers(identities).drop("truncated"), "identity_id"))


@dataclass(frozen=True)
class Decided:
    items: DataFrame
    rejected: DataFrame
    audit: DataFrame
    revocations: DataFrame


ITEM = ("account_id", "entitlement_id")


def decide(items: DataFrame, decisions: DataFrame, decided_at: Column, order: Sequence[str] = ()) -> Decided:
    """Apply reviewer decisions; a revoke without a reason is rejected and the item stays open.

    An item carries its last decision by ``order`` (then by decision, reason and actor); the audit keeps all of them.
    """
    no_reason = (F.col("decision") == "revoke") & (F.coalesce("reason", F.lit("")) == "")
    rejected = decisions.filter(no_reason)
    valid = decisions.filter(F.col("decision").isNotNull() & ~no_reason).join(items.select(*ITEM), list(ITEM), "left_semi")
    last = first_per_key(valid, ITEM, [F.desc(c) for c in (*order, "decision", "reason", "actor")])
    decided = items.join(last.select(*ITEM, "decision", "reason", "actor"), list(ITEM), "left").withColumn(
        "decided_at", F.when(F.col("decision").isNotNull(), decided_at))
    audit = valid.select(
        F.col("actor"), F.concat(F.lit("review_decision:"), "decision").alias("action"),
        F.lit("review_item").alias("object_type"),
        F.concat_ws("/", F.col("account_id").cast("string"), "entitlement_id").alias("object_id"), "reason", *order)
    revocations = decided.filter(F.col("decision") == "revoke").select(*ITEM, F.lit("pending").alias("execution_status"))
    return Decided(decided, rejected, audit, revocations)


def execute_revocations(revocations: DataFrame, grants: DataFrame, executed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks, remaining grants): pending tasks are executed with proof, also when the grant is gone."""
    pending = F.col("execution_status") == "pending"
    links = grants.select(*ITEM).join(revocations.select(*ITEM), list(ITEM), "left_semi").distinct().withColumn("_held", F.lit(True))
    tasks = revocations.join(links, list(ITEM), "left").select(
        *ITEM, F.when(pending, "executed").otherwise(F.col("execution_status")).alias("execution_status"),
        (pending & F.col("_held").isNotNull()).alias("grant_removed"), F.when(pending, executed_at).alias("executed_at"))
    removed = revocations.filter(pending).select(*ITEM)
    return tasks, grants.join(removed, list(ITEM), "left_anti")


def progress(items: DataFrame) -> DataFrame:
    """Total, decided, pending, unassigned and per-decision counts in one pass."""
    decided = F.col("decision").isNotNull()
    return items.agg(
        F.count("*").alias("total"), F.count_if(decided).alias("decided"), F.count_if(~decided).alias("pending"),
        F.count_if(F.col("reviewer_id").isNull()).alias("unassigned"),
        *[F.count_if(F.col("decision") == d).alias(f"{d}_count") for d in ("approve", "revoke", "delegate")])


def evidence_head(pack: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` rows of a pack by identity and entitlement, each with the number of all rows.

    The rows are those of a top-n that every task cuts to ``n``; the pack is stored, so its count is a second read only.
    """
    stored = cut_lineage(pack)
    first = ("identity", "entitlement", "account_id", "entitlement_id")
    return stored.orderBy(*[F.asc_nulls_first(c) for c in first]).limit(n).withColumn("total", F.lit(stored.count()))


def evidence_pack(items: DataFrame, identities: DataFrame, entitlements: DataFrame, tasks: DataFrame) -> DataFrame:
    """Who reviewed what, the decision and what came of it, one row per item."""
    people = identities.select(F.col("identity_id"), F.col("name").alias("identity"))
    reviewers = identities.select(F.col("identity_id").alias("_reviewer"), F.col("name").alias("reviewer_name"))
    names = entitlements.select("entitlement_id", F.col("name").alias("entitlement"))
    pack = items.join(people, "identity_id").join(names, "entitlement_id").join(
        tasks.select(*ITEM, "execution_status"), list(ITEM), "left")
    pack = lookup(pack, "reviewer_id", reviewers, "_reviewer", ["account_id"])
    return pack.select(
        "account_id", "entitlement_id", "identity", "entitlement", "reviewer_route",
        F.coalesce("reviewer_name", F.lit(UNASSIGNED)).alias("reviewer"),
        F.coalesce("decision", F.lit("PENDING")).alias("decision"), "reason",
        F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"),
        F.coalesce("execution_status", F.lit("n/a")).alias("revocation_executed"))
