"""What is known after each load: existing snapshots and one loaded feed give the next snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from accessloom.operators import keys, merge
from accessloom.plans.ingest import Ingest

#: How critical an application is until someone says otherwise.
STANDARD = "standard"
QUARANTINE_KEYS = ("feed", "source_file", "source_sheet", "source_line", "reason_code")


@dataclass(frozen=True)
class State:
    accounts: DataFrame
    entitlements: DataFrame | None = None
    grants: DataFrame | None = None
    edges: DataFrame | None = None
    identities: DataFrame | None = None
    aliases: DataFrame | None = None
    quarantine: DataFrame | None = None
    applications: DataFrame | None = None


def quarantine_rows(records: DataFrame, feed: str) -> DataFrame:
    """Quarantined rows of a load as open cases, named by where they stand."""
    def origin(name: str, found: str):
        return (F.col(found) if found in records.columns else F.lit(None)).cast("string").alias(name)

    none = F.lit(None).cast("string")
    return records.filter(F.col("stage") == "quarantined").select(
        F.lit(feed).alias("feed"), origin("source_file", "source_file"), origin("source_sheet", "sheet"),
        F.col("source_line").cast("bigint").alias("source_line"), "reason_code", "explanation",
        F.array_join(F.transform("candidate_ids", lambda c: c.cast("string")), ",").alias("candidate_ids"), F.lit("open").alias("status"),
        none.alias("resolution"), none.alias("resolved_by"), none.alias("resolved_at"))


def _added(existing: DataFrame | None, incoming: DataFrame | None, keys: tuple[str, ...]) -> DataFrame | None:
    """Existing rows as they are and incoming rows of new keys; history is only read for its keys."""
    if incoming is None:
        return existing
    new = merge.insert_absent(None, incoming, keys)
    if existing is None:
        return new
    return existing.unionByName(new.join(existing.select(*keys), merge.same_key(new, existing, keys), "left_anti"), allowMissingColumns=True)


def next_state(state: State | None, loaded: Ingest, feed: str) -> State:
    """Load a feed over a state. Loading the same feed again changes nothing.

    The last load of an account counts; entitlements, grants, edges, people and aliases keep their first row; an open
    case takes the new explanation and a resolved one stays resolved. An application gets its id when it is first seen.
    """
    old = state or State(loaded.accounts.limit(0))
    fresh = quarantine_rows(loaded.records, feed)
    applications = loaded.accounts.select("application").distinct().select(
        "application", F.lit(feed).alias("source_system"), F.lit(STANDARD).alias("criticality"))
    return State(
        merge.upsert(old.accounts, loaded.accounts, ["application", "native_id"], [F.col("source_line")]),
        _added(old.entitlements, loaded.entitlements, ("application", "native_id")),
        _added(old.grants, loaded.grants, ("application", "account_native_id", "entitlement_native_id")),
        _added(old.edges, loaded.edges, ("application", "parent_native_id", "child_native_id", "relationship")),
        _added(old.identities, loaded.identities, ("identity_id",)),
        _added(old.aliases, loaded.aliases, ("identity_id", "alias_type", "value")),
        merge.merge_quarantine(old.quarantine if old.quarantine is not None else fresh.limit(0), fresh, QUARANTINE_KEYS),
        keys.get_or_create(old.applications, applications, ("application",), "application_id"))


def merge_people(existing: DataFrame, incoming: DataFrame, kept: tuple[str, ...] = ("manager_id",)) -> DataFrame:
    """Next roster snapshot: the incoming row of a person counts, but ``kept`` columns stay as they were."""
    before = existing.select("identity_id", F.struct(*kept).alias("_before"))
    joined = incoming.join(before, "identity_id", "left")
    for c in kept:
        joined = joined.withColumn(c, F.when(F.col("_before").isNotNull(), F.col(f"_before.{c}")).otherwise(F.col(c)))
    updated = joined.select(*incoming.columns)
    return existing.join(incoming.select("identity_id"), "identity_id", "left_anti").unionByName(updated, allowMissingColumns=True)
