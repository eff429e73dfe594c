"""Why / why-not explanations, run differences and the executive summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from accessloom.functions.text import contains_ci
from accessloom.operators.graph import effective_access, path_text


def why_not(identities: DataFrame, items: DataFrame, accounts: DataFrame, grants: DataFrame, application: str) -> DataFrame:
    """For everyone: in the campaign, or the first reason that keeps them out."""
    counts = items.groupBy("identity_id").agg(F.count("*").alias("review_items"))
    scoped = accounts.filter((F.col("application") == application) & F.col("owner_id").isNotNull())
    granted = grants.select("account_id").distinct().withColumn("_granted", F.lit(True))
    owned = scoped.join(granted, "account_id", "left").groupBy(F.col("owner_id").alias("identity_id")).agg(
        F.count("*").alias("app_accounts"), F.count_if(F.col("_granted").isNull()).alias("empty_accounts"))
    joined = identities.select("identity_id", "name").join(counts, "identity_id", "left").join(owned, "identity_id", "left")
    reason = (
        F.when(F.col("review_items") > 0, "IN_CAMPAIGN").when(F.col("app_accounts").isNull(), "NO_ACCOUNT")
        .when(F.col("empty_accounts") > 0, "NO_ENTITLEMENTS").otherwise("AFTER_WATERMARK"))
    return joined.select(
        "identity_id", "name", F.coalesce("review_items", F.lit(0)).alias("review_items"), reason.alias("reason_code"))


def why(accounts: DataFrame, grants: DataFrame, entitlements: DataFrame, edges: DataFrame, entitlement_text: str) -> DataFrame:
    """Access to entitlements whose name contains the text, and how it came about. Only grants that lead there are read on."""
    access = effective_access(accounts, grants, entitlements, edges, wanted=contains_ci(F.col("name"), entitlement_text))
    how = F.when(F.col("grant_type") == "direct", "direct grant").otherwise(path_text(F.col("path_names")))
    return access.select(
        "identity_id", "account_id", "application", "granted_id", "entitlement_id", "entitlement_name", how.alias("how"))


def identity_360(
        identities: DataFrame, accounts: DataFrame, grants: DataFrame, entitlements: DataFrame, edges: DataFrame,
        name_text: str) -> DataFrame:
    """All access of the people whose name contains the text. Accounts of others are left out before grants are joined."""
    people = identities.filter(contains_ci(F.col("name"), name_text)).select(
        "identity_id", "name", "title", "department", "lifecycle_status")
    theirs = accounts.join(people.select(F.col("identity_id").alias("owner_id")), "owner_id", "left_semi")
    return effective_access(theirs, grants, entitlements, edges).join(people, "identity_id").select(
        "identity_id", "name", "title", "department", "lifecycle_status", "account_id", "application",
        "entitlement_name", "entitlement_type", path_text(F.col("path_names")).alias("how"))


def diff_runs(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per (stage, reason code) on both sides of each (run_a, run_b) and their difference."""
    side = F.inline(F.array(
        F.struct(F.col("run_a").alias("run_id"), F.lit(0).alias("is_b")),
        F.struct(F.col("run_b").alias("run_id"), F.lit(1).alias("is_b"))))
    counted = pairs.select("run_a", "run_b", side).join(metrics, "run_id").groupBy("run_a", "run_b", "stage", "reason_code").agg(
        F.coalesce(F.sum(F.when(F.col("is_b") == 0, F.col("row_count"))), F.lit(0)).alias("count_a"),
        F.coalesce(F.sum(F.when(F.col("is_b") == 1, F.col("row_count"))), F.lit(0)).alias("count_b"))
    return counted.withColumn("delta", F.col("count_b") - F.col("count_a"))


def executive_value(accounts: DataFrame, identities: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """Closed and open accounts of terminated people, revocations decided and open findings."""
    gone = identities.filter(F.col("lifecycle_status") == "terminated").select(F.col("identity_id").alias("owner_id"))
    terminated = accounts.join(gone, "owner_id").agg(
        F.count_if(~F.col("enabled")).alias("terminated_closed"), F.count_if("enabled").alias("terminated_open"))
    revoked = items.agg(F.count_if(F.col("decision") == "revoke").alias("revoked"))
    open_findings = findings.agg(F.count_if(F.col("status") == "open").alias("open_findings"))
    parts = terminated.unionByName(revoked, allowMissingColumns=True).unionByName(open_findings, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def open_quarantine(quarantine: DataFrame, n: int = 200) -> DataFrame:
    return quarantine.filter(F.col("status") == "open").orderBy("reason_code", "source_line").limit(n)
