"""Ingest account feeds against a standardised roster.

Each function returns an ``Ingest``: one outcome row per source row plus the business rows it adds.
Accounts keep the last row per native id, entitlements the first, links and edges are unique.
The matched rows of a feed are written once as a table, and every output reads that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.functions import dates, text
from accessloom.operators import mentions, merge, sheets
from accessloom.operators.correlate import (
    CorrelationPolicy, candidate_ids, candidate_text, correlate, unique_holder)
from accessloom.operators.joins import lookup
from accessloom.session import cut_lineage

# Fixed values, defaults of the policy arguments: privilege policy, group nesting and service markers.
PRIVILEGED_PROFILES = ("System Administrator", "Sales Admin")
PRIVILEGED_PERMISSION_SETS = ("Revenue_Admin", "Data_Export")
PRIVILEGED_GROUPS = ("Admins",)
ADMIN_POLICIES = ("AdministratorAccess",)
PRIVILEGED_ROLES = ("Plant-Ops-Leads",)
GROUP_NESTING = (("Plant-Ops-Leads", "Manufacturing-All"), ("Manufacturing-All", "All-Employees"))
SERVICE_PREFIXES = ("svc-", "plant-shared-")
SERVICE_KEYWORDS = ("service", "ci", "automation", "integration")

# What may become of a directory row.
DIRECTORY_OUTCOMES = (
    ("normalized", "OK"), ("normalized", "AUTO_MATCHED"), ("normalized", "OK_SAM_MATCH"), ("normalized", "CONTRACTOR_CLASSIFIED"),
    ("normalized", "SERVICE_ACCOUNT_OWNER_RESOLVED"), ("quarantined", "CORRELATION_AMBIGUOUS"), ("quarantined", "UNOWNED_SERVICE_ACCOUNT"),
    ("quarantined", "ORPHANED_DIRECTORY_ACCOUNT"))


@dataclass(frozen=True)
class Ingest:
    records: DataFrame
    accounts: DataFrame
    entitlements: DataFrame | None = None
    grants: DataFrame | None = None
    edges: DataFrame | None = None
    identities: DataFrame | None = None
    aliases: DataFrame | None = None


@dataclass(frozen=True)
class Directory:
    """Known people: identities (identity_id, name, department, lifecycle_status) and their aliases."""

    identities: DataFrame
    aliases: DataFrame
    policy: CorrelationPolicy


ACCOUNT_COLUMNS = (
    "application", "native_id", "username", "account_type", "enabled", "last_activity_at", "owner_identity_id",
    "ownership_status", "source_line")


def _origin(feed: DataFrame) -> list[str]:
    """Where a row of a feed comes from: its file too, if the feed tells."""
    return [c for c in ("source_file", "source_line") if c in feed.columns]


def _row_name(feed: DataFrame) -> Column:
    """Unique per row, as line numbers repeat over files."""
    origin = _origin(feed)
    return F.concat_ws("#", *origin) if len(origin) > 1 else F.col("source_line")


def _latest_accounts(rows: DataFrame) -> DataFrame:
    """The last row per account, by file name and line."""
    origin = _origin(rows)
    columns = [*[c for c in origin if c not in ACCOUNT_COLUMNS], *ACCOUNT_COLUMNS]
    latest = [*[F.col(c) for c in origin], F.xxhash64(*ACCOUNT_COLUMNS)]
    return merge.upsert(None, rows.select(*columns), ["application", "native_id"], latest)


def _first_entitlements(rows: DataFrame) -> DataFrame:
    columns = ["application", "native_id", "name", "type", "privileged", "source_line"]
    kept = merge.insert_absent(None, rows.select(*columns), ["application", "native_id"], [F.col("source_line"), F.col("name")])
    return kept.drop("source_line")


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("application", "account_native_id", "entitlement_native_id").distinct()


def _records(rows: DataFrame, quarantined: Column, reason: Column, explanation: Column, candidates: Column) -> DataFrame:
    return rows.withColumn("stage", F.when(quarantined, "quarantined").otherwise("normalized")).withColumn(
        "reason_code", reason).withColumn("explanation", F.when(quarantined, explanation)).withColumn(
        "candidate_ids", F.when(quarantined, candidates))


def _unclear(what: str, who: Column) -> Column:
    return F.concat(
        F.lit(f"{what} "), who, F.lit(" did not match one known person with confidence. Candidates: "),
        candidate_text(F.col("candidates")))


def ingest_cloud_directory(feed: DataFrame, people: Directory, application: str = "Cloud Directory") -> Ingest:
    """Match on employee id, sign-in name and display name; keep the account either way."""
    parsed = feed.select(
        *_origin(feed), F.col("id").alias("account_key"), F.col("userPrincipalName").alias("username"),
        text.email_local(F.col("userPrincipalName")).alias("local_part"),
        text.email_domain(F.col("userPrincipalName")).alias("domain"), F.col("displayName").alias("display_name"),
        F.when(F.col("employeeId") != "", text.normalize_employee_id(F.col("employeeId"))).alias("employee_id"),
        F.coalesce("accountEnabled", F.lit(True)).alias("enabled"),
        dates.iso_timestamp(F.col("lastSignInDateTime")).alias("last_activity_at"))
    scored = correlate(parsed, people.identities, people.aliases, people.policy)
    matched = F.col("decision") == "auto_match"
    rows = cut_lineage(scored).select(
        "*", F.lit(application).alias("application"), F.col("account_key").alias("native_id"),
        F.lit("human").alias("account_type"), F.col("matched_identity_id").alias("owner_identity_id"),
        F.when(matched, "owned").otherwise("unresolved").alias("ownership_status"))
    reason = (
        F.when(matched, "AUTO_MATCHED").when(F.col("decision") == "quarantine", "CORRELATION_AMBIGUOUS")
        .otherwise("NO_IDENTITY_MATCH"))
    records = _records(
        rows, ~matched, reason, _unclear("Cloud user", F.col("username")), candidate_ids(F.col("candidates")))
    return Ingest(records, _latest_accounts(rows))


def classify_unmatched(description: Column, distinguished_name: Column, sam: Column) -> Column:
    """contractor, else service, else orphan; the short keyword ``ci`` matches inside words too."""
    described = F.lower(F.coalesce(description, F.lit("")))
    placed = F.lower(F.coalesce(distinguished_name, F.lit("")))
    account = F.lower(F.coalesce(sam, F.lit("")))
    contractor = F.contains(described, F.lit("contractor")) | F.contains(placed, F.lit("ou=contractors"))
    service = F.lit(False)
    for prefix in SERVICE_PREFIXES:
        service = service | F.startswith(account, F.lit(prefix))
    for keyword in SERVICE_KEYWORDS:
        service = service | F.contains(described, F.lit(keyword))
    return F.when(contractor, "contractor").when(service, "service").otherwise("orphan")


def contractor_key(sam: Column) -> Column:
    return F.concat(F.lit("contractor:"), F.lower(sam))


def ingest_directory(feed: DataFrame, people: Directory, application: str = "Directory") -> Ingest:
    """Match, fall back to the account name, then classify contractor / service / orphan."""
    parsed = feed.select(
        *_origin(feed), _row_name(feed).alias("account_key"), F.col("samAccountName").alias("sam"),
        F.col("userPrincipalName").alias("username"),
        text.email_local(F.col("userPrincipalName")).alias("local_part"),
        text.email_domain(F.col("userPrincipalName")).alias("domain"), F.col("displayName").alias("display_name"),
        F.lit(None).cast("string").alias("employee_id"), text.text_true(F.col("enabled")).alias("enabled"),
        dates.filetime_timestamp(F.col("lastLogonTimestamp")).alias("last_activity_at"),
        text.split_values(F.col("memberOf"), ";").alias("groups"), "description", "distinguishedName")
    scored = correlate(parsed, people.identities, people.aliases, people.policy)
    # Stored, so that its size is known to the join and accounts move only if it is large.
    by_sam = cut_lineage(unique_holder(people.aliases, "email_localpart").withColumnRenamed("value", "_local"))
    scored = lookup(scored.withColumn("_sam", F.lower("sam")), "_sam", by_sam, "_local", ["source_line"])

    matched = F.col("decision") == "auto_match"
    sam_match = ~matched & F.coalesce(F.col("holders") == 1, F.lit(False))
    ambiguous = ~matched & ~sam_match & (
        (F.col("decision") == "quarantine") | F.coalesce(F.col("holders") > 1, F.lit(False)))
    kind = F.when(
        ~(matched | sam_match | ambiguous),
        classify_unmatched(F.col("description"), F.col("distinguishedName"), F.col("sam")))
    scored = scored.withColumn("kind", kind).withColumn("ambiguous", ambiguous).withColumn("sam_match", sam_match)

    texts = scored.filter(F.col("kind") == "service").select(F.col("description").alias("text"))
    owners = mentions.first_mentioned(texts, people.identities).withColumnRenamed("identity_id", "mentioned_id")
    status = people.identities.select(
        F.col("identity_id").alias("mentioned_id"), F.col("lifecycle_status").alias("mentioned_status"))
    owners = cut_lineage(owners.join(status, "mentioned_id"))
    contractor, service = F.col("kind") == "contractor", F.col("kind") == "service"
    scored = lookup(
        scored.withColumn("_described", F.when(service, F.col("description"))), "_described", owners, "text", ["source_line"])
    # What follows from other columns is worked out by those who read it.
    scored = cut_lineage(scored.drop("_described", "_sam", "holders"))

    owner = (
        F.when(F.col("decision") == "auto_match", F.col("matched_identity_id"))
        .when(F.col("sam_match"), F.col("holder_id"))
        .when(contractor, contractor_key(F.col("sam"))).when(service, F.col("mentioned_id")))
    ownership = (
        F.when((F.col("decision") == "auto_match") | F.col("sam_match"), "owned").when(contractor, "contractor")
        .when(service & (F.col("mentioned_status") == "terminated"), "service_owned_by_terminated")
        .when(service & F.col("mentioned_id").isNotNull(), "service_owned").when(F.col("kind") == "orphan", "orphan")
        .otherwise("unresolved"))
    rows = scored.select(
        "*", F.lit(application).alias("application"), F.col("sam").alias("native_id"),
        F.when(service, "service").otherwise("human").alias("account_type"), owner.alias("owner_identity_id"),
        ownership.alias("ownership_status"))
    service_owned = service & F.col("mentioned_id").isNotNull()
    reason = (
        F.when(F.col("decision") == "auto_match", "OK").when(F.col("sam_match"), "OK_SAM_MATCH")
        .when(F.col("ambiguous"), "CORRELATION_AMBIGUOUS").when(contractor, "CONTRACTOR_CLASSIFIED")
        .when(service_owned, "SERVICE_ACCOUNT_OWNER_RESOLVED").when(service, "UNOWNED_SERVICE_ACCOUNT")
        .otherwise("ORPHANED_DIRECTORY_ACCOUNT"))
    quarantined = F.col("ambiguous") | (F.col("kind") == "orphan") | (service & ~service_owned)
    explanation = (
        F.when(F.col("ambiguous"), _unclear("Directory account", F.col("sam")))
        .when(service, F.concat(F.lit("Service account "), F.col("sam"), F.lit(" names no known owner.")))
        .otherwise(F.concat(F.lit("Account "), F.col("sam"), F.lit(" has no person, contractor or service evidence."))))
    records = _records(
        rows, F.coalesce(quarantined, F.lit(False)), reason, explanation, candidate_ids(F.col("candidates")))

    member = rows.select("source_line", "application", F.col("sam").alias("account_native_id"), F.explode("groups").alias("group"))
    nesting = feed.sparkSession.createDataFrame(list(GROUP_NESTING), "child string, parent string")
    structure = nesting.select(F.explode(F.array("child", "parent")).alias("group")).distinct().select(
        F.lit(0).alias("source_line"), F.lit(application).alias("application"), "group")
    groups = member.select("source_line", "application", "group").unionByName(structure).select(
        "source_line", "application", F.col("group").alias("native_id"), F.col("group").alias("name"),
        F.lit("group").alias("type"), F.lit(False).alias("privileged"))
    contractors = rows.filter(contractor).select(
        F.col("owner_identity_id").alias("identity_id"), F.col("display_name").alias("name"), F.lower("sam").alias("sam"),
        "source_line")
    contractors = merge.insert_absent(None, contractors, ["identity_id"], [F.col("source_line")])
    return Ingest(
        records, _latest_accounts(rows), _first_entitlements(groups),
        _links(member.withColumn("entitlement_native_id", F.col("group"))),
        nesting.select(F.lit(application).alias("application"), F.col("parent").alias("parent_native_id"),
                       F.col("child").alias("child_native_id"), F.lit("nested_group").alias("relationship")),
        contractors.select("identity_id", "name", F.lit("contractor").alias("worker_type"),
                           F.lit("active").alias("lifecycle_status")),
        contractors.select("identity_id", F.lit("directory_sam").alias("alias_type"), F.col("sam").alias("value")))


def ingest_crm(feed: DataFrame, people: Directory, primary_domain: str, application: str = "CRM") -> Ingest:
    """Match on email and name; access is kept whether or not the person is known."""
    parsed = feed.select(
        *_origin(feed), _row_name(feed).alias("account_key"), "username",
        text.email_local(F.col("email")).alias("local_part"), text.email_domain(F.col("email")).alias("domain"),
        F.col("name").alias("display_name"), F.lit(None).cast("string").alias("employee_id"),
        text.text_true(F.col("is_active")).alias("enabled"),
        dates.iso_timestamp(F.col("last_login")).alias("last_activity_at"), "profile", "permission_sets")
    scored = correlate(parsed, people.identities, people.aliases, people.policy)
    matched = F.col("decision") == "auto_match"
    rows = cut_lineage(scored).select(
        "*", F.lit(application).alias("application"), F.col("username").alias("native_id"),
        F.lit("human").alias("account_type"), F.col("matched_identity_id").alias("owner_identity_id"),
        F.when(matched, "owned").otherwise("unresolved").alias("ownership_status"))
    reason = (
        F.when(matched, "OK").when((F.col("domain") != "") & (F.col("domain") != primary_domain), "CORRELATION_LEGACY_DOMAIN")
        .when(F.col("decision") == "quarantine", "CORRELATION_AMBIGUOUS").otherwise("NO_IDENTITY_MATCH"))
    records = _records(rows, ~matched, reason, _unclear("CRM user", F.col("username")), candidate_ids(F.col("candidates")))
    access = crm_access(feed, application)
    return Ingest(records, _latest_accounts(rows), _first_entitlements(access), _links(access))


def crm_access(feed: DataFrame, application: str = "CRM") -> DataFrame:
    """Profile and permission-set grants of every CRM user row."""
    profile = F.array(F.struct(
        F.concat(F.lit("profile:"), F.col("profile")).alias("native_id"), F.col("profile").alias("name"),
        F.lit("profile").alias("type"), F.col("profile").isin(*PRIVILEGED_PROFILES).alias("privileged")))
    sets = F.transform(text.split_values(F.col("permission_sets"), "|"), lambda p: F.struct(
        F.concat(F.lit("permset:"), p).alias("native_id"), p.alias("name"),
        F.lit("permission_set").alias("type"), p.isin(*PRIVILEGED_PERMISSION_SETS).alias("privileged")))
    granted = feed.select("source_line", F.col("username").alias("account_native_id"), F.inline(F.concat(profile, sets)))
    return granted.withColumn("application", F.lit(application)).withColumn("entitlement_native_id", F.col("native_id"))


def role_edges(roles: DataFrame) -> DataFrame:
    """(child, parent) of assume-role chains: each caller reaches the next role in its chain."""
    chain, n = F.col("assume_role_chain"), F.size("assume_role_chain")
    steps = F.arrays_zip(F.slice(chain, F.lit(1), n - 1).alias("child"), F.slice(chain, F.lit(2), n - 1).alias("parent"))
    return roles.filter(chain.isNotNull() & (n > 1)).select(F.inline(steps)).toDF("child", "parent").distinct()


def ingest_cloud_iam(users: DataFrame, roles: DataFrame, people: Directory, application: str = "Cloud IAM") -> Ingest:
    """Own a user when its name is the local part of exactly one person; case matters here."""
    keys = F.coalesce(F.array_max(F.transform("access_keys", lambda k: k["created_days_ago"])), F.lit(0))
    holders = unique_holder(people.aliases, "email_localpart").withColumnRenamed("value", "_local")
    rows = lookup(users.withColumn("oldest_key_days", keys), "username", holders, "_local", ["source_line"])
    owned = F.coalesce(F.col("holders") == 1, F.lit(False))
    crowded = F.coalesce(F.col("holders") > 1, F.lit(False))
    rows = rows.select(
        *_origin(users), "username", "arn", "groups", "oldest_key_days", F.coalesce("holders", F.lit(0)).alias("holders"),
        F.lit(application).alias("application"), F.col("arn").alias("native_id"), F.lit(True).alias("enabled"),
        F.lit(None).cast("timestamp").alias("last_activity_at"),
        F.when(owned, "human").otherwise("unknown").alias("account_type"),
        F.when(owned, F.col("holder_id")).alias("owner_identity_id"),
        F.when(owned, "owned").otherwise("unresolved").alias("ownership_status"))
    reason = (
        F.when(F.col("holders") == 1, "OK").when(F.col("holders") > 1, "CORRELATION_AMBIGUOUS")
        .otherwise("UNOWNED_NON_HUMAN_IDENTITY"))
    explanation = F.when(
        F.col("holders") > 1, F.concat(F.lit("User "), F.col("username"), F.lit(" matches several people.")),
    ).otherwise(F.concat(
        F.lit("User "), F.col("username"), F.lit(" matches nobody; oldest key age "),
        F.col("oldest_key_days").cast("string"), F.lit(" days.")))
    records = _records(rows, F.col("holders") != 1, reason, explanation, F.lit(None).cast("array<string>"))
    member = rows.select(
        "source_line", "application", F.col("native_id").alias("account_native_id"), F.explode("groups").alias("name"))
    groups = member.select(
        "source_line", "application", F.concat(F.lit("group:"), F.col("name")).alias("native_id"), "name",
        F.lit("group").alias("type"), F.col("name").isin(*PRIVILEGED_GROUPS).alias("privileged"))
    role_rows = roles.select(
        F.lit(0).alias("source_line"), F.lit(application).alias("application"),
        F.concat(F.lit("role:"), F.col("role_name")).alias("native_id"), F.col("role_name").alias("name"),
        F.lit("role").alias("type"),
        F.exists("attached_policies", lambda p: p.isin(*ADMIN_POLICIES)).alias("privileged"))
    edges = role_edges(roles).select(
        F.lit(application).alias("application"), F.concat(F.lit("role:"), F.col("parent")).alias("parent_native_id"),
        F.concat(F.lit("role:"), F.col("child")).alias("child_native_id"), F.lit("assume_role").alias("relationship"))
    return Ingest(
        records, _latest_accounts(rows), _first_entitlements(groups.unionByName(role_rows)),
        _links(member.withColumn("entitlement_native_id", F.concat(F.lit("group:"), F.col("name")))), edges)


def ingest_spreadsheet(
    cells: DataFrame, people: Directory, context_department: str, application: str = "Spreadsheet",
    headers: Sequence[str] = sheets.EXPECTED_HEADERS,
) -> Ingest:
    """Rows of the newest sheet, matched by name only; rows of other sheets are quarantined as stale.

    A workbook without any header is an error; single sheets without one are not access lists and are left out.
    """
    layout = cut_lineage(sheets.sheet_layout(cells, headers))
    if layout.isEmpty():
        raise ValueError("no sheet of the workbook has the expected header")
    ranked = sheets.elect_primary(layout)
    rows = sheets.sheet_rows(cells, layout).join(ranked.select("sheet", "is_primary"), "sheet")
    rows = rows.select(
        "sheet", F.col("row").alias("source_line"), "is_primary", text.strip(F.coalesce("employee name", F.lit(""))).alias("raw_name"),
        text.strip(F.coalesce("role", F.lit(""))).alias("role"))
    rows = cut_lineage(rows)
    asked = rows.filter("is_primary").select("raw_name").distinct()
    resolved = sheets.resolve_names(asked, people.identities)
    rows = lookup(
        rows.withColumn("_asked", F.when(F.col("is_primary"), F.col("raw_name"))), "_asked",
        resolved.withColumnRenamed("raw_name", "_resolved_name"), "_resolved_name", ["sheet", "source_line"])
    found = F.col("identity_id").isNotNull()
    in_context = (F.col("match_rule") == "email_localpart_exact") | (
        F.coalesce(F.col("department"), F.lit("")) == context_department)
    reason = (
        F.when(~F.col("is_primary"), "STALE_WORKSHEET_EXCLUDED").when(~found, "NAME_MATCH_AMBIGUOUS")
        .when(~in_context, "NAME_MATCH_MISSING_ROLE_CONTEXT").otherwise("OK"))
    rows = rows.withColumn("reason_code", reason)
    accepted = F.col("reason_code") == "OK"
    rows = rows.select(
        "*", F.lit(application).alias("application"),
        F.when(accepted, F.concat(F.lit("sheet:"), F.col("identity_id").cast("string"))).alias("native_id"),
        F.col("raw_name").alias("username"), F.lit("human").alias("account_type"), F.lit(True).alias("enabled"),
        F.lit(None).cast("timestamp").alias("last_activity_at"),
        F.when(accepted, F.col("identity_id")).alias("owner_identity_id"), F.lit("owned").alias("ownership_status"))
    explanation = (
        F.when(~F.col("is_primary"), F.concat(F.lit("Sheet "), F.col("sheet"), F.lit(" is older than the primary sheet.")))
        .when(F.col("reason_code") == "NAME_MATCH_AMBIGUOUS",
              F.concat(F.lit("Name "), F.col("raw_name"), F.lit(" has no unique confident match.")))
        .otherwise(F.concat(F.lit("Name "), F.col("raw_name"), F.lit(f" matches someone outside {context_department}."))))
    records = _records(
        rows, ~accepted, F.col("reason_code"), explanation,
        F.when(found, F.array(F.col("identity_id").cast("string"))))
    kept = rows.filter(accepted)
    access = kept.select(
        "source_line", "application", F.col("native_id").alias("account_native_id"),
        F.concat(F.lit("role:"), F.col("role")).alias("native_id"), F.col("role").alias("name"), F.lit("role").alias("type"),
        F.col("role").isin(*PRIVILEGED_ROLES).alias("privileged"))
    return Ingest(
        records, _latest_accounts(kept), _first_entitlements(access),
        _links(access.withColumn("entitlement_native_id", F.col("native_id"))))


def ingest_all(
    spark_feeds: dict[str, DataFrame], people: Directory, primary_domain: str, context_department: str
) -> dict[str, Ingest]:
    """All account feeds against one roster, in fixed order; a missing feed stops the load.

    Later feeds see the contractors the directory feed adds, as a published table.
    """
    needed = ("cloud_directory", "directory", "crm", "iam_users", "iam_roles", "cells")
    missing = [name for name in needed if name not in spark_feeds]
    if missing:
        raise ValueError(f"missing input feeds: {missing}")
    result = {
        "cloud_directory": ingest_cloud_directory(spark_feeds["cloud_directory"], people),
        "directory": ingest_directory(spark_feeds["directory"], people)}
    contractors = result["directory"]
    known = replace(
        people,
        identities=people.identities.unionByName(cut_lineage(contractors.identities), allowMissingColumns=True),
        aliases=people.aliases.unionByName(cut_lineage(contractors.aliases)))
    result["crm"] = ingest_crm(spark_feeds["crm"], known, primary_domain)
    result["cloud_iam"] = ingest_cloud_iam(spark_feeds["iam_users"], spark_feeds["iam_roles"], known)
    result["spreadsheet"] = ingest_spreadsheet(spark_feeds["cells"], known, context_department)
    return result
