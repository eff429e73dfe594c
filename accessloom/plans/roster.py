"""Standardise an HR roster: one outcome and one reason code per source row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.functions import dates, text
from accessloom.operators.joins import lookup
from accessloom.operators.rank import position_in_group
from accessloom.session import cut_lineage

MALFORMED = "MALFORMED_CSV_ROW"
COLLISION = "EMPLOYEE_ID_COLLISION"


def _row_key(df: DataFrame) -> list[str]:
    """Line numbers count per file, so feeds of several files are keyed by both."""
    return [c for c in ("source_line", "source_file") if c in df.columns]


def _parsed(raw: DataFrame) -> DataFrame:
    termination = dates.flexible_date(F.col("termination_date"))
    left = termination.isNotNull() | (F.col("status") == "Terminated")
    manager = text.strip(F.coalesce("manager_employee_id", F.lit("")))
    return raw.filter(~F.col("malformed")).select(
        *_row_key(raw), text.normalize_employee_id(F.col("employee_id")).alias("norm_id"),
        F.col("full_name").alias("name"), text.normalize_name(F.col("full_name")).alias("norm_name"),
        F.lower(text.strip(F.col("work_email"))).alias("email"),
        text.email_local(F.col("work_email")).alias("email_localpart"),
        text.email_domain(F.col("work_email")).alias("_domain"), "title", "department", "location",
        dates.flexible_date(F.col("hire_date")).alias("hire_date"),
        dates.flexible_date_error(F.col("hire_date")).alias("hire_date_error"),
        termination.alias("termination_date"),
        F.when(left, "terminated").otherwise("active").alias("lifecycle_status"),
        (termination.isNotNull() & (F.col("status") == "Active")).alias("status_date_conflict"),
        F.when(manager != "", text.normalize_employee_id(manager)).alias("manager_norm_id"))


def _collided(parsed: DataFrame, corporate_domain: str) -> DataFrame:
    """Members of every shared employee id: group facts, position, and whether all are provably different."""
    shared = parsed.groupBy("norm_id").agg(F.count("*").alias("n")).filter("n > 1").select("norm_id")
    members = parsed.select("norm_id", *_row_key(parsed), "email", "norm_name", "_domain").join(shared, "norm_id", "left_semi")
    members = cut_lineage(members)
    groups = members.groupBy("norm_id").agg(
        F.count("*").alias("group_size"), F.count_distinct("email").alias("emails"),
        F.count_distinct("norm_name").alias("names"), F.bool_and(F.col("_domain") == corporate_domain).alias("corporate"))
    distinct_people = (F.col("emails") == F.col("group_size")) & (F.col("names") == F.col("group_size"))
    members = members.drop("_domain").join(
        groups.withColumn("resolvable", distinct_people & F.col("corporate")), "norm_id")
    return position_in_group(members, ["norm_id"], "source_line", "group_index", _row_key(parsed)[1:])


def roster_collisions(raw: DataFrame, corporate_domain: str) -> DataFrame:
    """Members of every shared employee id with their position, one row each."""
    return _collided(_parsed(raw), corporate_domain)


def standardise_roster(raw: DataFrame, corporate_domain: str) -> DataFrame:
    """One row per source row: standardised person, manager link, stage and reason code.

    ``raw`` has the roster columns as text plus source_line and the ragged-row flag ``malformed``.
    ``canonical_employee_id`` is null when no person is built for the row.
    """
    parsed, row_key = _parsed(raw), _row_key(raw)
    members = cut_lineage(_collided(parsed, corporate_domain).select(
        *row_key, "group_size", "resolvable", "group_index"))
    rows = parsed.join(members, row_key, "left")
    suffix = F.when(F.col("group_index") > 0, F.concat(F.lit("-DUP"), F.col("group_index").cast("string"))).otherwise("")
    blocked = F.col("group_size").isNotNull() & ~F.col("resolvable")
    rows = rows.withColumn("canonical_employee_id", F.when(~blocked, F.concat("norm_id", suffix)))

    # A shared id resolves to its last built member, as later rows overwrite earlier ones.
    managers = (
        rows.filter(F.col("canonical_employee_id").isNotNull()).groupBy(F.col("norm_id").alias("_manager_key"))
        .agg(F.max_by(F.struct("canonical_employee_id", "lifecycle_status"), F.struct(*row_key)).alias("_manager")))
    rows = lookup(rows, "manager_norm_id", managers, "_manager_key", row_key)
    linked = F.col("_manager.canonical_employee_id")
    built = F.col("canonical_employee_id").isNotNull()
    reason = (
        F.when(blocked, "EMPLOYEE_ID_COLLISION_UNRESOLVED")
        .when(F.col("group_size").isNotNull(), "EMPLOYEE_ID_COLLISION_RESOLVED")
        .when(F.col("status_date_conflict"), "SOURCE_STATUS_DATE_CONFLICT")
        .when(F.col("manager_norm_id").isNull(), "MISSING_MANAGER")
        .when(linked.isNull(), "MANAGER_NOT_FOUND_IN_BATCH")
        .when(F.col("_manager.lifecycle_status") == "terminated", "MANAGER_TERMINATED")
        .otherwise("OK"))
    collided = F.col("group_size").isNotNull()
    outcome = rows.select(
        *row_key, "canonical_employee_id", "norm_id", "name", "norm_name", "email", "email_localpart", "title",
        "department", "location", "hire_date", "hire_date_error", "termination_date", "lifecycle_status",
        "status_date_conflict", F.when(built, linked).alias("manager_employee_id"),
        F.when(collided, "quarantined").otherwise("normalized").alias("stage"), reason.alias("reason_code"),
        F.when(collided, F.lit(COLLISION)).alias("quarantine_reason"),
        F.when(blocked, "open").when(collided, "resolved").alias("quarantine_status"),
        F.when(F.col("group_index") > 0, F.col("norm_id")).alias("disputed_employee_id"),
        "group_size")
    malformed = raw.filter("malformed").select(
        *row_key, F.lit("quarantined").alias("stage"), F.lit(MALFORMED).alias("reason_code"),
        F.lit(MALFORMED).alias("quarantine_reason"), F.lit("open").alias("quarantine_status"))
    return outcome.unionByName(malformed, allowMissingColumns=True)


def identities(records: DataFrame) -> DataFrame:
    """People built by a standardised roster, keyed by canonical employee id."""
    return records.filter(F.col("canonical_employee_id").isNotNull()).select(
        F.col("canonical_employee_id").alias("identity_id"), "name", "email", F.lit("employee").alias("worker_type"),
        "title", "department", F.col("manager_employee_id").alias("manager_id"), "location", "hire_date",
        "termination_date", "lifecycle_status", "status_date_conflict", "source_line")


def aliases(records: DataFrame) -> DataFrame:
    """(identity_id, alias_type, value) rows of a standardised roster."""
    built = records.filter(F.col("canonical_employee_id").isNotNull())
    entries = F.array(
        F.struct(F.lit("employee_id").alias("alias_type"), F.col("canonical_employee_id").alias("value")),
        F.struct(F.lit("email_localpart").alias("alias_type"), F.col("email_localpart").alias("value")),
        F.struct(F.lit("employee_id_disputed").alias("alias_type"), F.col("disputed_employee_id").alias("value")))
    return built.select(F.col("canonical_employee_id").alias("identity_id"), F.inline(entries)).filter(
        F.col("value").isNotNull()).distinct()


def _explain(collided: Column) -> Column:
    return (
        F.when(F.col("reason_code") == MALFORMED, "The row does not have as many fields as the header.")
        .when(collided, F.concat(
            F.lit("employee_id "), F.col("norm_id"), F.lit(" is shared by "), F.col("group_size").cast("string"),
            F.when(F.col("quarantine_status") == "resolved", " people with distinct corporate emails and names.")
            .otherwise(" rows that cannot be told apart by corporate email and name."))))


def quarantine(records: DataFrame) -> DataFrame:
    """Quarantine rows. Members of a collision are listed by ``roster_collisions`` under norm_id."""
    held = records.filter(F.col("quarantine_reason").isNotNull())
    resolved = F.col("quarantine_status") == "resolved"
    return held.select(
        *_row_key(records), F.col("quarantine_reason").alias("reason_code"),
        _explain(F.col("group_size").isNotNull()).alias("explanation"),
        F.col("norm_id").alias("candidate_ids"), F.col("quarantine_status").alias("status"),
        F.when(resolved, "Unique corporate email and unique name.").alias("resolution"),
        F.when(resolved, "system:correlation_policy").alias("resolved_by"))


def status_date_conflicts(people: DataFrame) -> DataFrame:
    """People a trigger on HR status alone would miss: ended by date, still Active by status."""
    return people.filter("status_date_conflict").select("identity_id", "name", "termination_date", "lifecycle_status")
