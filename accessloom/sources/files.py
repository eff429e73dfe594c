"""Readers for the six landed extracts, with explicit schemas and source line numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from accessloom.functions.hashing import canonical_json, input_hash, row_hash
from accessloom.sources import structure

# Header and field names of the input formats.
ROSTER_COLUMNS = (
    "employee_id", "full_name", "work_email", "title", "department", "manager_employee_id", "location", "hire_date",
    "termination_date", "employment_type", "status")
DIRECTORY_COLUMNS = (
    "samAccountName", "distinguishedName", "displayName", "userPrincipalName", "enabled", "lastLogonTimestamp",
    "memberOf", "description")
CRM_COLUMNS = ("username", "name", "email", "profile", "permission_sets", "is_active", "last_login")

CLOUD_USER = (
    "struct<id:string,userPrincipalName:string,displayName:string,mail:string,accountEnabled:boolean,"
    "employeeId:string,lastSignInDateTime:string,assignedGroups:array<string>,appRoleAssignments:array<string>>")
IAM_DOCUMENT = (
    "struct<accounts:array<string>,"
    "users:array<struct<username:string,account:string,arn:string,groups:array<string>,"
    "access_keys:array<struct<created_days_ago:int,active:boolean>>>>,"
    "roles:array<struct<role_name:string,account:string,trust_policy:string,attached_policies:array<string>,"
    "assume_role_chain:array<string>>>>")
CELL_SCHEMA = "sheet string, row int, col int, value string"

FIRST_LINE = 2  # the header is line 1


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_line, value) of a splittable text scan.

    Ids rise within each scan task; a file block's rows are contiguous there, so the line number is
    the rows of the file's earlier blocks plus the offset inside the block. Only one row per block
    is aggregated and joined back, never the data.
    """
    located = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value")
    block = ["source_file", "_block"]
    per_block = located.groupBy(*block).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    line = (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("bigint")
    return located.join(starts, block).select("source_file", line.alias("source_line"), "value")


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header: text columns, source_file, source_line and a ragged-row flag ``malformed``.

    A row with too few or too many fields, or none, is flagged and kept. Columns are found by the header names of
    their own file, so files of one path may order them differently; a file without one of them is an error. The
    distinct headers, not the files, reach the driver. A quoted field may hold line breaks; ``source_line`` is the physical
    line a row begins at.
    """
    records = structure.delimited_records(spark, path)
    heads = records.filter(F.col("source_line") < FIRST_LINE).select("source_file", F.col("fields").alias("_header"))
    layouts = [r[0] for r in heads.select("_header").distinct().collect()]
    for header in layouts:
        missing = [c for c in columns if c not in _named(header)]
        if missing:
            raise ValueError(f"{path} lacks columns {missing}")
    rows = records.filter(F.col("source_line") >= FIRST_LINE)
    if len(layouts) > 1:
        rows = rows.join(heads, "source_file")
        known = F.col("_header")
    else:
        known = F.array(*[F.lit(c) for c in next(iter(layouts), columns)]).cast("array<string>")

    def value(name: str) -> Column:
        places = [(header, _named(header).index(name)) for header in layouts]
        if len(places) < 2:
            return F.get("fields", F.lit(places[0][1] if places else 0))
        of_header = [F.when(known == F.array(*[F.lit(c) for c in header]), F.get("fields", F.lit(at))) for header, at in places]
        return F.coalesce(*of_header)

    malformed = F.size("fields") != F.size(known)
    return rows.select(
        "source_file", "source_line", *[F.coalesce(value(c), F.lit("")).alias(c) for c in columns],
        malformed.alias("malformed"), F.when(malformed, F.col("raw")).alias("raw_line"))


def _named(header: Sequence[str]) -> list[str]:
    return [c.removeprefix("\ufeff") if i == 0 else c for i, c in enumerate(header)]


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ROSTER_COLUMNS)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, DIRECTORY_COLUMNS)


def read_crm(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, CRM_COLUMNS)


def read_cloud_directory(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of users, of any size; the first element is line 2."""
    users = structure.json_elements(spark, path).withColumn("user", F.from_json("value", CLOUD_USER))
    return users.select("source_file", (F.col("position") + FIRST_LINE).cast("bigint").alias("source_line"), "user.*")


def read_cloud_iam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(users, roles) of an IAM export with both lists in one document, of any size."""
    parts = structure.json_elements(spark, path, level=2)

    def part(name: str) -> DataFrame:
        element = F.from_json(F.concat(F.lit(f'{{"{name}":['), "value", F.lit("]}")), IAM_DOCUMENT)[name]
        return parts.filter(F.col("name") == name).select(
            "source_file", (F.col("position") + FIRST_LINE).cast("bigint").alias("source_line"), F.inline(element))

    return part("users"), part("roles").drop("source_line")


def read_cloud_directory_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines export of users, one per line: splittable, for large directories."""
    lines = _numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.select("source_file", "source_line", F.from_json("value", CLOUD_USER).alias("user")).select(
        "source_file", "source_line", "user.*")


def read_cloud_iam_lines(spark: SparkSession, users_path: str, roles_path: str) -> tuple[DataFrame, DataFrame]:
    """(users, roles) of an IAM export landed as two JSON Lines files."""
    def part(path: str, name: str) -> DataFrame:
        element = F.from_json("value", IAM_DOCUMENT)[name]
        wrapped = _numbered_lines(spark, path).filter(F.trim("value") != "").withColumn(
            "value", F.concat(F.lit(f'{{"{name}":['), "value", F.lit("]}")))
        return wrapped.select("source_file", "source_line", F.inline(element))

    return part(users_path, "users"), part(roles_path, "roles").drop("source_line")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Spreadsheet cells exported as a (sheet, row, col, value) table."""
    return spark.read.schema(CELL_SCHEMA).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A document of known answers as one long table: source_file, system, label_set, entity, detail.

    The document names systems, each its label sets: a list of entities (text, or objects, which are kept as their JSON), an
    object of entities with a detail each, or a note, which is a detail without an entity. Whatever sets there are is
    read; no schema is asked for.
    """
    documents = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.parse_json("value").alias("document"))

    def opened(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
        entries = df.lateralJoin(spark.tvf.variant_explode_outer(F.col(column).outer()))
        return entries.select(*df.columns, F.col("key").alias(key), F.col("value").alias(value))

    def shown(value: str) -> Column:
        return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(F.col(value)))

    sets = opened(opened(documents, "document", "system", "sets").drop("document"), "sets", "label_set", "entities").drop("sets")
    nested = F.schema_of_variant("entities").rlike("^(ARRAY|OBJECT)<")
    notes = sets.filter(~nested).withColumns({"entity": F.lit(None).cast("string"), "detail": shown("entities")})
    listed = opened(sets.filter(nested), "entities", "member", "found").filter("found IS NOT NULL").withColumns({
        "entity": F.coalesce("member", shown("found")), "detail": F.when(F.col("member").isNotNull(), shown("found"))})
    columns = ["source_file", "system", "label_set", "entity", "detail"]
    return listed.select(*columns).unionByName(notes.select(*columns)).filter("label_set IS NOT NULL")


def source_records(feed: DataFrame, source_system: str, columns: Sequence[str], run_id: str, sheet: str | None = None) -> DataFrame:
    """Provenance rows of a feed: verbatim payload and its hash under the record key."""
    return feed.select(
        F.lit(source_system).alias("source_system"), "source_file",
        (F.col(sheet) if sheet else F.lit(None).cast("string")).alias("source_sheet"), "source_line",
        row_hash(columns).alias("raw_hash"), canonical_json(columns).alias("raw_payload"), F.lit(run_id).alias("run_id"))


def start_run(feed: DataFrame, source_system: str, run_id: str, started_at) -> DataFrame:
    """One running row for the run table, with the hash of its whole input."""
    return input_hash(feed).select(
        F.lit(run_id).alias("run_id"), F.lit(source_system).alias("source_system"), "input_hash", "rows_in",
        started_at.alias("started_at"), F.lit("running").alias("status"))


def finish_run(run: DataFrame, totals: DataFrame, completed_at) -> DataFrame:
    """Close a run with its totals, one row; the status says whether every row got exactly one outcome. A run of which
    there are no totals failed."""
    found = totals.select("rows_in", "rows_normalized", "rows_quarantined").first() or (0, 0, 0)
    outcomes, normalized, quarantined = (F.lit(n).cast("bigint") for n in found)
    whole = (outcomes == F.col("rows_in")) & (F.col("rows_in") == normalized + quarantined)
    return run.drop("status").withColumns({
        "rows_normalized": normalized, "rows_quarantined": quarantined, "completed_at": completed_at,
        "status": F.when(whole & F.lit(tuple(found) != (0, 0, 0)), "succeeded").otherwise("failed")})
