"""Spreadsheet access lists held as a (sheet, row, col, value) cell table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from accessloom.functions import dates, text
from accessloom.operators import fuzzy
from accessloom.session import cut_lineage

# Header names, and how far down and right they may stand.
EXPECTED_HEADERS = ("employee name", "role", "granted by", "date")
HEADER_ROWS, HEADER_COLUMNS, HEADER_HITS = 10, 7, 3


def _label(value):
    return F.lower(text.strip(value))


def detect_headers(cells: DataFrame, headers: Sequence[str] = EXPECTED_HEADERS) -> DataFrame:
    """(sheet, header_row): first row near the top that holds enough distinct expected headers."""
    near = cells.filter((F.col("row") <= HEADER_ROWS) & (F.col("col") <= HEADER_COLUMNS) & _label(F.col("value")).isin(*headers))
    rows = near.groupBy("sheet", "row").agg(F.count_distinct(_label(F.col("value"))).alias("hits"))
    return rows.filter(F.col("hits") >= HEADER_HITS).groupBy("sheet").agg(F.min("row").alias("header_row"))


def _column_map(cells: DataFrame, headers: Sequence[str]) -> DataFrame:
    found = detect_headers(cells, headers).withColumnRenamed("header_row", "row")
    titles = cells.filter((F.col("col") <= HEADER_COLUMNS) & _label(F.col("value")).isin(*headers)).select(
        "sheet", "row", "col", _label(F.col("value")).alias("header"))
    return titles.join(found, ["sheet", "row"]).groupBy("sheet", F.col("row").alias("header_row"), "header").agg(
        F.max("col").alias("header_col"))


def sheet_layout(cells: DataFrame, headers: Sequence[str] = EXPECTED_HEADERS) -> DataFrame:
    """(sheet, header, header_row, header_col, max_date) of every sheet with a header.

    The column map has a few rows per sheet; the date maximum is a map-side aggregate over the date
    column.
    """
    # Stored, so that its size is known and the cells, whose size is not, are never the side that is broadcast.
    columns = cut_lineage(_column_map(cells, headers))
    dated = columns.filter(F.col("header") == "date").select("sheet", "header_row", F.col("header_col").alias("col"))
    newest = (
        cells.join(dated, ["sheet", "col"]).filter(F.col("row") > F.col("header_row"))
        .groupBy("sheet").agg(F.max(dates.flexible_date(F.col("value"))).alias("max_date")))
    return columns.join(newest, "sheet", "left")


def elect_primary(layout: DataFrame) -> DataFrame:
    """(sheet, header_row, max_date, is_primary): the newest sheet; undated last, ties to the first name."""
    by_sheet = layout.groupBy("sheet").agg(F.min("header_row").alias("header_row"), F.max("max_date").alias("max_date"))
    age = -F.unix_date(F.coalesce("max_date", F.lit("0001-01-01").cast("date")))
    primary = by_sheet.agg(F.min(F.struct(age.alias("age"), "sheet")).alias("best")).select(
        F.col("best.sheet").alias("sheet"), F.lit(True).alias("_first"))
    return by_sheet.join(primary, "sheet", "left").select(
        "sheet", "header_row", "max_date", F.col("_first").isNotNull().alias("is_primary"))


def sheet_rows(cells: DataFrame, layout: DataFrame, headers: Sequence[str] = EXPECTED_HEADERS) -> DataFrame:
    """One row per data row of a sheet with one column per expected header."""
    wanted = layout.select("sheet", "header_row", F.col("header_col").alias("col"), "header")
    values = cells.join(wanted, ["sheet", "col"]).filter(F.col("row") > F.col("header_row"))
    return values.groupBy("sheet", "row").pivot("header", list(headers)).agg(F.first("value"))


def resolve_names(asked: DataFrame, identities: DataFrame) -> DataFrame:
    """(raw_name, identity_id, department, match_rule) for names that mean exactly one person.

    ``first.last@`` takes the smallest id with that name; ``First L.`` needs a unique first name and
    last initial; anything else needs a unique best fuzzy match that leads by 5.
    """
    people = identities.select("identity_id", "department", text.normalize_name(F.col("name")).alias("norm")).filter("norm <> ''")
    holder = F.struct("identity_id", "department")
    by_name = people.groupBy("norm").agg(F.min_by(holder, "identity_id").alias("person"))

    raw = F.col("raw_name")
    stripped = text.strip(F.regexp_replace(raw, "[.]+$", ""))
    words = F.split(stripped, "\\s+")
    short = (F.size(words) == 2) & (F.length(F.get(words, F.lit(1))) == 1)
    handle = F.endswith(raw, F.lit("@"))
    form = F.when(handle, "handle").when(short, "initial").otherwise("full")
    names = asked.filter(raw != "").withColumn("form", form)

    local = F.split(F.lower(F.regexp_replace(raw, "@$", "")), "[.]")
    handles = names.filter((F.col("form") == "handle") & (F.size(local) == 2)).select(
        "raw_name", F.concat_ws(" ", local[0], local[1]).alias("norm"))
    exact = handles.join(by_name, "norm").select(
        "raw_name", "person.*", F.lit("email_localpart_exact").alias("match_rule"))

    tokens = F.split("norm", " ")
    splits = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: i > 0),
        lambda i: F.array_join(F.slice(tokens, F.lit(1), i), " "))
    openings = people.select(
        F.explode(splits).alias("opening"), F.substring(F.element_at(tokens, -1), 1, 1).alias("initial"),
        "identity_id", "department")
    sole = (
        openings.groupBy("opening", "initial")
        .agg(F.count("*").alias("n"), F.min_by(holder, "identity_id").alias("person")).filter("n = 1"))
    initials = names.filter(F.col("form") == "initial").select(
        "raw_name", text.normalize_name(words[0]).alias("opening"), F.lower(words[1]).alias("initial"))
    abbreviated = initials.join(sole, ["opening", "initial"]).select(
        "raw_name", "person.*", F.lit("first_lastinitial_exact").alias("match_rule"))

    # Token order does not count, so people with the same sorted tokens are one name with several holders.
    sorted_names = (
        people.groupBy(text.sort_tokens(F.col("norm")).alias("name"))
        .agg(F.count("*").alias("holders"), F.min_by(holder, "identity_id").alias("person")))
    full = names.filter(F.col("form") == "full").select(
        "raw_name", text.sort_tokens(text.normalize_name(text.natural_name(raw))).alias("name"))
    pairs = fuzzy.similar_names(full, sorted_names).join(
        sorted_names.withColumnRenamed("name", "index_name"), "index_name")
    best = fuzzy.unique_best(pairs, ["probe_name"], "holders")
    similar = full.join(best.withColumnRenamed("probe_name", "name"), "name").select(
        "raw_name", "person.*", F.lit("fuzzy_name_unique").alias("match_rule"))
    return exact.unionByName(abbreviated).unionByName(similar)
