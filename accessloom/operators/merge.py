"""Merge-on-key writers as snapshot transformations: existing + incoming -> next snapshot.

Each merge is one union and one rank over the key, so it costs a single shuffle and treats null
key parts as equal.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.operators.rank import first_per_key

EXISTING, INCOMING = 0, 1


def _stacked(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    new = incoming.withColumn("_side", F.lit(INCOMING))
    if existing is None:
        return new
    return existing.withColumn("_side", F.lit(EXISTING)).unionByName(new, allowMissingColumns=True)


def upsert(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write wins: incoming beats existing; among incoming rows the last by ``order`` wins."""
    latest = [F.desc("_side"), *[o.desc() for o in order]]
    return first_per_key(_stacked(existing, incoming), keys, latest).drop("_side")


def insert_absent(
    existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()
) -> DataFrame:
    """First write wins: an existing row is kept as is, otherwise the first incoming row is added."""
    earliest = [F.asc("_side"), *[o.asc() for o in order]]
    return first_per_key(_stacked(existing, incoming), keys, earliest).drop("_side")


SOURCE_RECORD_KEYS = ("source_system", "source_file", "source_sheet", "source_line", "raw_hash")


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition under which null key parts are equal."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def merge_source_records(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """An unchanged row keeps its provenance record; a changed row (other hash) adds one.

    History is only read for its keys and never sorted; what is new is appended.
    """
    new = first_per_key(incoming, SOURCE_RECORD_KEYS, [F.col(c) for c in incoming.columns if c not in SOURCE_RECORD_KEYS])
    if existing is None:
        return new
    known = existing.select(*SOURCE_RECORD_KEYS)
    return existing.unionByName(new.join(known, same_key(new, known, SOURCE_RECORD_KEYS), "left_anti"), allowMissingColumns=True)


QUARANTINE_VALUES = ("status", "explanation", "candidate_ids", "resolution", "resolved_by", "resolved_at")


def merge_quarantine(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Refresh explanation and candidates; move open -> resolved; never reopen a resolution.

    Both sides meet in one grouping by key, in which null key parts are equal. Of several rows of one
    side under a key the greatest counts, resolved before open.
    """
    row = F.struct(*QUARANTINE_VALUES)
    stacked = _stacked(existing.select(*keys, *QUARANTINE_VALUES), incoming.select(*keys, *QUARANTINE_VALUES))
    both = stacked.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == EXISTING, row)).alias("o"), F.max(F.when(F.col("_side") == INCOMING, row)).alias("n"))
    seen, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    take_new = ~known | ((F.col("o.status") == "open") & seen & (F.col("n.status") != "open"))

    def chosen(new: Column, name: str) -> Column:
        return F.when(new, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return both.select(
        *keys, chosen(seen, "explanation"), chosen(seen, "candidate_ids"),
        *[chosen(take_new, name) for name in ("status", "resolution", "resolved_by", "resolved_at")])


def record_outcomes(records: DataFrame, quarantine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A record with any quarantine row is quarantined, every other one is normalized; null key parts are equal."""
    flagged = quarantine.select(*keys).distinct().withColumn("_flagged", F.lit(True))
    outcome = F.when(F.col("_flagged"), "quarantined").otherwise("normalized")
    joined = records.join(flagged, same_key(records, flagged, keys), "left")
    return joined.withColumn("outcome", outcome).select(*[records[c] for c in records.columns], "outcome")


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


# Column order of the export.
EVIDENCE_COLUMNS = (
    "identity", "entitlement", "reviewer_route", "reviewer", "decision", "reason", "decided_at", "revocation_executed",
)


def export_evidence(pack: DataFrame, path: str) -> None:
    """Evidence rows as CSV part files in the fixed column order."""
    pack.select(*EVIDENCE_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
