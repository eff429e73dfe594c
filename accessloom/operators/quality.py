"""Reconciliation, label evaluation and source freshness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from accessloom.functions.dates import hours_between
from accessloom.session import cut_lineage


def reconcile(records: DataFrame, run_keys: Sequence[str] = ()) -> DataFrame:
    """Rows per (stage, reason code) of each run."""
    return records.groupBy(*run_keys, "stage", "reason_code").agg(F.count("*").alias("row_count"))


def run_totals(records: DataFrame, run_keys: Sequence[str] = ()) -> DataFrame:
    """rows_in, normalized and quarantined per run, and whether they add up."""
    totals = records.groupBy(*run_keys).agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col("stage") == "normalized").alias("rows_normalized"),
        F.count_if(F.col("stage") == "quarantined").alias("rows_quarantined"),
    )
    return totals.withColumn(
        "invariant_ok", F.col("rows_in") == F.col("rows_normalized") + F.col("rows_quarantined"))


def ordered_metrics(metrics: DataFrame, run_keys: Sequence[str] = ()) -> DataFrame:
    """Reason codes of each run with their place in a listing: by stage, then the most frequent first."""
    listing = Window.partitionBy(*run_keys).orderBy("stage", F.desc("row_count"), "reason_code")
    return metrics.withColumn("position", F.row_number().over(listing))


@dataclass(frozen=True)
class StoredRun:
    """The stored rows of a run, its one row for the run table, and its rows for the metrics table."""

    records: DataFrame
    run: DataFrame
    metrics: DataFrame


def store_run(records: DataFrame, run: DataFrame, reasons: Sequence[tuple[str, str]], completed_at: Column) -> StoredRun:
    """Stores the rows of a run and closes it with the counts that were observed while they were written.

    ``run`` is its running row (run_id, rows_in, ...). ``reasons`` are the (stage, reason code) pairs that may occur; only if
    another occurs are the stored rows read once more to count them. The run failed if a row has no outcome, or if
    rows were lost or added on the way.
    """
    stage, reason = F.col("stage"), F.col("reason_code")
    counts = {pair: F.count_if((stage == pair[0]) & (reason == pair[1])) for pair in reasons}
    seen = Observation()
    observed = records.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(stage == "normalized").alias("normalized"),
        F.count_if(stage == "quarantined").alias("quarantined"), *[c.alias("|".join(pair)) for pair, c in counts.items()])
    stored = cut_lineage(observed)
    got = seen.get
    spark, opened = records.sparkSession, run.first()
    found = [(opened["run_id"], *pair, got["|".join(pair)]) for pair in counts if got["|".join(pair)]]
    schema = f"run_id {run.schema['run_id'].dataType.simpleString()}, stage string, reason_code string, row_count long"
    metrics = spark.createDataFrame(found, schema)
    if sum(r[3] for r in found) != got["rows"]:
        metrics = reconcile(stored).select(F.lit(opened["run_id"]).alias("run_id"), "stage", "reason_code", "row_count")
    whole = got["rows"] == opened["rows_in"] == got["normalized"] + got["quarantined"]
    closed = run.drop("status").withColumns({
        "rows_normalized": F.lit(got["normalized"]), "rows_quarantined": F.lit(got["quarantined"]), "completed_at": completed_at,
        "status": F.lit("succeeded" if whole else "failed")})
    return StoredRun(stored, closed, metrics)


def require_invariant(records: DataFrame, rows_in: int | None = None) -> None:
    """Fail hard when a row got no outcome, or when rows were lost or duplicated on the way."""
    totals = run_totals(records).first()
    if not totals["invariant_ok"] or (rows_in is not None and totals["rows_in"] != rows_in):
        raise ValueError(f"reconciliation invariant broken: rows_in={rows_in} outcome rows={totals}")


def precision_recall(labelled: DataFrame, label: Column, expected: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, precision and recall of each label; an empty denominator gives null."""
    counts = labelled.groupBy(label.alias("label")).agg(
        F.count_if(expected & predicted).alias("tp"),
        F.count_if(~expected & predicted).alias("fp"),
        F.count_if(expected & ~predicted).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn))


def source_health(runs: DataFrame, sources: DataFrame, as_of: Column, sla_hours: float = 24) -> DataFrame:
    """Last run, last success and staleness of every expected source, run or not."""
    succeeded = F.col("status") == "succeeded"
    finished = F.struct("completed_at", "run_id")
    latest = runs.groupBy("source_system").agg(
        F.max_by("status", F.struct("started_at", "run_id")).alias("last_run_status"),
        F.max(F.when(succeeded, finished)).alias("_success"),
    )
    completed = F.col("_success.completed_at")
    hours = hours_between(completed, as_of)
    return sources.join(latest, "source_system", "left").select(
        "source_system", "last_run_status", completed.alias("last_completed_at"),
        F.col("_success.run_id").alias("watermark_run_id"),
        hours.alias("hours_since_last_success"),
        F.coalesce(hours > sla_hours, F.lit(True)).alias("stale"),
    )


def overall_health(health: DataFrame) -> DataFrame:
    stale = F.count_if(F.col("stale"))
    return health.agg(
        F.when(stale == 0, "healthy").otherwise("degraded").alias("status"), stale.alias("stale_sources"))
