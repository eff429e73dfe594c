"""Continuous upkeep with the batch semantics: trigger folding and last activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from accessloom.operators import merge
from accessloom.plans.lifecycle import idempotency_key
from accessloom.session import delete_folder, folders_in


def fold_triggers(triggers: DataFrame, event_time: str, late_by: str = "7 days") -> DataFrame:
    """Keep the first delivery of each lifecycle trigger; state is dropped once ``late_by`` has passed.

    A delivery that arrives later than ``late_by`` behind the newest one is dropped by the watermark, seen before or
    not. Land deliveries first and run ``workflow_runs`` over them where late ones must count.
    """
    keyed = triggers.withColumn("idempotency_key", idempotency_key()).withWatermark(event_time, late_by)
    return keyed.dropDuplicatesWithinWatermark(["idempotency_key"])


def last_activity(events: DataFrame, user: str, event_time: str) -> DataFrame:
    """Running newest activity per user."""
    return events.groupBy(user).agg(F.max(event_time).alias("last_activity_at"))


def runs_of(batch_id: int, fan: int) -> list[tuple[int, int]]:
    """The runs (first batch, last batch) that hold all batches up to one: as many of each power of ``fan`` as its number
    has units of it."""
    rest, power, out, first = batch_id + 1, 1, [], 0
    while power * fan <= rest:
        power *= fan
    while rest:
        for _ in range(rest // power):
            out.append((first, first + power - 1))
            first += power
        rest, power = rest % power, power // fan
    return out


def _name(run: tuple[int, int]) -> str:
    return f"run={run[0]}-{run[1]}"


def read_newest(spark: SparkSession, path: str, schema: str | StructType, keys: list[str], newest: str, fan: int = 8) -> DataFrame:
    """The newest row per key of all batches written so far."""
    found = [tuple(map(int, name[4:].split("-"))) for name in folders_in(spark, path) if name.startswith("run=")]
    if not found:
        return spark.createDataFrame([], schema)
    live = runs_of(max(last for _, last in found), fan)
    rows = reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{path}/{_name(r)}") for r in live])
    return merge.upsert(None, rows, keys, [F.col(newest)])


def upsert_each_batch(
        stream: DataFrame, path: str, keys: list[str], newest: str, checkpoint: str, fan: int = 8) -> DataStreamWriter:
    """Keep the newest row per key in runs, of which each batch writes one.

    A batch is written as a run of its own; each ``fan``-th of a size is written together with those before it, as one of the
    next size. So a row is written again once per power of ``fan`` batches and not with every batch, and few runs are there to
    read. Which runs there are follows from the number of the batch: a replayed batch writes the same folder, and
    readers see whole runs only. Runs that were merged go one batch later.
    """
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now, before = runs_of(batch_id, fan), runs_of(batch_id - 1, fan)
        first = now[-1][0]
        rows = [batch, *(spark.read.schema(schema).parquet(f"{path}/{_name(r)}") for r in before if r[0] >= first)]
        merged = merge.upsert(None, reduce(DataFrame.unionByName, rows), keys, [F.col(newest)])
        merged.write.mode("overwrite").parquet(f"{path}/{_name(now[-1])}")
        kept = {_name(r) for r in (*now, *before)}
        for name in folders_in(spark, path):
            if name.startswith("run=") and name not in kept and int(name.split("-")[1]) <= batch_id:
                delete_folder(spark, f"{path}/{name}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
