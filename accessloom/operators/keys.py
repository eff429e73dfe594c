"""Surrogate keys that stay as they are across loads, given out without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from accessloom.operators.merge import same_key
from accessloom.operators.rank import first_per_key
from accessloom.session import cut_lineage


def get_or_create(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """``existing`` and, for each key of ``incoming`` that it lacks, the first such row with a new id.

    New ids follow the greatest known one. Every task numbers its new rows; only the number of rows of each task is summed
    up to say where its block begins, so ids have no gaps and no row moves for its id. Known rows keep their id and all
    other values; null key parts are equal.
    """
    rest = [c for c in incoming.columns if c not in keys]
    new = first_per_key(incoming, keys, [F.col(c) for c in (rest or keys)])
    highest = 0
    if existing is not None:
        known = existing.select(*keys)
        new = new.join(known, same_key(new, known, keys), "left_anti")
        highest = existing.agg(F.max(id_col)).first()[0] or 0
    placed = cut_lineage(new.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    offset = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(blocks), "_part").withColumn(id_col, F.lit(highest) + F.col("_before") + offset + 1)
    numbered = numbered.drop("_at", "_part", "_before")
    return numbered if existing is None else existing.unionByName(numbered, allowMissingColumns=True)
