"""Per-group ranking that never needs a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """Keep the first ``n`` rows of each key.

    The rank filter lets Spark drop all but ``n`` rows per key before the shuffle.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def position_in_group(
    df: DataFrame, keys: Sequence[str], line: str, out: str, ties: Sequence[str] = (), slice_width: int = 1_000_000
) -> DataFrame:
    """0-based position by ``line`` (then ``ties``) within each key.

    A group is cut into slices of ``slice_width`` line numbers; rows are ranked inside a slice and
    shifted by the size of the slices before it, so one huge group spreads over many tasks.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(line) / F.lit(slice_width)))
    slice_keys = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*slice_keys).agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*slice_keys).orderBy(line, *ties)) - 1
    return (
        sliced.withColumn("_local", local).join(offsets, slice_keys, "inner")
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_local", "_offset")
    )
