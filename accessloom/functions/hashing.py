"""Content hashes for provenance rows and whole inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def canonical_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON with sorted keys and explicit nulls."""
    return F.sha2(canonical_json(columns), 256)


def input_hash(df: DataFrame) -> DataFrame:
    """One order-free SHA-256 over all rows, folded with map-side partial sums."""
    digest = df.select(row_hash(df.columns).alias("h"))
    parts = [
        F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0))
        for i in range(4)
    ]
    folded = F.sha2(F.concat_ws(":", F.count("*"), *parts), 256)
    return digest.agg(folded.alias("input_hash"), F.count("*").alias("rows_in"))
