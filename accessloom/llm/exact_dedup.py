"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from accessloom.llm import common
from accessloom.session import cut_lineage


def exact_dedup(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Round 1 keeps lengths (in bytes) that more than one row has, round 2 the pairs of length and hash of the first
    ``prefix`` characters that more than one row has; both work on two numbers per row. Only rows of surviving groups
    are read in full and get a SHA-256, which decides equality. No text is shuffled: survivors are found in the second
    scan through a bitmap of fixed size, whose false positives cost one more digest each and change nothing.

    Of equal texts the row with the largest id stays. A null text is an empty text. Rows that repeat an id with the
    same text are one document: both are ``kept`` and both count in group_size. A row without id never stays where
    another has one; where none has, all stay and keep_id is null. text_sha256 is null for rows that never had to be
    read in full, unless ``digest_all``. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = F.xxhash64(F.substring(text, 1, prefix))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    size, start = F.octet_length("text"), F.xxhash64(F.substring("text", 1, prefix))
    sketch = cut_lineage(docs.select(F.octet_length(text).alias("n_bytes"), head.alias("head")))
    lengths = sketch.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    groups = sketch.join(lengths, "n_bytes", "left_semi").groupBy("n_bytes", "head").count().where("count > 1")
    members = common.membership(groups, F.xxhash64("n_bytes", "head"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    rows = common.with_membership(base, F.xxhash64(size, start), members, "open").select(
        "id", "open", F.when(F.col("open") | F.lit(digest_all), digest).alias("digest"))
    # A row outside every group meets only itself; its key is spread instead of null.
    rows = cut_lineage(rows.select(
        "id", "digest", F.when(F.col("open"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.rand(7))).alias("key")))
    equal = rows.where(~F.startswith("key", F.lit("-"))).groupBy("key").agg(
        F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = rows.join(equal, "key", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("last"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))
