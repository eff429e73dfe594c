"""Join helpers for keys that are often null or very frequent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

NULL_SPREADS = 256
#: Bits of a bitmap of keys: at most 262,144 words of 64 bits are broadcast at any input size.
KEY_BITS = 1 << 24


def lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, spread_by: Sequence[str]) -> DataFrame:
    """Left join on a nullable key against a side that is unique on it.

    Null keys never match, yet a plain left join sends all of them to one partition. Here every
    null gets one of NULL_SPREADS keys of its own kind, which no right row carries.
    """
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SPREADS)).cast("string")
    present = F.concat(F.lit("k"), F.col(key).cast("string"))
    keyed = left.withColumn("_lookup", F.when(F.col(key).isNull(), F.concat(F.lit("n"), spread)).otherwise(present))
    target = right.withColumn("_lookup", F.concat(F.lit("k"), F.col(right_key).cast("string"))).drop(right_key)
    return keyed.join(target, "_lookup", "left").drop("_lookup")


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BITS))


def with_maybe(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: false only where ``key`` is surely not among ``keys``, a table of one column. Moves no row of ``df``.

    A bitmap of fixed size holds the hash of every key, and so some others that share a bit with one.
    """
    known = keys.columns[0]
    if keys.schema[known].dataType != df.schema[key].dataType:  # equal keys of two types have different hashes
        return df.withColumn(name, F.lit(True))
    words = keys.select(_bit(known).alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    joined = df.withColumn("_word", F.shiftright(_bit(key), 6)).join(F.broadcast(words), "_word", "left")
    held = F.getbit("_bits", (_bit(key) % 64).cast("int")) == 1
    return joined.select(*df.columns, F.coalesce(held, F.lit(False)).alias(name))
