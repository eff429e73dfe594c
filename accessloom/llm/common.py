"""Helpers the corpus operators share: tables, bounded membership filters, hashed words of Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from accessloom.session import shared_folder

#: Bits of a membership bitmap: 512 rows of 4 KB, so at most 2 MB are broadcast at any input size.
FILTER_BITS = 1 << 24
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, used once, that the driver and all executors reach."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by id and text: equal for repeated rows, different for other texts under one id, never null."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` bears it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(FILTER_BITS))


def membership(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap of hashed keys with a fixed size; it has every key, and some others that share a bit with one."""
    return keys.select(_bit(key).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def with_membership(df: DataFrame, key: Column, members: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: false only where the key is surely not among the members. Moves no row of ``df``."""
    bucket, bitmap = free_name(df.columns, "_bucket"), free_name(df.columns, "_bitmap")
    small = F.broadcast(members.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    position = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (position / 8 + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    hit = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    joined = df.join(small, F.bitmap_bucket_number(_bit(key)) == F.col(bucket), "left")
    return joined.select(*df.columns, hit.alias(name))


def without_keys(docs: DataFrame, key: Column, dropped: DataFrame, dropped_key: str) -> DataFrame:
    """The rows whose key is not in ``dropped``. Only rows that the bitmap lets through are shuffled."""
    flag, own = free_name(docs.columns, "_may_drop"), free_name(docs.columns, "_own_key")
    seen = with_membership(docs, key, membership(dropped, F.col(dropped_key)), flag)
    rest = seen.where(F.col(flag)).withColumn(own, key).join(
        dropped.select(F.col(dropped_key).alias(own)).distinct(), own, "left_anti")
    return seen.where(~F.col(flag)).select(*docs.columns).unionByName(rest.select(*docs.columns))


# ---- Arrow text as numpy arrays ------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(texts: pa.Array, limit: int = _BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a column into runs of rows of about ``limit`` bytes: first row, UTF-8 bytes, row offsets in them.

    A null is an empty text. A single longer text is a run of its own, so memory follows the longest text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Words:
    """Words of a run of texts: byte ranges, 64-bit hashes, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, prefix: int = 0):
        """table: 0 for a separator, else the byte that counts (for lower case). prefix: also hash so many first bytes."""
        folded = table[data]
        inside = folded != 0
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before[cuts], after[cuts - 1] = False, False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        up, down = _powers(1 << max(20, int(len(data)).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(folded * up[:len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.prefix = mix((sums[np.minimum(self.end, self.start + prefix)] - sums[self.start]) * down[self.start] + np.uint64(1)) if prefix else None


@lru_cache(maxsize=1)
def ascii_words() -> np.ndarray:
    """Words are runs of other bytes than blank and 0x09-0x0D; A-Z count as a-z."""
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)
    fold += np.uint64(1)
    fold[list(SEPARATORS)] = 0
    return fold


@lru_cache(maxsize=1)
def letter_words() -> np.ndarray:
    """Words are runs of ASCII letters, digits and all bytes beyond ASCII; A-Z count as a-z."""
    fold = np.zeros(256, np.uint64)
    for low, high in ((48, 58), (97, 123), (128, 256)):
        fold[low:high] = np.arange(low, high)
    fold[65:91] = np.arange(97, 123)
    return fold


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its word shingles; a shorter text is one shingle, no word gives none."""
    words = Words(data, offsets, ascii_words())
    h, n = words.hash, len(words.hash)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled = mix(rolled * _BASE + h[k:k + len(rolled)])
    sets = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= size:
            sets.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            one = np.uint64([b - a])
            for k in range(a, b):
                one = mix(one * _BASE + h[k:k + 1])
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
