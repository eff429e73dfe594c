"""Snapshots kept in buckets of their key, of which a load reads and rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from accessloom.operators.merge import same_key
from accessloom.operators.rank import first_per_key
from accessloom.session import cut_lineage

BUCKET = "_bucket"


@dataclass(frozen=True)
class Load:
    """What one load did: buckets touched and all buckets, and rows written."""

    touched: int
    buckets: int
    rows: int


@dataclass(frozen=True)
class BucketedSnapshot:
    """A table under ``path`` whose rows lie in one folder per bucket, unique by ``keys``.

    By default a bucket is a hash of the keys; ``span`` instead puts whole stretches of so many values of the first, numeric,
    key together, so that a load of neighbouring keys touches few of the ``buckets``.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 256
    span: int | None = None

    def bucket(self) -> Column:
        if self.span is None:
            return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return F.pmod(F.floor(F.col(self.keys[0]) / F.lit(self.span)), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame, order: Sequence[Column]) -> DataFrame:
        """The first load; of several rows of a key the last by ``order`` counts."""
        self._write(first_per_key(rows, self.keys, [o.desc() for o in order]).withColumn(BUCKET, self.bucket()), "error")
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def _held(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col(BUCKET).isin(numbers))

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Rows of a bucket come together, so that it has one file per task that writes it and not one per task.
        spread = rows.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*self.keys), F.lit(4)))
        spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _incoming(self, rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, list[int]]:
        """The load's rows, once per key, and its buckets; at most ``buckets`` numbers reach the driver."""
        stored = cut_lineage(first_per_key(rows, self.keys, [o.desc() for o in order]).withColumn(BUCKET, self.bucket()))
        return stored, sorted(r[0] for r in stored.select(BUCKET).distinct().collect())

    def upsert(self, rows: DataFrame, order: Sequence[Column]) -> Load:
        """Last write wins. Rows of touched buckets that the load does not replace are kept; other buckets are not read.

        The kept rows are found by an anti join that leaves them where they are while the load's keys are small
        enough to send to them, which Spark decides.
        """
        incoming, numbers = self._incoming(rows, order)
        held, keys = self._held(numbers), incoming.select(*self.keys)
        kept = held.join(keys, same_key(held, keys, self.keys), "left_anti")
        # Stored before the folders it is read from are replaced, so a lost task can be run again.
        after = cut_lineage(kept.select(*held.columns).unionByName(incoming, allowMissingColumns=True))
        if numbers:
            self._write(after, "overwrite")
        return Load(len(numbers), self.buckets, after.count())

    def insert_absent(self, rows: DataFrame, order: Sequence[Column]) -> Load:
        """First write wins: rows of new keys are appended; of touched buckets only the keys are read, nothing is rewritten."""
        incoming, numbers = self._incoming(rows, order)
        known = self._held(numbers).select(*self.keys)
        new = cut_lineage(incoming.join(known, same_key(incoming, known, self.keys), "left_anti").select(*incoming.columns))
        if not new.isEmpty():
            self._write(new, "append")
        return Load(len(numbers), self.buckets, new.count())
