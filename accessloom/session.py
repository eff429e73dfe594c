"""Session settings the library relies on, reliable lineage cuts, and scopes that release them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT = "spark.checkpoint.dir"
#: With it, shuffle files go when the query that made them has ended, not when the driver next collects garbage.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark takes a file's size for that of its rows and so has the driver collect tables that are several times larger.
EXPANSION, EXPANDED = "spark.sql.sources.fileCompressionFactor", "5.0"
#: Spark joins shuffled partitions up to a size, and needs enough of them to keep to it on large tables; rows in a sort or
#: hash table take some 30 times that.
SMALL_TASKS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600"}
#: For tables of hashes, which files do not compress.
PLAIN_SIZES = {EXPANSION: "1.0"}
#: A table is worked out in slices of so many planned bytes of input, one after the other, in so many at most, and stored
#: in little room.
SLICE_BYTES, SLICES = 64 << 20, 8
COMPACT = {"spark.sql.parquet.compression.codec": "zstd"}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on, and how files are sized; cluster sizing is left to the deployment."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(EXPANSION, EXPANDED)
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is stored inside; those before come back at the end."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def under(values: dict[str, str]) -> Callable[[Callable], Callable]:
    """Runs a step, whose first argument is a table, with session settings."""
    def wrap(step: Callable) -> Callable:
        @wraps(step)
        def run(first: DataFrame, *args, **options):
            with settings(first.sparkSession, values):
                return step(first, *args, **options)

        return run

    return wrap


def shared_folder(spark: SparkSession) -> str:
    """The folder the deployment names for intermediate tables.

    Where it is unset, as on a single machine or in tests, this process makes one and names it in the session, so all
    later cuts use the same one. A cluster must set it to a folder that every executor can reach.
    """
    folder = spark.conf.get(CHECKPOINT, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="accessloom-")
        spark.conf.set(CHECKPOINT, folder)
    return folder


class Scope:
    """The tables stored since a scope began, which its end deletes."""

    def __init__(self, outer: Scope | None):
        self.outer, self.stored = outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Stores ``df`` as a table that outlives this scope and belongs to the one around it, if any."""
        return _stored(df, self.outer)


_innermost: ContextVar[Scope | None] = ContextVar("innermost scope", default=None)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that the library wrote, in any file system Spark reads."""
    files, where = _located(spark, path)
    files.delete(where, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path`` that a finished write left."""
    files, where = _located(spark, path)
    if not files.exists(where):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory() and files.exists(done(s.getPath(), "_SUCCESS"))]


@contextmanager
def stored_tables() -> Iterator[Scope]:
    """Tables that ``cut_lineage`` writes inside are deleted at the end; what is to be read later goes through ``keep``.

    Until then all of them stay, so a lost executor never costs a round. Only folders that the scope made are deleted.
    """
    scope = Scope(_innermost.get())
    token = _innermost.set(scope)
    try:
        yield scope
    finally:
        _innermost.reset(token)
        for spark, path in scope.stored:
            delete_folder(spark, path)


def released(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Stores the result of ``step`` and deletes what it stored on the way."""
    @wraps(step)
    def run(*args, **options):
        with stored_tables() as scope:
            return scope.keep(step(*args, **options))

    return run


def cut_lineage(df: DataFrame, outlives_scope: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    A lost executor then never replays earlier rounds, readers prune columns, and the optimizer
    sees real sizes when it chooses join strategies. The table belongs to the innermost scope, or to the one around it.
    """
    return _stored(df, _chosen(outlives_scope))


def _chosen(outlives_scope: bool) -> Scope | None:
    scope = _innermost.get()
    return scope.outer if scope is not None and outlives_scope else scope


def cut_by_slices(
    step: Callable[..., DataFrame], *tables: DataFrame, by: str, slices: int | None = None, outlives_scope: bool = False
) -> DataFrame:
    """Writes ``step(*tables)`` once as a table, as ``cut_lineage`` does, for tables whose rows meet on equal ``by`` only.

    One slice of the keys is worked out after the other, so no more than a slice's shuffle files are there at a time. Keys
    are told apart by their hash, so all tables must have them in one type; where they have not, there is one slice.
    ``slices`` None takes as many as the planned size of the tables asks for; the rows are the same with any number.
    """
    if len({table.schema[by].dataType for table in tables}) > 1:
        slices = 1
    elif slices is None:
        planned = sum(int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for table in tables)
        slices = max(1, min(SLICES, planned // SLICE_BYTES))
    path, scope = None, _chosen(outlives_scope)
    for k in range(slices):
        ours = F.pmod(F.xxhash64(by), F.lit(slices)) == k
        df = step(*[table.filter(ours) for table in tables])
        with settings(df.sparkSession, COMPACT):
            path = _written(df, scope, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _written(df: DataFrame, scope: Scope | None, path: str | None = None) -> str:
    """Writes a table, or more rows of the one at ``path``, and gives its path."""
    spark = df.sparkSession
    if path is None:
        path = f"{shared_folder(spark).rstrip('/')}/accessloom-{uuid.uuid4().hex}"
        if scope is not None:
            scope.stored.append((spark, path))
    with settings(spark, {RELEASE_SHUFFLES: "true"}):
        df.write.mode("append").parquet(path)
    return path


def _stored(df: DataFrame, scope: Scope | None) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, scope))
