"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.llm import common
from accessloom.session import cut_lineage

_NONE = "\0"
#: Largest mean of one draw; e to its negative is far from underflow. A larger rate is a sum of draws.
_PER_DRAW = 256.0


def _unit(*parts: Column) -> Column:
    """A number from 0 up to 1 from 52 bits of the MD5 of the parts."""
    words = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(words, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def tempered(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> DataFrame:
    """Target weights by size: (source, weight) with the number of documents to the given power."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))


def rates(docs: DataFrame, targets: DataFrame, source_col: str, epochs: float, most: float | None) -> DataFrame:
    """Mean repetitions of each source's documents and the Poisson distribution function up to them.

    A rate beyond _PER_DRAW is the sum of ``draws`` equal draws. ``cdf`` holds P(one draw <= k) for k = 0, 1, ... until
    the rest is far below the 52 bits of a draw. ``wanted`` is the rate without the bound ``most``.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit(_NONE)).alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    asked = targets.select(F.coalesce(F.col("source"), F.lit(_NONE)).alias("_source"), F.col("weight").cast("double").alias("weight"))
    known = cut_lineage(sizes.join(asked, "_source"))
    whole = known.agg(F.coalesce(F.sum("weight"), F.lit(1.0)), F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()
    share = F.col("weight") / F.lit(whole[0]) * F.lit(whole[1])
    wanted = share * F.lit(float(epochs)) / F.col("n")
    rate = F.round(wanted if most is None else F.least(F.lit(float(most)), wanted), 9)
    steps = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")
    first = F.exp(-F.col("mean"))

    def step(state, k):
        term = state["term"] * F.col("mean") / k
        below = state["below"] + term
        return F.struct(term.alias("term"), below.alias("below"), F.concat(state["cdf"], F.array(below)).alias("cdf"))

    start = F.struct(first.alias("term"), first.alias("below"), F.array(first).alias("cdf"))
    drawn = known.select("_source", "n", F.round(wanted, 9).alias("wanted"), rate.alias("rate")).withColumn(
        "draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(_PER_DRAW))).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    return drawn.select("_source", "n", "wanted", "rate", "draws", F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["cdf"]).alias("cdf"))


def unmet(docs: DataFrame, targets: DataFrame | None = None, source_col: str = "source", epochs: float = 1.0,
          most: float | None = None) -> DataFrame:
    """What a bound leaves unfilled: (source, n, wanted, rate, unmet) with mean repetitions and the share of the wanted
    copies that are not made; 0 without a bound."""
    table = rates(docs, targets if targets is not None else tempered(docs, source_col), source_col, epochs, most)
    short = F.when(F.col("wanted") > 0, 1 - F.col("rate") / F.col("wanted")).otherwise(0.0)
    return table.select(F.when(F.col("_source") != _NONE, F.col("_source")).alias("source"), "n", "wanted", "rate", short.alias("unmet"))


def mix_sources(
        docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
        epochs: float = 1.0, most: float | None = None, seed: int = 17) -> DataFrame:
    """The documents, each as often as its draw says, in one global random order; adds _copy (from 1), _rate, _order
    (with another underscore before a name that the documents bear).

    targets: (source, weight); without it, weights follow ``tempered``. A source's mean repetition rate is its share of
    the weights times all documents times ``epochs`` over its own documents; only a caller who names ``most`` bounds it,
    and ``unmet`` tells what that leaves unfilled. A document's count is the Poisson distribution with that mean inverted
    at a uniform number hashed from seed and id (a sum of such counts for large rates), so it depends on nothing but the
    id and its source's rate. _order is hashed from seed, id and copy; range partitions of it, sorted within,
    are a global shuffle. Sources absent from targets, or with weight 0, give no rows; a null source is a source of its
    own; rows that repeat an id, or lack one, share its draw. An empty table gives no rows.
    """
    spark, n = docs.sparkSession, common.partitions(docs.sparkSession)
    table = cut_lineage(rates(docs, targets if targets is not None else tempered(docs, source_col), source_col, epochs, most))
    own = [docs[c] for c in docs.columns]
    copy, rate, order = (common.free_name(docs.columns, n) for n in ("_copy", "_rate", "_order"))
    joined = docs.join(table, F.coalesce(docs[source_col], F.lit(_NONE)) == table["_source"])
    def count_of(*more: Column) -> Column:
        draw = _unit(F.lit(seed), docs[id_col], *more)
        return F.size(F.filter(table["cdf"], lambda c: c <= draw))

    several = F.aggregate(F.sequence(F.lit(1), table["draws"]), F.lit(0), lambda total, k: total + count_of(F.lit("draw"), k))
    count = F.when(table["rate"] > 0, F.when(table["draws"] == 1, count_of()).otherwise(several))
    copies = joined.select(*own, table["rate"].alias(rate), F.explode(F.sequence(F.lit(1), F.when(count > 0, count))).alias(copy))
    ordered = copies.withColumn(order, _unit(F.lit(seed + 1), F.col(id_col), F.col(copy)))
    place = F.least(F.lit(n - 1), F.floor(F.col(order) * n)).cast("int")
    return ordered.repartitionById(n, place).sortWithinPartitions(order, id_col, copy)
