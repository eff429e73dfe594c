"""Compare ingestion results with known labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from accessloom.operators.quality import precision_recall


def classification_quality(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall of contractor, service and orphan classification.

    ``labels`` is (source_line, label); service counts by account type, the others by ownership.
    """
    joined = records.select("source_line", "account_type", "ownership_status").join(
        labels.withColumnRenamed("label", "truth"), "source_line", "left")
    judged = F.inline(F.array(
        F.struct(F.lit("contractor").alias("kind"), (F.col("ownership_status") == "contractor").alias("predicted")),
        F.struct(F.lit("service").alias("kind"), (F.col("account_type") == "service").alias("predicted")),
        F.struct(F.lit("orphan").alias("kind"), (F.col("ownership_status") == "orphan").alias("predicted"))))
    rows = joined.select("truth", judged).withColumn(
        "expected", F.coalesce(F.col("truth") == F.col("kind"), F.lit(False)))
    return precision_recall(rows, F.col("kind"), F.col("expected"), F.col("predicted"))


def judge(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_set, tp, fp, fn, precision, recall) of each label set and, as ``all``, of all together.

    Both sides are (label_set, entity); they meet in one grouping by both, and all sets are counted in one pass over it.
    An entity that is given twice counts once; an empty denominator gives null.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("label_set", F.col("entity").cast("string").alias("entity"), F.lit(name).alias("side"))

    met = side(predicted, "p").unionByName(side(labels, "e")).filter("label_set IS NOT NULL").groupBy("label_set", "entity").agg(
        F.max(F.col("side") == "p").alias("p"), F.max(F.col("side") == "e").alias("e"))
    counted = met.rollup("label_set").agg(
        F.count_if(F.expr("p AND e")).alias("tp"), F.count_if(F.expr("p AND NOT e")).alias("fp"), F.count_if(F.expr("e AND NOT p")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        F.coalesce("label_set", F.lit("all")).alias("label_set"), "tp", "fp", "fn",
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))


def no_human_quality(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision and recall of "no person behind this user"; ``expected`` is (username)."""
    flagged = expected.select("username").distinct().withColumn("_expected", F.lit(True))
    rows = records.join(flagged, "username", "left")
    return precision_recall(
        rows, F.lit("no_human_match"), F.col("_expected").isNotNull(), F.col("owner_identity_id").isNull())


def multi_account_people(accounts: DataFrame, minimum: int = 2) -> DataFrame:
    """People who own at least ``minimum`` accounts."""
    owned = accounts.filter(F.col("owner_identity_id").isNotNull())
    return owned.groupBy("owner_identity_id").agg(F.count("*").alias("accounts")).filter(F.col("accounts") >= minimum)


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("reason_code", "status").agg(F.count("*").alias("row_count"))
