"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from accessloom.llm import common, decontaminate, mixing, ngram_join, token_output, toxicity
from accessloom.llm.queries import _fold
from accessloom.session import cut_lineage, prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of those of the learning fold.

    Null and empty texts are scored like any other, as texts without evidence; repeated rows are rejected or kept alike;
    rows without id are scored but not learned from; other columns pass as they are, whatever their names.
    """
    net = toxicity.train(docs, common.table(spark, sf_dir, "labels"), ~_fold(5, 0))
    own = common.free_name(docs.columns, "_toxicity")
    return docs.withColumn(own, toxicity.score(F.col("text"), net)).where(F.col(own) < 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least id; among rows of that id, or of a group without any id,
    one by the hash of id and text. Rows that repeat id and text are copies too.

    A text without words is no copy of any: null and empty texts all stay. Other columns pass as they are; of
    rows that repeat id and text but differ in other columns any one stays.
    """
    found = ngram_join.jaccard_components(docs).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first")
    stays = cut_lineage(found.groupBy("class_key").agg(first).select("first.row_key"))
    copies = cut_lineage(found.select("row_key").join(stays, "row_key", "left_anti"))
    repeated = cut_lineage(found.groupBy("row_key").count().where("count > 1").join(stays, "row_key", "left_semi").select("row_key"))
    left = common.without_keys(docs, common.row_key("doc_id", "text"), copies, "row_key")
    own, flag = (common.free_name(docs.columns, n) for n in ("_row_key", "_repeated"))
    marked = common.with_membership(
        left.withColumn(own, common.row_key("doc_id", "text")), F.col(own), common.membership(repeated, F.col("row_key")), flag)
    words = F.regexp_like(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    once = marked.where(F.col(flag) & words).dropDuplicates([own])
    return marked.where(~(F.col(flag) & words)).unionByName(once).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows go or stay alike; rows without
    id take part; other columns pass as they are, whatever their names."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them, in random order. Null and empty texts are drawn like others; a null
    source is one of its own; rows that repeat an id, or lack one, share its draw; other columns pass as they are."""
    return mixing.mix_sources(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token sequence written in training order. Null and empty texts give no tokens; repeated rows are written
    each; a null id stands as null among a sequence's ids; other columns are not read."""
    return token_output.materialise(docs).drop("path")


STAGES = [
    ("toxicity", drop_toxic), ("ngram_join", keep_one_of_each), ("decontaminate", drop_benchmark), ("mix_sources", mix),
    ("token_output", write_tokens)]

#: The first stage scores texts with a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(prepare(spark), sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut_lineage(docs) if position else docs, sf_dir)
    return docs
