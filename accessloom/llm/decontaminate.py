"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.llm import common
from accessloom.session import cut_lineage

def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(n: Column, size: int, one) -> Column:
    """``one`` of each run of ``size`` words by its first place, from 1; a shorter text, if it has words, is a single
    run at place 0."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), one)).when(n > 0, F.array(one(F.lit(0))))


def hashed_shingles(df: DataFrame, size: int, name: str) -> DataFrame:
    """Adds hashes of the runs of column ``words``, made from hashes of the words, so no text is put together.

    The word hashes are a column of their own: inside the function that makes the runs they would be made for each run.
    """
    own = "_word_hashes"
    hashed = df.withColumn(own, F.transform("words", lambda w: F.xxhash64(w)))

    def one(i):
        return F.when(i == 0, F.xxhash64(F.col(own))).otherwise(F.xxhash64(*[F.get(F.col(own), i - 1 + k) for k in range(size)]))

    return hashed.withColumn(name, _runs(F.size(own), size, one)).drop(own)


def exact_shingles(words_: str, size: int) -> Column:
    """The distinct runs themselves of a column of words."""
    def one(i):
        return F.when(i == 0, F.concat_ws(" ", F.col(words_))).otherwise(F.concat_ws(" ", F.slice(F.col(words_), i, size)))

    return F.array_distinct(_runs(F.size(words_), size, one))


def minima_needed(partition: Column, share: float, most: int | None) -> Column:
    """How many minima an item of size partition p (sizes 2^p up to 2^(p+1) - 1) keeps: one more than the shingles it may
    lack makes the search exact; ``most`` bounds them."""
    may_lack = F.floor(F.lit(1 - share) * (F.pow(F.lit(2), partition + 1) - 1) + F.lit(1e-9))
    return (may_lack + 1 if most is None else F.least(F.lit(most), may_lack + 1)).cast("int")


def signatures(items: DataFrame, id_col: str, text_col: str, size: int, share: float, most: int | None = None) -> DataFrame:
    """Items with shingles: item_key, item_id, words, n_shingles, and the hashes of their least shingles.

    Items are partitioned by the power of two of their size; the partition sets how many of the hash minima of the set
    are its MinHash signature.
    """
    split = items.select(
        common.row_key(id_col, text_col).alias("item_key"), F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")
    ).dropDuplicates(["item_key"]).where(F.size("words") > 0)
    hashed = hashed_shingles(split, size, "runs").withColumn("hashes", F.array_sort(F.array_distinct("runs")))
    partition = F.floor(F.log2(F.size("hashes")) + F.lit(1e-9)).cast("int")
    return hashed.withColumn("partition", partition).select(
        "item_key", "item_id", "words", "partition", F.size("hashes").alias("n_shingles"),
        F.slice("hashes", F.lit(1), minima_needed(F.col("partition"), share, most)).alias("minima"))


def contained(
        docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
        item_text: str = "text", size: int = 5, share: float = 0.8, most_minima: int | None = None) -> DataFrame:
    """Pairs of document and item where the document holds at least ``share`` of the item's distinct word shingles:
    doc_key, doc_id, item_id, n_item, n_shared, containment.

    A document is a candidate for an item if it holds one of the item's minima: a minimum of the small set is in the
    large set with a chance equal to the containment, whatever the size of the large set, and minima are distinct
    shingles, so with one more than may be lacking one of them must be there. Only a caller who bounds the minima by
    ``most_minima`` may lose pairs, each with a chance below (1 - share) ** most_minima. A document too small for an item's
    partition is no candidate. Candidates are then verified on their words. Signatures are one small table that Spark
    broadcasts while it is under its threshold and joins by hash beyond; documents are never shuffled but for
    candidates, which a bitmap of fixed size finds in the second scan.

    A text with fewer than ``size`` words is one shingle, which only an equally short text can hold. Null or empty texts
    hold nothing and are held by nothing. Repeated rows count once; rows without id take part, their id is null. Other
    columns are ignored; where either table is empty there are no pairs.
    """
    signed = cut_lineage(signatures(items, item_id, item_text, size, share, most_minima))
    minima = cut_lineage(signed.select("item_key", "partition", F.explode("minima").alias("hash")))
    own = docs.select(
        common.row_key(doc_id, doc_text).alias("doc_key"), words(F.col(doc_text)).alias("words"))
    held = hashed_shingles(own, size, "runs").select("doc_key", F.size("words").alias("n"), F.explode_outer("runs").alias("hash"))
    # explode_outer: before explode, the optimizer tests the array's size with all that makes it put inside that test.
    # A document of n words has at most n shingles; it needs ``share`` of the least size of the item's partition.
    fits = F.col("n") >= F.floor(F.lit(share) * F.pow(F.lit(2), F.col("partition")))
    pairs = cut_lineage(held.join(minima, "hash").where(fits).select("doc_key", "item_key").distinct())
    members = common.membership(pairs, F.col("doc_key"))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"), common.row_key(doc_id, doc_text).alias("doc_key"))
    texts = common.with_membership(keyed, F.col("doc_key"), members, "open").where("open").dropDuplicates(["doc_key"])
    both = texts.join(pairs, "doc_key").withColumn("doc_words", words(F.col("text"))).join(
        signed.select("item_key", "item_id", F.col("words").alias("item_words")), "item_key")
    runs = both.select(
        "doc_key", "doc_id", "item_id", exact_shingles("item_words", size).alias("wanted"), exact_shingles("doc_words", size).alias("have"))
    counted = runs.select(
        "doc_key", "doc_id", "item_id", F.size("wanted").alias("n_item"), F.size(F.array_intersect("wanted", "have")).alias("n_shared"))
    # Stored first, so that the counts are made once and not again inside the filter.
    return cut_lineage(counted.withColumn("containment", F.col("n_shared") / F.col("n_item"))).where(F.col("containment") >= share)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents, all columns as they are, that hold no item; see ``contained``."""
    hits = cut_lineage(contained(docs, items, **options).select("doc_key"))
    key = common.row_key(options.get("doc_id", "doc_id"), options.get("doc_text", "text"))
    return common.without_keys(docs, key, hits, "doc_key")
