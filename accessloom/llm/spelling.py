"""Spelling variants by asymmetric chunks: one word gives two disjoint chunks, the other its positional grams.

Two words that differ by one edit keep one of the shorter word's two halves intact: the leading one in its place, or the
trailing one shifted by the difference of the lengths. So a word is entered with its halves as chunks, and looked up
with those of its grams that such a chunk can be, for its own length and for one less. What remains beside an equal half
differs by the same edit, so it is halved and matched likewise: a key holds about three quarters of a word, and the words of
one key differ in the letters left free, which bounds a key's words however many words begin or end alike. Pairs of equal
keys are verified in the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from accessloom.session import cut_lineage

#: Distinct words that a task counts before it hands them on.
HELD = 300_000
_FOLD = {c: c + 32 for c in range(65, 91)}
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


# ---- words ----------------------------------------------------------------------------------


def words_of(doc_id: object, text: str | None, slip: int | None = None) -> Counter:
    """How often a text has each run of letters, A-Z as a-z. With ``slip``, a run loses a letter where ``slip`` divides the
    checksum of id and run; the letter is the checksum modulo the length."""
    found = Counter(_RUN.findall((text or "").translate(_FOLD)))
    if slip is None:
        return found
    out, prefix = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), prefix)
        if h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


def word_counts(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, least_length: int = 5,
        least_count: int = 3) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters and their occurrences in all texts, from ``least_count`` on.

    A null or empty text has no words; rows that repeat count each; without id a row slips as one with an empty id.
    """
    def count(batches):
        def flush():
            kept = [(w, n) for w, n in held.items() if len(w) >= least_length]
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        held = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in zip(ids, batch.column(1)):
                for word, n in words_of(i, text.as_py(), slip).items():
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
                    held = Counter()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- chunks and grams -----------------------------------------------------------------------


def _piece(text: Column, first: Column, size: Column) -> Column:
    return text.substr(first + 1, size)


def keys(word: Column, length: Column) -> Column:
    """Keys of a word as the one of ``length`` letters or as its partner of one letter more.

    Two chunks, or the grams at the two places where they can be, each with two of the rest. For the word of ``length``
    letters itself, chunks and grams are the same pieces.
    """
    size = F.char_length(word)

    def halves(text: Column, own: Column, of: Column) -> list[tuple[Column, Column]]:
        """(piece, rest) for a leading and a trailing chunk of half of ``of`` letters in a text of ``own``."""
        half = F.floor(of / 2).cast("int")
        return [(_piece(text, F.lit(0), half), _piece(text, half, own - half)), (_piece(text, own - half, half), _piece(text, F.lit(0), own - half))]

    out = []
    half = F.floor(length / 2).cast("int")
    for side, (piece, rest) in enumerate(halves(word, size, length)):
        for inner, (second, _) in enumerate(halves(rest, size - half, length - half)):
            out.append(F.xxhash64(length, F.lit(2 * side + inner), piece, second))
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): all pairs of words of at least two letters that differ by one inserted, deleted or replaced letter, a < b
    or a the shorter. ``words`` has a column word without repeats."""
    sized = words.select("word", F.char_length("word").alias("length"))
    chunks = sized.select(F.col("word").alias("a"), F.col("length").alias("n_a"), F.explode(keys(F.col("word"), F.col("length"))).alias("key"))
    lengths = F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("of")
    grams = sized.select("word", lengths).where("of > 1").select(F.col("word").alias("b"), F.explode(keys(F.col("word"), F.col("of"))).alias("key"))
    found = (F.char_length("b") > F.col("n_a")) | (F.col("a") < F.col("b"))
    verified = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    return chunks.join(grams, (chunks.key == grams.key) & found & verified).select("a", "b").distinct()


# ---- groups ---------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), following forms to the last; every path doubles the way it looks ahead by round."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(now.join(ahead, "root", "left"))
        if moved.where("next IS NOT NULL").isEmpty():
            return now
        now = moved.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of each of ``words`` (word, n).

    n_near counts the words one edit away. The form is the most frequent of them (ties: the least by code points), if it
    is at least ``ratio`` times as frequent as the word, else null. The root is where forms lead, the word itself
    without one. Words are compared as they are; other columns are ignored; an empty table has no rows.
    """
    words = cut_lineage(words.select("word", "n"))
    pairs = cut_lineage(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("word", "near")
    counted = both.join(words.toDF("near", "near_n"), "near")
    best = counted.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    named = words.join(best, "word", "left").withColumn("form_n", -F.col("best.minus"))
    led = F.col("form_n") >= ratio * F.col("n")
    named = cut_lineage(named.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("best.form")).alias("form"),
        F.when(led, F.col("form_n")).alias("form_n")))
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, least_length: int = 5,
        least_count: int = 3, ratio: int = 2) -> DataFrame:
    """The words of all texts, grouped with their variants; see ``word_counts`` and ``group_variants``."""
    return group_variants(word_counts(docs, id_col, text_col, slip, least_length, least_count), ratio)
