"""Exact similarity join of names at an Indel ratio of at least 90, without comparing all pairs.

Two names within Indel distance k share the string left after deleting d1 characters from one and
d2 from the other with d1 + d2 <= k, and the least such d1 + d2 is their distance. Names whose pair
allows k <= 3 meet on these shortened strings. Longer names meet on their rarest trigrams at places at most
k apart: an edit destroys at most three and moves the others by one, so among the 3k + 1 rarest of both is one that both
keep, the rarest and leftmost of those kept. They are then verified; the parts that many names share, such as a
suffix, are never keys. Cutting names into k + 1 segments instead
was tried: with a shared suffix most segments are common, and 1,500 names took 200 s.
Both routes are exact; which one a pair takes depends on its summed length only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from accessloom.functions import similarity
from accessloom.session import cut_lineage

THRESHOLD = 90
DELETION_BUDGET = 3
GRAM = 3


def _allowed(total: int) -> int:
    return total * (100 - THRESHOLD) // 100


def _partner_lengths(n: int) -> list[int]:
    return [m for m in range(1, 2 * n + 2) if abs(n - m) <= _allowed(n + m)]


def _deletion_depths() -> dict[int, int]:
    """Length -> most characters a name of that length may have to drop on the deletion route."""
    depths, n = {}, 1
    while True:
        pairs = [(m, _allowed(n + m)) for m in _partner_lengths(n) if _allowed(n + m) <= DELETION_BUDGET]
        if not pairs:
            return depths
        depths[n] = max((k + n - m) // 2 for m, k in pairs)
        n += 1


DEPTHS = _deletion_depths()
SHORTEST_LONG = min(n for n in range(1, 200) if _allowed(n + max(_partner_lengths(n))) > DELETION_BUDGET)


def _drop_one(words: Column) -> Column:
    def variants(word: Column) -> Column:
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.length(word)), lambda i: i > 0),
            lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)),
        )

    return F.array_distinct(F.flatten(F.transform(words, variants)))


def _shortened(names: DataFrame, scope: Sequence[str], side: str) -> DataFrame:
    """One row per name and distinct string reachable within its deletion depth."""
    depth = F.lit(0)
    for n, d in DEPTHS.items():
        depth = F.when(F.col("name_len") == n, d).otherwise(depth)
    level = F.array(F.col("name"))
    reached = level
    for step in range(1, DELETION_BUDGET + 1):
        level = F.when(F.col("depth") >= step, _drop_one(level)).otherwise(F.array().cast("array<string>"))
        reached = F.concat(reached, level)
    short = names.filter(F.col("name_len") <= max(DEPTHS)).withColumn("depth", depth)
    return short.select(
        *scope, F.col("name").alias(f"{side}_name"), F.col("name_len").alias(f"{side}_len"),
        F.explode(reached).alias("rest"))


def _budget() -> Column:
    """The largest distance a name of this length allows, with its longest partner."""
    longest_sum = F.col("name_len") + F.floor(F.col("name_len") * (200 - THRESHOLD) / THRESHOLD)
    return F.floor(longest_sum * (100 - THRESHOLD) / 100)


def _bag(name: Column) -> Column:
    """Two bits for each of 32 classes of characters: some, and more than one. Names at Indel distance d differ in at most d."""
    bits = F.transform(F.split(name, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * (F.ascii(c) % 32)))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda seen, bit: seen.bitwiseOR(
        F.when(seen.bitwiseAND(bit) == 0, bit).otherwise(F.call_function("shiftleft", bit, F.lit(1)))))


def _ranked_grams(names: DataFrame, frequencies: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per trigram and place of a name, with how often the trigram is seen and its rank from the rarest on."""
    grams = F.transform(F.sequence(F.lit(1), F.col("name_len") - (GRAM - 1)), lambda i: F.substr(F.col("name"), i, F.lit(GRAM)))
    placed = F.transform(F.col("grams"), lambda g, i: F.struct(g.alias("gram"), i.alias("place")))
    tokens = names.withColumn("grams", grams).select(
        *scope, "name", "name_len", "bag", (GRAM * _budget() + 1).alias("keep"), F.inline(placed))
    by_rarity = Window.partitionBy(*scope, "name").orderBy(F.coalesce("seen", F.lit(0)), "gram", "place")
    return tokens.join(frequencies, "gram", "left").withColumn("rarity", F.row_number().over(by_rarity))


def _sided(df: DataFrame, scope: Sequence[str], key: str, side: str) -> DataFrame:
    return df.select(*scope, key, *[F.col(c).alias(f"{side}_{c.removeprefix('name_')}") for c in ("place", "name", "name_len", "bag")])


def _rare_grams(names: DataFrame, frequencies: DataFrame, scope: Sequence[str], side: str) -> DataFrame:
    ranked = _ranked_grams(names, frequencies, scope)
    return _sided(ranked.filter(F.col("rarity") <= F.col("keep")), scope, "gram", side)


def _parts(length: Column) -> tuple[Column, Column]:
    """How many parts a name is cut into, two edits for each and one more, and how long they are."""
    longest_sum = length + F.floor(length * (200 - THRESHOLD) / THRESHOLD)
    count = F.floor(F.floor(longest_sum * (100 - THRESHOLD) / 100) / 2).cast("int") + 1
    return count, F.floor(length / count).cast("int")


def _without(word: Column, i: Column) -> Column:
    return F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))


def _part_keys(names: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The parts of each name, whole and without one character."""
    count, width = _parts(F.col("name_len"))
    parts = names.withColumns({"count": count, "width": width}).select(
        *scope, "name", "name_len", "bag", "width", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("count") - 1), lambda i: i * F.col("width") + 1)).alias("place"))
    part = F.substr(F.col("name"), F.col("place"), F.col("width"))
    texts = F.concat(F.array(part), F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: _without(part, i)))
    keyed = parts.withColumn("text", F.explode(F.array_distinct(texts))).withColumn("key", F.xxhash64("text"))
    return _sided(keyed, scope, "key", "index")


def _window_keys(names: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Whatever in a name may stand for a part of a partner: substrings as long as it or one shorter, and those one longer
    without an inner character. Without the first or the last one they are substrings of the part's length again."""
    n = F.col("name_len")
    partners = F.sequence(F.floor(n * THRESHOLD / (200 - THRESHOLD)).cast("int"), F.floor(n * (200 - THRESHOLD) / THRESHOLD).cast("int"))
    widths = names.withColumn("widths", F.array_distinct(F.transform(partners, lambda m: _parts(m)[1])))
    lengths = F.array_distinct(F.concat("widths", F.transform("widths", lambda w: w - 1)))
    kinds = F.concat(
        F.transform(lengths, lambda w: F.struct(w.alias("width"), F.lit(False).alias("shorten"))),
        F.transform("widths", lambda w: F.struct((w + 1).alias("width"), F.lit(True).alias("shorten"))))
    windows = widths.select(*scope, "name", "name_len", "bag", F.inline(kinds)).filter((F.col("width") > 0) & (F.col("width") <= n))
    windows = windows.withColumn("place", F.explode(F.sequence(F.lit(1), n - F.col("width") + 1)))
    window = F.substr(F.col("name"), F.col("place"), F.col("width"))
    inner = F.filter(F.sequence(F.lit(1), F.col("width") - 1), lambda i: i > 1)
    texts = F.when(F.col("shorten"), F.array_distinct(F.transform(inner, lambda i: _without(window, i)))).otherwise(F.array(window))
    keyed = windows.withColumn("text", F.explode(texts)).withColumn("key", F.xxhash64("text"))
    return _sided(keyed, scope, "key", "probe")


def by_parts(known: DataFrame, frequencies: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The known names with mark ``by_parts``: whether their parts are rarer than the trigrams they would be met on.

    A part is no more frequent than its rarest trigram; it counts threefold, as it is met without a character too.
    """
    count, width = _parts(F.col("name_len"))
    ranked = _ranked_grams(known, frequencies, scope).withColumns({"count": count, "width": width})
    at = F.col("place") - 1
    part, inside = F.floor(at / F.col("width")), (at % F.col("width") <= F.col("width") - GRAM) & (at < F.col("count") * F.col("width"))
    name = [*scope, "name", "name_len", "bag"]
    of_part = ranked.groupBy(*name, part.alias("part")).agg(
        F.min(F.when(inside, F.col("seen"))).alias("met"), F.sum(F.when(F.col("rarity") <= F.col("keep"), F.col("seen"))).alias("grams"))
    return of_part.groupBy(*name).agg(F.coalesce(3 * F.sum("met") < F.sum("grams"), F.lit(False)).alias("by_parts"))


def _near(met: DataFrame, scope: Sequence[str], shift: Column) -> DataFrame:
    """The pairs that may be similar enough; what is cheap and rules out most is asked first, before any shuffle."""
    a, b = F.col("probe_name"), F.col("index_name")
    allowed = F.floor((F.col("probe_len") + F.col("index_len")) * (100 - THRESHOLD) / 100)
    bags = F.bit_count(F.col("probe_bag").bitwiseXOR(F.col("index_bag"))) <= allowed
    pairs = met.filter((allowed > DELETION_BUDGET) & (shift <= allowed) & bags & (a != b) & similarity.maybe_at_least(a, b, THRESHOLD))
    return pairs.select(*scope, "probe_name", "index_name")


def long_candidates(probe: DataFrame, known: DataFrame, frequencies: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pairs of different names that may be similar enough: a rare trigram or a part, at places, and lengths, no further
    apart than their distance allows, and a Levenshtein distance, which never exceeds the Indel distance, within that."""
    moved, longer = F.col("probe_place") - F.col("index_place"), F.col("probe_len") - F.col("index_len")
    probe, known = (names.withColumn("bag", _bag(F.col("name"))) for names in (probe, known))
    routed = cut_lineage(by_parts(known, frequencies, scope))
    found = [routed.select(*scope, F.lit("").alias("probe_name"), F.lit("").alias("index_name")).limit(0)]
    rare, parted = routed.filter(~F.col("by_parts")), routed.filter("by_parts")
    if not rare.isEmpty():
        met = _rare_grams(probe, frequencies, scope, "probe").join(_rare_grams(rare, frequencies, scope, "index"), [*scope, "gram"], "inner")
        found.append(_near(met, scope, F.greatest(F.abs(longer), F.abs(moved))))
    if not parted.isEmpty():
        # A name has hundreds of keys, which Spark's estimate of a size to broadcast does not see.
        met = _window_keys(probe, scope).join(_part_keys(parted, scope).hint("merge"), [*scope, "key"], "inner")
        # What is inserted before a part and behind it adds up.
        found.append(_near(met, scope, F.abs(moved) + F.abs(longer - moved)))
    return reduce(DataFrame.unionByName, found).distinct()


def similar_names(probes: DataFrame, index: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """All (probe_name, index_name, ratio) with ratio >= 90 and equal ``scope`` columns.

    Both inputs need a ``name`` column; duplicates are collapsed first.
    """
    scope = list(scope)

    def distinct_names(df: DataFrame) -> DataFrame:
        named = df.select(*scope, "name").filter(F.col("name") != "").distinct()
        # Each name grows into many rows, so names are spread evenly and not merged into few tasks.
        spread = named.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *scope, "name")
        return spread.withColumn("name_len", F.length("name"))

    probe, known = distinct_names(probes), distinct_names(index)
    total = F.col("probe_len") + F.col("index_len")
    allowed = F.floor(total * (100 - THRESHOLD) / 100)
    pair = [*scope, "probe_name", "index_name"]

    equal = (
        probe.join(known.select(*scope, "name"), [*scope, "name"], "inner")
        .select(*scope, F.col("name").alias("probe_name"), F.col("name").alias("index_name"), F.lit(100.0).alias("ratio")))

    dropped = total - 2 * F.length("rest")
    # A name has up to about 1,500 shortened strings, which Spark's estimate of a size to broadcast does not see.
    near = (
        _shortened(probe, scope, "probe").join(_shortened(known, scope, "index").hint("merge"), [*scope, "rest"], "inner")
        .filter((dropped <= allowed) & (F.col("probe_name") != F.col("index_name")) & (allowed <= DELETION_BUDGET))
        .groupBy(*pair).agg(F.min(dropped).alias("distance"), F.first(total).alias("total"))
        .select(*pair, similarity.ratio_from_distance(F.col("distance"), F.col("total")).alias("ratio")))

    def long_only(names: DataFrame) -> DataFrame:
        return names.filter(F.col("name_len") >= SHORTEST_LONG)

    # At most (alphabet size)^GRAM rows: normalised names use 37 characters.
    frequencies = long_only(known).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.col("name_len") - (GRAM - 1)), lambda i: F.substr(F.col("name"), i, F.lit(GRAM)))).alias("gram"))
    frequencies = frequencies.groupBy("gram").agg(F.count("*").alias("seen"))
    far = similarity.with_ratio(long_candidates(long_only(probe), long_only(known), frequencies, scope), "probe_name", "index_name", THRESHOLD)
    return equal.unionByName(near).unionByName(far)


def unique_best(pairs: DataFrame, key: Sequence[str], holders: str, min_gap: float = 5.0) -> DataFrame:
    """The best match per key when it is one holder and the runner-up trails by ``min_gap`` or more."""
    order = Window.partitionBy(*key).orderBy(F.desc("ratio"), "index_name")
    top_two = pairs.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= 2)
    folded = top_two.groupBy(*key).agg(
        F.min_by(F.struct(*[c for c in pairs.columns if c not in key]), "_rn").alias("best"),
        F.max(F.when(F.col("_rn") == 2, F.col("ratio"))).alias("runner_up"))
    clear = F.col("runner_up").isNull() | (F.col("best.ratio") - F.col("runner_up") >= min_gap)
    return folded.filter(clear & (F.col(f"best.{holders}") == 1)).select(*key, "best.*")
