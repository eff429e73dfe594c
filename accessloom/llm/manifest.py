"""Merkle manifest of a dataset as a postorder append log, one binary tree per group and one over the groups' roots.

A tree has ``height(n)`` levels above its n leaves; node (level k, index i) covers the leaves from i x 2^k on, and the last
node of a level may be an only child. Nodes are logged as they complete, so node (k, i) with m leaves stands at
``2x - popcount(x) + size(m, k) - 1`` with x = i x 2^k: what the x leaves before it have completed, then its own subtree.
Builders take aligned blocks of 2^BITS nodes, whose nodes are therefore one stretch of the log, and the levels above
are built alike from the blocks' roots. Siblings of a proof are addressed by that formula, without searching.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from accessloom.session import cut_lineage

#: An aligned block has 2^BITS nodes of its lowest level.
BITS = 12
LOGGED = "tree string, n long, level int, idx long, pos long, digest binary"


def node(*digests: bytes) -> bytes:
    """The digest of a run of nodes: of their digests as hexadecimal text, joined."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(n: int) -> int:
    return max(0, n - 1).bit_length()


def position(level, index, n):
    """Place of a node in the log of a tree of n leaves; takes numbers or arrays."""
    first = index << level
    leaves = np.minimum(n, (index + 1) << level) - first
    size = sum(-(-leaves >> k) for k in range(level + 1))
    return 2 * first - np.bitwise_count(np.asarray(first, np.int64)).astype(np.int64) + size - 1


def complete(digests: Iterator[bytes], first: int, n: int, base: int, top: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, digest) of the nodes of an aligned run of nodes of level ``base``, as they complete.

    ``first`` is the index of the run's first node; n the leaves of the whole tree. Holds one digest per level.
    """
    waiting = {}
    last = [-(-n >> k) - 1 for k in range(top + 1)]
    for index, digest in enumerate(digests, first):
        level = base
        yield level, index, digest
        while level < top:
            if index & 1:
                digest = node(waiting.pop(level), digest)
            elif index == last[level]:
                digest = node(digest)
            else:
                waiting[level] = digest
                break
            level, index = level + 1, index >> 1
            yield level, index, digest


# ---- Spark ----------------------------------------------------------------------------------


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its byte count, a colon and its value, or as a dash if it is null."""
    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


_HEIGHT = "CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END"


@dataclass
class Forest:
    """``leaves``: tree, n, idx, digest and what else the rows carried; ``log``: see LOGGED."""

    leaves: DataFrame
    log: DataFrame

    def roots(self) -> DataFrame:
        return self.log.where(f"level = {_HEIGHT}").select("tree", "digest")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds n, the rows of a tree, and idx, a row's place among them by ``order``; rows that tie in all of it in any order.

    Rows are sorted by ranges over all trees, so one tree spreads over many tasks; only the number of rows of each
    range and tree is summed up.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "spread")]
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    sorted_ = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread").withColumn("at", F.monotonically_increasing_id())
    stored = cut_lineage(sorted_.withColumn("part", F.shiftright("at", 33)))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own")).select(
        "part", "tree", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"),
        F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    return stored.join(parts, ["part", "tree"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop(
        "part", "at", "first", "before")


def _grown(base: int):
    """Log rows of nodes (tree, n, idx, digest) of level ``base``, sorted by tree and idx."""
    def batch(rows):
        tree, n, level, index, digest = zip(*rows)
        level, index, n = np.array(level, np.int32), np.array(index, np.int64), np.array(n, np.int64)
        place = np.zeros(len(level), np.int64)
        for k in np.unique(level):
            at = level == k
            place[at] = position(int(k), index[at], n[at])
        return pa.RecordBatch.from_arrays(
            [pa.array(tree, pa.string()), pa.array(n), pa.array(level), pa.array(index), pa.array(place), pa.array(digest, pa.binary())],
            names=[c.split()[0] for c in LOGGED.split(", ")])

    def runs(batches):
        """Each aligned run as (tree, n, first index, digests)."""
        key, run = None, []
        for b in batches:
            for tree, n, index, digest in zip(*(b.column(k).to_pylist() for k in range(4))):
                if key is None or key[:2] != (tree, index >> BITS):
                    if run:
                        yield key[0], key[2], key[3], run
                    key, run = (tree, index >> BITS, n, index), []
                run.append(digest)
        if run:
            yield key[0], key[2], key[3], run

    def grow(batches):
        rows = []
        for tree, n, first, run in runs(batches):
            for level, index, digest in complete(run, first, n, base, min(base + BITS, height(n))):
                if level > base or base == 0:
                    rows.append((tree, n, level, index, digest))
            if len(rows) >= 1 << 14:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
    return grow


def build(rows: DataFrame, order: list[str]) -> Forest:
    """The trees over ``rows`` (tree, digest, columns of ``order``, others), each over its rows in that order."""
    leaves = cut_lineage(ranked(rows, order))
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, log = leaves.select("tree", "n", "idx", "digest"), None
    for base in range(0, max(1, height(most)), BITS):
        block = F.shiftright("idx", BITS)
        grown = cut_lineage(nodes.repartition("tree", block).sortWithinPartitions("tree", "idx").mapInArrow(_grown(base), LOGGED))
        log = grown if log is None else log.unionByName(grown)
        nodes = grown.where(f"level = {base + BITS} AND {_HEIGHT} > level").select("tree", "n", "idx", "digest")
    return Forest(leaves, log)


def _upper(forest: Forest, above: DataFrame | None) -> DataFrame:
    """By block: the digests of the siblings of its root and of those above it, and those of ``above`` (tree, siblings)."""
    blocks = forest.log.where(f"level = least({BITS}, {_HEIGHT})").select("tree", "n", F.col("idx").alias("block"), F.expr(_HEIGHT).alias("height"))
    levels = blocks.where(f"height > {BITS}").select("tree", "n", "block", F.explode(F.expr(f"sequence({BITS}, height - 1)")).alias("level"))
    asked = levels.withColumn("idx", F.expr(f"shiftright(block, level - {BITS}) ^ 1")).withColumn(
        "first", F.expr("shiftleft(idx, level)")).withColumn("m", F.expr("least(n - first, shiftleft(1L, level))"))
    size = "aggregate(sequence(0, level), 0L, (s, k) -> s + shiftright(m + shiftleft(1L, k) - 1, k))"
    placed = asked.withColumn("pos", F.when(F.col("m") > 0, F.expr(f"2 * first - bit_count(first) + {size} - 1")))
    found = placed.join(forest.log.where(f"level >= {BITS}").select("tree", "pos", "digest"), ["tree", "pos"], "left")
    paths = found.groupBy("tree", "block").agg(F.expr("transform(sort_array(collect_list(struct(level, digest))), x -> x.digest)").alias("path"))
    out = blocks.join(paths, ["tree", "block"], "left").select(
        "tree", "n", "block", F.coalesce("path", F.expr("array()").cast("array<binary>")).alias("path"))
    if above is None:
        return out
    return out.join(above, "tree").select(
        "tree", "n", "block", F.concat("path", F.transform("siblings", lambda s: F.unhex(s))).alias("path"))


def _addressed(carried: list[str]):
    """Leaves with their siblings, from rows sorted by tree, block and kind: siblings above, log of the block, leaves."""
    width = 64

    def extract(batches):
        key, path, log = None, [], []
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            trees, blocks, kinds = (column[c].to_pylist() for c in ("tree", "block", "kind"))
            at = 0
            while at < batch.num_rows:
                if (trees[at], blocks[at]) != key:
                    key, log, held = (trees[at], blocks[at]), [], None
                if kinds[at] == 0:
                    path = column["path"][at].as_py()
                    at += 1
                elif kinds[at] == 1:
                    if column["at"][at].as_py() != 2 * (key[1] << BITS) - (key[1] << BITS).bit_count() + len(log):
                        raise RuntimeError(f"the log of block {key[1]} has a gap")
                    log.append(column["digest"][at].as_py())
                    at += 1
                else:
                    last = at
                    while last < batch.num_rows and kinds[last] == 2 and (trees[last], blocks[last]) == key:
                        last += 1
                    if held is None:
                        held = np.array([d.hex().encode() for d in log], f"S{width}")
                    for a in range(at, last, 2048):
                        yield rows(batch.slice(a, min(2048, last - a)), key[1], path, held)
                    at = last

    def rows(batch, block, path, log):
        index, n = np.asarray(batch.column("at")), batch.column("n")[0].as_py()
        low, start = min(BITS, height(n)), 2 * (block << BITS) - (block << BITS).bit_count()
        found = np.zeros((len(index), low + len(path)), f"S{width}")
        for k in range(low):
            sibling = index >> k ^ 1
            there = sibling <= (n - 1) >> k
            found[there, k] = log[position(k, sibling[there], n) - start]
        for k, digest in enumerate(path, low):
            found[:, k] = digest.hex().encode() if digest else b""
        flat = pa.array(found.ravel().tolist(), pa.binary()).cast(pa.string())
        flat = pc.if_else(pc.equal(flat, ""), pa.scalar(None, pa.string()), flat)
        offsets = pa.array(np.arange(len(index) + 1, dtype=np.int32) * found.shape[1])
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("tree", "n", "at", "digest", *carried)] + [pa.ListArray.from_arrays(offsets, flat)],
            names=["tree", "n", "idx", "digest", *carried, "siblings"])
    return extract


def proofs(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``siblings``, the digests (hexadecimal) beside their path level by level, null where there is none.

    A task holds the log of one block, at most 2^(BITS + 1) digests. ``above`` (tree, siblings) is the rest of the way from
    the trees' roots on.
    """
    taken = {"tree", "n", "idx", "digest"}
    carried = [c for c in forest.leaves.columns if c not in taken]
    kinds = dict(forest.leaves.dtypes)
    first = _upper(forest, above).select("tree", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "path")
    block = F.shiftright(F.expr("shiftleft(idx, level)"), BITS)
    log = forest.log.where(f"level <= {BITS}").select("tree", block.alias("block"), F.lit(1).alias("kind"), F.col("pos").alias("at"), "digest")
    own = forest.leaves.select("tree", F.shiftright("idx", BITS).alias("block"), F.lit(2).alias("kind"), F.col("idx").alias("at"), "n", "digest", *carried)
    rows = own.unionByName(log, allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    schema = "tree string, n long, idx long, digest binary, " + "".join(f"`{c}` {kinds[c]}, " for c in carried) + "siblings array<string>"
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "at").mapInArrow(_addressed(carried), schema)


def folded(leaf_: str, siblings: str, sides: str) -> Column:
    """The root that a leaf and its siblings lead to; bit k of ``sides`` tells that the sibling of level k stands left."""
    return F.expr(f"""aggregate(transform({siblings}, (s, k) -> struct(s, k)), {leaf_}, (d, e) -> sha2(
        CASE WHEN e.s IS NULL THEN d WHEN (shiftright({sides}, e.k) & 1) = 1 THEN concat(e.s, d) ELSE concat(d, e.s) END, 256))""")


def manifest(
        docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
        fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), other_leaf: Column | None = None) -> DataFrame:
    """A row per document: id, leaf, subroot, root, siblings, sides, and other_leaf if one is given (say, of changed rows).

    Leaves are digests of ``fields``; those of one group, by id, make a tree; the groups' roots, by group, make the
    tree above. A lone leaf is its tree's root. ``folded`` leads from a leaf to the root by siblings and sides.

    Null fields are part of the digest; a null group is a group of its own, before all others; rows without id come first
    in theirs. Rows of one id are ordered by leaf, and rows that are equal in all fields stand side by side in any order.
    Empty and very long texts are digested whole, without leaving their task. Other columns are ignored; an empty table
    has no rows and no root.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    digest = leaf(*[F.col(c) for c in fields])
    more = [] if other_leaf is None else [other_leaf.alias("other_leaf")]
    rows = docs.select(key.alias("tree"), F.col(id_col).alias("id"), F.unhex(digest).alias("digest"), *more)
    groups = build(rows, ["id", "digest"])
    upper = build(groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), ["own"])
    tops = cut_lineage(proofs(upper).join(upper.roots().toDF("tree", "top"), "tree").select(
        F.col("own").alias("tree"), F.lower(F.hex("digest")).alias("subroot"), F.lower(F.hex("top")).alias("root"),
        F.col("idx").alias("place"), "siblings"))
    found = proofs(groups, tops.select("tree", "siblings"))
    sides = F.expr(f"idx + shiftleft(place, {_HEIGHT})")
    named = tops.select("tree", "subroot", "root", "place")
    return found.join(named, "tree").select(
        F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", "siblings", sides.alias("sides"),
        *(["other_leaf"] if more else []))
