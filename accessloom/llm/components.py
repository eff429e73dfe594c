"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from accessloom.session import cut_lineage, released, stored_tables


@released
def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that is not its component's least node, from links (a, b).

    Alternates large stars (each node's larger neighbours move to the least node it sees) and small stars (its smaller
    neighbours do) until no link changes; the number of rounds grows with the logarithm of the component size. Each
    round is one stored table; all are deleted when the result is stored. Loops and repeated links are ignored.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        with stored_tables() as turn:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = cut_lineage(large)
            near = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = turn.keep(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct())
        seen = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
        if seen == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
