"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import keep


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of each node with an edge; edges have columns x and y.

    A large star ties each node's larger neighbours to its smallest one, a small star its smaller ones; both need the
    smallest neighbour alone, which is aggregated before it is shuffled, and a join, which can be split where a node
    has very many edges. Each round is written out. The rounds end when they change nothing.
    """
    e = keep(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        large = keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        e = keep(small.filter("u != v").distinct(), "small-star")
