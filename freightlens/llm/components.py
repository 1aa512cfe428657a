"""Connected components by alternating large-star and small-star rounds.

Every round is a grouping and a join over the edges, so neither an edge list
nor a component is ever gathered in one task or on the driver. The rounds
needed grow with the logarithm of the longest chain. The edges are counted each round; few
edges are kept in few partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, gathered


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of an undirected graph.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; repeated
    edges, loops and edges with a null end add nothing. Returns ``node`` and
    ``label``, the smallest node that can be reached. Nodes without an edge to
    another node don't appear. An empty edge table gives an empty result.
    """
    e = cut_lineage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _signature(e)
    while before[0]:
        n = before[0]
        e = gathered(e, n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = gathered(
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), 2 * n,
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m"))
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut_lineage(gathered(gathered(stars, 2 * n).distinct(), 2 * n))
        after = _signature(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
