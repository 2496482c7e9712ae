"""Connected components by alternating stars: every step is a minimum per node and a join, never a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long): the smallest node that it reaches.

    Nodes without a link to another node are not listed. Each round hangs every node's larger neighbours,
    then its smaller ones, under the smallest; rounds are written to the shared checkpoint folder.
    """
    pairs = materialise(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before or not state.n:
            break
        before = (state.n, state.h)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(under, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        pairs = materialise(small)
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots)
