"""Connected components as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import drop_scratch, materialise


def _starred(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: every node hands its neighbours (the larger ones, or the smaller ones and itself) to its smallest neighbour."""
    if larger:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        # written, so that the join reads two plain shuffles and a node with very many neighbours can be split
        least = materialise(least, "least")
        out = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = materialise(down.groupBy("src").agg(F.min("dst").alias("m")), "least")
        out = down.join(least, "src").filter("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        out = out.unionByName(least.select("src", F.col("m").alias("dst")))
    done = materialise(out.filter("src <> dst").distinct(), "star")
    drop_scratch(least)
    return done


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the smallest node that it is connected with.

    Alternates large-star and small-star steps until the edges are stars. Nothing is collected but a count and a
    checksum of each round. Loops, repeated and null edges are dropped; a node with loops only is not returned.
    """
    now = materialise(
        edges.select(F.least("src", "dst").alias("dst"), F.greatest("src", "dst").alias("src"))
        .filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct(), "edges")
    mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
    for _ in range(most_rounds):
        big = _starred(now, True)
        new = _starred(big, False)
        drop_scratch(big)
        drop_scratch(now)
        now, old = new, mark
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if mark == old:
            break
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
