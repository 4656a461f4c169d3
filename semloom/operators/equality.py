"""Individuals that are the same: functional properties say so of their values, inverse functional ones of their subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.operators.reasoning import dropped, written


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(member, representative) of all that pairs (a, b) connect: the least member stands for all.

    A round links every node to the least of its neighbours and itself, first those above it, then those below it, so that
    components become stars in a number of rounds that grows with the logarithm of their size. A node's neighbours are
    never gathered, only their least one.
    """
    edges = written(pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        changed = not small.exceptAll(edges).isEmpty() or not edges.exceptAll(small).isEmpty()
        dropped([edges, large])
        edges = small
        if not changed:
            return edges.select(F.col("a").alias("member"), F.col("b").alias("representative"))
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")


def renamed(triples: DataFrame, names: DataFrame) -> DataFrame:
    """triples (s, p, o, literal) with representatives for members (member, representative); literals stay."""
    by = lambda c: names.select(F.col("member").alias(c), F.col("representative").alias(f"_{c}"))
    out = triples.join(by("s"), "s", "left").withColumn("s", F.coalesce("_s", "s")).drop("_s")
    things = out.filter("NOT literal").join(by("o"), "o", "left").withColumn("o", F.coalesce("_o", "o")).select("s", "p", "o", "literal")
    return things.unionByName(out.filter("literal").select("s", "p", "o", "literal")).distinct()


def same(triples: DataFrame, functional: DataFrame, inverse_functional: DataFrame, stated: DataFrame | None = None, most_rounds: int = 30) -> tuple[DataFrame, DataFrame]:
    """(member, representative) of individuals that are one, and triples (s, p, o, literal) in terms of representatives.

    For triples (s, p, o, literal), the properties (p) that have one value at most and those that have one subject at most,
    and pairs (a, b) that are stated to be the same. What is merged may bring further values together: rounds go on until
    nothing more is merged. Of each subject with several values the least one is paired with the others, so a subject with
    many values gives as many pairs. Literals are never the same; nulls are no individuals.
    """
    current = written(triples.select("s", "p", "o", "literal").filter("s IS NOT NULL AND o IS NOT NULL").distinct())
    spark = triples.sparkSession
    names = written(components(stated.select("a", "b")) if stated is not None else spark.createDataFrame([], "member string, representative string"))
    if stated is not None:
        current = written(renamed(current, names))
    for _ in range(most_rounds):
        things = current.filter("NOT literal")

        def met(properties: DataFrame, key: str, value: str) -> DataFrame:
            own = things.join(properties.select("p").distinct(), "p", "left_semi")
            return own.join(own.groupBy("p", key).agg(F.min(value).alias("a")), ["p", key]).select("a", F.col(value).alias("b")).filter("a <> b")

        pairs = written(met(functional, "s", "o").unionByName(met(inverse_functional, "o", "s")).distinct())
        if pairs.isEmpty():
            return names, current
        step = components(pairs)
        onto = step.select(F.col("member").alias("representative"), F.col("representative").alias("_next"))
        moved = names.join(onto, "representative", "left").select("member", F.coalesce("_next", "representative").alias("representative"))
        names = written(moved.unionByName(step))
        current = written(renamed(current, names))
    raise RuntimeError(f"the merging did not settle in {most_rounds} rounds")


def literal_clashes(triples: DataFrame, functional: DataFrame) -> DataFrame:
    """(s, p, n) for subjects with several literals of a property that has one value at most; after same(), also those that
    only one of the merged individuals had each."""
    own = triples.filter("literal").join(functional.select("p").distinct(), "p", "left_semi")
    return own.groupBy("s", "p").agg(F.countDistinct("o").alias("n")).filter("n > 1")


