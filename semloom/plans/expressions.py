"""Class expressions of mapping patterns as rows, for all models of a table at once.

A pattern is walked from one of its ends, a step of all patterns a round: each template joins the node that reaches it
first, along or against its direction, and is used once. What the walk finds is a table of hops with a depth. It folds
from the deepest hops up into text, and it is read as types and edges of witnesses without any folding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.functions import iri
from semloom.model import TYPE
from semloom.operators.reasoning import written
from semloom.plans.pattern import THIS, VALUE

ROOT = -1
#: The order of a node's members: its own class, types, and restrictions by the direction that the walk takes first.
OWN, TYPED, FIRST, SECOND = range(4)


def hops(roots: DataFrame, most_rounds: int = 100) -> tuple[DataFrame, int]:
    """The hops of patterns and how many levels they have, from roots (anchor, forward, own, end, pattern).

    A forward walk starts at ?this, which is of the class own; ?value, where it is reached along a template, is of the
    class end. A backward walk starts at ?value, of the class own, and ?this is of the class end. Templates without
    predicate are left out. A hop (anchor, node, k, depth, rank, is_type, p, inverse, filler) leads from a node, named by
    the template that reached it, by template k to the class filler, or to the node k where filler is null. Anchors must
    be unique. In a pattern with cycles a template belongs to the node that is reached in fewest steps, the earlier one
    of several.
    """
    flat = roots.select("anchor", "forward", "own", "end", F.posexplode("pattern").alias("k", "t")).select("anchor", "forward", "own", "end", "k", "t.subject", F.col("t.predicate").alias("p"), "t.object")
    left = written(flat.filter("p <> ''"))
    frontier = roots.select("anchor", F.lit(ROOT).alias("node"), F.when(F.col("forward"), THIS).otherwise(VALUE).alias("at"))
    constant = ~F.startswith("object", F.lit("?"))
    ahead = F.col("forward")
    typed = constant & (ahead | (F.col("p") == TYPE))
    found: list[DataFrame] = []
    for depth in range(most_rounds):
        along = left.join(frontier.withColumnRenamed("at", "subject"), ["anchor", "subject"])
        along = along.filter(ahead | typed | ((F.col("p") != TYPE) & (F.col("subject") != VALUE)))
        against = left.join(frontier.withColumnRenamed("at", "object"), ["anchor", "object"])
        against = against.filter(~ahead | ~F.col("object").isin(THIS, VALUE))
        along = along.select(
            "anchor", "k", "node", F.when(typed, TYPED).when(ahead, FIRST).otherwise(SECOND).alias("rank"), typed.alias("is_type"), "p", F.lit(False).alias("inverse"),
            F.when(typed, F.col("object")).when(F.col("object") == VALUE, F.when(ahead, F.col("end")).otherwise(F.col("own"))).alias("filler"), F.col("object").alias("to"),
        )
        this = F.col("subject") == THIS
        against = against.select(
            "anchor", "k", "node", F.when(ahead, SECOND).otherwise(FIRST).alias("rank"), F.lit(False).alias("is_type"), "p", F.lit(True).alias("inverse"),
            F.when(this, F.when(ahead, F.col("own")).otherwise(F.col("end"))).alias("filler"), F.col("subject").alias("to"),
        )
        both = along.unionByName(against)
        first = both.groupBy("anchor", "k").agg(F.min(F.struct("node", "rank", "is_type", "p", "inverse", "filler", "to")).alias("h")).select("anchor", "k", "h.*")
        step = written(first.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        found.append(step)
        frontier = step.filter("filler IS NULL AND NOT is_type").select("anchor", F.col("k").alias("node"), F.col("to").alias("at"))
        left = left.join(step.select("anchor", "k"), ["anchor", "k"], "left_anti")
    else:
        raise RuntimeError(f"the patterns were not walked in {most_rounds} rounds")
    own = roots.filter("own IS NOT NULL").select(
        "anchor", F.lit(ROOT).alias("k"), F.lit(ROOT).alias("node"), F.lit(OWN).alias("rank"), F.lit(True).alias("is_type"), F.lit(None).cast("string").alias("p"), F.lit(False).alias("inverse"),
        F.col("own").alias("filler"), F.lit(None).cast("string").alias("to"), F.lit(0).alias("depth"),
    )
    return reduce(DataFrame.unionByName, [own, *found]).drop("to"), max(1, len(found))


def texts(rows: DataFrame, levels: int) -> DataFrame:
    """(anchor, text): the expressions in Turtle, from hops whose p and filler are written as Turtle already."""
    below: DataFrame | None = None
    for depth in reversed(range(levels)):
        here = rows.filter(F.col("depth") == depth)
        inner = F.col("filler")
        if below is not None:
            here = here.join(below.select("anchor", F.col("node").alias("k"), F.col("text").alias("_inner")), ["anchor", "k"], "left")
            inner = F.coalesce("filler", "_inner")
        inner = F.coalesce(inner, F.lit("owl:Thing"))
        on = F.when(F.col("inverse"), F.concat(F.lit("[ owl:inverseOf "), "p", F.lit(" ]"))).otherwise(F.col("p"))
        some = F.concat(F.lit("[ a owl:Restriction ; owl:onProperty "), on, F.lit(" ; owl:someValuesFrom "), inner, F.lit(" ]"))
        member = F.struct("rank", "k", F.when(F.col("is_type"), F.col("filler")).otherwise(some).alias("text"))
        members = F.sort_array(F.collect_list(member))["text"]
        joined = F.concat(F.lit("[ a owl:Class ; owl:intersectionOf ( "), F.array_join(members, " "), F.lit(" ) ]"))
        below = here.groupBy("anchor", "node").agg(F.when(F.size(members) == 1, members[0]).otherwise(joined).alias("text"))
    return below.filter(F.col("node") == ROOT).select("anchor", "text")


def witness_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types (anchor, s, c) and edges (anchor, s, p, o) of hops: one individual for each node of an expression."""
    name = lambda n: F.concat("anchor", F.lit(":"), F.col(n).cast("string"))
    types = rows.filter("filler IS NOT NULL").select("anchor", F.when(F.col("is_type"), name("node")).otherwise(name("k")).alias("s"), F.col("filler").alias("c"))
    some = rows.filter("NOT is_type")
    start, end = (F.when(F.col("inverse"), name(a)).otherwise(name(b)) for a, b in (("k", "node"), ("node", "k")))
    return types, some.select("anchor", start.alias("s"), "p", end.alias("o"))


def shown(term: Column, namespaces: list[tuple[Column, Column]]) -> Column:
    """term under the first prefix that leaves a local name, else <term>; a prefix without namespace (null) is passed over."""
    tries = [F.when(F.startswith(term, n) & F.substring(term, F.length(n) + 1, F.lit(1 << 30)).rlike(iri.LOCAL), F.concat(p, F.lit(":"), F.substring(term, F.length(n) + 1, F.lit(1 << 30)))) for p, n in namespaces]
    return F.coalesce(*tries, F.concat(F.lit("<"), term, F.lit(">")))
