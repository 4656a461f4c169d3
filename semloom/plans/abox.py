"""Relational tables as one virtual triples view (s, p, o).

Every branch of the view is a projection of one table's column with a literal predicate, so a pattern reads just the
columns that its predicates come from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.model import TABLES, TYPE


def individual(table: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{table}/"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


@dataclass(frozen=True)
class Term:
    """One end of a branch: a column as it is in the table, and what stands before it in an individual's name; a literal, or
    a constant, has nothing before it."""

    column: str
    before: str | None = None
    constant: str | None = None

    @property
    def raw(self) -> Column:
        return F.lit(self.constant) if self.constant is not None else F.expr(self.column)

    def name(self, raw: Column | None = None) -> Column:
        text = (self.raw if raw is None else raw).cast("string")
        return text if self.before is None else F.concat(F.lit(self.before), text)


@dataclass(frozen=True)
class Branch:
    predicate: str
    table: str
    s: Term
    o: Term


class View:
    """The triples of tables with a key, branch by branch: a type, an edge for each object column, a literal for each
    data column; for orders also the role that a customer plays and the instant of the order.

    only() makes the branches that are asked for and no others, so that planning takes what the question takes and not
    what the model holds.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, tables: list[str] | None = None):
        self.spark, self.sf_dir, self.read = spark, sf_dir, {}
        self.branches: list[Branch] = []
        for t in (TABLES[n] for n in tables or TABLES):
            me = Term(t.key, f"{t.name}/")
            add = lambda p, s, o, t=t: self.branches.append(Branch(p, t.name, s, o))
            add(TYPE, me, Term("", constant=t.name))
            for c, other in t.objects.items():
                add(c, me, Term(c, f"{other}/"))
            for c in t.data:
                add(c, me, Term(c))
            if t.name == "orders":
                role, time = Term(t.key, "buyer/"), Term(t.key, "time/")
                add("hasParticipant", me, role)
                add(TYPE, role, Term("", constant="BuyerRole"))
                add("isFeatureOf", role, Term("o_custkey", "customer/"))
                add("atTime", me, time)
                add(TYPE, time, Term("", constant="TimeInstant"))
                add("hasValue", time, Term("date_format(o_orderdate, 'yyyy-MM-dd')"))

    def table(self, name: str) -> DataFrame:
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.read[name]

    def matching(self, *predicates: str, objects: tuple[str, ...] = ()) -> list[Branch]:
        return [b for b in self.branches if (not predicates or b.predicate in predicates) and (not objects or b.o.constant is None or b.o.constant in objects)]

    def only(self, *predicates: str, objects: tuple[str, ...] = ()) -> DataFrame:
        """The triples (s, p, o) of predicates, all of them where none is named; of constant objects only those given."""
        named = lambda b: self.table(b.table).select(b.s.name().alias("s"), F.lit(b.predicate).alias("p"), b.o.name().alias("o")).filter("s IS NOT NULL AND o IS NOT NULL")
        parts = [named(b) for b in self.matching(*predicates, objects=objects)]
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "s string, p string, o string")
        return found.filter(F.col("o").isin(*objects)) if objects else found


def edges_of(triples: View | DataFrame, *predicates: str, objects: tuple[str, ...] = ()) -> DataFrame:
    """Triples of predicates, of given objects if there are any, from a view or a table (s, p, o)."""
    if isinstance(triples, View):
        return triples.only(*predicates, objects=objects)
    found = triples.filter(F.col("p").isin(*predicates))
    return found.filter(F.col("o").isin(*objects)) if objects else found


def triples(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> DataFrame:
    """All triples of the tables as one table."""
    return View(spark, sf_dir, tables).only()
