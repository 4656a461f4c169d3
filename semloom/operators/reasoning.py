"""Ontology rules over triples (s, p, o) and types, as joins; closures as semi-naive rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.model import TYPE
from semloom.plans.abox import edges_of


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cuts the lineage of a round by a table in the session's checkpoint folder; one of its own only in local mode, where none is set."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="semloom-"))
        root = context.getCheckpointDir()
    path = f"{root.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one, which a plan reads as a single scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.scratch for t in tables))


def dropped(tables: list[DataFrame]) -> None:
    """Removes written tables that no later result reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def transitive(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """The transitive closure of edges (sub, sup). Each round joins what is new with all pairs found so far, so the
    paths' length doubles; it ends, also on cycles, when nothing is new. A round writes what is new and no more."""
    tables = [written(edges.select("sub", "sup").filter("sub IS NOT NULL AND sup IS NOT NULL").distinct())]
    for _ in range(most_rounds):
        known, new = together(tables), tables[-1]
        a, b = new.select("sub", F.col("sup").alias("mid")), known.select(F.col("sub").alias("mid"), "sup")
        c, d = known.select("sub", F.col("sup").alias("mid")), new.select(F.col("sub").alias("mid"), "sup")
        step = a.join(b, "mid").unionByName(c.join(d, "mid")).select("sub", "sup").distinct()
        step = written(step.join(known, ["sub", "sup"], "left_anti"))
        if step.isEmpty():
            dropped([step])
            return together(tables)
        tables.append(step)
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def propagate_types(types: DataFrame, closure: DataFrame) -> DataFrame:
    """types (s, c) with all superclasses, by a closure (sub, sup)."""
    up = types.join(closure, F.col("c") == F.col("sub")).select("s", F.col("sup").alias("c"))
    return types.select("s", "c").unionByName(up).distinct()


def _distinct(types: DataFrame) -> DataFrame:
    """Distinct types (s, c), told apart after they are dealt: a task that reads a large part of a file keeps none of them."""
    return types.repartition("s", "c").distinct()


def infer_domain(triples: DataFrame, domains: DataFrame) -> DataFrame:
    """Types (s, c) of subjects by domains (p, c)."""
    return _distinct(triples.join(domains, "p").select("s", "c"))


def infer_range(triples: DataFrame, ranges: DataFrame) -> DataFrame:
    """Types (s, c) of objects by ranges (p, c)."""
    return _distinct(triples.join(ranges, "p").select(F.col("o").alias("s"), "c"))


def invert(triples: DataFrame, p: str, inverse: str) -> DataFrame:
    return edges_of(triples, p).select(F.col("o").alias("s"), F.lit(inverse).alias("p"), F.col("s").alias("o"))


def symmetric(triples: DataFrame, p: str) -> DataFrame:
    found = edges_of(triples, p).select("s", "p", "o")
    return found.unionByName(invert(triples, p, p)).distinct()


def subproperties(triples: DataFrame, spo: DataFrame) -> DataFrame:
    """triples with what all superproperties, direct and further up, add; spo (sub, sup) holds the direct ones."""
    up = triples.join(transitive(spo), F.col("p") == F.col("sub")).select("s", F.col("sup").alias("p"), "o")
    return triples.select("s", "p", "o").unionByName(up).distinct()


def reflexive(individuals: DataFrame, p: str) -> DataFrame:
    """Triples of a reflexive property: every individual (s) with itself."""
    return individuals.select("s").distinct().select("s", F.lit(p).alias("p"), F.col("s").alias("o"))


def chain(triples: DataFrame, first: str, second: str, result: str) -> DataFrame:
    a = edges_of(triples, first).select("s", F.col("o").alias("mid"))
    b = edges_of(triples, second).select(F.col("s").alias("mid"), "o")
    return a.join(b, "mid").select("s", F.lit(result).alias("p"), "o").distinct()


def all_values(triples: DataFrame, types: DataFrame, c: str, p: str, filler: str) -> DataFrame:
    """Types (s, c) of the values of p at individuals of a class whose values of p are all of filler."""
    mine = types.filter(F.col("c") == c).select("s")
    return edges_of(triples, p).join(mine, "s", "left_semi").select(F.col("o").alias("s"), F.lit(filler).alias("c")).distinct()


def some_values(triples: DataFrame, types: DataFrame, p: str, filler: str, anchor: str) -> DataFrame:
    """Types (s, c): what has a value of p in filler belongs to anchor."""
    theirs = types.filter(F.col("c") == filler).select(F.col("s").alias("o"))
    return edges_of(triples, p).join(theirs, "o", "left_semi").select("s", F.lit(anchor).alias("c")).distinct()


def intersections(types: DataFrame, parts: DataFrame) -> DataFrame:
    """Types (s, c) of the individuals that are in every part c of a whole, for parts (whole, c)."""
    n = parts.distinct().groupBy("whole").agg(F.count("*").alias("parts"))
    mine = types.select("s", "c").distinct().join(parts.distinct(), "c").groupBy("s", "whole").agg(F.count("*").alias("n"))
    return mine.join(n, "whole").filter("n = parts").select("s", F.col("whole").alias("c"))


def unions(types: DataFrame, parts: DataFrame) -> DataFrame:
    """Types (s, c) of the individuals that are in any part c of a whole, for parts (whole, c)."""
    return types.join(parts, "c").select("s", F.col("whole").alias("c")).distinct()


def exist(types: DataFrame, triples: DataFrame, axioms: DataFrame) -> DataFrame:
    """(s, p, o, c): a witness o of class c for each individual of a class that must have a value of p in the class filler,
    by axioms (c, p, filler), and has none. Both the triple and the type of o follow from a row."""
    due = types.join(axioms, "c").select("s", "p", "filler").distinct()
    met = triples.join(types.select(F.col("s").alias("o"), F.col("c").alias("filler")), "o").select("s", "p", "filler")
    name = F.concat("s", F.lit("#"), "p", F.lit(":"), "filler")
    return due.join(met, ["s", "p", "filler"], "left_anti").select("s", "p", name.alias("o"), F.col("filler").alias("c"))


def disjoint_classes(types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(s, one, other) for individuals in two classes that are disjoint (one, other)."""
    a, b = types.select("s", F.col("c").alias("one")), types.select("s", F.col("c").alias("other"))
    return a.join(disjoint, "one").join(b, ["s", "other"]).select("s", "one", "other").distinct()


def functional(triples: DataFrame, p: str) -> DataFrame:
    """(s, n) with several values."""
    return edges_of(triples, p).groupBy("s").agg(F.countDistinct("o").alias("n")).filter("n > 1")


def inverse_functional(triples: DataFrame, p: str) -> DataFrame:
    """(o, n) that several subjects have."""
    return edges_of(triples, p).groupBy("o").agg(F.countDistinct("s").alias("n")).filter("n > 1")


def asymmetric(triples: DataFrame, p: str) -> DataFrame:
    found = edges_of(triples, p).select("s", "o").distinct()
    return found.join(found.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"], "left_semi")


def irreflexive(triples: DataFrame, p: str) -> DataFrame:
    return edges_of(triples, p).filter("s = o").select("s").distinct()


def disjoint_properties(triples: DataFrame, one: str, other: str) -> DataFrame:
    return edges_of(triples, one).select("s", "o").intersect(edges_of(triples, other).select("s", "o"))


def types_of(triples: DataFrame, *classes: str) -> DataFrame:
    return edges_of(triples, TYPE, objects=classes).select("s", F.col("o").alias("c"))


def small(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Axioms as a table, which a join with triples sends to them: by its few keys, all triples would go to a few tasks."""
    return F.broadcast(spark.createDataFrame(rows, columns))
