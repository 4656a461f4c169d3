"""From raw documents to packed sequences: five stages, each an operator for training corpora over all that is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and hands what it reads back
to the next. All stages but the last keep the columns of documents. Nulls, empty and very long texts, repeated rows and
empty tables have the results that the operators' docstrings state; a row with a null doc_id passes the filters by its
text and is nobody's duplicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm import decontaminate, language, neardup, packing, quality
from semloom.llm.common import fresh, materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose probability of the top grade is too low, by a model fitted on the rated ones."""
    model = quality.train(docs.select("doc_id", "text"), quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    name = fresh(docs, "quality")
    return docs.withColumn(name, quality.scored(model)("text")).filter(F.col(f"{name}.tail") >= quality.LEAST_TAIL).drop(name)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter or are near no language: learned from those not held out that are left."""
    model = language.fit(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    name = fresh(docs, "language")
    known = (F.col(f"{name}.lang") != language.UNKNOWN) & (F.col(f"{name}.score") >= language.LEAST_SCORE)
    return docs.withColumn(name, language.predicted(*model)("text")).filter(known).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id stays; of its rows with equal texts, one."""
    found = neardup.near_duplicates(docs)
    gone = materialise(found.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    named = docs.filter("doc_id IS NOT NULL").join(gone.hint("merge"), F.col("doc_id") == F.col("_gone"), "left_anti").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which a window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = materialise(found.filter("contaminated").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("language_id", keep_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stages are fitted models: no SQL gives their rows. tests/llm compares token counts with the library
#: and the operators' own tests compare duplicates and contamination with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
