"""A reasoner's explanation reports, Markdown texts, as rows: one for each class that can't have members, or one for an
inconsistency. All of it is expressions over the column that holds the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.functions import iri
from semloom.model import OWL

NOTHING = OWL + "Nothing"
_NAMED = r"\[([^\]]*)\]\([^)]*\)\s+Type\s+"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def blocks(report: Column) -> Column:
    """The explanations of a report as an array of (header, body). Each begins with a line "## ... ##"; the first line
    "# ..." ends them all. A report that is null or has no such line gives an empty array."""
    kept = F.regexp_replace(report, r"(?dms)^#[^\S\n].*", "")
    parts = F.filter(F.split(kept, r"(?dm)^(?=##[^\S\n])"), lambda x: x.rlike(r"\A##\s"))
    header = lambda x: _stripped(F.regexp_replace(F.substring_index(x, "\n", 1), r"^##\s*|\s*##\s*$", ""))
    body = lambda x: _stripped(F.regexp_replace(x, r"\A[^\n]*", ""))
    out = F.transform(parts, lambda x: F.struct(header(x).alias("header"), body(x).alias("body")))
    return F.coalesce(out, F.array().cast("array<struct<header:string,body:string>>"))


def individuals(body: Column) -> Column:
    """The distinct individuals that an explanation gives a type, in the order of their lines."""
    lines = F.filter(F.transform(F.split(body, "\n"), _stripped), lambda x: x.rlike(_NAMED))
    return F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, _NAMED, 1)))


def unsatisfiable(reports: DataFrame) -> DataFrame:
    """(report, ord, iri, label, explanation) of reports (report, md): a row for each explained class. Headers without a
    link, and the class that is empty by definition, give none."""
    flat = reports.select("report", F.posexplode(blocks(F.col("md"))).alias("ord", "block"))
    label, link = iri.first_link(F.col("block.header"))
    out = flat.select("report", "ord", link.alias("iri"), label.alias("label"), iri.strip_links(F.col("block.body")).alias("explanation"))
    return out.filter((F.col("iri") != "") & (F.col("iri") != NOTHING))


def inconsistent(reports: DataFrame) -> DataFrame:
    """(report, involved, explanation) of the reports that explain an inconsistency, by their first explanation; involved
    joins the individuals that it names with commas, and is empty if it names none."""
    first = reports.select("report", F.get(blocks(F.col("md")), 0).alias("block")).filter("block IS NOT NULL")
    return first.select("report", F.array_join(individuals(F.col("block.body")), ", ").alias("involved"), iri.strip_links(F.col("block.body")).alias("explanation"))


def verdicts(inconsistencies: DataFrame, clashes: DataFrame) -> DataFrame:
    """(report, kind, iri, label, explanation) from two tables of reports (report, md). An inconsistency comes first: where
    a report has one, it is the only row, since from a contradiction every class would follow to be empty."""
    whole = inconsistent(inconsistencies)
    none = F.lit(None).cast("string")
    one = whole.select("report", F.lit("inconsistent").alias("kind"), none.alias("iri"), none.alias("label"), "explanation")
    rest = unsatisfiable(clashes).join(whole.select("report").distinct(), "report", "left_anti")
    return one.unionByName(rest.select("report", F.lit("unsatisfiable").alias("kind"), "iri", "label", "explanation"))
