"""Concepts of RDF documents: typing, labels, comments, search and ranking, over triples with their document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.functions.iri import CLASS_TYPES, PROPERTY_TYPES, local_name
from semloom.model import OWL, RDFS, TYPE

SEARCH_LIMIT = 50


def preferred(text: Column, lang: Column, ord_: Column) -> Column:
    """The last English text in document order, else the first text."""
    return F.coalesce(F.max_by(text, F.when(lang == "en", ord_)), F.min_by(text, ord_))


def concepts(triples: DataFrame) -> DataFrame:
    """(iri, localName, type, label, comment) of the named classes and properties of triples (ord, s, s_kind, p, o, o_lang).

    One pass: a subject that is typed as a property is one, whatever else it is; a label is chosen by preferred(), a
    comment is the first one. Blank nodes are no concepts. Triples are dealt by subject before they are sorted to be
    aggregated, so that a task that reads a large part of a file sorts none of it.
    """
    named = triples.filter("s_kind = 'iri'").filter(F.col("p").isin(TYPE, RDFS + "label", RDFS + "comment"))
    is_type, is_label = F.col("p") == TYPE, F.col("p") == RDFS + "label"
    comment = F.when(F.col("p") == RDFS + "comment", F.col("o"))
    found = named.repartition("s").groupBy("s").agg(
        F.bool_or(is_type & F.col("o").isin(PROPERTY_TYPES)).alias("is_property"),
        F.bool_or(is_type & F.col("o").isin(CLASS_TYPES)).alias("is_class"),
        preferred(F.when(is_label, F.col("o")), F.when(is_label, F.col("o_lang")), F.when(is_label, F.col("ord"))).alias("label"),
        F.min_by(comment, F.when(comment.isNotNull(), F.col("ord"))).alias("comment"),
    )
    kind = F.when(F.col("is_property"), "property").when(F.col("is_class"), "class")
    return found.select(F.col("s").alias("iri"), local_name(F.col("s")).alias("localName"), kind.alias("type"), "label", "comment").filter("type IS NOT NULL")


def ranked(found: DataFrame) -> DataFrame:
    """By label, else local name, in the collation of the root locale."""
    return found.orderBy(F.collate(F.coalesce("label", "localName"), "UNICODE"), "iri")


def search(found: DataFrame, query: str, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """The first concepts whose local name, label or IRI holds the query, cases alike, or all of them where no limit is
    given; an empty query is in all."""
    q = query.strip().lower()
    hit = [F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False)) for c in ("localName", "label", "iri")]
    hits = found.filter(hit[0] | hit[1] | hit[2]) if q else found
    return hits if limit is None else ranked(hits).limit(limit)


def adoptable(triples: DataFrame, least: int = 10) -> DataFrame:
    """One row (classes, ontologies, valid): whether a document has enough classes and an ontology header."""
    typed = triples.filter(F.col("p") == TYPE)
    out = typed.agg(F.countDistinct(F.when(F.col("o") == OWL + "Class", F.col("s"))).alias("classes"), F.countDistinct(F.when(F.col("o") == OWL + "Ontology", F.col("s"))).alias("ontologies"))
    return out.withColumn("valid", (F.col("classes") >= least) & (F.col("ontologies") >= 1))


def header(triples: DataFrame, preferred_iri: str | None = None) -> DataFrame:
    """(iri, version, modified) of the preferred ontology header, else of the first one; the first value of each."""
    heads = triples.filter((F.col("p") == TYPE) & (F.col("o") == OWL + "Ontology"))
    one = heads.orderBy(F.col("s") != F.lit(preferred_iri or ""), "ord").limit(1).select(F.col("s").alias("iri"))
    facts = triples.join(F.broadcast(one), F.col("s") == F.col("iri"))
    value = lambda p: F.min_by(F.when(F.col("p").isin(*p), F.col("o")), F.when(F.col("p").isin(*p), F.col("ord")))
    return facts.groupBy("iri").agg(value([OWL + "versionInfo"]).alias("version"), value(["http://purl.org/dc/terms/modified", "http://purl.org/dc/elements/1.1/modified"]).alias("modified"))
