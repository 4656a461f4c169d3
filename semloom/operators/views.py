"""What a model's rows look like to its readers, over tables of classes and properties of any number of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.functions import iri
from semloom.model import TEMPLATE, TYPE, XSD
from semloom.operators.exports import references
from semloom.sources.catalog import json_array

#: The property that types a node, offered beside those of an upper ontology.
TYPE_CONCEPT = (TYPE, "type", "property", "a (rdf:type)", "The class of the subject")


def class_view(classes: DataFrame, base: str) -> DataFrame:
    """Class rows under their outward names, with an address; what is absent stays null."""
    return classes.select(
        "id", F.concat(F.lit(base), "id").alias("url"), "name", "label", "description",
        F.col("maps_to_concept_iri").alias("mapsToConceptIri"), F.col("super_class_id").alias("superClassId"),
    )


def property_view(properties: DataFrame, base: str) -> DataFrame:
    """Property rows under their outward names: JSON texts as arrays (empty if null or malformed), 0 and 1 as booleans."""
    return properties.select(
        "id", F.concat(F.lit(base), "id").alias("url"), "name", "label", F.col("property_type").alias("propertyType"),
        F.col("domain_class_id").alias("domainClassId"), F.col("range_class_iri").alias("rangeClassIri"),
        json_array(F.col("mapping_pattern"), TEMPLATE).alias("mappingPattern"), F.coalesce(F.col("is_required") == 1, F.lit(False)).alias("isRequired"),
        json_array(F.col("property_features")).alias("propertyFeatures"), json_array(F.col("disjoint_property_iris")).alias("disjointPropertyIris"),
    )


def property_concepts(concepts: DataFrame) -> DataFrame:
    """The properties among concepts (iri, localName, type, label, comment), and the one that types a node."""
    pinned = concepts.sparkSession.createDataFrame([TYPE_CONCEPT], "iri string, localName string, type string, label string, comment string")
    return pinned.unionByName(concepts.filter("type = 'property'").select(*pinned.columns))


def previews(properties: DataFrame, classes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, preview) for properties (id, pattern) with a pattern whose predicates are all set: "subject predicate object"
    lines. A class is shown by its label or name, a class concept by its label or local name, other IRIs by local name."""
    full = F.forall("pattern", lambda t: F.coalesce(t["predicate"] != "", F.lit(False)))
    flat = properties.filter((F.size("pattern") > 0) & full).select("id", F.posexplode("pattern").alias("at", "t")).select("id", "at", "t.subject", "t.predicate", "t.object")
    known = classes.select(F.col("url").alias("object"), F.struct(F.lit(0), F.coalesce("label", "name").alias("shown")).alias("k"))
    known = known.unionByName(concepts.filter("type = 'class'").select(F.col("iri").alias("object"), F.struct(F.lit(1), F.coalesce("label", "localName").alias("shown")).alias("k")))
    names = known.filter("k.shown IS NOT NULL").groupBy("object").agg(F.min("k")["shown"].alias("shown"))
    predicate = F.when(F.col("predicate") == TYPE, "a").otherwise(iri.local_name(F.col("predicate")))
    shown = F.when(F.startswith("object", F.lit("?")), F.col("object")).otherwise(F.coalesce("shown", iri.local_name(F.col("object"))))
    lines = flat.join(names, "object", "left").select("id", "at", F.concat_ws(" ", "subject", predicate, shown).alias("line"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return lines.groupBy("id").agg(F.array_join(ordered, " .\n").alias("preview"))


def intermediate(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """classes (url, ...) with intermediate: whether a pattern names the class as an object, so that it is a bridge only."""
    objects = properties.select(F.explode("pattern.object").alias("url")).filter("url NOT LIKE '?%'").distinct()
    return classes.join(objects.withColumn("intermediate", F.lit(True)), "url", "left").withColumn("intermediate", F.coalesce("intermediate", F.lit(False)))


def property_cards(properties: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, domain_class_id, ranges): a row for properties (ord, name, domain_class_id, range_class_iri) of one name and
    domain, their ranges' names in order; null without a range. Datatypes begin with xsd:."""
    named = classes.groupBy(F.col("url").alias("range_class_iri")).agg(F.min_by("name", "id").alias("class_name"))
    label = F.when(F.contains("range_class_iri", F.lit(XSD)), F.concat(F.lit("xsd:"), F.substring_index("range_class_iri", "#", -1)))
    label = F.coalesce(label, "class_name", iri.local_id(F.col("range_class_iri")))
    rows = properties.join(named, "range_class_iri", "left").select("ord", "name", "domain_class_id", label.alias("label"))
    ranges = F.transform(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("ord", "label")))), lambda x: x["label"])
    return rows.groupBy("name", "domain_class_id").agg(F.nullif(F.array_join(ranges, " | "), F.lit("")).alias("ranges"))


def property_names(properties: DataFrame) -> DataFrame:
    return properties.select("name").distinct().orderBy("name")


def unchosen(names: Column, chosen: Column) -> Column:
    """The names that aren't among those chosen already."""
    return F.array_except(names, F.coalesce(chosen, F.array().cast("array<string>")))


def is_due(last: Column, now: Column, hours: int = 24) -> Column:
    """Whether a check is due: the last one, a text, is so old, or is null or no time."""
    at = F.try_to_timestamp(last)
    return F.coalesce(at + F.make_interval(hours=F.lit(hours)) <= now, F.lit(True))


def characteristics(name: Column, features: Column, inverse: Column, disjoint: Column) -> Column:
    """What OWL states of a property besides its ends, as one Turtle statement."""
    kinds = F.concat(F.array(F.lit("owl:ObjectProperty")), iri.feature_types(features))
    refs = F.transform(disjoint, lambda x: F.concat(F.lit("owl:propertyDisjointWith "), iri.property_reference(x, {})))
    parts = F.concat(
        F.array(F.concat(F.lit("a "), F.array_join(kinds, ", "))),
        F.array_compact(F.array(F.concat(F.lit("owl:inverseOf "), iri.property_reference(inverse, {})))), refs,
    )
    return F.concat(iri.property_reference(name, {}), F.lit(" "), F.array_join(parts, " ; "), F.lit(" ."))


# -- exports over tables ---------------------------------------------------------------------------------------------


def diagram_edges(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(schema_id, source, target, label, kind) of every model: inheritance, then properties between two of its classes,
    for classes (schema_id, id, url, name, super_class_id) and properties (schema_id, name, domain_class_id, range_class_iri)."""
    own = classes.select("schema_id", F.col("id").alias("super_class_id"), F.col("name").alias("target"))
    up = classes.join(own, ["schema_id", "super_class_id"]).select("schema_id", F.col("name").alias("source"), "target", F.lit("").alias("label"), F.lit("inherits").alias("kind"))
    start = classes.select("schema_id", F.col("id").alias("domain_class_id"), F.col("name").alias("source"))
    end = classes.select("schema_id", F.col("url").alias("range_class_iri"), F.col("name").alias("target"))
    across = properties.select("schema_id", "domain_class_id", "range_class_iri", F.col("name").alias("label")).join(start, ["schema_id", "domain_class_id"]).join(end, ["schema_id", "range_class_iri"])
    return up.unionByName(across.select("schema_id", "source", "target", "label", F.lit("property").alias("kind")))


def class_blocks(classes: DataFrame, prefixes: dict[str, str], owl: bool) -> DataFrame:
    """(schema_id, ord, value): each class of every model as a Turtle block, for classes (schema_id, ord, id, url, name,
    label, description, maps_to_concept_iri, super_class_id). Classes go by their canonical names."""
    refs = references(classes)
    above = refs.select("schema_id", F.col("id").alias("super_class_id"), F.col("ref").alias("above"))
    quoted = lambda c: F.concat(F.lit('"'), iri.escaped(F.nullif(F.col(c), F.lit(""))), F.lit('"'))
    pair = lambda p, o: F.concat(F.lit(p + " "), o)
    pairs = [F.lit("a owl:Class" if owl else "a rdfs:Class"), pair("rdfs:label", quoted("label")), pair("rdfs:comment", quoted("description")), pair("rdfs:subClassOf", F.col("above"))]
    if owl:
        pairs.append(pair("rdfs:subClassOf", iri.shortened(F.col("maps_to_concept_iri"), prefixes)))
    text = F.concat(F.col("ref"), F.lit("\n    "), F.array_join(F.array_compact(F.array(*pairs)), " ;\n    "), F.lit(" ."))
    return classes.join(refs.select("schema_id", "id", "ref"), ["schema_id", "id"]).join(above, ["schema_id", "super_class_id"], "left").select("schema_id", "ord", text.alias("value"))


def shape_counts(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(schema_id, node_shapes, property_shapes, unions): the shapes of every model. Properties of one name and domain are
    one property shape, a union if several of its ranges are classes."""
    end = classes.select("schema_id", F.col("url").alias("range_class_iri"), F.col("url").alias("class_url"))
    start = classes.select("schema_id", F.col("id").alias("domain_class_id"))
    rows = properties.join(start, ["schema_id", "domain_class_id"]).join(end, ["schema_id", "range_class_iri"], "left")
    shapes = rows.groupBy("schema_id", "domain_class_id", "name").agg(F.countDistinct("class_url").alias("n"))
    per = shapes.groupBy("schema_id").agg(F.count("*").alias("property_shapes"), F.count_if(F.col("n") > 1).alias("unions"))
    nodes = classes.groupBy("schema_id").agg(F.count("*").alias("node_shapes"))
    return nodes.join(per, "schema_id", "left").na.fill(0, ["property_shapes", "unions"])
