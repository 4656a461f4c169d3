"""Row schemas of the metamodel, the instance tables seen as classes and properties, and XSD types in Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

SCHEMAS = "id string, title string, description string, upper_ontology_iri string, base_uri string, created_at timestamp, modified_at timestamp"
CLASSES = "id string, schema_id string, name string, label string, description string, maps_to_concept_iri string, super_class_id string, ord int"
TEMPLATE = "struct<ord:int,subject:string,predicate:string,object:string>"
PROPERTIES = (
    "id string, schema_id string, name string, label string, description string, property_type string, domain_class_id string, "
    f"range_class_iri string, mapping_pattern array<{TEMPLATE}>, regex_pattern string, regex_variable string, is_required boolean, "
    "property_features array<string>, inverse_property_iri string, disjoint_property_iris array<string>, ord int"
)
TRIPLES = "ord bigint, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string"

#: Namespaces and the terms that patterns and exports use.
RDF, RDFS, OWL, XSD, SH = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#",
    "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/ns/shacl#",
)
TYPE = RDF + "type"

#: XSD types and what holds them in Spark; double is an extension for the instance tables.
XSD_TYPES = {
    "string": "string", "integer": "decimal(38,0)", "decimal": "decimal(38,18)", "boolean": "boolean", "date": "date",
    "dateTime": "timestamp_ntz", "dateTimeStamp": "timestamp", "anyURI": "string", "float": "float", "double": "double",
}


@dataclass(frozen=True)
class Table:
    """An instance table as a class: its key column, and its columns as properties (object ones with their class)."""

    name: str
    key: str
    objects: dict[str, str] = field(default_factory=dict)
    data: tuple[str, ...] = ()


#: The instance tables with a single-column key. Individuals are named "<table>/<key>".
TABLES = {
    t.name: t
    for t in (
        Table("region", "r_regionkey", {}, ("r_name",)),
        Table("nation", "n_nationkey", {"n_regionkey": "region"}, ("n_name",)),
        Table("customer", "c_custkey", {"c_nationkey": "nation"}, ("c_name", "c_mktsegment")),
        Table("supplier", "s_suppkey", {"s_nationkey": "nation"}, ("s_name",)),
        Table("part", "p_partkey", {}, ("p_name", "p_brand", "p_type")),
        Table("orders", "o_orderkey", {"o_custkey": "customer"}, ("o_orderstatus", "o_orderpriority")),
        Table("events", "event_id", {"user_id": "customer"}, ("event_type",)),
        Table("documents", "doc_id", {}, ("lang", "source")),
    )
}
