import random

from pyspark.sql import functions as F

from semloom.model import TYPE
from semloom.operators import exports
from semloom.plans import expressions, pattern
from semloom.plans.pattern import Template as T
from semloom.sources.upper import NAMESPACE as UP

XSD = "http://www.w3.org/2001/XMLSchema#"
TEMPLATES = "array<struct<ord:int,subject:string,predicate:string,object:string>>"
ROLE = [("?this", UP + "hasParticipant", "?o1"), ("?o1", TYPE, "http://x/c/3"), ("?o1", UP + "isFeatureOf", "?value")]
MEETS = [("?this", "http://p/a", "?o1"), ("?o1", "http://p/b", "?o2"), ("?value", "http://p/c", "?o2"), ("?value", TYPE, "http://p/K")]


def numbered(templates):
    return [(k, *t) for k, t in enumerate(templates)]


def trees(n):
    """Random patterns without cycles between ?this and ?value, with types and templates that lack a predicate."""
    rng = random.Random(1)
    for _ in range(n):
        names = ["?this", *(f"?o{k}" for k in range(1, rng.choice([1, 2, 4, 7]))), "?value"]
        out = []
        for k in range(1, len(names)):
            a, b = names[rng.randrange(max(0, k - 2), k)], names[k]
            a, b = (a, b) if rng.random() < 0.7 or a == "?this" else (b, a)
            out.append((a, f"http://p/{rng.choice('abc')}", b))
        out += [(rng.choice(names), rng.choice([TYPE, "http://p/d"]), f"http://t/T{k}") for k in range(rng.randrange(4))]
        rng.shuffle(out)
        yield [*out, ("?this", "", "?o9")]


def test_expressions_of_many_patterns_equal_those_of_each(spark):
    rows, want, trees_of = [], {}, {}
    for k, templates in enumerate([ROLE, MEETS, [], *trees(150)]):
        for forward, own, end in ((True, "http://x/D", "http://x/R"), (False, "http://x/R", "http://x/D")):
            name = f"{k} {forward}"
            rows.append((name, forward, own, end, numbered(templates)))
            # a constant is a class in a walk from ?this only: from ?value it says no more than that there is something
            plain = [T(*t) for t in templates if t[1] and (forward or t[1] == TYPE or t[2].startswith("?"))]
            if plain == [T(*t) for t in templates if t[1]]:
                tree = pattern.forward(plain, end, own) if forward else pattern.backward(plain, end, own)
                trees_of[name], want[name] = tree, pattern.turtle(tree, {})
    roots = spark.createDataFrame(rows, f"anchor string, forward boolean, own string, end string, pattern {TEMPLATES}")
    found, levels = expressions.hops(roots)
    shown = found.withColumns({c: expressions.shown(F.col(c), []) for c in ("p", "filler")})
    got = {r.anchor: r.text for r in expressions.texts(shown, levels).collect()}
    assert set(got) == {r[0] for r in rows} and len(want) > 200
    assert {k: got[k] for k in want} == want
    types, edges = (x.collect() for x in expressions.witness_rows(found))

    def leaves(x):
        return [x.name] if isinstance(x, pattern.Named) else leaves(x.filler) if isinstance(x, pattern.Some) else [n for m in x.members for n in leaves(m)]

    for name, tree in trees_of.items():
        assert sorted(r.c for r in types if r.anchor == name) == sorted(n for n in leaves(tree) if n != "owl:Thing")
    assert {r.anchor for r in edges} <= set(got)


def test_cycles_use_each_template_once(spark):
    ring = [("?this", "http://p/a", "?o1"), ("?o1", "http://p/b", "?o2"), ("?o2", "http://p/c", "?o1"), ("?o2", "http://p/d", "?value"), ("?o1", "http://p/e", "?o1")]
    roots = spark.createDataFrame([("x", True, "http://x/D", None, numbered(ring))], f"anchor string, forward boolean, own string, end string, pattern {TEMPLATES}")
    found, _ = expressions.hops(roots)
    assert sorted(r.k for r in found.filter("k >= 0").collect()) == [0, 1, 2, 3, 4]


def model(spark):
    schemas = spark.createDataFrame(
        [("m1", "http://x/m1/", 'My "own"  model', "First\nline", "http://base.org/f", UP), ("m2", "http://x/m2", "Bare", None, "", None), ("m3", "http://x/m3", "None", "", None, "http://up.org/u#")],
        "id string, url string, title string, description string, base_uri string, upper_ontology_iri string",
    )
    classes = spark.createDataFrame(
        [
            ("m1", 0, "1", "http://x/c/1", "Visit", "Visit", "", UP + "Process", None), ("m1", 1, "2", "http://x/c/2", "Person", None, 'A "b" \\', "http://other.org/Person", None),
            ("m1", 2, "3", "http://x/c/3", "Patient", "", None, UP + "Role", None), ("m1", 3, "4", "http://x/c/4", "Child", "Child", None, None, "2"),
            ("m2", 0, "5", "http://x/c/5", "Alone", "Alone", None, None, "1"), ("m2", 1, "6", "http://x/c/6", "Other", None, None, "http://up.org/u#K", None),
        ],
        "schema_id string, ord int, id string, url string, name string, label string, description string, maps_to_concept_iri string, super_class_id string",
    )
    rows = [
        ("m1", 0, "p0", "hasPatient", "Has patient", None, "object", "1", "http://x/c/2", numbered(ROLE), True, ["functional", "unknown", "transitive"], "patientOf", ["http://q.org/z", "other"]),
        ("m1", 1, "p1", "hasCode", None, None, "object", "1", "http://x/c/4", [], False, None, None, None),
        ("m1", 2, "p2", "hasCode", "later", None, "object", "1", "http://x/c/2", [], None, None, None, None),
        ("m1", 3, "p3", "hasCode", None, None, "object", "1", "http://x/c/4", None, None, None, None, None),
        ("m1", 4, "p4", "score", 'a "b"\n', "d", "datatype", "1", XSD + "float", numbered([("?this", UP + "hasValue", "?value")]), True, [], "", None),
        ("m1", 5, "p5", "loose", None, None, "object", None, None, numbered(ROLE), False, None, "http://q.org/inv", None),
        ("m1", 6, "p6", "near", None, None, "object", "2", UP + "Unit", numbered([("?this", UP + "hasPart", "?value")]), False, None, None, None),
        ("m2", 0, "p7", "size", None, None, "datatype", "5", XSD + "decimal", None, False, None, None, None),
        ("m2", 1, "p8", "any", None, None, "object", "5", None, None, False, None, None, None),
    ]
    properties = spark.createDataFrame(rows, f"schema_id string, ord int, id string, name string, label string, description string, property_type string, domain_class_id string, range_class_iri string, pattern {TEMPLATES}, is_required boolean, features array<string>, inverse string, disjoint array<string>")
    return schemas, classes, properties


def text(lines, schema):
    rows = sorted((r.ord, r.value) for r in lines.collect() if r.schema_id == schema)
    assert [k for k, _ in rows] == list(range(len(rows)))
    return "\n".join(v for _, v in rows)


OWL = f"""@prefix : <http://base.org/f/> .
@prefix xsd: <{XSD}> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix dct: <http://purl.org/dc/terms/> .
@prefix sulo: <{UP}> .

<http://x/m1>
    a owl:Ontology ;
    dct:title "My \\"own\\"  model" ;
    dct:description "First\\nline" ;
    owl:imports <{UP}> .

{exports.CLASSES_HEADING}

:Visit
    a owl:Class ;
    rdfs:label "Visit" ;
    rdfs:subClassOf sulo:Process .

<http://other.org/Person>
    a owl:Class ;
    rdfs:comment "A \\"b\\" \\\\" ;
    rdfs:subClassOf <http://other.org/Person> .

:Patient
    a owl:Class ;
    rdfs:subClassOf sulo:Role .

:Child
    a owl:Class ;
    rdfs:label "Child" ;
    rdfs:subClassOf <http://other.org/Person> .

{exports.PROPERTIES_HEADING}

:hasPatient
    a owl:ObjectProperty, owl:FunctionalProperty, owl:TransitiveProperty ;
    rdfs:label "Has patient" ;
    owl:inverseOf :patientOf ;
    owl:propertyDisjointWith <http://q.org/z> ;
    owl:propertyDisjointWith :other ;
    rdfs:domain <http://base.org/f/Visit_hasPatient_domain> ;
    rdfs:range <http://base.org/f/Visit_hasPatient_range> .

:hasCode
    a owl:ObjectProperty ;
    rdfs:domain :Visit ;
    rdfs:range [ owl:unionOf (:Child <http://other.org/Person>) ] .

:score
    a owl:DatatypeProperty ;
    rdfs:label "a \\"b\\"\\n" ;
    rdfs:comment "d" ;
    rdfs:domain <http://base.org/f/Visit_score_domain> ;
    rdfs:range xsd:float .

:loose
    a owl:ObjectProperty ;
    owl:inverseOf <http://q.org/inv> .

:near
    a owl:ObjectProperty ;
    rdfs:domain <http://base.org/f/Person_near_domain> ;
    rdfs:range sulo:Unit .

{exports.ANCHORS_HEADING}

<http://base.org/f/Visit_hasPatient_domain>
    owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( :Visit [ a owl:Restriction ; owl:onProperty sulo:hasParticipant ; owl:someValuesFrom [ a owl:Class ; owl:intersectionOf ( :Patient [ a owl:Restriction ; owl:onProperty sulo:isFeatureOf ; owl:someValuesFrom <http://other.org/Person> ] ) ] ] ) ] .

<http://base.org/f/Visit_hasPatient_range>
    owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( <http://other.org/Person> [ a owl:Restriction ; owl:onProperty [ owl:inverseOf sulo:isFeatureOf ] ; owl:someValuesFrom [ a owl:Class ; owl:intersectionOf ( :Patient [ a owl:Restriction ; owl:onProperty [ owl:inverseOf sulo:hasParticipant ] ; owl:someValuesFrom :Visit ] ) ] ] ) ] .

<http://base.org/f/Visit_score_domain>
    owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( :Visit [ a owl:Restriction ; owl:onProperty sulo:hasValue ; owl:someValuesFrom xsd:float ] ) ] .

<http://base.org/f/Person_near_domain>
    owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( <http://other.org/Person> [ a owl:Restriction ; owl:onProperty sulo:hasPart ; owl:someValuesFrom sulo:Unit ] ) ] .
"""


def test_owl_and_rdfs(spark):
    tables = model(spark)
    owl, rdfs = (exports.ontologies(*tables, owl=x) for x in (True, False))
    assert text(owl, "m1") == OWL
    plain = text(rdfs, "m1")
    assert "a rdfs:Property, owl:FunctionalProperty, owl:TransitiveProperty ;" in plain and "equivalentClass" not in plain and "owl:imports" not in plain and "@prefix owl" not in plain
    assert f"rdfs:seeAlso <{UP}> ." in plain and "rdfs:domain :Visit ;\n    rdfs:range <http://other.org/Person> ." in plain and "rdfs:domain :Person ;" in plain
    assert text(owl, "m3") == text(rdfs, "m3").replace("@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .").replace('    dct:title "None" ;\n    rdfs:seeAlso <http://up.org/u#> .', '    a owl:Ontology ;\n    dct:title "None" .')
    assert "@prefix u: <http://up.org/u#> ." in text(owl, "m3") and "rdfs:subClassOf :Visit" not in text(owl, "m2") and "sulo" not in text(owl, "m2")
    assert all(exports.ontologies(*(t.limit(0) for t in tables), owl=x).count() == 0 for x in (True, False))


SHACL = """:VisitShape
    a sh:NodeShape, owl:Class ;
    sh:targetClass :Visit ;
    rdfs:label "Visit" ;
    sh:property [
        sh:path :hasPatient ;
        sh:name "Has patient" ;
        sh:class <http://other.org/Person> ;
        sh:minCount 1 ;
    ] ;
    sh:property [
        sh:path :hasCode ;
        sh:or (
            [ sh:class :Child ]
            [ sh:class <http://other.org/Person> ]
        ) ;
        sh:minCount 0 ;
    ] ;
    sh:property [
        sh:path :score ;
        sh:name "a \\"b\\"\\n" ;
        sh:datatype xsd:float ;
        sh:minCount 1 ;
    ] .

:PersonShape
    a sh:NodeShape, owl:Class ;
    sh:targetClass <http://other.org/Person> ;
    sh:property [
        sh:path :near ;
        sh:class <https://w3id.org/sulo/Unit> ;
        sh:minCount 0 ;
    ] .

:PatientShape
    a sh:NodeShape, owl:Class ;
    sh:targetClass :Patient .

:ChildShape
    a sh:NodeShape, owl:Class ;
    sh:targetClass :Child ;
    rdfs:subClassOf <http://other.org/Person> ;
    rdfs:label "Child" .
"""


def test_shacl_and_diagrams(spark):
    tables = model(spark)
    got = text(exports.shacl(*tables), "m1")
    assert got.split("\n\n", 1)[1] == SHACL
    assert "        sh:path :any ;\n        sh:minCount 0 ;\n    ] ." in text(exports.shacl(*tables), "m2")
    assert text(exports.mermaid(*tables), "m1") == """classDiagram
  class Visit {
    <<sulo:Process>>
    +hasPatient() Person
    +hasCode() Child
    +hasCode() Person
    +hasCode() Child
    +score() float
  }
  class Person {
    +near() Unit
  }
  class Patient {
    <<sulo:Role>>
  }
  class Child {
  }

  Person <|-- Child
  Visit --> Person : hasPatient
  Visit --> Child : hasCode
  Visit --> Person : hasCode
  Visit --> Child : hasCode"""
    nodes = {(r.schema_id, r.name): (r.x, r.y) for r in exports.diagram_nodes(tables[1], 2).collect()}
    assert nodes["m1", "Patient"] == (0, 220) and nodes["m2", "Other"] == (260, 0)


def test_files_hold_the_lines_in_order(spark, tmp_path):
    tables = model(spark)
    lines = exports.mermaid(*tables)
    exports.save(lines, tables[0], str(tmp_path / "out"), "_uml.mmd")
    back = spark.read.text(str(tmp_path / "out"))
    assert {r.file for r in back.select("file").distinct().collect()} == {'My_"own"_model_uml.mmd', "Bare_uml.mmd", "None_uml.mmd"}
    parts = [p.read_text() for p in (tmp_path / "out").rglob("part-*") if "own" in str(p.parent)]
    assert parts == [text(lines, "m1") + "\n"]
