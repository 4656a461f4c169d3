"""Models as text: RDFS, OWL, SHACL and class diagrams of all models of a table, as lines (schema_id, ord, value).

Takes schemas (id, url, title, description, base_uri, upper_ontology_iri), classes (schema_id, ord, id, url, name, label,
description, maps_to_concept_iri, super_class_id) and properties (schema_id, ord, id, name, label, description,
property_type, domain_class_id, range_class_iri, pattern, is_required, features, inverse, disjoint). Nulls and empty texts
are left out of the text; what refers to no class of its own model counts as absent. Ids are unique over all models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.functions import iri
from semloom.model import OWL, RDFS, SH, XSD
from semloom.plans import expressions
from semloom.sources.upper import NAMESPACE

DCT = "http://purl.org/dc/terms/"
#: The headings between the parts of a document.
CLASSES_HEADING = "# ── Classes ──────────────────────────────────────────────────────────────"
PROPERTIES_HEADING = "# ── Properties ───────────────────────────────────────────────────────────"
ANCHORS_HEADING = "# ── Domain / Range class expressions (OWL equivalent axioms) ──────────────"
#: The parts of a document, in order.
PREFIXES, HEADER, CLASSES, PROPERTIES, ANCHORS = range(5)


def _given(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), iri.escaped(_given(c)), F.lit('"'))


def _pair(p: str, o: Column) -> Column:
    """One statement as an array: empty where o is null."""
    return F.array_compact(F.array(F.concat(F.lit(p + " "), o)))


def _block(subject: Column, pairs: Column, indent: str = "    ") -> Column:
    """The lines of a subject with its statements, and an empty one."""
    n = F.size(pairs)
    ended = F.transform(pairs, lambda x, i: F.concat(F.lit(indent), x, F.when(i < n - 1, " ;").otherwise(" .")))
    return F.concat(F.array(subject), ended, F.array(F.lit("")))


def _lines(parts: list[DataFrame]) -> DataFrame:
    """parts (schema_id, part, at, lines) as numbered lines. The numbers of a model's lines need them in one task; a model
    is what people write."""
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    flat = rows.select("schema_id", "part", "at", F.posexplode("lines").alias("k", "value"))
    return flat.select("schema_id", (F.row_number().over(Window.partitionBy("schema_id").orderBy("part", "at", "k")) - 1).alias("ord"), "value")


def _spaces(schemas: DataFrame) -> DataFrame:
    """(schema_id, base, upper_prefix, upper): what a model's own and its upper ontology's names expand under."""
    upper = iri.base_uri(_given("upper_ontology_iri"))
    return schemas.select(F.col("id").alias("schema_id"), iri.base_uri(F.coalesce(_given("base_uri"), "url")).alias("base"), iri.upper_prefix(upper).alias("upper_prefix"), upper.alias("upper"))


def references(classes: DataFrame) -> DataFrame:
    """(schema_id, id, url, name, ref): what each class is called in a text: a class that is mapped outside the upper
    ontology by what it is mapped to, any other by its own name."""
    outside = ~F.startswith("maps_to_concept_iri", F.lit(NAMESPACE))
    ref = F.when(outside & (F.col("maps_to_concept_iri") != ""), F.concat(F.lit("<"), "maps_to_concept_iri", F.lit(">"))).otherwise(F.concat(F.lit(":"), "name"))
    return classes.select("schema_id", "id", "url", "name", ref.alias("ref"))


def _mapped(classes: DataFrame) -> DataFrame:
    """(schema_id, mapped) of the models with a class below the upper ontology."""
    return classes.groupBy("schema_id").agg(F.coalesce(F.bool_or(F.startswith("maps_to_concept_iri", F.lit(NAMESPACE))), F.lit(False)).alias("mapped"))


def _namespaces(owl: bool) -> list[tuple[Column, Column]]:
    """Prefixes in the order in which they are tried, from columns base, upper_prefix, upper and mapped."""
    fixed = [("", None), ("xsd", XSD), ("rdfs", RDFS), *([("owl", OWL)] if owl else []), ("dct", DCT)]
    out = [(F.lit(p), F.col("base") if n is None else F.lit(n)) for p, n in fixed] + [(F.col("upper_prefix"), F.col("upper"))]
    name = "sulo"
    extra = F.coalesce("mapped", F.lit(False)) & ~F.coalesce(F.col("upper_prefix") == name, F.lit(False))
    return out + ([(F.lit(name), F.when(extra, NAMESPACE))] if owl else [])


def grouped(properties: DataFrame, classes: DataFrame) -> DataFrame:
    """Properties of one name and domain as one row: the columns of the first, where it stands, the domain's name and url,
    the distinct classes that any of them ranges over, in order, and what the first one's range is called."""
    refs = references(classes)
    ends = refs.select("schema_id", F.col("url").alias("range_class_iri"), F.col("id").alias("_end"), F.col("ref").alias("_ref"))
    domains = refs.select("schema_id", F.col("id").alias("domain_class_id"), F.col("name").alias("domain"), F.col("url").alias("domain_url"), F.col("ref").alias("domain_ref"))
    rows = properties.join(ends, ["schema_id", "range_class_iri"], "left").join(domains, ["schema_id", "domain_class_id"], "left")
    every = F.array_sort(F.collect_list(F.when(F.col("_end").isNotNull(), F.struct("ord", "id", "_end", "_ref"))))
    ids = F.array_distinct(F.transform(every, lambda x: x["_end"]))
    ranges = F.transform(ids, lambda e: F.get(F.filter(every, lambda x: x["_end"] == e), 0)["_ref"])
    kept = ["label", "description", "property_type", "range_class_iri", "pattern", "is_required", "features", "inverse", "disjoint", "domain", "domain_url", "domain_ref"]
    first = F.min_by(F.struct("ord", "id", *kept), F.struct("ord", "id"))
    return rows.groupBy("schema_id", "name", F.coalesce("domain_class_id", F.lit("")).alias("domain_class_id")).agg(first.alias("f"), ranges.alias("ranges")).select("schema_id", "name", "domain_class_id", "ranges", "f.*")


def anchors(groups: DataFrame) -> DataFrame:
    """Roots for expressions.hops(): the domain of each property with a pattern and a domain, and the range of those that
    are object properties with one class as range. An anchor is called like its model, its property's first row and side."""
    some = groups.filter("size(pattern) > 0 AND domain_url IS NOT NULL")
    name = lambda side: F.concat_ws(" ", "schema_id", "id", F.lit(side)).alias("anchor")
    made = lambda side, own, end: (name(side), "schema_id", F.lit(side).alias("side"), F.lit(side == "domain").alias("forward"), own.alias("own"), end.alias("end"), "pattern")
    domain = some.select(*made("domain", F.col("domain_url"), F.coalesce("range_class_iri", "domain_url")))
    ranged = some.filter("property_type = 'object' AND size(ranges) = 1 AND range_class_iri IS NOT NULL")
    return domain.unionByName(ranged.select(*made("range", F.col("range_class_iri"), F.col("domain_url"))))


def expressed(groups: DataFrame, classes: DataFrame, spaces: DataFrame) -> DataFrame:
    """(anchor, text): what each anchor is equivalent to."""
    roots = anchors(groups)
    rows, levels = expressions.hops(roots)
    terms = spaces.join(_mapped(classes), "schema_id", "left")
    named = rows.join(roots.select("anchor", "schema_id"), "anchor").join(terms, "schema_id", "left")
    refs = references(classes).select("schema_id", F.col("url").alias("filler"), "ref")
    named = named.join(refs, ["schema_id", "filler"], "left")
    spaced = _namespaces(owl=True)
    written = named.select("anchor", "node", "k", "depth", "rank", "is_type", "inverse", expressions.shown(F.col("p"), spaced).alias("p"), F.coalesce("ref", expressions.shown(F.col("filler"), spaced)).alias("filler"))
    return expressions.texts(written, levels)


def ontologies(schemas: DataFrame, classes: DataFrame, properties: DataFrame, owl: bool) -> DataFrame:
    """Each model in RDFS, or in OWL with anchors: classes that are equivalent to what a pattern says of its ends."""
    spaces = _spaces(schemas)
    terms = spaces.join(_mapped(classes), "schema_id", "left")
    spaced = _namespaces(owl)
    declared = [F.when(n.isNotNull(), F.concat(F.lit("@prefix "), p, F.lit(": <"), n, F.lit("> ."))) for p, n in spaced]
    head = terms.select("schema_id", F.lit(PREFIXES).alias("part"), F.lit(0).alias("at"), F.concat(F.array_compact(F.array(*declared)), F.array(F.lit(""))).alias("lines"))

    about = schemas.join(_mapped(classes), schemas["id"] == F.col("schema_id"), "left")
    link = _pair("owl:imports", F.when(F.col("mapped"), F.lit(f"<{NAMESPACE}>"))) if owl else _pair("rdfs:seeAlso", F.concat(F.lit("<"), _given("upper_ontology_iri"), F.lit(">")))
    title = F.concat(F.lit('"'), iri.escaped(F.coalesce("title", F.lit(""))), F.lit('"'))
    pairs = F.concat(*([F.array(F.lit("a owl:Ontology"))] if owl else []), _pair("dct:title", title), _pair("dct:description", _quoted("description")), link)
    header = about.select(F.col("id").alias("schema_id"), F.lit(HEADER).alias("part"), F.lit(0).alias("at"), _block(F.concat(F.lit("<"), F.regexp_replace("url", "/$", ""), F.lit(">")), pairs).alias("lines"))

    refs = references(classes)
    above = refs.select("schema_id", F.col("id").alias("super_class_id"), F.col("ref").alias("above"))
    each = classes.join(refs.select("schema_id", "id", "ref"), ["schema_id", "id"]).join(above, ["schema_id", "super_class_id"], "left").join(terms, "schema_id", "left")
    up = [_pair("rdfs:subClassOf", F.col("above")), *([_pair("rdfs:subClassOf", expressions.shown(_given("maps_to_concept_iri"), spaced))] if owl else [])]
    stated = F.concat(F.array(F.lit("a owl:Class" if owl else "a rdfs:Class")), _pair("rdfs:label", _quoted("label")), _pair("rdfs:comment", _quoted("description")), *up)
    class_lines = each.select("schema_id", F.lit(CLASSES).alias("part"), "ord", "id", _block(F.col("ref"), stated).alias("lines"))

    groups = grouped(properties, classes)
    ready = groups.join(terms, "schema_id", "left")
    kind = F.when(F.col("property_type") == "object", "owl:ObjectProperty").otherwise("owl:DatatypeProperty") if owl else F.lit("rdfs:Property")
    kinds = F.concat(F.array(kind), F.coalesce(iri.feature_types(F.col("features")), F.array().cast("array<string>")))
    reference = lambda x: F.when(F.contains(x, F.lit("://")), expressions.shown(x, spaced)).otherwise(F.concat(F.lit(":"), x))
    apart = F.transform(F.coalesce("disjoint", F.array().cast("array<string>")), lambda x: F.concat(F.lit("owl:propertyDisjointWith "), reference(x)))
    name = lambda side: F.concat(F.lit("<"), "base", "domain", F.lit("_"), "name", F.lit(f"_{side}>"))
    patterned = F.coalesce((F.size("pattern") > 0) & F.col("domain").isNotNull(), F.lit(False)) if owl else F.lit(False)
    domain = F.when(patterned, name("domain")).otherwise(F.concat(F.lit(":"), "domain"))
    one = F.size("ranges") == 1
    of_one = F.when(patterned & (F.col("property_type") == "object") & F.col("range_class_iri").isNotNull(), name("range")).otherwise(F.get("ranges", 0))
    range_ = F.when(F.size("ranges") > 1, F.concat(F.lit("[ owl:unionOf ("), F.array_join("ranges", " "), F.lit(") ]"))).when(one, of_one).otherwise(expressions.shown(_given("range_class_iri"), spaced))
    pairs = F.concat(
        F.array(F.concat(F.lit("a "), F.array_join(kinds, ", "))), _pair("rdfs:label", _quoted("label")), _pair("rdfs:comment", _quoted("description")),
        _pair("owl:inverseOf", reference(_given("inverse"))), apart, _pair("rdfs:domain", domain), _pair("rdfs:range", range_),
    )
    property_lines = ready.select("schema_id", F.lit(PROPERTIES).alias("part"), "ord", "id", _block(F.concat(F.lit(":"), "name"), pairs).alias("lines"))

    parts = [(class_lines, CLASSES_HEADING), (property_lines, PROPERTIES_HEADING)]
    if owl:
        texts = expressed(groups, classes, spaces)
        sides = anchors(groups).select("anchor", "schema_id", "side")
        named = sides.join(texts, "anchor").withColumn("id", F.element_at(F.split("anchor", " "), -2))
        named = named.join(ready.select("schema_id", "id", "ord", "base", "domain", "name"), ["schema_id", "id"])
        ref = F.when(F.col("side") == "domain", name("domain")).otherwise(name("range"))
        # both anchors of a property stand together, the domain's first
        both = F.array_sort(F.collect_list(F.struct("side", F.array(ref, F.concat(F.lit("    owl:equivalentClass "), "text", F.lit(" .")), F.lit("")).alias("lines"))))
        anchored = named.groupBy("schema_id", "ord", "id").agg(F.flatten(F.transform(both, lambda x: x["lines"])).alias("lines")).withColumn("part", F.lit(ANCHORS))
        parts.append((anchored, ANCHORS_HEADING))
    placed = [head, header]
    for rows, heading in parts:
        at = F.row_number().over(Window.partitionBy("schema_id").orderBy("ord", "id"))
        placed.append(rows.select("schema_id", "part", at.alias("at"), F.when(at == 1, F.concat(F.array(F.lit(heading), F.lit("")), "lines")).otherwise(F.col("lines")).alias("lines")))
    return _lines(placed)


def shacl(schemas: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """The shapes of each model: a node shape for each class, a property shape for each name among its properties."""
    spaces = _spaces(schemas)
    fixed = [("", F.col("base")), ("sh", F.lit(SH)), ("owl", F.lit(OWL)), ("rdfs", F.lit(RDFS)), ("xsd", F.lit(XSD))]
    declared = [F.concat(F.lit(f"@prefix {p}: <"), n, F.lit("> .")) for p, n in fixed]
    head = spaces.select("schema_id", F.lit(PREFIXES).alias("part"), F.lit(0).alias("at"), F.concat(F.array(*declared), F.array(F.lit(""))).alias("lines"))

    groups = grouped(properties, classes).join(spaces, "schema_id", "left")
    spaced = [(F.lit(p), n) for p, n in fixed]
    many = F.concat(F.array(F.lit("        sh:or (")), F.transform("ranges", lambda r: F.concat(F.lit("            [ sh:class "), r, F.lit(" ]"))), F.array(F.lit("        ) ;")))
    line = lambda p, o: F.array_compact(F.array(F.concat(F.lit(f"        {p} "), o, F.lit(" ;"))))
    of_one = line("sh:class", F.coalesce(F.get("ranges", 0), expressions.shown(_given("range_class_iri"), spaced)))
    typed = line("sh:datatype", expressions.shown(_given("range_class_iri"), spaced[-1:]))
    none = F.array().cast("array<string>")
    value = F.when(F.col("property_type") == "object", F.when(F.size("ranges") > 1, many).otherwise(of_one)).when(F.col("property_type") == "datatype", typed).otherwise(none)
    least = F.concat(F.lit("        sh:minCount "), F.coalesce(F.col("is_required").cast("int"), F.lit(0)).cast("string"), F.lit(" ;"))
    body = F.concat(F.array(F.lit("    sh:property ["), F.concat(F.lit("        sh:path :"), "name", F.lit(" ;"))), line("sh:name", _quoted("label")), value, F.array(least))
    # a property shape ends the block where none follows it
    follows = F.lead("name").over(Window.partitionBy("schema_id", "domain_class_id").orderBy("ord", "id")).isNotNull()
    shaped = groups.select("schema_id", "domain_class_id", "ord", "id", F.concat(body, F.array(F.when(follows, "    ] ;").otherwise("    ] ."))).alias("lines"))
    shaped = shaped.groupBy("schema_id", F.col("domain_class_id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "lines"))), lambda x: x["lines"])).alias("shapes"))

    refs = references(classes)
    above = refs.select("schema_id", F.col("id").alias("super_class_id"), F.col("ref").alias("above"))
    each = classes.join(refs.select("schema_id", "id", "ref"), ["schema_id", "id"]).join(above, ["schema_id", "super_class_id"], "left").join(shaped, ["schema_id", "id"], "left")
    pairs = F.concat(F.array(F.lit("a sh:NodeShape, owl:Class"), F.concat(F.lit("sh:targetClass "), "ref")), _pair("rdfs:subClassOf", F.col("above")), _pair("rdfs:label", _quoted("label")))
    n = F.size(pairs)
    last = F.when(F.col("shapes").isNull(), " .").otherwise(" ;")
    stated = F.transform(pairs, lambda x, i: F.concat(F.lit("    "), x, F.when(i < n - 1, " ;").otherwise(last)))
    lines = F.concat(F.array(F.concat(F.lit(":"), "name", F.lit("Shape"))), stated, F.coalesce("shapes", none), F.array(F.lit("")))
    at = F.row_number().over(Window.partitionBy("schema_id").orderBy("ord", "id"))
    return _lines([head, each.select("schema_id", F.lit(CLASSES).alias("part"), at.alias("at"), lines.alias("lines"))])


def mermaid(schemas: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """The class diagram of each model: classes with their properties, then inheritance, then properties between classes."""
    end = classes.select("schema_id", F.col("url").alias("range_class_iri"), F.col("name").alias("end"))
    start = classes.select("schema_id", F.col("id").alias("domain_class_id"), F.col("name").alias("start"))
    rows = properties.join(end, ["schema_id", "range_class_iri"], "left").join(start, ["schema_id", "domain_class_id"])
    label = F.coalesce("end", F.element_at(F.split(_given("range_class_iri"), "[/#]"), -1), F.lit("Any"))
    member = F.struct("ord", "id", F.concat(F.lit("    +"), "name", F.lit("() "), label).alias("line"))
    members = rows.groupBy("schema_id", F.col("domain_class_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["line"]).alias("members"))
    inside = F.when(F.startswith("maps_to_concept_iri", F.lit(NAMESPACE)), F.concat(F.lit("    <<sulo:"), F.substring("maps_to_concept_iri", len(NAMESPACE) + 1, 1 << 30), F.lit(">>")))
    lines = F.concat(F.array(F.concat(F.lit("  class "), "name", F.lit(" {"))), F.array_compact(F.array(inside)), F.coalesce("members", F.array().cast("array<string>")), F.array(F.lit("  }")))
    at = lambda *by: F.row_number().over(Window.partitionBy("schema_id").orderBy(*by)).alias("at")
    boxes = classes.join(members, ["schema_id", "id"], "left").select("schema_id", F.lit(1).alias("part"), at("ord", "id"), lines.alias("lines"))
    fixed = lambda part, text: schemas.select(F.col("id").alias("schema_id"), F.lit(part).alias("part"), F.lit(0).alias("at"), F.array(F.lit(text)).alias("lines"))
    above = classes.select("schema_id", F.col("id").alias("super_class_id"), F.col("name").alias("above"))
    up = classes.join(above, ["schema_id", "super_class_id"]).select("schema_id", F.lit(3).alias("part"), at("ord", "id"), F.array(F.concat(F.lit("  "), "above", F.lit(" <|-- "), "name")).alias("lines"))
    arrow = F.when(F.col("property_type") == "datatype", " ..> ").otherwise(" --> ")
    across = rows.filter("end IS NOT NULL").select("schema_id", F.lit(4).alias("part"), at("ord", "id"), F.array(F.concat(F.lit("  "), "start", arrow, "end", F.lit(" : "), "name")).alias("lines"))
    return _lines([fixed(0, "classDiagram"), boxes, fixed(2, ""), up, across])


def diagram_nodes(classes: DataFrame, columns: int = 5, width: int = 260, height: int = 220) -> DataFrame:
    """(schema_id, id, name, x, y): each model's classes on a grid, row by row."""
    k = F.row_number().over(Window.partitionBy("schema_id").orderBy("ord", "id")) - 1
    return classes.select("schema_id", "id", "name", (k % columns * width).alias("x"), (F.floor(k / columns) * height).cast("int").alias("y"))


def file_name(title: Column, ending: str) -> Column:
    """A title as a file's name: white space becomes a low line."""
    return F.concat(F.regexp_replace(title, r"\s+", "_"), F.lit(ending))


def save(lines: DataFrame, schemas: DataFrame, path: str, ending: str) -> None:
    """Writes each model's lines, in order, as one text file in a folder that is called by its title."""
    named = lines.join(schemas.select(F.col("id").alias("schema_id"), file_name(F.col("title"), ending).alias("file")), "schema_id")
    ordered = named.repartition("file").sortWithinPartitions("file", "schema_id", "ord")
    ordered.select("file", "value").write.partitionBy("file").text(path)
