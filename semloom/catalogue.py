"""Every query of the library by name, with the SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.functions import explain, iri
from semloom.model import OWL, RDFS, SH, TYPE, XSD
from semloom.operators import concepts, consistency, equality, exports, reasoning, shapes, views
from semloom.plans import pattern
from semloom.plans.abox import View, edges_of, individual, triples
from semloom.sources import catalog, rdf

T = pattern.Template
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- mapping patterns ------------------------------------------------------------------------------------------------

PATTERNS = {
    "direct": [T("?this", "o_custkey", "?value")],
    "role_bearer": [T("?this", "hasParticipant", "?o1"), T("?o1", TYPE, "BuyerRole"), T("?o1", "isFeatureOf", "?value")],
    "time_instant": [T("?this", "atTime", "?o1"), T("?o1", TYPE, "TimeInstant"), T("?o1", "hasValue", "?value")],
    # orders and suppliers meet in the nation of the order's customer
    "convergent": [T("?this", "o_custkey", "?o1"), T("?o1", "c_nationkey", "?o2"), T("?value", "s_nationkey", "?o2"), T("?value", TYPE, "supplier")],
}
_BUYS = "SELECT 'orders/' || o_orderkey AS this, 'customer/' || o_custkey AS value FROM orders"


@query("pattern_direct", _BUYS)
def pattern_direct(spark: SparkSession, d: str) -> DataFrame:
    return pattern.evaluate(PATTERNS["direct"], View(spark, d))


@query("pattern_role_bearer", _BUYS)
def pattern_role_bearer(spark: SparkSession, d: str) -> DataFrame:
    return pattern.evaluate(PATTERNS["role_bearer"], View(spark, d))


@query("pattern_time_instant", "SELECT 'orders/' || o_orderkey AS this, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders")
def pattern_time_instant(spark: SparkSession, d: str) -> DataFrame:
    return pattern.evaluate(PATTERNS["time_instant"], View(spark, d))


@query("pattern_reverse", "SELECT 'customer/' || o_custkey AS this, 'orders/' || o_orderkey AS value FROM orders")
def pattern_reverse(spark: SparkSession, d: str) -> DataFrame:
    return pattern.reverse(pattern.evaluate(PATTERNS["role_bearer"], View(spark, d)))


@query(
    "pattern_convergent",
    """SELECT DISTINCT 'orders/' || o_orderkey AS this, 'supplier/' || s_suppkey AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey""",
)
def pattern_convergent(spark: SparkSession, d: str) -> DataFrame:
    return pattern.evaluate(PATTERNS["convergent"], View(spark, d))


@query("pattern_group_count", "SELECT 'customer/' || o_custkey AS value, count(*) AS n FROM orders GROUP BY o_custkey")
def pattern_group_count(spark: SparkSession, d: str) -> DataFrame:
    return pattern.evaluate(PATTERNS["role_bearer"], View(spark, d)).groupBy("value").agg(F.count("*").alias("n"))


@query(
    "triples_predicate_stats",
    """SELECT p, count(*) AS n FROM (
      SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'n_regionkey', 'n_name']) AS p FROM nation UNION ALL
      SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'c_nationkey', 'c_name', 'c_mktsegment']) FROM customer UNION ALL
      SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'r_name']) FROM region) GROUP BY p""",
)
def triples_predicate_stats(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d, ["region", "nation", "customer"]).groupBy("p").agg(F.count("*").alias("n"))


@query(
    "bgp_optional",
    """SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS nation, 'orders/' || o_orderkey AS "order", CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
)
def bgp_optional(spark: SparkSession, d: str) -> DataFrame:
    """Customers with no, one or many orders, and a segment for some of them."""
    view = View(spark, d, ["customer", "orders"])
    some = _read(spark, d, "customer").filter("c_custkey % 3 = 0").select(individual("customer", "c_custkey").alias("s"), F.lit("segment").alias("p"), F.col("c_mktsegment").alias("o"))
    graph = view.only("c_name", "c_nationkey").unionByName(reasoning.invert(view, "o_custkey", "placed")).unionByName(some)
    return rdf.star(graph, "c_name", {"nation": "c_nationkey", "order": "placed", "segment": "segment"})


# -- catalog ---------------------------------------------------------------------------------------------------------


@query("list_sorted", "SELECT n_nationkey AS id, n_name AS title FROM nation")
def list_sorted(spark: SparkSession, d: str) -> DataFrame:
    return catalog.listed(_read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")), "title")


@query("point_lookup", "SELECT r_regionkey AS id, r_name AS title FROM region WHERE r_regionkey = 2")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.by_id(_read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title")), 2)


@query(
    "nested_document",
    "SELECT r_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey",
)
def nested_document(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.nested(_read(spark, d, "region"), _read(spark, d, "nation"), "r_regionkey", "n_regionkey", ["n_name"], "nations")
    return out.select("r_regionkey", F.array_join(F.col("nations.n_name"), ",").alias("nations"))


@query("upsert_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 = 0 DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    events = _read(spark, d, "events").select("user_id", "event_id", "event_type")
    old, new = events.filter("event_id % 3 > 0"), events.filter("event_id % 3 = 0")
    return catalog.upsert(old, new, "user_id", "event_id")


_GONE = "c_nationkey = 3"


@query("cascade_delete", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE {_GONE})")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = _read(spark, d, "customer").filter(_GONE).select("c_custkey")
    return catalog.cascade(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone)


@query("set_null_delete", f"SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE {_GONE}) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def set_null_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = _read(spark, d, "customer").filter(_GONE).select("c_custkey")
    return catalog.set_null(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone)


@query("patch_partial", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey = 7 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey = 7 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer")
def patch_partial(spark: SparkSession, d: str) -> DataFrame:
    table = _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return catalog.patch(table, 7, {"name": "", "segment": "NEW"})


@query("lenient_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n FROM events")
def lenient_json(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, '["functional", "transitive"]').when(F.col("event_id") % 3 == 0, "[broken")
    return _read(spark, d, "events").select("event_id", F.size(catalog.json_array(text)).alias("n"))


@query(
    "validation_errors",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'title: required' END, CASE WHEN p_partkey % 3 = 0 THEN 'name: no white space' END,
      CASE WHEN p_partkey % 5 > 0 THEN 'property_type: object or datatype' END], lambda x: x IS NOT NULL), ',') AS errors FROM part""",
)
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows with every combination of errors, and with none."""
    n = F.col("p_partkey")
    found = catalog.errors(F.when(n % 2 > 0, F.col("p_name")), F.when(n % 3 == 0, F.lit("two words")).otherwise("p1"), F.when(n % 5 == 0, "object").otherwise(F.col("p_type")))
    return _read(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("errors"))


def _metamodel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as classes below regions; customers as properties of nations."""
    nation = _read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("super_class_id"))
    region = _read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("super_class_id"))
    props = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("r"), F.col("s_nationkey") % 5).alias("domain_class_id"), (F.col("s_suppkey") % 7).alias("name"))
    return nation.unionByName(region), props


@query("inherited_properties", "SELECT 'n' || n_nationkey AS class_id, s_suppkey AS property_id FROM nation JOIN supplier ON s_nationkey % 5 = n_regionkey")
def inherited_properties(spark: SparkSession, d: str) -> DataFrame:
    return catalog.inherited(*_metamodel(spark, d))


@query("own_properties", "SELECT min(s_suppkey) AS id, 'r' || s_nationkey % 5 AS domain_class_id, s_suppkey % 7 AS name FROM supplier GROUP BY 2, 3")
def own_properties(spark: SparkSession, d: str) -> DataFrame:
    return catalog.representative(_metamodel(spark, d)[1], ["domain_class_id", "name"], "id")


@query("summary_counts", "SELECT (SELECT count(*) FROM part) AS classes, (SELECT count(*) FROM supplier) AS properties, (SELECT count(*) FROM part WHERE p_size > 25) AS mapped")
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = _read(spark, d, "part").agg(F.count("*").alias("classes"), F.count_if(F.col("p_size") > 25).alias("mapped"))
    return parts.join(_read(spark, d, "supplier").agg(F.count("*").alias("properties")), F.lit(True)).select("classes", "properties", "mapped")


@query("range_union", "SELECT c_mktsegment AS name, array_to_string(list_sort(list(DISTINCT c_nationkey)), ' | ') AS ranges FROM customer GROUP BY 1")
def range_union(spark: SparkSession, d: str) -> DataFrame:
    ranges = F.transform(F.sort_array(F.collect_set("c_nationkey")), lambda x: x.cast("string"))
    return _read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.array_join(ranges, " | ").alias("ranges"))


@query("representative_row", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey, count(*) AS n FROM part GROUP BY 1, 2")
def representative_row(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part").withColumn("n", F.count("*").over(Window.partitionBy("p_brand", "p_type")))
    return catalog.representative(part, ["p_brand", "p_type"], "p_partkey").select("p_brand", "p_type", "p_partkey", "n")


@query("last_flag", "SELECT n_nationkey, lead(1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) IS NULL AS last FROM nation")
def last_flag(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "nation").select("n_nationkey", F.lead(F.lit(1)).over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).isNull().alias("last"))


@query("grid_layout", "SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1) % 5 * 260 AS x, (row_number() OVER (ORDER BY n_nationkey) - 1) // 5 * 220 AS y FROM nation")
def grid_layout(spark: SparkSession, d: str) -> DataFrame:
    """A UML diagram's nodes: one schema's classes, which are few, so that one window over all of them does."""
    i = F.row_number().over(Window.orderBy("n_nationkey")).cast("long") - 1
    return _read(spark, d, "nation").select("n_nationkey", (i % 5 * 260).alias("x"), (F.floor(i / 5) * 220).alias("y"))


# -- concepts --------------------------------------------------------------------------------------------------------


def _part_triples(spark: SparkSession, d: str) -> DataFrame:
    """Parts as subjects with types, labels in two languages and a comment, in document order."""
    part = _read(spark, d, "part").withColumn("s", F.concat(F.lit("http://x.org/part#"), "p_partkey"))
    rows = F.array(
        *(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), o.alias("o"), F.lit(lang).cast("string").alias("o_lang")) for k, p, o, lang in (
            (0, TYPE, F.when(F.col("p_size") % 3 == 0, OWL + "ObjectProperty").when(F.col("p_size") % 3 == 1, OWL + "Class"), None),
            (1, TYPE, F.when(F.col("p_size") % 2 == 0, RDFS + "Class"), None),
            (2, RDFS + "label", F.col("p_brand"), "de"), (3, RDFS + "label", F.when(F.col("p_size") % 5 == 0, F.col("p_name")), "en"),
            (4, RDFS + "label", F.when(F.col("p_size") % 10 == 0, F.col("p_type")), "en"), (5, RDFS + "comment", F.col("p_type"), None), (6, RDFS + "comment", F.col("p_name"), None),
        ))
    )
    flat = part.select("s", "p_partkey", F.explode(rows).alias("r")).filter("r.o IS NOT NULL")
    return flat.select((F.col("p_partkey") * 10 + F.col("r.k")).alias("ord"), "s", F.lit("iri").alias("s_kind"), "r.p", "r.o", "r.o_lang")


_CONCEPTS = """SELECT 'http://x.org/part#' || p_partkey AS iri, CAST(p_partkey AS VARCHAR) AS "localName",
  CASE WHEN p_size % 3 = 0 THEN 'property' ELSE 'class' END AS type,
  CASE WHEN p_size % 10 = 0 THEN p_type WHEN p_size % 5 = 0 THEN p_name ELSE p_brand END AS label, p_type AS comment
  FROM part WHERE p_size % 3 < 2 OR p_size % 2 = 0"""


@query("concept_typing", _CONCEPTS)
def concept_typing(spark: SparkSession, d: str) -> DataFrame:
    return concepts.concepts(_part_triples(spark, d))


@query("concept_search", f"WITH c AS ({_CONCEPTS}) SELECT * FROM c WHERE contains(lower(\"localName\"), '12') OR contains(lower(label), '12') OR contains(lower(iri), '12')")
def concept_search(spark: SparkSession, d: str) -> DataFrame:
    return concepts.search(concepts.concepts(_part_triples(spark, d)), " 12 ", limit=None)


@query("preferred_label", "SELECT source, coalesce(arg_max(lang || n_chars, doc_id) FILTER (WHERE lang = 'en'), arg_min(lang || n_chars, doc_id)) AS label FROM documents GROUP BY source")
def preferred_label(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("source", "lang", "doc_id", F.concat("lang", "n_chars").alias("text"))
    return docs.groupBy("source").agg(concepts.preferred(F.col("text"), F.col("lang"), F.col("doc_id")).alias("label"))


@query("ontology_guard", "SELECT count(*) FILTER (WHERE p_size % 3 = 1) AS classes, CAST(0 AS BIGINT) AS ontologies, false AS valid FROM part")
def ontology_guard(spark: SparkSession, d: str) -> DataFrame:
    return concepts.adoptable(_part_triples(spark, d))


@query(
    "ntriples_read",
    f"""SELECT 'http://x.org/' || n_nationkey AS s, 'http://x.org/name' AS p, n_name || '"' AS o, 'en' AS o_lang, CAST(NULL AS VARCHAR) AS o_dtype FROM nation
    UNION ALL SELECT 'http://x.org/' || n_nationkey, 'http://x.org/key', CAST(n_nationkey AS VARCHAR), NULL, '{XSD}integer' FROM nation
    UNION ALL SELECT '_:n' || n_nationkey, 'http://x.org/é', n_name, 'de-1996', NULL FROM nation UNION ALL SELECT 'http://x.org/' || n_nationkey, 'http://x.org/of', '_:r.' || n_regionkey, NULL, NULL FROM nation""",
)
def ntriples_read(spark: SparkSession, d: str) -> DataFrame:
    """Lines with and without white space, comments, escapes, and what is no triple."""
    n = _read(spark, d, "nation")
    s = F.concat(F.lit("<http://x.org/"), "n_nationkey", F.lit("> "))
    lines = F.array(
        F.concat(s, F.lit("<http://x.org/name> "), F.lit('"'), "n_name", F.lit('\\""@en .')),
        F.concat(s, F.lit("<http://x.org/key> "), F.lit('"'), "n_nationkey", F.lit(f'"^^<{XSD}integer> . # key')), F.lit("# nothing"), F.lit("broken line"),
        F.concat(F.lit("_:n"), "n_nationkey", F.lit('<http://x.org/\\u00e9>"'), "n_name", F.lit('"@de-1996.')), F.concat(F.rtrim(s), F.lit("<http://x.org/of>_:r."), "n_regionkey", F.lit(".")),
    )
    flat = n.select(F.posexplode(lines).alias("ord", "value"))
    return rdf.parse_ntriples(flat).select("s", "p", "o", "o_lang", "o_dtype")


@query("ntriples_rejected", "SELECT p_partkey, 'broken ' || p_brand AS value FROM part WHERE p_partkey % 4 = 0")
def ntriples_rejected(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = _read(spark, d, "part").select(k.alias("ord"), F.when(k % 4 == 0, F.concat(F.lit("broken "), "p_brand")).when(k % 4 == 1, " # note").when(k % 4 == 2, "").otherwise('<a:s><a:p>"o".').alias("value"))
    return rdf.rejected(lines).select(F.col("ord").alias("p_partkey"), "value")


@query("ontology_header", "SELECT 'http://x.org/part#' || min(p_partkey) AS iri, min_by(p_brand, p_partkey) AS version, min_by(p_type, p_partkey) AS modified FROM part WHERE p_size % 3 = 0")
def ontology_header(spark: SparkSession, d: str) -> DataFrame:
    """The first of several ontology headers, with the first version and date of each."""
    part = _read(spark, d, "part").filter("p_size % 3 = 0").withColumn("s", F.concat(F.lit("http://x.org/part#"), "p_partkey"))
    facts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), o.alias("o")) for k, p, o in (
        (0, TYPE, F.lit(OWL + "Ontology")), (1, OWL + "versionInfo", F.col("p_brand")), (2, OWL + "versionInfo", F.lit("later")), (3, "http://purl.org/dc/terms/modified", F.col("p_type")),
    )))
    flat = part.select("s", "p_partkey", F.explode(facts).alias("r"))
    return concepts.header(flat.select((F.col("p_partkey") * 10 + F.col("r.k")).alias("ord"), "s", F.lit("iri").alias("s_kind"), "r.p", "r.o"))


@query("concept_ranking", f"WITH c AS ({_CONCEPTS}) SELECT iri, row_number() OVER (ORDER BY lower(label), iri) AS place FROM c WHERE contains(lower(label), 'small') ORDER BY place LIMIT 50")
def concept_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty hits by label in the collation of the root locale, numbered as they come."""
    found = concepts.search(concepts.concepts(_part_triples(spark, d)), "SMALL")
    return found.select("iri", F.row_number().over(Window.orderBy(F.collate("label", "UNICODE"), "iri")).alias("place"))


# -- rules -----------------------------------------------------------------------------------------------------------


@query(
    "class_closure",
    """WITH RECURSIVE e AS (SELECT 'nation/' || n_nationkey AS sub, 'region/' || n_regionkey AS sup FROM nation UNION ALL
      SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer UNION ALL SELECT DISTINCT 'region/' || n_regionkey, 'world' FROM nation),
    t AS (SELECT * FROM e UNION SELECT t.sub, e.sup FROM t JOIN e ON t.sup = e.sub) SELECT * FROM t""",
)
def class_closure(spark: SparkSession, d: str) -> DataFrame:
    view = View(spark, d, ["nation", "customer"])
    nation, customer = (edges_of(view, p).select(F.col("s").alias("sub"), F.col("o").alias("sup")) for p in ("n_regionkey", "c_nationkey"))
    world = nation.select(F.col("sup").alias("sub"), F.lit("world").alias("sup")).distinct()
    return reasoning.transitive(nation.unionByName(customer).unionByName(world))


@query(
    "cyclic_closure",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS sub, (n_nationkey + 5) % 25 AS sup FROM nation), t AS (SELECT * FROM e UNION SELECT t.sub, e.sup FROM t JOIN e ON t.sup = e.sub) SELECT * FROM t""",
)
def cyclic_closure(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.transitive(_read(spark, d, "nation").select(F.col("n_nationkey").alias("sub"), ((F.col("n_nationkey") + 5) % 25).alias("sup")))


@query("type_propagation", "SELECT 'orders/' || o_orderkey AS s, unnest(['orders', 'Process', 'Thing']) AS c FROM orders")
def type_propagation(spark: SparkSession, d: str) -> DataFrame:
    up = reasoning.transitive(reasoning.small(spark, [("orders", "Process"), ("Process", "Thing")], "sub string, sup string"))
    types = reasoning.types_of(View(spark, d, ["orders"]), "orders")
    return reasoning.propagate_types(types, up)


@query("domain_inference", "SELECT 'orders/' || o_orderkey AS s, 'Process' AS c FROM orders UNION ALL SELECT 'buyer/' || o_orderkey, 'Feature' FROM orders")
def domain_inference(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.infer_domain(View(spark, d).only("hasParticipant", "isFeatureOf"), reasoning.small(spark, [("hasParticipant", "Process"), ("isFeatureOf", "Feature")], "p string, c string"))


@query("range_inference", "SELECT 'buyer/' || o_orderkey AS s, 'Object' AS c FROM orders UNION ALL SELECT DISTINCT 'customer/' || o_custkey, 'Object' FROM orders")
def range_inference(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.infer_range(View(spark, d).only("hasParticipant", "isFeatureOf"), reasoning.small(spark, [("hasParticipant", "Object"), ("isFeatureOf", "Object")], "p string, c string"))


@query("inverse_materialize", "SELECT 'buyer/' || o_orderkey AS s, 'isParticipantIn' AS p, 'orders/' || o_orderkey AS o FROM orders")
def inverse_materialize(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.invert(View(spark, d), "hasParticipant", "isParticipantIn")


@query("symmetric_materialize", "SELECT 'nation/' || n_nationkey AS s, 'n_regionkey' AS p, 'region/' || n_regionkey AS o FROM nation UNION SELECT 'region/' || n_regionkey, 'n_regionkey', 'nation/' || n_nationkey FROM nation")
def symmetric_materialize(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.symmetric(View(spark, d), "n_regionkey")


@query("subproperty", "SELECT 'nation/' || n_nationkey AS s, unnest(['n_regionkey', 'isIn', 'relatedTo']) AS p, 'region/' || n_regionkey AS o FROM nation")
def subproperty(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.subproperties(edges_of(View(spark, d), "n_regionkey"), reasoning.small(spark, [("n_regionkey", "isIn"), ("isIn", "relatedTo")], "sub string, sup string"))


@query("property_chain", "SELECT 'orders/' || o_orderkey AS s, 'hasParticipant' AS p, 'customer/' || o_custkey AS o FROM orders")
def property_chain(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.chain(View(spark, d), "hasParticipant", "isFeatureOf", "hasParticipant")


@query("all_values_from", "SELECT DISTINCT 'nation/' || c_nationkey AS s, 'SpatialObject' AS c FROM customer")
def all_values_from(spark: SparkSession, d: str) -> DataFrame:
    view = View(spark, d)
    return reasoning.all_values(view, reasoning.types_of(view, "customer"), "customer", "c_nationkey", "SpatialObject")


@query("some_values_from", "SELECT 'orders/' || o_orderkey AS s, 'Sale' AS c FROM orders")
def some_values_from(spark: SparkSession, d: str) -> DataFrame:
    view = View(spark, d)
    return reasoning.some_values(view, reasoning.types_of(view, "BuyerRole"), "hasParticipant", "BuyerRole", "Sale")


@query("functional_check", "SELECT 'nation/' || c_nationkey AS s, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1")
def functional_check(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.functional(reasoning.invert(View(spark, d), "c_nationkey", "population"), "population")


@query("inverse_functional_check", "SELECT 'customer/' || o_custkey AS o, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def inverse_functional_check(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.inverse_functional(View(spark, d), "o_custkey")


def _follows(spark: SparkSession, d: str) -> DataFrame:
    """Nations in a graph with loops and pairs of opposite edges."""
    n = _read(spark, d, "nation")
    o = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey")).otherwise(F.lit(24) - F.col("n_nationkey"))
    return n.select(F.col("n_nationkey").cast("string").alias("s"), F.lit("follows").alias("p"), o.cast("string").alias("o"))


_FOLLOWS = "WITH e AS (SELECT n_nationkey AS s, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey ELSE 24 - n_nationkey END AS o FROM nation)"


@query("asymmetric_check", f"{_FOLLOWS} SELECT CAST(a.s AS VARCHAR) AS s, CAST(a.o AS VARCHAR) AS o FROM e a JOIN e b ON a.s = b.o AND a.o = b.s")
def asymmetric_check(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.asymmetric(_follows(spark, d), "follows")


@query("irreflexive_check", f"{_FOLLOWS} SELECT CAST(s AS VARCHAR) AS s FROM e WHERE s = o")
def irreflexive_check(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.irreflexive(_follows(spark, d), "follows")


@query("property_disjoint_check", "SELECT DISTINCT 'orders/' || o_orderkey AS s, 'customer/' || o_custkey AS o FROM orders WHERE o_orderkey % 10 = 0")
def property_disjoint_check(spark: SparkSession, d: str) -> DataFrame:
    buys = edges_of(View(spark, d), "o_custkey")
    gives = _read(spark, d, "orders").filter("o_orderkey % 10 = 0").select(individual("orders", "o_orderkey").alias("s"), F.lit("gives").alias("p"), individual("customer", "o_custkey").alias("o"))
    return reasoning.disjoint_properties(buys.unionByName(gives), "o_custkey", "gives")


@query("disjoint_class_check", "SELECT 'orders/' || o_orderkey AS s, 'Process' AS one, 'Object' AS other FROM orders WHERE o_orderstatus = 'F'")
def disjoint_class_check(spark: SparkSession, d: str) -> DataFrame:
    view = View(spark, d, ["orders"])
    process = reasoning.types_of(view).filter("c = 'orders'").select("s", F.lit("Process").alias("c"))
    objects = edges_of(view, "o_orderstatus").filter("o = 'F'").select("s", F.lit("Object").alias("c"))
    return reasoning.disjoint_classes(process.unionByName(objects), reasoning.small(spark, [("Process", "Object")], "one string, other string"))


_CLASSES = [("Order", "Process"), ("Customer", "SpatialObject"), ("Invoice", "InformationObject")]
_ROLE = [T("?this", "hasParticipant", "?o1"), T("?o1", TYPE, "Role"), T("?o1", "isFeatureOf", "?value")]


@query("data_clashes", "SELECT 'orders/' || o_orderkey AS s FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 7 = 0")
def data_clashes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as processes: a role of a customer is no contradiction; a dose as a part is one, and an amount that must be
    of two types."""
    one = lambda p: [T("?this", p, "?value")]
    mapped = [
        consistency.Mapped("buyer", pattern.forward(_ROLE, "Customer", "Order"), pattern.backward(_ROLE, "Order", "Customer")),
        consistency.Mapped("dose", pattern.forward(one("hasPart"), "Quantity", "Order"), pattern.backward(one("hasPart"), "Order", "Quantity")),
        consistency.Mapped("amount", pattern.Named("Order"), datatype="float"), consistency.Mapped("amount", pattern.Named("Order"), datatype="decimal"),
    ]
    orders = _read(spark, d, "orders").withColumn("s", individual("orders", "o_orderkey"))
    dose = F.col("o_orderstatus") == "P"
    linked = orders.select("s", F.when(dose, "dose").otherwise("buyer").alias("p"), F.when(dose, F.concat(F.lit("dose/"), F.col("o_orderkey"))).otherwise(individual("customer", "o_custkey")).alias("o"))
    amounts = orders.filter("o_orderkey % 7 = 0").select("s", F.lit("amount").alias("p"), F.col("o_totalprice").cast("string").alias("o"))
    found = consistency.data_clashes(spark, orders.select("s", F.lit("Order").alias("c")), linked.unionByName(amounts), _CLASSES, mapped)
    return found.filter(F.startswith("s", F.lit("orders/"))).select("s").distinct()


# -- shapes ----------------------------------------------------------------------------------------------------------

P = shapes.Property


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph of which a part breaks each constraint: customers, of whom some have orders of a kind; nations of one region as
    Home; parts whose size is a number for some and a brand for others. With types and the classes above them."""
    view = View(spark, d)
    part = _read(spark, d, "part").select(individual("part", "p_partkey").alias("s"), F.lit("size").alias("p"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("o"))
    placed = _read(spark, d, "orders").filter("o_orderkey % 20 = 0").select(individual("customer", "o_custkey").alias("s"), F.lit("placed").alias("p"), individual("orders", "o_orderkey").alias("o"))
    triples_ = view.only("c_nationkey", "c_name").unionByName(placed).unionByName(part)
    home = edges_of(view, "n_regionkey").filter("o = 'region/1'").select("s", F.lit("Home").alias("c"))
    types = reasoning.types_of(view, "customer", "supplier", "part").unionByName(home)
    up = reasoning.transitive(reasoning.small(spark, [("customer", "Party"), ("Home", "Place")], "sub string, sup string"))
    return triples_, types, up


def _report(spark: SparkSession, d: str, *properties: shapes.Property, target: str = "Party") -> DataFrame:
    graph, types, up = _graph(spark, d)
    return shapes.violations(graph, types, shapes.Shape(target, properties), up)


_ORDERLESS = "SELECT 'customer/' || c_custkey AS focus, 'placed' AS path, 'minCount' AS kind, CAST(NULL AS VARCHAR) AS value, 'Party' AS shape FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)"
_ABROAD = "SELECT 'customer/' || c_custkey AS focus, 'c_nationkey' AS path, '{kind}' AS kind, 'nation/' || c_nationkey AS value, 'Party' AS shape FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1"


@query("shacl_min_count", _ORDERLESS)
def shacl_min_count(spark: SparkSession, d: str) -> DataFrame:
    """Of customers, below the target class, those without such orders."""
    return _report(spark, d, P("placed", 1), P("c_name", 1))


@query("shacl_class", _ABROAD.format(kind="class"))
def shacl_class(spark: SparkSession, d: str) -> DataFrame:
    """Home is below Place, the class that is asked for."""
    return _report(spark, d, P("c_nationkey", classes=("Place",)))


@query("shacl_or", _ABROAD.format(kind="or"))
def shacl_or(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, P("c_nationkey", classes=("supplier", "Home")))


@query("shacl_datatype", "SELECT 'part/' || p_partkey AS focus, 'size' AS path, 'datatype' AS kind, p_brand AS value, 'part' AS shape FROM part WHERE p_partkey % 3 = 0")
def shacl_datatype(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, P("size", datatype="integer"), target="part")


@query(
    "shacl_report",
    f"""SELECT path, kind, count(*) AS n FROM (
      {_ORDERLESS} UNION ALL {_ABROAD.format(kind="class")} UNION ALL SELECT 'customer/' || c_custkey, 'c_name', 'datatype', c_name, 'Party' FROM customer) GROUP BY path, kind""",
)
def shacl_report(spark: SparkSession, d: str) -> DataFrame:
    out = _report(spark, d, P("placed", 1), P("c_name", 1, datatype="date"), P("c_nationkey", 1, classes=("Home",)))
    return out.groupBy("path", "kind").agg(F.count("*").alias("n"))


# -- views of model rows ---------------------------------------------------------------------------------------------


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Models by region: nations as classes, every second one below the first of its kind; customers as properties with a
    text, a class or nothing as range, and a pattern for every second one."""
    n, at = _read(spark, d, "nation"), F.col("n_nationkey")
    up = F.when(at >= 5, F.concat(F.lit("c"), at - 5))
    classes = n.select(
        F.concat(F.lit("m"), "n_regionkey").alias("schema_id"), at.cast("int").alias("ord"), F.concat(F.lit("c"), at).alias("id"), F.concat(F.lit("http://x.org/c"), at).alias("url"), F.col("n_name").alias("name"),
        F.when(at % 2 == 0, F.concat(F.lit("The \""), "n_name", F.lit('"'))).alias("label"), F.lit("").alias("description"), F.when(at % 3 == 0, "http://up.org/Place").alias("maps_to_concept_iri"), up.alias("super_class_id"),
    )
    c = _read(spark, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    k = F.col("c_custkey")
    range_ = F.when(k % 3 == 0, XSD + "string").when(k % 3 == 1, F.concat(F.lit("http://x.org/c"), k % 30))
    triple = lambda i, s, p, o: F.struct(F.lit(i).alias("ord"), F.lit(s).alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    through = F.concat(F.lit("http://x.org/c"), k % 7 * 2)
    steps = F.array(triple(0, "?this", "http://up.org/has", F.lit("?o1")), triple(1, "?o1", TYPE, through), triple(2, "?o1", "http://up.org/of", F.lit("?value")))
    properties = c.select(
        F.concat(F.lit("m"), "n_regionkey").alias("schema_id"), k.cast("int").alias("ord"), F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit("has"), k % 4).alias("name"), F.concat(F.lit("c"), "c_nationkey").alias("domain_class_id"),
        range_.alias("range_class_iri"), F.when(k % 2 == 0, steps).alias("pattern"),
    )
    return classes, properties


_MODEL = """WITH cls AS (SELECT 'm' || n_regionkey AS schema_id, n_nationkey AS k, 'c' || n_nationkey AS id, 'http://x.org/c' || n_nationkey AS url, n_name AS name,
    CASE WHEN n_nationkey % 2 = 0 THEN 'The "' || n_name || '"' END AS label, CASE WHEN n_nationkey >= 5 THEN 'c' || (n_nationkey - 5) END AS up FROM nation),
  prop AS (SELECT 'm' || n_regionkey AS schema_id, c_custkey AS k, 'has' || c_custkey % 4 AS name, 'c' || c_nationkey AS domain,
    CASE c_custkey % 3 WHEN 0 THEN 'xsd' WHEN 1 THEN 'http://x.org/c' || c_custkey % 30 END AS range FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(
    "class_view",
    f"{_MODEL} SELECT 'c' || k AS id, 'http://api/' || id AS url, name, label, '' AS description, CASE WHEN k % 3 = 0 THEN 'http://up.org/Place' END AS \"mapsToConceptIri\", up AS \"superClassId\" FROM cls",
)
def class_view(spark: SparkSession, d: str) -> DataFrame:
    return views.class_view(_model(spark, d)[0], "http://api/")


@query(
    "property_view",
    """SELECT p_partkey AS id, p_partkey % 5 = 1 AS required, CASE WHEN p_partkey % 2 = 0 THEN 'functional,symmetric' ELSE '' END AS features, CASE WHEN p_partkey % 3 = 0 THEN '?this' ELSE '' END AS subjects FROM part""",
)
def property_view(spark: SparkSession, d: str) -> DataFrame:
    """JSON texts that are right, broken and null."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    rows = _read(spark, d, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), none.alias("label"), F.lit("object").alias("property_type"), none.alias("domain_class_id"), none.alias("range_class_iri"),
        F.when(k % 3 == 0, '[{"subject":"?this","predicate":"p","object":"?value"}]').when(k % 3 == 1, "[{").alias("mapping_pattern"),
        F.when(k % 5 > 1, 0).when(k % 5 == 1, 1).alias("is_required"), F.when(k % 2 == 0, '["functional","symmetric"]').alias("property_features"), none.alias("disjoint_property_iris"),
    )
    out = views.property_view(rows, "http://api/")
    return out.select("id", F.col("isRequired").alias("required"), F.array_join("propertyFeatures", ",").alias("features"), F.array_join("mappingPattern.subject", ",").alias("subjects"))


@query("property_concepts", f"WITH c AS ({_CONCEPTS}) SELECT iri, \"localName\", label FROM c WHERE type = 'property' UNION ALL SELECT '{TYPE}', 'type', 'a (rdf:type)'")
def property_concepts(spark: SparkSession, d: str) -> DataFrame:
    return views.property_concepts(concepts.concepts(_part_triples(spark, d))).select("iri", "localName", "label")


@query(
    "pattern_preview",
    f"""{_MODEL} SELECT 'p' || c_custkey AS id, '?this has ?o1 .' || chr(10) || '?o1 a ' || CASE c_custkey % 7 * 2 WHEN 12 THEN 'Twelve' ELSE label END || ' .' || chr(10) || '?o1 of ?value' AS preview
    FROM customer JOIN cls ON k = c_custkey % 7 * 2 WHERE c_custkey % 2 = 0""",
)
def pattern_preview(spark: SparkSession, d: str) -> DataFrame:
    """One of the classes is known as a concept of the upper ontology only."""
    classes, properties = _model(spark, d)
    upper = spark.createDataFrame([("http://x.org/c12", "c12", "class", "Twelve"), ("http://x.org/c2", "c2", "class", "hidden by the class")], "iri string, localName string, type string, label string")
    return views.previews(properties, classes.filter("id <> 'c12'"), upper)


@query("intermediate_classes", f"{_MODEL} SELECT id, id IN (SELECT 'c' || c_custkey % 7 * 2 FROM customer WHERE c_custkey % 2 = 0) AS intermediate FROM cls")
def intermediate_classes(spark: SparkSession, d: str) -> DataFrame:
    return views.intermediate(*_model(spark, d)).select("id", "intermediate")


@query(
    "property_cards",
    f"""{_MODEL} SELECT p.name, domain AS domain_class_id, string_agg(CASE WHEN range = 'xsd' THEN 'xsd:string' ELSE coalesce(c.name, replace(range, 'http://x.org/', '')) END, ' | ' ORDER BY p.k) AS ranges
    FROM prop p LEFT JOIN cls c ON c.url = range GROUP BY p.name, domain""",
)
def property_cards(spark: SparkSession, d: str) -> DataFrame:
    classes, properties = _model(spark, d)
    return views.property_cards(properties, classes)


@query("property_names", f"{_MODEL} SELECT DISTINCT name FROM prop")
def property_names(spark: SparkSession, d: str) -> DataFrame:
    return views.property_names(_model(spark, d)[1])


@query("unchosen_names", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'a,b' WHEN n_nationkey % 3 = 1 THEN 'b' ELSE '' END AS free FROM nation")
def unchosen_names(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("n_nationkey"), lambda *x: F.array(*map(F.lit, x))
    chosen = F.when(k % 3 == 1, text("a", "z")).when(k % 3 == 2, text("b", "a"))
    return _read(spark, d, "nation").select("n_nationkey", F.array_join(views.unchosen(text("a", "b"), chosen), ",").alias("free"))


@query("check_due", "SELECT event_id, event_id % 10 < 2 OR date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(event_id % 48 AS INTEGER))) <= 23 AS due FROM events")
def check_due(spark: SparkSession, d: str) -> DataFrame:
    """Times on either side of a day ago, a text that is no time, and null."""
    k = F.col("event_id")
    then = F.date_format(F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=(k % 48).cast("int")), "yyyy-MM-dd HH:mm:ss")
    last = F.when(k % 10 == 1, "yesterday").when(k % 10 > 1, then)
    return _read(spark, d, "events").select("event_id", views.is_due(last, F.to_timestamp(F.lit("2024-01-02 23:00:00"))).alias("due"))


@query(
    "characteristics",
    """SELECT n_nationkey, ':p' || n_nationkey || ' a owl:ObjectProperty' || CASE WHEN n_nationkey % 2 = 0 THEN ', owl:FunctionalProperty' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN ' ; owl:inverseOf <http://x.org/q>' ELSE '' END
    || ' ; owl:propertyDisjointWith :other .' AS text FROM nation""",
)
def characteristics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    features = F.when(k % 2 == 0, F.array(F.lit("functional"), F.lit("unheard of"))).otherwise(F.array().cast("array<string>"))
    text = views.characteristics(F.concat(F.lit("p"), k), features, F.when(k % 3 == 0, "http://x.org/q"), F.array(F.lit("other")))
    return _read(spark, d, "nation").select("n_nationkey", text.alias("text"))


@query(
    "diagram_edges",
    f"""{_MODEL} SELECT a.schema_id, a.name AS source, b.name AS target, '' AS label, 'inherits' AS kind FROM cls a JOIN cls b ON a.up = b.id AND a.schema_id = b.schema_id
    UNION ALL SELECT p.schema_id, a.name, b.name, p.name, 'property' FROM prop p JOIN cls a ON p.domain = a.id AND p.schema_id = a.schema_id JOIN cls b ON p.range = b.url AND p.schema_id = b.schema_id""",
)
def diagram_edges(spark: SparkSession, d: str) -> DataFrame:
    return views.diagram_edges(*_model(spark, d))


_BLOCK = """SELECT a.schema_id, CAST(a.k AS INTEGER) AS ord, CASE WHEN a.k % 3 = 0 THEN '<http://up.org/Place>' ELSE ':' || a.name END || chr(10) || '    a {kind}:Class' || CASE WHEN a.label IS NOT NULL THEN ' ;' || chr(10) || '    rdfs:label "The \\"' || a.name || '\\""' ELSE '' END
  || CASE WHEN b.id IS NOT NULL THEN ' ;' || chr(10) || '    rdfs:subClassOf ' || CASE WHEN b.k % 3 = 0 THEN '<http://up.org/Place>' ELSE ':' || b.name END ELSE '' END || {more} || ' .' AS value FROM cls a LEFT JOIN cls b ON a.up = b.id AND a.schema_id = b.schema_id"""


@query("class_blocks_rdfs", f"{_MODEL} " + _BLOCK.format(kind="rdfs", more="''"))
def class_blocks_rdfs(spark: SparkSession, d: str) -> DataFrame:
    return views.class_blocks(_model(spark, d)[0], {"": "http://x.org/"}, owl=False)


@query("class_blocks_owl", f"{_MODEL} " + _BLOCK.format(kind="owl", more="CASE WHEN a.k % 3 = 0 THEN ' ;' || chr(10) || '    rdfs:subClassOf up:Place' ELSE '' END"))
def class_blocks_owl(spark: SparkSession, d: str) -> DataFrame:
    return views.class_blocks(_model(spark, d)[0], {"": "http://x.org/", "up": "http://up.org/"}, owl=True)


@query(
    "shape_counts",
    f"""{_MODEL}, s AS (SELECT p.schema_id, p.domain, p.name, count(DISTINCT b.url) AS n FROM prop p LEFT JOIN cls b ON p.range = b.url AND p.schema_id = b.schema_id GROUP BY 1, 2, 3)
    SELECT c.schema_id, node_shapes, coalesce(property_shapes, 0) AS property_shapes, coalesce(unions, 0) AS unions FROM (SELECT schema_id, count(*) AS node_shapes FROM cls GROUP BY 1) c
    LEFT JOIN (SELECT schema_id, count(*) AS property_shapes, count(*) FILTER (WHERE n > 1) AS unions FROM s GROUP BY 1) x ON c.schema_id = x.schema_id""",
)
def shape_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.shape_counts(*_model(spark, d))


# -- contradictions in models -----------------------------------------------------------------------------------------


def _aligned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Models by region: nations as classes of four kinds, customers as properties that refer to their range, reach it by a
    role or have it as a part; the range is a nation, of the same region or not."""
    classes, properties = _model(spark, d)
    at, k, upper_ = F.col("ord"), F.col("ord"), exports.NAMESPACE
    kinds = F.array(*(F.lit(upper_ + x) for x in ("Process", "SpatialObject", "InformationObject", "Quantity")))
    classes = classes.withColumns({"maps_to_concept_iri": F.get(kinds, at % 4), "super_class_id": F.lit(None).cast("string")})
    triple = lambda i, s, p, o: F.struct(F.lit(i).alias("ord"), F.lit(s).alias("subject"), F.lit(p).alias("predicate"), F.lit(o).alias("object"))
    one = lambda p: F.array(triple(0, "?this", upper_ + p, "?value"))
    role = F.array(triple(0, "?this", upper_ + "hasParticipant", "?o1"), triple(1, "?o1", TYPE, upper_ + "Role"), triple(2, "?o1", upper_ + "isFeatureOf", "?value"))
    properties = properties.withColumns({
        "name": F.concat(F.lit("p"), k), "range_class_iri": F.concat(F.lit("http://x.org/c"), k % 25), "pattern": F.when(k % 3 == 0, one("refersTo")).when(k % 3 == 1, role).otherwise(one("hasPart")),
        "property_type": F.lit("object"), "is_required": F.lit(False), "features": F.array().cast("array<string>"), "inverse": F.lit(None).cast("string"), "disjoint": F.array().cast("array<string>"),
        "label": F.lit(None).cast("string"), "description": F.lit(None).cast("string"),
    })
    return classes, properties


_ALIGNED = """WITH a AS (SELECT 'm' || d.n_regionkey || ' p' || c_custkey AS anchor, c_custkey % 3 AS way, d.n_nationkey % 4 AS dom, r.n_nationkey % 4 AS rng, r.n_regionkey = d.n_regionkey AS ranged
    FROM customer JOIN nation d ON d.n_nationkey = c_nationkey JOIN nation r ON r.n_nationkey = c_custkey % 25),
  bad AS (SELECT *, CASE way WHEN 0 THEN CASE dom WHEN 0 THEN 'Object is disjoint with Process' WHEN 1 THEN 'Feature is disjoint with SpatialObject' END
    WHEN 1 THEN CASE WHEN dom > 0 OR rng = 0 THEN 'Object is disjoint with Process' END
    ELSE CASE WHEN dom < 2 AND dom <> rng OR dom >= 2 AND rng < 2 THEN CASE WHEN dom > 0 AND rng > 0 THEN 'Feature is disjoint with SpatialObject' WHEN dom > 0 THEN 'Object has no Process as hasPart' ELSE 'Object is disjoint with Process' END END END AS axiom FROM a),
  found AS (SELECT anchor || ' domain' AS anchor, axiom FROM bad WHERE axiom IS NOT NULL UNION ALL SELECT anchor || ' range', axiom FROM bad WHERE axiom IS NOT NULL AND ranged)"""


@query("unsat_classes", f"{_ALIGNED} SELECT anchor FROM found")
def unsat_classes(spark: SparkSession, d: str) -> DataFrame:
    """The anchors of all models that cannot have instances, with the classes of those models below the upper ontology."""
    types, edges, below = consistency.model_anchors(*_aligned(spark, d))
    types, edges, members = consistency.alike(types, edges)
    found = consistency.refuted(types, edges, consistency.Ontology(spark, below))[0].select(F.col("anchor").alias("same"))
    return members.join(found, "same").select("anchor")


@query("clash_proofs", f"{_ALIGNED} SELECT anchor, axiom FROM found")
def clash_proofs(spark: SparkSession, d: str) -> DataFrame:
    """The axiom that each such anchor runs into, by its proof."""
    types, edges, below = consistency.model_anchors(*_aligned(spark, d))
    types, edges, members = consistency.alike(types, edges)
    _, proofs = consistency.refuted(types, edges, consistency.Ontology(spark, below), trace=True)
    found = consistency.justified(proofs).filter("rule = 'clash'").select(F.col("anchor").alias("same"), "axiom")
    return members.join(found, "same").select("anchor", "axiom")


@query("case_refutation", "SELECT 's' || s_suppkey AS anchor FROM supplier WHERE s_suppkey % 3 = 0")
def case_refutation(spark: SparkSession, d: str) -> DataFrame:
    """Bearers of features, so objects or processes, with an object and a process as parts, or two of a kind: the first
    cannot be either."""
    s = _read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("anchor"), F.col("s_suppkey").alias("k"))
    kind = lambda r: F.when(F.col("k") % 3 == r, "Process").otherwise("SpatialObject")
    types = s.select("anchor", F.lit("a").alias("s"), kind(1).alias("c")).unionByName(s.select("anchor", F.lit("b").alias("s"), F.when(F.col("k") % 3 == 0, "Process").otherwise(kind(1)).alias("c")))
    part = lambda o, p: s.select("anchor", F.lit("x").alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o"))
    edges = part("a", "hasPart").unionByName(part("b", "hasPart")).unionByName(part("f", "hasFeature"))
    return consistency.refuted(types, edges, consistency.Ontology(spark))[0].select("anchor")


@query(
    "same_individuals",
    """WITH RECURSIVE e AS (SELECT c_nationkey AS a, c_custkey % 25 AS b FROM customer WHERE c_custkey % 150 = 0), eb AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    n AS (SELECT n_nationkey AS x, n_nationkey AS y FROM nation UNION SELECT x, b FROM n JOIN eb ON a = y), nm AS (SELECT x, min(y) AS m FROM n GROUP BY x),
    re AS (SELECT DISTINCT p.n_regionkey AS a, q.n_regionkey AS b FROM nm JOIN nation p ON p.n_nationkey = x JOIN nation q ON q.n_nationkey = m), rb AS (SELECT a, b FROM re UNION SELECT b, a FROM re),
    r AS (SELECT r_regionkey AS x, r_regionkey AS y FROM region UNION SELECT x, b FROM r JOIN rb ON a = y)
    SELECT 'nation/' || lpad(CAST(x AS VARCHAR), 2, '0') AS member, 'nation/' || lpad(CAST(m AS VARCHAR), 2, '0') AS representative FROM nm WHERE x <> m
    UNION ALL SELECT 'region/' || lpad(CAST(x AS VARCHAR), 2, '0'), 'region/' || lpad(CAST(min(y) AS VARCHAR), 2, '0') FROM r GROUP BY x HAVING x <> min(y)""",
)
def same_individuals(spark: SparkSession, d: str) -> DataFrame:
    """Some customers have two homes where they may have one: these nations are the same, and then so are their regions."""
    name = lambda t, k: F.concat(F.lit(t + "/"), F.lpad(k.cast("string"), 2, "0"))
    c, k = _read(spark, d, "customer").filter("c_custkey % 150 = 0"), F.col("c_custkey")
    homes = c.select(individual("customer", "c_custkey").alias("s"), F.lit("home").alias("p"), F.explode(F.array(name("nation", F.col("c_nationkey")), name("nation", k % 25))).alias("o"))
    within = _read(spark, d, "nation").select(name("nation", F.col("n_nationkey")).alias("s"), F.lit("within").alias("p"), name("region", F.col("n_regionkey")).alias("o"))
    one = spark.createDataFrame([("home",), ("within",)], "p string")
    names, _ = equality.same(homes.unionByName(within).withColumn("literal", F.lit(False)), one, one.limit(0))
    return names.filter("member <> representative")


@query(
    "literal_conflicts",
    "SELECT 'nation/' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS s, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1",
)
def literal_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation are one individual by an inverse functional property; their segments, one each, then conflict."""
    c = _read(spark, d, "customer").withColumn("n", F.concat(F.lit("key/"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")))
    one = lambda p: spark.createDataFrame([(p,)], "p string")
    owner = c.select(individual("customer", "c_custkey").alias("s"), F.lit("key").alias("p"), F.col("n").alias("o"), F.lit(False).alias("literal"))
    segment = c.select(individual("customer", "c_custkey").alias("s"), F.lit("segment").alias("p"), F.col("c_mktsegment").alias("o"), F.lit(True).alias("literal"))
    _, facts = equality.same(owner.unionByName(segment), one("none"), one("key"))
    bad = equality.literal_clashes(facts, one("segment")).join(facts.filter("p = 'key'").select("s", F.col("o").alias("n_")), "s")
    return bad.select(F.replace("n_", F.lit("key/"), F.lit("nation/")).alias("s"), "n")


@query(
    "graph_merge",
    """SELECT 'total' AS p, count(*) AS n, count(DISTINCT o_orderkey) AS subjects FROM orders UNION ALL SELECT 'line', count(*), count(DISTINCT l_orderkey) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
    UNION ALL SELECT 'number', count(*), count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""",
)
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their lines as blank nodes, in two graphs with other labels: the merged graph is that of one."""
    blank = lambda source, *x: F.concat(F.lit(f"_:{source}"), *x)
    none, o = F.lit(None).cast("string"), _read(spark, d, "orders")
    # labels that stand next to each other are shuffled as few bytes; two numbers in a shuffle are many times their bytes in memory
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").repartition(tasks, "l_orderkey").distinct().sortWithinPartitions("l_orderkey")

    def copy(source: str, order, line) -> DataFrame:
        row = lambda s, p, x, kind: (F.lit(source).alias("source"), s.alias("s"), F.lit("blank").alias("s_kind"), F.lit(p).alias("p"), x.cast("string").alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_lang"), none.alias("o_dtype"))
        at = line(F.col("l_orderkey"), F.col("l_linenumber"))
        return o.select(*row(order(F.col("o_orderkey")), "total", F.col("o_orderkey"), "literal")).unionByName(li.select(*row(order(F.col("l_orderkey")), "line", at, "blank"))).unionByName(li.select(*row(at, "number", F.col("l_linenumber"), "literal")))

    one = copy("one", lambda k: blank("o", k), lambda k, n: blank("l", k, F.lit("_"), n))
    two = copy("two", lambda k: blank("l", k), lambda k, n: blank("o", n, F.lit("_"), k))
    # every subject is a blank node, whose label is two numbers in hex
    node = F.unhex(F.substring("s", 3, 32))
    return rdf.merged(one.unionByName(two)).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct(node).alias("subjects"))


# -- explanations ----------------------------------------------------------------------------------------------------


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports with two explanations, with one of the empty class, with none, and null."""
    k = F.col("p_partkey")
    two = F.concat(
        F.lit("preface\n## [Part "), k, F.lit("](http://x.org/"), k, F.lit(") SubClassOf [Nothing](n) ##\n\n  - [a](http://x.org/a) Type [Part](http://x.org/P)\n  - [b](http://x.org/b) Type [Part](http://x.org/P)\n"),
        F.lit("  - [a](http://x.org/a) Type [Brand](http://x.org/B)\n\n## [Brand](http://x.org/B) ##\nby [size](http://x.org/s)\n# Axiom Impact\n## [After](http://x.org/end) ##\nno\n"),
    )
    text = F.when(k % 4 == 0, two).when(k % 4 == 1, f"## [owl:Nothing]({OWL}Nothing) ##\n[x](http://x.org/x) SubClassOf [y](http://x.org/y)").when(k % 4 == 2, "No explanations found.")
    return _read(spark, d, "part").select(k.alias("report"), text.alias("md"))


_WHY = "'- a Type Part' || chr(10) || '  - b Type Part' || chr(10) || '  - a Type Brand'"
_UNSAT = f"""SELECT p_partkey AS report, CAST(0 AS INTEGER) AS ord, 'http://x.org/' || p_partkey AS iri, 'Part ' || p_partkey AS label, {_WHY} AS explanation FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 1, 'http://x.org/B', 'Brand', 'by size' FROM part WHERE p_partkey % 4 = 0"""


@query("explained_unsatisfiable", _UNSAT)
def explained_unsatisfiable(spark: SparkSession, d: str) -> DataFrame:
    return explain.unsatisfiable(_reports(spark, d))


_INCON = f"""SELECT p_partkey AS report, CASE WHEN p_partkey % 4 = 0 THEN 'a, b' ELSE '' END AS involved, CASE WHEN p_partkey % 4 = 0 THEN {_WHY} ELSE 'x SubClassOf y' END AS explanation FROM part WHERE p_partkey % 4 < 2"""


@query("explained_inconsistent", _INCON)
def explained_inconsistent(spark: SparkSession, d: str) -> DataFrame:
    return explain.inconsistent(_reports(spark, d))


@query(
    "inconsistency_first",
    f"""SELECT report, 'inconsistent' AS kind, CAST(NULL AS VARCHAR) AS iri, CAST(NULL AS VARCHAR) AS label, explanation FROM ({_INCON}) WHERE report % 3 = 0
    UNION ALL SELECT report, 'unsatisfiable', iri, label, explanation FROM ({_UNSAT}) WHERE report % 3 <> 0""",
)
def inconsistency_first(spark: SparkSession, d: str) -> DataFrame:
    reports = _reports(spark, d)
    return explain.verdicts(reports.filter("report % 3 = 0"), reports)


# -- further rules and changes ---------------------------------------------------------------------------------------


@query("reflexive_materialize", "SELECT 'nation/' || n_nationkey AS s, 'near' AS p, 'nation/' || n_nationkey AS o FROM nation")
def reflexive_materialize(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.reflexive(reasoning.types_of(View(spark, d), "nation"), "near")


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Parts in none, one or both of two classes."""
    part, s = _read(spark, d, "part"), individual("part", "p_partkey").alias("s")
    return part.filter("p_partkey % 2 = 0").select(s, F.lit("Even").alias("c")).unionByName(part.filter("p_size > 25").select(s, F.lit("Big").alias("c")))


@query("intersection_membership", "SELECT 'part/' || p_partkey AS s, 'BigEven' AS c FROM part WHERE p_partkey % 2 = 0 AND p_size > 25")
def intersection_membership(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.intersections(_kinds(spark, d), reasoning.small(spark, [("BigEven", "Big"), ("BigEven", "Even"), ("Never", "Big"), ("Never", "None")], "whole string, c string"))


@query("union_membership", "SELECT 'part/' || p_partkey AS s, 'Either' AS c FROM part WHERE p_partkey % 2 = 0 OR p_size > 25")
def union_membership(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.unions(_kinds(spark, d), reasoning.small(spark, [("Either", "Big"), ("Either", "Even")], "whole string, c string"))


@query(
    "existential_witness",
    """SELECT 'customer/' || c_custkey AS s, 'placed' AS p, 'customer/' || c_custkey || '#placed:Order' AS o, 'Order' AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def existential_witness(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an order of the class need no witness; those with other orders, or none, do."""
    view = View(spark, d)
    ordered = _read(spark, d, "orders").filter("o_orderstatus = 'F'").select(individual("orders", "o_orderkey").alias("s"), F.lit("Order").alias("c"))
    types = reasoning.types_of(view, "customer").unionByName(ordered)
    placed = reasoning.invert(view, "o_custkey", "placed")
    return reasoning.exist(types, placed, reasoning.small(spark, [("customer", "placed", "Order")], "c string, p string, filler string"))


@query(
    "datatype_clash",
    """SELECT 'part/' || p_partkey AS s, 'size' AS p, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE CAST(-p_size AS VARCHAR) END AS o FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 5 = 1""",
)
def datatype_clash(spark: SparkSession, d: str) -> DataFrame:
    """Values that are no number, and numbers below the least that the range allows."""
    k = F.col("p_partkey")
    value = F.when(k % 5 == 0, F.col("p_brand")).when(k % 5 == 1, (-F.col("p_size")).cast("string")).otherwise(F.col("p_size").cast("string"))
    literals = _read(spark, d, "part").select(individual("part", "p_partkey").alias("s"), F.lit("size").alias("p"), value.alias("o"))
    return shapes.out_of_range(literals, {"size": shapes.Range(("decimal",), least=0), "other": shapes.Range(("dateTime", "dateTimeStamp"))})


@query("kv_get", "SELECT CASE WHEN (SELECT count(*) FROM region WHERE r_name = 'NOWHERE') > 0 THEN '' END AS unbound, (SELECT CAST(r_regionkey AS VARCHAR) FROM region WHERE r_name = 'ASIA') AS bound")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    settings = _read(spark, d, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    get = lambda key, name: catalog.value_of(settings, key).select(F.lit(0).alias("at"), F.col("value").alias(name))
    return get("NOWHERE", "unbound").join(get("ASIA", "bound"), "at").drop("at")


@query("insert_rows", "SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS empty_lists, count(*) FILTER (WHERE p_partkey % 2 = 0) AS lists, true AS stamped FROM part")
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("functional"))).otherwise(F.array().cast("array<string>")).alias("features"))
    table = spark.createDataFrame([], "id string, name string, features array<string>, created_at timestamp, modified_at timestamp")
    return catalog.insert(table, rows).agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.size("features") == 0).alias("empty_lists"), F.count("features").alias("lists"),
        F.bool_and((F.length("id") == 36) & (F.col("created_at") == F.col("modified_at"))).alias("stamped"),
    )


# -- names and literals ----------------------------------------------------------------------------------------------


@query("iri_local_name", "SELECT page_id, regexp_extract(url, '[^/#]*$') AS name FROM pages")
def iri_local_name(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", iri.local_name(F.col("url")).alias("name"))


@query("iri_shorten", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ex:p' || p_partkey ELSE '<http://x.org/' || p_partkey || '>' END AS name FROM part")
def iri_shorten(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.lit("http://x.org/"), F.when(F.col("p_partkey") % 2 == 0, "p").otherwise(""), "p_partkey")
    return _read(spark, d, "part").select("p_partkey", iri.shortened(full, {"ex": "http://x.org/"}).alias("name"))


@query("curie_expand", "SELECT p_partkey, 'http://x.org/p' || p_partkey AS iri FROM part")
def curie_expand(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "part").select("p_partkey", iri.expanded(F.concat(F.lit("ex:p"), "p_partkey"), {"ex": "http://x.org/"}).alias("iri"))


@query("escape_literal", r"""SELECT conv_id, turn, replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') AS text FROM conversations""")
def escape_literal(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "conversations").select("conv_id", "turn", iri.escaped(F.col("text")).alias("text"))


@query("named_groups", "SELECT n_nationkey, 'year,n' || n_nationkey AS groups FROM nation")
def named_groups(spark: SparkSession, d: str) -> DataFrame:
    regex = F.concat(F.lit(r"(?<year>\d{4})-(?<n"), "n_nationkey", F.lit(">[a-z]+)"))
    return _read(spark, d, "nation").select("n_nationkey", F.array_join(iri.group_names(regex), ",").alias("groups"))


@query("regex_extract", "SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS number FROM pages")
def regex_extract(spark: SparkSession, d: str) -> DataFrame:
    value = lambda k: F.regexp_extract("url", "/(?<lang>[a-z]{2})/(?<number>[0-9]+)", k)
    return _read(spark, d, "pages").select("page_id", value(1).alias("lang"), value(2).alias("number"))


@query("version_compare", "SELECT p_partkey, CAST(CASE WHEN p_size = 7 THEN NULL WHEN p_size = 8 THEN 1 ELSE sign(p_size - 12) END AS INTEGER) AS cmp FROM part")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    version = F.when(F.col("p_size") == 7, "draft").when(F.col("p_size") == 8, "000.20260101123456789012345678901234567890").otherwise(F.concat(F.lit("0."), "p_size", F.lit(".0")))
    return _read(spark, d, "part").select("p_partkey", iri.version_order(version, F.lit("0_12")).alias("cmp"))


@query("base_uri_normalize", "SELECT page_id, CASE WHEN right(url, 1) IN ('/', '#') THEN url ELSE url || '/' END AS base FROM pages")
def base_uri_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", iri.base_uri(F.col("url")).alias("base"))


@query("markdown_strip", "SELECT page_id, 'see page ' || page_id || ' now' AS text, 'page ' || page_id AS label, url AS iri FROM pages")
def markdown_strip(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see [page "), "page_id", F.lit("]("), "url", F.lit(") now"))
    label, link = iri.first_link(text)
    return _read(spark, d, "pages").select("page_id", iri.strip_links(text).alias("text"), label.alias("label"), link.alias("iri"))


@query("sha256_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_digest(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# -- rules of rows -----------------------------------------------------------------------------------------------------

#: Texts, a type, and whether they are one of its values.
_FORMS = [
    ("1.5", "integer", False), ("1e3", "integer", False), ("+007", "integer", True), ("1234567890123456789012345678901234567890", "integer", True), (" 1", "integer", False), ("", "integer", False),
    ("1.", "decimal", True), (".5", "decimal", True), (".", "decimal", False), ("1e3", "decimal", False), ("TRUE", "boolean", False), ("1", "boolean", True), ("anything", "string", True),
    ("2020", "date", False), ("2020-1-1", "date", False), ("2020-02-30", "date", False), ("2020-02-29", "date", True), ("2100-02-29", "date", False), ("12000-02-29", "date", True), ("-0004-02-29", "date", True), ("2020-01-01Z", "date", True),
    ("2020-01-01+14:00", "date", True), ("2020-01-01+14:30", "date", False), ("2020-01-01", "dateTime", False), ("2020-01-01T24:00:00", "dateTime", True), ("2020-01-01T25:00:00", "dateTime", False),
    ("2020-01-01T10:00:00.123456789012", "dateTime", True), ("2020-01-01T10:00:00", "dateTimeStamp", False), ("2020-01-01T10:00:00-05:00", "dateTimeStamp", True),
    ("1.0f", "float", False), ("1.0d", "double", False), ("Infinity", "float", False), ("INF", "float", True), ("-INF", "double", True), ("NaN", "float", True), ("1e400", "double", True), ("1e", "double", False),
]


@query("lexical_forms", f"SELECT o_orderkey, v.col2 AS valid FROM orders JOIN (VALUES {', '.join(f'({k}, {str(ok).lower()})' for k, (_, _, ok) in enumerate(_FORMS))}) v(col1, col2) ON o_orderkey % {len(_FORMS)} = v.col1")
def lexical_forms(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("o_orderkey") % len(_FORMS)).cast("int")
    pick = lambda k: F.get(F.array(*(F.lit(f[k]) for f in _FORMS)), at)
    kind = pick(1)
    valid = F.coalesce(*(F.when(kind == t, shapes.lexical(pick(0), t)) for t in dict.fromkeys(f[1] for f in _FORMS)))
    return _read(spark, d, "orders").select("o_orderkey", valid.alias("valid"))


@query("class_children", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size % 10 = 3")
def class_children(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("m"), F.col("p_size") % 10).alias("schema_id"))
    return catalog.children(rows, "m3").select("id", "name")


@query("schema_delete", "SELECT 'c' || n_nationkey AS id FROM nation WHERE n_regionkey <> 2")
def schema_delete(spark: SparkSession, d: str) -> DataFrame:
    schemas, classes, properties = _models(spark, d)
    return catalog.delete_schema(schemas, classes, properties, "m2")[1].select("id")


@query("class_delete", "SELECT 'c' || n_nationkey AS id, CASE WHEN n_nationkey >= 5 AND n_nationkey <> 6 THEN 'c' || n_nationkey - 5 END AS above FROM nation WHERE n_nationkey <> 1")
def class_delete(spark: SparkSession, d: str) -> DataFrame:
    """A class goes; the one below it has no parent then."""
    _, classes, properties = _models(spark, d)
    return catalog.delete_class(classes, properties, "c1")[0].select("id", F.col("super_class_id").alias("above"))


@query("schema_patch", "SELECT 'm' || r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'New' ELSE 'Model  of ' || r_name END AS title, CASE WHEN r_regionkey = 1 THEN 'http://new.org/' ELSE 'http://x.org' END AS base_uri, r_regionkey = 1 AS moved FROM region")
def schema_patch(spark: SparkSession, d: str) -> DataFrame:
    then = F.to_timestamp(F.lit("2020-01-01"))
    out = catalog.patch_schema(_models(spark, d)[0].withColumn("modified_at", then), "m1", {"title": "New", "base_uri": "http://new.org"})
    return out.select("id", "title", "base_uri", (F.col("modified_at") > then).alias("moved"))


@query(
    "row_errors",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'title: required' END, CASE WHEN p_partkey % 3 = 0 THEN 'upper_ontology_iri: no URL' END], lambda x: x IS NOT NULL), ', ') AS of_schema,
      array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'name: no white space' END, CASE WHEN p_partkey % 3 = 0 THEN 'maps_to_concept_iri: no URL' END], lambda x: x IS NOT NULL), ', ') AS of_class,
      array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'name: no white space' END, CASE WHEN p_partkey % 7 = 0 THEN 'property_type: object or datatype' END, CASE WHEN p_partkey % 4 = 0 THEN 'domain_class_id: required' END,
        CASE WHEN p_partkey % 11 = 0 THEN 'mapping_pattern: incomplete template' END, CASE WHEN p_partkey % 13 = 0 THEN 'property_features: unknown' END], lambda x: x IS NOT NULL), ', ') AS of_property FROM part""",
)
def row_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all three kinds with what is wrong with them."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    name, url = F.when(k % 5 == 0, "a b").otherwise("ab"), F.when(k % 3 == 0, "no url").when(k % 3 == 1, "urn:x:y").otherwise("")
    template = F.array(F.struct(F.lit("?this").alias("subject"), F.when(k % 11 == 0, none).otherwise("").alias("predicate"), F.lit("?value").alias("object")))
    features = F.when(k % 13 == 0, F.array(F.lit("functional"), F.lit("odd"))).when(k % 13 == 1, F.array(F.lit("symmetric")))
    kind = F.when(k % 7 == 0, "other").when(k % 7 == 1, none).otherwise("object")
    some = F.when(k % 8 == 0, none).when(k % 8 == 4, "").otherwise("x")
    joined = lambda c: F.array_join(c, ", ")
    return _read(spark, d, "part").select(
        "p_partkey", joined(catalog.schema_errors(some, url, none)).alias("of_schema"), joined(catalog.class_errors(name, url)).alias("of_class"),
        joined(catalog.property_errors(name, kind, some, template, features)).alias("of_property"),
    )


@query("model_summary", f"{_MODEL} SELECT schema_id, (SELECT count(*) FROM cls c WHERE c.schema_id = s.schema_id) AS classes, count(*) AS properties, count(*) FILTER (WHERE k % 2 = 0) AS mapped, true AS any_mapping FROM prop s GROUP BY schema_id")
def model_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.summary(*_models(spark, d)[1:])


@query("newer_version", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 20 > 9 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') > '1995-06-01' ELSE false END AS newer FROM orders")
def newer_version(spark: SparkSession, d: str) -> DataFrame:
    """By versions, by dates where a version is none, and not where neither tells."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    version = F.when(k % 3 == 0, F.concat(F.lit("1."), k % 20)).when(k % 3 == 1, "draft")
    day = F.when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(none)
    return _read(spark, d, "orders").select("o_orderkey", iri.is_newer(version, day, F.lit("1.9"), F.lit("1995-06-01")).alias("newer"))


@query("upper_prefixes", "SELECT page_id, lower(regexp_extract(regexp_replace(url, '[/#]+$', ''), '[^/#]*$')) AS prefix FROM pages")
def upper_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", iri.upper_prefix(F.col("url")).alias("prefix"))


@query("file_names", "SELECT r_regionkey, 'Model_of_' || replace(r_name, ' ', '_') || '.ttl' AS file FROM region")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d)[0].select(F.substring("id", 2, 9).cast("long").alias("r_regionkey"), exports.file_name(F.col("title"), ".ttl").alias("file"))


# -- exports ---------------------------------------------------------------------------------------------------------


def _models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The models of regions with all that their texts tell; every second one has an upper ontology."""
    classes, properties = _model(spark, d)
    region, k, none = _read(spark, d, "region"), F.col("ord"), F.lit(None).cast("string")
    schema = F.concat(F.lit("m"), "r_regionkey")
    schemas = region.select(
        schema.alias("id"), F.concat(F.lit("http://x.org/model/"), schema, F.lit("/")).alias("url"), F.concat(F.lit("Model  of "), "r_name").alias("title"), F.when(F.col("r_regionkey") % 2 == 1, 'A "model"').alias("description"),
        F.lit("http://x.org").alias("base_uri"), F.when(F.col("r_regionkey") % 2 == 0, "http://up.org").alias("upper_ontology_iri"),
    )
    text = lambda *x: F.array(*map(F.lit, x))
    properties = properties.withColumns({
        "label": F.when(k % 5 == 0, F.concat(F.lit("No "), k)), "description": none, "property_type": F.when(k % 3 == 0, "datatype").otherwise("object"), "is_required": k % 2 == 1,
        "features": F.when(k % 4 == 1, text("functional", "unheard of", "transitive")), "inverse": F.when(k % 7 == 0, "back"), "disjoint": F.when(k % 11 == 0, text("http://x.org/q", "r")),
    })
    return schemas, classes, properties


_TEXTS = f"""{_MODEL}, s AS (SELECT 'm' || r_regionkey AS schema_id, r_regionkey % 2 = 0 AS upper, r_name AS title, CASE WHEN r_regionkey % 2 = 0 THEN 'up.org:' ELSE '<http://up.org/' END AS o, CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE '>' END AS e FROM region),
  c AS (SELECT *, CASE WHEN k % 3 = 0 THEN '<http://up.org/Place>' ELSE ':' || name END AS ref FROM cls),
  rn AS (SELECT schema_id, name, domain, count(*) AS n, string_agg(ref, ' ' ORDER BY m) AS refs, list(ref ORDER BY m) AS each_ref FROM
    (SELECT p.schema_id, p.name, p.domain, c.id, any_value(c.ref) AS ref, min(p.k) AS m FROM prop p JOIN c ON c.url = p.range AND c.schema_id = p.schema_id GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
  g AS (SELECT p.*, coalesce(n, 0) AS n, refs, each_ref, p.k % 2 = 0 AS mapped, p.k % 3 <> 0 AS object, dc.name AS dname, dc.ref AS dref, coalesce(tc.ref, ':c' || p.k % 7 * 2) AS through,
      CASE WHEN range = 'xsd' THEN 'xsd:string' ELSE coalesce(ec.ref, ':' || replace(range, 'http://x.org/', '')) END AS end
    FROM (SELECT schema_id, name, domain, min(k) AS k FROM prop GROUP BY 1, 2, 3) JOIN prop p USING (schema_id, name, domain, k) LEFT JOIN rn USING (schema_id, name, domain)
    JOIN c dc ON dc.id = p.domain AND dc.schema_id = p.schema_id LEFT JOIN c tc ON tc.id = 'c' || p.k % 7 * 2 AND tc.schema_id = p.schema_id LEFT JOIN c ec ON ec.url = p.range AND ec.schema_id = p.schema_id)"""
_NUMBERED = "SELECT schema_id, CAST(unnest(range(len(t))) AS INTEGER) AS ord, unnest(t) AS value FROM (SELECT schema_id, string_split(string_agg(text, chr(10) ORDER BY part, k), chr(10)) AS t FROM {parts} GROUP BY schema_id)"


def _ontology_sql(owl: bool) -> str:
    nl, name = "' ;' || chr(10) || '    ", lambda side: f"'<http://x.org/' || dname || '_' || name || '_{side}>'"
    some = lambda p, x, inverse: f"'[ a owl:Restriction ; owl:onProperty {'[ owl:inverseOf ' if inverse else ''}' || o || '{p}' || e || '{' ]' if inverse else ''} ; owl:someValuesFrom ' || {x} || ' ]'"
    both = lambda x, y: f"'[ a owl:Class ; owl:intersectionOf ( ' || {x} || ' ' || {y} || ' ) ]'"
    ahead = both("dref", some("has", both("through", some("of", 'coalesce("end", dref)', False)), False))
    back = both('"end"', some("of", both("through", some("has", "dref", True)), True))
    patterned, prefix = ("mapped", "'@prefix owl: <http://www.w3.org/2002/07/owl#> .' || chr(10) ||") if owl else ("false", "")
    domain = f"CASE WHEN {patterned} THEN {name('domain')} ELSE ':' || dname END"
    single = f"CASE WHEN {patterned} AND object AND range IS NOT NULL THEN {name('range')} ELSE refs END"
    kind = "CASE WHEN object THEN 'owl:ObjectProperty' ELSE 'owl:DatatypeProperty' END" if owl else "'rdfs:Property'"
    anchored = f"""UNION ALL SELECT schema_id, 4, k, text || {name('domain')} || chr(10) || '    owl:equivalentClass ' || {ahead} || ' .' || chr(10)
      || CASE WHEN object AND n = 1 AND range IS NOT NULL THEN chr(10) || {name('range')} || chr(10) || '    owl:equivalentClass ' || {back} || ' .' || chr(10) ELSE '' END
    FROM (SELECT *, CASE WHEN k = min(k) OVER (PARTITION BY schema_id) THEN '{exports.ANCHORS_HEADING}' || chr(10) || chr(10) ELSE '' END AS text FROM g WHERE mapped) JOIN s USING (schema_id)"""
    parts = f"""(SELECT schema_id, 0 AS part, 0 AS k, '@prefix : <http://x.org/> .' || chr(10) || '@prefix xsd: <{XSD}> .' || chr(10) || '@prefix rdfs: <{RDFS}> .' || chr(10) || {prefix} '@prefix dct: <http://purl.org/dc/terms/> .'
        || CASE WHEN upper THEN chr(10) || '@prefix up.org: <http://up.org/> .' ELSE '' END || chr(10) AS text FROM s
      UNION ALL SELECT schema_id, 1, 0, '<http://x.org/model/' || schema_id || '>' || chr(10) || '    {"a owl:Ontology ;' || chr(10) || '    " if owl else ""}dct:title "Model  of ' || title || '"'
        || CASE WHEN NOT upper THEN {nl}dct:description "A \\"model\\""' {"" if owl else "ELSE " + nl + "rdfs:seeAlso <http://up.org>'"} {"ELSE ''" if owl else ""} END || ' .' || chr(10) FROM s
      UNION ALL SELECT a.schema_id, 2, a.k, CASE WHEN a.k = min(a.k) OVER (PARTITION BY a.schema_id) THEN '{exports.CLASSES_HEADING}' || chr(10) || chr(10) ELSE '' END || a.ref || chr(10) || '    a {"owl" if owl else "rdfs"}:Class'
        || coalesce({nl}rdfs:label "' || replace(a.label, '"', '\\"') || '"', '') || coalesce({nl}rdfs:subClassOf ' || b.ref, '')
        || {"CASE WHEN a.k % 3 = 0 THEN " + nl + "rdfs:subClassOf ' || o || 'Place' || e ELSE '' END" if owl else "''"} || ' .' || chr(10) FROM c a JOIN s USING (schema_id) LEFT JOIN c b ON b.id = a.up AND b.schema_id = a.schema_id
      UNION ALL SELECT schema_id, 3, k, CASE WHEN k = min(k) OVER (PARTITION BY schema_id) THEN '{exports.PROPERTIES_HEADING}' || chr(10) || chr(10) ELSE '' END || ':' || name || chr(10) || '    a ' || {kind}
        || CASE WHEN k % 4 = 1 THEN ', owl:FunctionalProperty, owl:TransitiveProperty' ELSE '' END || CASE WHEN k % 5 = 0 THEN {nl}rdfs:label "No ' || k || '"' ELSE '' END || CASE WHEN k % 7 = 0 THEN {nl}owl:inverseOf :back' ELSE '' END
        || CASE WHEN k % 11 = 0 THEN {nl}owl:propertyDisjointWith :q' || {nl}owl:propertyDisjointWith :r' ELSE '' END || {nl}rdfs:domain ' || {domain}
        || coalesce({nl}rdfs:range ' || CASE WHEN n > 1 THEN '[ owl:unionOf (' || refs || ') ]' WHEN n = 1 THEN {single} ELSE "end" END, '') || ' .' || chr(10) FROM g
      {anchored if owl else ""})"""
    return f"{_TEXTS} " + _NUMBERED.format(parts=parts)


_SHACL_SQL = f"""{_TEXTS}, shape AS (SELECT schema_id, domain, string_agg('    sh:property [' || chr(10) || '        sh:path :' || name || ' ;' || chr(10) || CASE WHEN k % 5 = 0 THEN '        sh:name "No ' || k || '" ;' || chr(10) ELSE '' END
    || CASE WHEN object AND n > 1 THEN '        sh:or (' || chr(10) || array_to_string(list_transform(each_ref, lambda r: '            [ sh:class ' || r || ' ]' || chr(10)), '') || '        ) ;' || chr(10)
        WHEN object THEN coalesce('        sh:class ' || CASE WHEN n = 1 THEN refs ELSE "end" END || ' ;' || chr(10), '') ELSE '        sh:datatype xsd:string ;' || chr(10) END
    || '        sh:minCount ' || k % 2 || ' ;' || chr(10) || '    ]', ' ;' || chr(10) ORDER BY k) || ' .' AS shapes FROM g GROUP BY 1, 2)
""" + _NUMBERED.format(parts=f"""(SELECT schema_id, 0 AS part, 0 AS k, '@prefix : <http://x.org/> .' || chr(10) || '@prefix sh: <{SH}> .' || chr(10) || '@prefix owl: <{OWL}> .' || chr(10) || '@prefix rdfs: <{RDFS}> .' || chr(10) || '@prefix xsd: <{XSD}> .' || chr(10) AS text FROM s
  UNION ALL SELECT a.schema_id, 1, a.k, ':' || a.name || 'Shape' || chr(10) || '    a sh:NodeShape, owl:Class ;' || chr(10) || '    sh:targetClass ' || a.ref || coalesce(' ;' || chr(10) || '    rdfs:subClassOf ' || b.ref, '')
    || coalesce(' ;' || chr(10) || '    rdfs:label "' || replace(a.label, '"', '\\"') || '"', '') || coalesce(' ;' || chr(10) || shapes, ' .') || chr(10)
  FROM c a LEFT JOIN c b ON b.id = a.up AND b.schema_id = a.schema_id LEFT JOIN shape x ON x.domain = a.id AND x.schema_id = a.schema_id)""")

_MERMAID_SQL = f"{_TEXTS} " + _NUMBERED.format(parts="""(SELECT schema_id, 0 AS part, 0 AS k, 'classDiagram' AS text FROM s
  UNION ALL SELECT a.schema_id, 1, a.k, '  class ' || a.name || ' {' || chr(10) || coalesce(m, '') || '  }' FROM c a LEFT JOIN (SELECT p.schema_id, domain,
      string_agg('    +' || p.name || '() ' || CASE WHEN range = 'xsd' THEN 'string' ELSE coalesce(c.name, replace(range, 'http://x.org/', ''), 'Any') END || chr(10), '' ORDER BY p.k) AS m
    FROM prop p LEFT JOIN c ON c.url = range AND c.schema_id = p.schema_id GROUP BY 1, 2) x ON domain = a.id AND x.schema_id = a.schema_id
  UNION ALL SELECT schema_id, 2, 0, '' FROM s
  UNION ALL SELECT a.schema_id, 3, a.k, '  ' || b.name || ' <|-- ' || a.name FROM c a JOIN c b ON b.id = a.up AND b.schema_id = a.schema_id
  UNION ALL SELECT p.schema_id, 4, p.k, '  ' || a.name || ' --> ' || b.name || ' : ' || p.name FROM prop p JOIN c a ON a.id = p.domain AND a.schema_id = p.schema_id JOIN c b ON b.url = p.range AND b.schema_id = p.schema_id)""")


@query("export_rdfs", _ontology_sql(owl=False))
def export_rdfs(spark: SparkSession, d: str) -> DataFrame:
    return exports.ontologies(*_models(spark, d), owl=False)


@query("export_owl", _ontology_sql(owl=True))
def export_owl(spark: SparkSession, d: str) -> DataFrame:
    return exports.ontologies(*_models(spark, d), owl=True)


@query("export_shacl", _SHACL_SQL)
def export_shacl(spark: SparkSession, d: str) -> DataFrame:
    return exports.shacl(*_models(spark, d))


@query("export_mermaid", _MERMAID_SQL)
def export_mermaid(spark: SparkSession, d: str) -> DataFrame:
    return exports.mermaid(*_models(spark, d))


@query("uml_graph", f"{_MODEL} SELECT schema_id, id, name, CAST(n % 5 * 260 AS INTEGER) AS x, CAST(n // 5 * 220 AS INTEGER) AS y FROM (SELECT *, row_number() OVER (PARTITION BY schema_id ORDER BY k) - 1 AS n FROM cls)")
def uml_graph(spark: SparkSession, d: str) -> DataFrame:
    return exports.diagram_nodes(_models(spark, d)[1])


@query("canonical_names", f"{_TEXTS} SELECT schema_id, url, ref FROM c")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return exports.references(_models(spark, d)[1]).select("schema_id", "url", "ref")


# -- shapes of many models -------------------------------------------------------------------------------------------


@query(
    "shape_table_report",
    """WITH sh AS (SELECT DISTINCT 'S' || s_nationkey AS shape, s_nationkey AS target, s_suppkey % 3 AS p, s_suppkey % 2 AS least, s_suppkey % 5 AS c FROM supplier),
    t AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 4 AS way FROM customer), top AS (SELECT max(c_custkey) AS m FROM customer),
    v AS (SELECT k, 0 AS p, CASE WHEN way = 0 THEN k || '.5' ELSE '-' || k END AS value, NULL AS o FROM t WHERE way < 3 UNION ALL SELECT k, 1, 'customer/' || (k + 1), k + 1 FROM t UNION ALL SELECT k, 2, 'customer/' || (k * 3), k * 3 FROM t WHERE way > 0),
    a AS (SELECT 'customer/' || k AS focus, k, sh.* FROM t JOIN sh ON target = n)
    SELECT focus, 'p' || p AS path, 'minCount' AS kind, NULL AS value, shape FROM a WHERE least > 0 AND NOT EXISTS (SELECT 1 FROM v WHERE v.k = a.k AND v.p = a.p)
    UNION SELECT focus, 'p0', 'datatype', value, shape FROM a JOIN v USING (k, p) WHERE p = 0 AND value LIKE '%.5'
    UNION SELECT focus, 'p' || a.p, CASE a.p WHEN 1 THEN 'or' ELSE 'class' END, value, shape FROM a JOIN v ON v.k = a.k AND v.p = a.p LEFT JOIN t x ON x.k = v.o
      WHERE a.p > 0 AND NOT coalesce(x.n = a.c OR a.p = 1 AND x.n = a.c + 5, false)""",
)
def shape_table_report(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as rows of the shapes of nations, which customers of a nation must meet."""
    c, k = _read(spark, d, "customer"), F.col("c_custkey")
    me, node = individual("customer", "c_custkey"), lambda x: F.concat(F.lit("c"), x)
    way = k % 4
    values = F.array(
        F.struct(F.lit("p0").alias("p"), F.when(way == 0, F.concat(k, F.lit(".5"))).when(way < 3, F.concat(F.lit("-"), k)).alias("o")),
        F.struct(F.lit("p1").alias("p"), individual("customer", k + 1).alias("o")), F.struct(F.lit("p2").alias("p"), F.when(way > 0, individual("customer", k * 3)).alias("o")),
    )
    facts = c.select(me.alias("s"), F.explode(values).alias("v")).select("s", "v.p", "v.o")
    x, p = F.col("s_suppkey"), F.col("s_suppkey") % 3
    table = _read(spark, d, "supplier").select(
        F.concat(F.lit("S"), "s_nationkey").alias("shape"), node(F.col("s_nationkey")).alias("target"), F.concat(F.lit("p"), p).alias("path"), (x % 2).cast("int").alias("least"),
        F.when(p == 0, "integer").alias("datatype"), F.when(p == 1, F.array(node(x % 5), node(x % 5 + 5))).when(p == 2, F.array(node(x % 5))).alias("classes"),
    )
    return shapes.report(facts, c.select(me.alias("s"), node(F.col("c_nationkey")).alias("c")), table)


@query(
    "model_shape_rows",
    f"""{_TEXTS}, r AS (SELECT p.schema_id, p.name, p.domain, string_agg(DISTINCT c.url, ' ' ORDER BY c.url) AS urls FROM prop p JOIN c ON c.url = p.range AND c.schema_id = p.schema_id WHERE p.k % 3 <> 0 GROUP BY 1, 2, 3)
    SELECT dname || 'Shape' AS shape, g.name AS path, CAST(k % 2 AS INTEGER) AS least, CASE WHEN NOT object THEN 'string' END AS datatype, urls AS classes FROM g LEFT JOIN r ON r.schema_id = g.schema_id AND r.name = g.name AND r.domain = g.domain""",
)
def model_shape_rows(spark: SparkSession, d: str) -> DataFrame:
    return shapes.model_shapes(*_models(spark, d)[1:]).select("shape", "path", "least", "datatype", F.array_join("classes", " ").alias("classes"))
