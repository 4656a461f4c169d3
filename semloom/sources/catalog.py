"""The metamodel catalog: reads, changes with referential actions, and validation, as functions from DataFrames to
DataFrames. Nothing is changed in place; what a function returns is the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.functions.iri import FEATURES, base_uri
from semloom.model import TEMPLATE


class NotFound(LookupError):
    """No row has the id."""


def by_id(table: DataFrame, id_: str) -> DataFrame:
    found = table.filter(F.col("id") == id_)
    if found.isEmpty():
        raise NotFound(id_)
    return found


def value_of(table: DataFrame, key: str) -> DataFrame:
    """One row (value) of a table (key, value): null where the key isn't bound."""
    return table.filter(F.col("key") == key).agg(F.first("value").alias("value"))


def listed(table: DataFrame, *order: str) -> DataFrame:
    """In binary order, upper case before lower case; ids break ties."""
    return table.orderBy(*order, "id")


def children(table: DataFrame, schema_id: str) -> DataFrame:
    return listed(table.filter(F.col("schema_id") == schema_id), "name")


def nested(parents: DataFrame, kids: DataFrame, key: str, parent: str, fields: list[str], name: str) -> DataFrame:
    """parents with an array of their kids' fields, ordered by the fields; empty where there are none."""
    many = kids.groupBy(F.col(parent).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(many, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.array().cast(many.schema[name].dataType)))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """For each key its last change by order, else its row of the table: a change counts, however old the order says it is."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_new").desc(), F.col(order).desc()))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_new")


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows added, each under a new id and stamped with the time; empty lists become null, columns that a row
    lacks are null. Ids are random: write the result before it is read twice."""
    lists = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
    new = rows.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in lists} | {"id": F.expr("uuid()"), "created_at": F.current_timestamp(), "modified_at": F.current_timestamp()})
    return table.unionByName(new, allowMissingColumns=True)


def patch(table: DataFrame, id_: str, values: dict[str, object], clearable: bool = True) -> DataFrame:
    """The row's given fields changed; an empty string clears a field where that is allowed. An unknown id changes nothing."""
    out = table
    for name, value in values.items():
        new = F.lit(None if value == "" and clearable else value).cast(table.schema[name].dataType)
        out = out.withColumn(name, F.when(F.col("id") == id_, new).otherwise(F.col(name)))
    return out


def patch_schema(schemas: DataFrame, id_: str, values: dict[str, object]) -> DataFrame:
    """A model's row changed and stamped with the time: whatever is given of title, description, upper_ontology_iri and
    base_uri, which gets / at its end where it has neither / nor #."""
    given = {k: base_uri(F.lit(v)) if k == "base_uri" and v is not None else F.lit(v) for k, v in values.items() if k in ("title", "description", "upper_ontology_iri", "base_uri")}
    mine = F.col("id") == id_
    return schemas.withColumns({k: F.when(mine, v.cast("string")).otherwise(F.col(k)) for k, v in given.items()} | {"modified_at": F.when(mine, F.current_timestamp()).otherwise(F.col("modified_at"))})


def delete(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key is not among gone (key)."""
    return table.join(gone.select(F.col(gone.columns[0]).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


cascade = delete


def set_null(table: DataFrame, reference: str, gone: DataFrame) -> DataFrame:
    """References to what is gone become null, their rows stay."""
    marks = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    out = table.join(marks, F.col(reference) == F.col("_gone"), "left")
    return out.withColumn(reference, F.when(F.col("_hit"), None).otherwise(F.col(reference))).drop("_gone", "_hit")


def delete_schema(schemas: DataFrame, classes: DataFrame, properties: DataFrame, id_: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return schemas.filter(F.col("id") != id_), *(t.filter(F.col("schema_id") != id_) for t in (classes, properties))


def delete_class(classes: DataFrame, properties: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """Subclasses lose their parent and properties their domain; range texts stay as they are."""
    none = lambda t, c: t.withColumn(c, F.when(F.col(c) == id_, None).otherwise(F.col(c)))
    return none(classes.filter(F.col("id") != id_), "super_class_id"), none(properties, "domain_class_id")


def json_array(text: Column, element: str = "string") -> Column:
    """A JSON array; null and malformed text give an empty one."""
    kind = f"array<{element}>"
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def errors(title: Column, name: Column, kind: Column) -> Column:
    """What is wrong with a row: an array, empty where all is right."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.length(title), F.lit(0)) < 1, "title: required"),
            F.when(~F.coalesce(name.rlike(r"^\S+$"), F.lit(False)), "name: no white space"),
            F.when(~F.coalesce(kind.isin("object", "datatype"), F.lit(False)), "property_type: object or datatype"),
        )
    )


#: A URL: a scheme and something after it, without white space.
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"


def _problems(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), text) for holds, text in rules)))


def _url(value: Column) -> Column:
    """Nothing, or a URL."""
    return value.isNull() | (value == "") | value.rlike(_URL)


def _word(name: Column) -> Column:
    return name.rlike(r"^\S+$")


def schema_errors(title: Column, upper_ontology_iri: Column, base_uri: Column) -> Column:
    """What is wrong with a model's row: an array, empty where all is right."""
    return _problems((F.length(title) > 0, "title: required"), (_url(upper_ontology_iri), "upper_ontology_iri: no URL"), (_url(base_uri), "base_uri: no URL"))


def class_errors(name: Column, maps_to_concept_iri: Column) -> Column:
    return _problems((_word(name), "name: no white space"), (_url(maps_to_concept_iri), "maps_to_concept_iri: no URL"))


def property_errors(name: Column, kind: Column, domain_class_id: Column, pattern: Column, features: Column) -> Column:
    """A kind that is null counts as datatype; the templates of a pattern have a subject, a predicate and an object, which
    may be empty."""
    known = F.array(*map(F.lit, FEATURES))
    whole = pattern.isNull() | F.forall(pattern, lambda t: t["subject"].isNotNull() & t["predicate"].isNotNull() & t["object"].isNotNull())
    return _problems(
        (_word(name), "name: no white space"), (F.coalesce(kind, F.lit("datatype")).isin("object", "datatype"), "property_type: object or datatype"), (F.length(domain_class_id) > 0, "domain_class_id: required"),
        (whole, "mapping_pattern: incomplete template"), (features.isNull() | (F.size(F.array_except(features, known)) == 0), "property_features: unknown"),
    )


def summary(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(schema_id, classes, properties, mapped, any_mapping) of each model: how many there are, how many properties have a
    pattern, and whether any class is mapped to a concept or any property has a pattern."""
    c = classes.groupBy("schema_id").agg(F.count("*").alias("classes"), F.bool_or(F.coalesce(F.col("maps_to_concept_iri") != "", F.lit(False))).alias("_any"))
    p = properties.groupBy("schema_id").agg(F.count("*").alias("properties"), F.count_if(F.size("pattern") > 0).alias("mapped"))
    out = c.join(p, "schema_id", "full").na.fill(0, ["classes", "properties", "mapped"])
    return out.select("schema_id", "classes", "properties", "mapped", (F.coalesce("_any", F.lit(False)) | (F.col("mapped") > 0)).alias("any_mapping"))


def inherited(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(class_id, property_id) of the properties of the direct parent."""
    return classes.join(properties, classes["super_class_id"] == properties["domain_class_id"]).select(classes["id"].alias("class_id"), properties["id"].alias("property_id"))


def representative(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return table.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
