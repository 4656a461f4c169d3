"""Validation of an instance graph against shapes: rows (focus, path, kind, value, shape) for what breaks them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.model import XSD, XSD_TYPES
from semloom.operators.reasoning import propagate_types
from semloom.plans.abox import View, edges_of


@dataclass(frozen=True)
class Property:
    """What a shape asks of a path: a least count, one of several classes, or an XSD type."""

    path: str
    least: int = 0
    classes: tuple[str, ...] = ()
    datatype: str | None = None


@dataclass(frozen=True)
class Shape:
    target: str
    properties: tuple[Property, ...]


#: How XSD types are written. Types that aren't here take any text.
_SIGNED, _DIGITS = "[+-]?", r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_DAY, _ZONE = r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))"
_TIME = r"T(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
LEXICAL = {
    "boolean": "true|false|1|0", "integer": f"{_SIGNED}[0-9]+", "decimal": _SIGNED + _DIGITS,
    "float": f"{_SIGNED}{_DIGITS}(?:[eE]{_SIGNED}[0-9]+)?|[+-]?INF|NaN", "double": f"{_SIGNED}{_DIGITS}(?:[eE]{_SIGNED}[0-9]+)?|[+-]?INF|NaN",
    "date": f"{_DAY}{_ZONE}?", "dateTime": f"{_DAY}{_TIME}{_ZONE}?", "dateTimeStamp": _DAY + _TIME + _ZONE,
}


def lexical(value: Column, datatype: str) -> Column:
    """Whether a text is a value of an XSD type, as it is written: white space around it makes it none. Days must exist in
    the calendar, in any year; numbers may have any number of digits."""
    if datatype not in XSD_TYPES:
        raise ValueError(f"unknown type {datatype}")
    if datatype not in LEXICAL:
        return value.isNotNull()
    written = value.rlike(rf"\A(?:{LEXICAL[datatype]})\z")
    if not datatype.startswith("date"):
        return written
    # the calendar repeats after 400 years, and the last four digits tell the place within
    parts = [F.regexp_extract(value, r"\A(-?)[0-9]*?([0-9]{4})(-[0-9]{2}-[0-9]{2})", k) for k in (1, 2, 3)]
    year = F.pmod(F.when(parts[0] == "-", -parts[1].try_cast("int")).otherwise(parts[1].try_cast("int")), F.lit(400)) + 2000
    return written & F.concat(year.cast("string"), parts[2]).try_cast("date").isNotNull()


@dataclass(frozen=True)
class Range:
    """The XSD types of which a value must have one, and the least number that it may be."""

    datatypes: tuple[str, ...]
    least: float | None = None

    def holds(self, value: Column) -> Column:
        typed = reduce(lambda a, b: a | b, (lexical(value, t) for t in self.datatypes))
        return typed if self.least is None else typed & F.coalesce(value.try_cast("decimal(38,18)") >= self.least, value.try_cast("double") >= self.least, F.lit(False))


def out_of_range(literals: DataFrame, ranges: dict[str, Range]) -> DataFrame:
    """The literals (s, p, o) that the range of their property excludes; properties without one exclude nothing."""
    wrong = [(F.col("p") == p) & ~F.coalesce(r.holds(F.col("o")), F.lit(False)) for p, r in ranges.items()]
    return literals.filter(reduce(lambda a, b: a | b, wrong, F.lit(False))).select("s", "p", "o")


def violations(triples: View | DataFrame, types: DataFrame, shape: Shape, closure: DataFrame | None = None) -> DataFrame:
    """The target's individuals, and those of its subclasses by a closure (sub, sup) if one is given, are the focus; a
    value belongs to a class in the same way. A path's values are met with the focus once for all its constraints."""
    types = propagate_types(types, closure) if closure is not None else types.select("s", "c").distinct()
    focus = types.filter(F.col("c") == shape.target).select(F.col("s").alias("focus")).distinct()
    parts = []
    for path in dict.fromkeys(p.path for p in shape.properties):
        own = [p for p in shape.properties if p.path == path]
        values = edges_of(triples, path).select(F.col("s").alias("focus"), F.col("o").alias("value")).distinct()
        met = focus.join(values, "focus", "left")
        wrong = [F.when(F.col("value").isNotNull() & ~lexical(F.col("value"), p.datatype), F.lit("datatype")) for p in own if p.datatype]
        for k, p in enumerate(p for p in own if p.classes):
            allowed = types.filter(F.col("c").isin(*p.classes)).select(F.col("s").alias("value"), F.lit(True).alias(f"_in{k}")).distinct()
            met = met.join(allowed, "value", "left")
            wrong.append(F.when(F.col("value").isNotNull() & F.col(f"_in{k}").isNull(), F.lit("class" if len(p.classes) == 1 else "or")))
        row = lambda kind, value: (F.col("focus"), F.lit(path).alias("path"), kind.alias("kind"), value.cast("string").alias("value"), F.lit(shape.target).alias("shape"))
        if wrong:
            parts.append(met.withColumn("_kind", F.explode(F.array_compact(F.array(*wrong)))).select(*row(F.col("_kind"), F.col("value"))))
        least = max(p.least for p in own)
        if least:
            counts = focus.join(values, "focus", "left").groupBy("focus").agg(F.count("value").alias("n")).filter(F.col("n") < least)
            parts.append(counts.select(*row(F.lit("minCount"), F.lit(None))))
    if not parts:
        return focus.limit(0).select("focus", *(F.lit(None).cast("string").alias(c) for c in ("path", "kind", "value", "shape")))
    return reduce(DataFrame.unionByName, parts)


# -- shapes as a table -----------------------------------------------------------------------------------------------


def model_shapes(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Shapes (shape, target, path, least, datatype, classes) of all models of tables as exports takes them: one for each name
    among a class's properties. Object properties ask for one of the classes that they range over, others for a type of
    their first row; null where nothing is asked."""
    ends = classes.select("schema_id", F.col("url").alias("range_class_iri"), F.lit(True).alias("_own"))
    domains = classes.select("schema_id", F.col("id").alias("domain_class_id"), F.col("url").alias("target"), F.concat("name", F.lit("Shape")).alias("shape"))
    rows = properties.join(domains, ["schema_id", "domain_class_id"]).join(ends, ["schema_id", "range_class_iri"], "left")
    own = F.array_sort(F.collect_set(F.when(F.col("_own") & (F.col("property_type") == "object"), F.col("range_class_iri"))))
    first = F.min_by(F.struct("is_required", "property_type", "range_class_iri"), F.struct("ord", "id")).alias("f")
    groups = rows.groupBy("schema_id", "shape", "target", F.col("name").alias("path")).agg(own.alias("classes"), first)
    typed = F.when((F.col("f.property_type") == "datatype") & F.startswith("f.range_class_iri", F.lit(XSD)), F.substring("f.range_class_iri", len(XSD) + 1, 99))
    return groups.select("shape", "target", "path", F.coalesce(F.col("f.is_required").cast("int"), F.lit(0)).alias("least"), typed.alias("datatype"), F.when(F.size("classes") > 0, F.col("classes")).alias("classes"))


def report(triples: DataFrame, types: DataFrame, shapes: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(focus, path, kind, value, shape) for what breaks shapes (shape, target, path, least, datatype, classes), of any number
    of models at once, in triples (s, p, o) and types (s, c).

    An individual of a target, or of what a closure (sub, sup) puts below it, meets the rows of its shapes, and each row
    the individual's values: joins on class and path, so that the plan is the same for any number of shapes. Rows of one
    shape and path are separate constraints. A datatype that isn't known is met by no value.
    """
    types = propagate_types(types, closure) if closure is not None else types.select("s", "c").distinct()
    values = triples.select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value")).filter("value IS NOT NULL").distinct()
    rows = shapes.select("shape", F.col("target").alias("c"), "path", "least", "datatype", "classes").distinct()
    asked = types.select(F.col("s").alias("focus"), "c").join(rows, "c").drop("c").distinct()
    met = asked.join(values, ["focus", "path"], "left")
    out = lambda df, kind, value: df.select("focus", "path", kind.alias("kind"), value.cast("string").alias("value"), "shape")
    few = asked.filter("least > 0").join(values.groupBy("focus", "path").agg(F.count("*").alias("n")), ["focus", "path"], "left").filter("coalesce(n, 0) < least")
    fits = F.coalesce(*(F.when(F.col("datatype") == t, lexical(F.col("value"), t)) for t in XSD_TYPES), F.lit(False))
    wrong = met.filter(F.col("value").isNotNull() & F.col("datatype").isNotNull() & ~fits)
    classed = met.filter("value IS NOT NULL AND classes IS NOT NULL").select("focus", "path", "shape", "value", "classes").distinct()
    held = classed.select("focus", "path", "shape", "value", "classes", F.explode("classes").alias("c")).join(types.select(F.col("s").alias("value"), "c"), ["value", "c"])
    key = ["focus", "path", "shape", "value", "classes"]
    outside = classed.join(held.select(*key), key, "left_anti")
    kind = F.when(F.size("classes") == 1, "class").otherwise("or")
    return out(few, F.lit("minCount"), F.lit(None)).unionByName(out(wrong, F.lit("datatype"), F.col("value"))).unionByName(out(outside, kind, F.col("value"))).distinct()
