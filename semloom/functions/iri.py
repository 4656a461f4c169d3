"""Names, literals and versions as column expressions; those of single values serve the exporters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from semloom.model import OWL, RDFS

LOCAL = r"^[A-Za-z_][\w.-]*$"

#: Property characteristics and the OWL types that state them.
FEATURES = {
    "functional": "FunctionalProperty", "inverseFunctional": "InverseFunctionalProperty", "transitive": "TransitiveProperty", "symmetric": "SymmetricProperty",
    "asymmetric": "AsymmetricProperty", "reflexive": "ReflexiveProperty", "irreflexive": "IrreflexiveProperty",
}


def shorten(iri: str, prefixes: dict[str, str]) -> str:
    """prefix:local by the first prefix that leaves a local name, else <iri>."""
    for prefix, base in prefixes.items():
        if iri.startswith(base) and re.match(LOCAL, iri[len(base) :], re.ASCII):
            return f"{prefix}:{iri[len(base):]}"
    return f"<{iri}>"


def shortened(iri: Column, prefixes: dict[str, str]) -> Column:
    """shorten() as an expression, a branch for each prefix."""
    tries = [F.when(iri.startswith(base) & F.substring(iri, len(base) + 1, 1 << 30).rlike(LOCAL), F.concat(F.lit(prefix + ":"), F.substring(iri, len(base) + 1, 1 << 30))) for prefix, base in prefixes.items()]
    return F.coalesce(*tries, F.concat(F.lit("<"), iri, F.lit(">")))


def expanded(curie: Column, prefixes: dict[str, str]) -> Column:
    """The IRI of prefix:local; an unknown prefix is an error."""
    prefix, local = F.substring_index(curie, ":", 1), F.regexp_replace(curie, "^[^:]*:", "")
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    base = F.try_element_at(known, prefix)
    return F.when(base.isNotNull(), F.concat(base, local)).otherwise(F.raise_error(F.concat(F.lit("unknown prefix in "), curie)))


def local_name(iri: Column) -> Column:
    """What follows the last / or #."""
    return F.element_at(F.split(iri, "[/#]"), -1)


def local_id(iri: Column) -> Column:
    return F.substring_index(iri, "/", -1)


def base_uri(uri: Column) -> Column:
    """With / or # at its end."""
    return F.when(uri.rlike("[/#]$"), uri).otherwise(F.concat(uri, F.lit("/")))


def upper_prefix(iri: Column) -> Column:
    """The lower-cased last piece of a namespace."""
    return F.lower(local_name(F.regexp_replace(iri, "[/#]+$", "")))


def escaped(text: Column) -> Column:
    """A literal's text in Turtle: backslashes first, then quotes and line feeds."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def property_reference(name: Column, prefixes: dict[str, str]) -> Column:
    return F.when(F.contains(name, F.lit("://")), shortened(name, prefixes)).otherwise(F.concat(F.lit(":"), name))


def feature_types(features: Column) -> Column:
    """The OWL types of characteristics, unknown ones dropped."""
    known = F.create_map(*(F.lit(x) for k, v in FEATURES.items() for x in (k, "owl:" + v)))
    return F.array_compact(F.transform(features, lambda f: F.try_element_at(known, f)))


def group_names(pattern: Column) -> Column:
    """The named groups of a regular expression, in order."""
    return F.regexp_extract_all(pattern, F.lit(r"\(\?<([^>]+)>"), F.lit(1))


def strip_links(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"\[([^\]]*)\]\([^)]*\)", "$1")


def first_link(markdown: Column) -> tuple[Column, Column]:
    """Label and IRI of the first link, null without one."""
    link = r"\[([^\]]*)\]\(([^)]*)\)"
    return tuple(F.when(markdown.rlike(link), F.regexp_extract(markdown, link, k)) for k in (1, 2))


def version_parts(version: Column) -> Column:
    """The numbers of a version, of any length, as (digits, text without leading zeros), which order as numbers do; null if
    a part is none."""
    plain = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    parts = F.transform(F.split(version, "[._-]"), lambda x: F.when(x.rlike("^[0-9]+$"), F.struct(F.length(plain(x)).alias("digits"), plain(x).alias("text"))))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)


def version_order(one: Column, other: Column) -> Column:
    """-1, 0 or 1 as one comes before, with or after other; missing parts are 0; null where one is no version."""
    a, b = version_parts(one), version_parts(other)
    n = F.greatest(F.size(a), F.size(b))
    zero = F.struct(F.lit(1).alias("digits"), F.lit("0").alias("text"))
    pad = lambda x: F.concat(x, F.array_repeat(zero, (n - F.size(x)).cast("int")))
    known = a.isNotNull() & b.isNotNull()
    return F.when(known & (pad(a) > pad(b)), 1).when(known & (pad(a) < pad(b)), -1).when(known, 0)


def is_newer(version: Column, modified: Column, than_version: Column, than_modified: Column) -> Column:
    """By version where both are comparable, else by the date's text, else not."""
    order = version_order(version, than_version)
    return F.when(order.isNotNull(), order > 0).otherwise(F.coalesce(modified > than_modified, F.lit(False)))


#: What makes a subject a property or a class.
PROPERTY_TYPES = [OWL + "ObjectProperty", OWL + "DatatypeProperty", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"]
CLASS_TYPES = [OWL + "Class", RDFS + "Class"]
