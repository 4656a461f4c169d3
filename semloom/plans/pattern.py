"""Mapping patterns: ordered triple templates between ?this and ?value, compiled to joins or to class expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.functions.iri import shorten
from semloom.model import TYPE
from semloom.plans.abox import Branch, Term, View, edges_of

THIS, VALUE = "?this", "?value"
#: Rows of one side of a many-to-many meeting that every task may hold.
FEW = 1_000_000


@dataclass(frozen=True)
class Template:
    subject: str
    predicate: str
    object: str


def is_variable(term: str) -> bool:
    return term.startswith("?")


def evaluate(pattern: list[Template], view: View | DataFrame) -> DataFrame:
    """The distinct pairs (this, value) for which every template holds in a triples view (s, p, o).

    Templates without predicate are left out. Each next template shares a variable with those before it where one
    does, so no product of unrelated templates arises; patterns in several parts are refused. Where each template of a view
    has one branch, tables are joined on their own keys and names are made of what is left in the end.
    """
    left = [t for t in pattern if t.predicate]
    if isinstance(view, View) and (keyed := _by_keys(left, view)) is not None:
        return keyed
    bound: DataFrame | None = None
    while left:
        known = set() if bound is None else set(bound.columns)
        todo = _next(left, known)
        left.remove(todo)
        step = edges_of(view, todo.predicate, objects=() if is_variable(todo.object) else (todo.object,))
        names = [(c, term) for c, term in (("s", todo.subject), ("o", todo.object))]
        for c, term in names:
            if not is_variable(term) and c == "s":
                step = step.filter(F.col(c) == term)
        if todo.subject == todo.object and is_variable(todo.subject):
            step = step.filter("s = o")
            names = names[:1]
        step = step.select(*(F.col(c).alias(term) for c, term in names if is_variable(term)))
        shared = [c for c in step.columns if c in known]
        bound = step if bound is None else bound.join(step, shared)
        # a variable that no template asks for any more only multiplies rows
        needed = {THIS, VALUE}.union(*({t.subject, t.object} for t in left)) if left else {THIS, VALUE}
        kept = [c for c in bound.columns if c in needed]
        if len(kept) < len(bound.columns):
            bound = bound.select(*kept)
    if bound is None or not {THIS, VALUE} <= set(bound.columns):
        raise ValueError("a pattern must bind ?this and ?value")
    return bound.select(F.col(THIS).alias("this"), F.col(VALUE).alias("value")).distinct()


def _next(left: list[Template], known: set[str]) -> Template:
    """The template to join next: of those that meet what is known, one that only restricts it, else one with most ends
    known; to begin with, the first."""
    met = [t for t in left if known & {t.subject, t.object}]
    if not met:
        if known:
            raise ValueError("the templates are not connected")
        return left[0]
    return min(met, key=lambda t: sum(is_variable(x) and x not in known for x in (t.subject, t.object)))


def _by_keys(templates: list[Template], view: View) -> DataFrame | None:
    """evaluate() on the tables' own keys; None where a template has several branches or none, or a constant subject."""
    chosen: dict[Template, Branch] = {}
    for t in templates:
        found = view.matching(t.predicate, objects=() if is_variable(t.object) else (t.object,))
        if len(found) != 1 or not is_variable(t.subject) or t.subject == t.object or (not is_variable(t.object) and found[0].o.constant is None):
            return None
        chosen[t] = found[0]
    terms: dict[str, Term] = {}
    for t, b in chosen.items():
        for variable, term in ((t.subject, b.s), (t.object, b.o)):
            if is_variable(variable):
                if term.constant is not None or terms.setdefault(variable, term).before != term.before:
                    return None
    if not {THIS, VALUE} <= set(terms):
        raise ValueError("a pattern must bind ?this and ?value")
    # what a row has as its key is of the key's class: a type says nothing new of a variable that is one anyway
    keys = {(t.subject, b.table, b.s) for t, b in chosen.items() if b.o.constant is None}
    left = [t for t, b in chosen.items() if b.o.constant is None or (t.subject, b.table, b.s) not in keys]
    subjects: set[str] = set()
    bound: DataFrame | None = None
    while left:
        known = set() if bound is None else set(bound.columns)
        todo = _next(left, known)
        left.remove(todo)
        b = chosen[todo]
        ends = [(todo.subject, b.s), *([(todo.object, b.o)] if is_variable(todo.object) else [])]
        step = view.table(b.table).select(*(x.raw.alias(v) for v, x in ends))
        for v, _ in ends:
            step = step.filter(F.col(v).isNotNull())
        on = [v for v, _ in ends if v in known]
        if not left and len(on) == 1 and on[0] == todo.object and on[0] not in subjects and {*known, todo.subject} == {THIS, VALUE, *on}:
            return _crossed(bound, step, on[0], terms)
        subjects.add(todo.subject)
        bound = step if bound is None else bound.join(step, on)
        needed = {THIS, VALUE}.union(*({t.subject, t.object} for t in left))
        bound = bound.select(*(c for c in bound.columns if c in needed))
    pairs = bound.select(THIS, VALUE).distinct()
    return pairs.select(terms[THIS].name(F.col(THIS)).alias("this"), terms[VALUE].name(F.col(VALUE)).alias("value"))


def _crossed(near: DataFrame, far: DataFrame, mid: str, terms: dict[str, Term]) -> DataFrame:
    """The distinct pairs of ends that meet in mid, where each side may have many rows of one mid.

    Pairs are many more than rows, so they are not shuffled to be told apart: an end with a single mid has each pair once, as
    both sides are distinct. Only pairs of ends with several mids are compared. A task makes the pairs of few mids, since a
    file of pairs is small only where it has few names of the far end.
    """
    (end,), (other,) = ([c for c in side.columns if c != mid] for side in (near, far))
    # names are made before rows meet, not again for each pair
    near, far = (side.select(terms[v].name(F.col(v)).alias(v), mid) for side, v in ((near, end), (far, other)))
    far = far.distinct()
    # few bytes make many pairs, so the number of tasks is not left to the bytes
    tasks = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = near.repartition(tasks, end)
    spans = near.groupBy(end).agg(F.min(mid).alias(mid), F.max(mid).alias("_last"))
    single = spans.filter(F.col(mid) == F.col("_last")).select(end, mid)
    if far.count() <= FEW:
        # a join that deals rows would send all of a mid to one task
        far = F.broadcast(far)
        single = single.repartitionByRange(tasks, mid, end)
    once = single.join(far, mid).select(THIS, VALUE)
    several = near.join(spans.filter(F.col(mid) < F.col("_last")).select(end), end, "left_semi").distinct()
    pairs = once.unionByName(several.join(far, mid).select(THIS, VALUE).distinct())
    return pairs.select(F.col(THIS).alias("this"), F.col(VALUE).alias("value"))


def reverse(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("value").alias("this"), F.col("this").alias("value"))


@dataclass(frozen=True)
class Named:
    name: str


@dataclass(frozen=True)
class Some:
    """There is a value of the property, or of its inverse, in the filler."""

    predicate: str
    filler: Named | Some | All
    inverse: bool = False


@dataclass(frozen=True)
class All:
    """Intersection: named members stand before restrictions."""

    members: tuple


THING = Named("owl:Thing")


def _all(types: list[Named], restrictions: list[Some]) -> Named | Some | All:
    members = [*types, *restrictions]
    return THING if not members else members[0] if len(members) == 1 else All(tuple(members))


def forward(pattern: list[Template], terminal: str | None, subject: str | None = None) -> Named | Some | All:
    """What ?this must be. Each template is an edge of its own, used once. Constants in object place are types."""
    free = dict(enumerate(pattern))
    end = Named(terminal) if terminal else THING

    def node(variable: str, own: list[Named]) -> Named | Some | All:
        types, restrictions = own, []
        out = [k for k, t in free.items() if t.subject == variable and t.predicate]
        for k in out:
            t = free.pop(k, pattern[k])
            if not is_variable(t.object):
                types.append(Named(t.object))
            else:
                restrictions.append(Some(t.predicate, end if t.object == VALUE else node(t.object, [])))
        if variable not in (THIS, VALUE):
            for k in [k for k, t in free.items() if t.object == variable and t.predicate]:
                if k in free:
                    t = free.pop(k)
                    inner = (Named(subject) if subject else THING) if t.subject == THIS else node(t.subject, [])
                    restrictions.append(Some(t.predicate, inner, inverse=True))
        return _all(types, restrictions)

    return node(THIS, [Named(subject)] if subject else [])


def backward(pattern: list[Template], domain: str | None, range_: str | None = None) -> Named | Some | All:
    """What ?value must be: incoming templates are inverse restrictions, ?this ends at the domain class."""
    free = dict(enumerate(pattern))

    def node(variable: str, own: list[Named]) -> Named | Some | All:
        types, restrictions = own, []
        for k in [k for k, t in free.items() if t.subject == variable and t.predicate == TYPE and not is_variable(t.object)]:
            types.append(Named(free.pop(k).object))
        for k in [k for k, t in free.items() if t.object == variable]:
            if k in free:
                t = free.pop(k)
                inner = (Named(domain) if domain else THING) if t.subject == THIS else node(t.subject, [])
                restrictions.append(Some(t.predicate, inner, inverse=True))
        if variable != VALUE:
            for k in [k for k, t in free.items() if t.subject == variable and t.predicate != TYPE]:
                if k in free:
                    t = free.pop(k)
                    restrictions.append(Some(t.predicate, node(t.object, [])))
        return _all(types, restrictions)

    return node(VALUE, [Named(range_)] if range_ else [])


def turtle(expression: Named | Some | All, prefixes: dict[str, str]) -> str:
    """A class expression in Turtle."""
    name = lambda iri: iri if ":" in iri and "://" not in iri else shorten(iri, prefixes)
    if isinstance(expression, Named):
        return name(expression.name)
    if isinstance(expression, Some):
        on = f"[ owl:inverseOf {name(expression.predicate)} ]" if expression.inverse else name(expression.predicate)
        return f"[ a owl:Restriction ; owl:onProperty {on} ; owl:someValuesFrom {turtle(expression.filler, prefixes)} ]"
    return f"[ a owl:Class ; owl:intersectionOf ( {' '.join(turtle(m, prefixes) for m in expression.members)} ) ]"
