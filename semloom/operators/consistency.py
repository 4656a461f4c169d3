"""Contradictions of a model with an upper ontology, by canonical witnesses.

What a property's pattern says of its ends is a finite tree of existential restrictions. One fresh individual for each
node of the tree is asserted with its types and edges; the ontology's rules are applied to all witnesses of all
properties at once until nothing is new; a tree in which an individual has disjoint types cannot have instances.
Unions are met by cases. This is sound, and incomplete where cases must be nested or values be made deeper than allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.model import TYPE
from semloom.operators import exports
from semloom.operators.reasoning import dropped, small, together, transitive, written
from semloom.plans import expressions
from semloom.plans.pattern import All, Named, Some
from semloom.sources import upper


def witnesses(anchors: dict[str, Named | Some | All]) -> tuple[list[tuple], list[tuple]]:
    """Types (anchor, s, c) and edges (anchor, s, p, o) of the trees of anchors."""
    types, edges = [], []

    def grow(anchor: str, at: str, expression: Named | Some | All) -> None:
        for k, m in enumerate(expression.members if isinstance(expression, All) else (expression,)):
            if isinstance(m, Named):
                types.append((anchor, at, m.name))
            else:
                there = f"{at}.{k}"
                edges.append((anchor, there, m.predicate, at) if m.inverse else (anchor, at, m.predicate, there))
                grow(anchor, there, m.filler)

    for name, expression in anchors.items():
        grow(name, f"{name}:0", expression)
    return types, edges


class Ontology:
    """Axioms as tables; the defaults are the upper ontology's, with what a model adds of its own:

    - classes: subclasses (sub, sup), as pairs or as a table; a union's parts are its subclasses;
    - wholes (whole, c): what is in every part c of a whole is in the whole;
    - exists (c, p, filler): what is in c has a value of p in the filler.
    """

    def __init__(self, spark: SparkSession, classes: list[tuple[str, str]] | DataFrame = (), wholes: list[tuple[str, str]] = (), exists: list[tuple[str, str, str]] = ()):
        inverses = upper.INVERSES + [(b, a) for a, b in upper.INVERSES]
        own = classes if isinstance(classes, DataFrame) else small(spark, list(classes), "sub string, sup string")
        self.up = transitive(small(spark, upper.SUBCLASSES, "sub string, sup string").unionByName(own))
        self.disjoint = small(spark, upper.DISJOINT + [(b, a) for a, b in upper.DISJOINT], "one string, other string")
        self.domains, self.ranges = (small(spark, x, "p string, c string") for x in (upper.DOMAINS, upper.RANGES))
        self.inverses, self.above = small(spark, inverses, "p string, q string"), small(spark, upper.SUBPROPERTIES, "p string, q string")
        # a transitive property is a chain of itself with itself
        self.chains = small(spark, [*upper.CHAINS, *((p, p, p) for p in upper.TRANSITIVE)], "p string, second string, q string")
        self.only, self.never = (small(spark, x, "c string, p string, filler string") for x in (upper.ONLY, upper.NEVER))
        self.wholes = small(spark, list(wholes), "whole string, c string") if wholes else None
        self.exists = small(spark, list(exists), "c string, p string, filler string") if exists else None
        flat = lambda rows: [(x, "|".join(parts), c) for x, parts in rows for c in parts]
        self.covers = small(spark, flat(upper.COVERS), "on string, choice string, c string")
        self.domain_unions, self.range_unions = (small(spark, flat(x), "on string, choice string, c string") for x in (upper.DOMAIN_UNIONS, upper.RANGE_UNIONS))


#: A fact: a triple of an anchor's world; of a type the property is TYPE and the object the class.
FACT = ["anchor", "s", "p", "o"]
#: Between an individual and what it only must have a value of, in the name of that value.
_VALUE = "#"


def facts_of(types: DataFrame, edges: DataFrame) -> DataFrame:
    return types.select("anchor", "s", F.lit(TYPE).alias("p"), F.col("c").alias("o")).unionByName(edges.select(*FACT))


class Saturation:
    """Facts and all that follows from them, round by round, each round from what the one before found.

    A rule joins what is new with all that is known, in each place where it can stand, so the work of a round goes with
    what is new; a round writes that and nothing else. With trace, a fact has the rule, the axiom and the facts that it
    follows from; these are of earlier rounds, so that proofs end. Values that must exist are made once for each axiom on a
    way from one to the next and no deeper than most_depth, so that cyclic axioms end too; leaving values out loses
    conclusions and makes no wrong ones.
    """

    def __init__(self, given: DataFrame, o: Ontology, trace: bool = False, known: DataFrame | None = None, most_rounds: int = 60, most_depth: int = 3):
        """given: facts that are new; known: facts from which all has followed already."""
        self.o, self.trace, self.most_depth = o, trace, most_depth
        first = self._traced(given.select(*FACT), F.lit("given"), F.lit(None), [])
        self.tables: list[DataFrame] = []
        if known is not None:
            self.tables.append(written(self._traced(known.select(*FACT), F.lit("known"), F.lit(None), []).distinct()))
        new = written(self._new([first]))
        while not new.isEmpty():
            if len(self.tables) > most_rounds:
                raise RuntimeError(f"the rules did not settle in {most_rounds} rounds")
            self.tables.append(new)
            new = written(self._new(self._step(new)))
        self.settled = new
        self.rounds = len(self.tables)

    def drop(self) -> None:
        dropped([*self.tables, self.settled])

    @property
    def facts(self) -> DataFrame:
        return together([*self.tables, self.settled])

    @property
    def types(self) -> DataFrame:
        return self.facts.filter(F.col("p") == TYPE).select("anchor", "s", F.col("o").alias("c"))

    @property
    def edges(self) -> DataFrame:
        return self.facts.filter(F.col("p") != TYPE).select(*FACT)

    def _traced(self, rows: DataFrame, rule: Column, axiom: Column, parents: list[Column]) -> DataFrame:
        if not self.trace:
            return rows.select(*FACT)
        none = F.array().cast("array<struct<s:string,p:string,o:string>>")
        return rows.select(*FACT, rule.alias("rule"), axiom.cast("string").alias("axiom"), (F.array(*parents) if parents else none).alias("parents"))

    def _new(self, candidates: list[DataFrame]) -> DataFrame:
        """The distinct facts among candidates that are not known, each with its first derivation."""
        rows = reduce(DataFrame.unionByName, candidates)
        if self.trace:
            rows = rows.groupBy(*FACT).agg(F.min(F.struct("rule", "axiom", "parents")).alias("d")).select(*FACT, "d.*")
        else:
            rows = rows.distinct()
        return rows.join(together(self.tables).select(*FACT), FACT, "left_anti") if self.tables else rows

    def _step(self, new: DataFrame) -> list[DataFrame]:
        o, known, out = self.o, together(self.tables), []
        of = lambda t, is_type: t.filter((F.col("p") == TYPE) == F.lit(is_type)).select(*FACT)
        types, edges, all_types, all_edges = of(new, True), of(new, False), of(known, True), of(known, False)
        fact = lambda s, p, o_: F.struct(F.col(s).alias("s"), (F.lit(p) if p == TYPE else F.col(p)).alias("p"), F.col(o_).alias("o"))

        def add(rows: DataFrame, s: str, p: str, o_: str, rule: str, axiom: list, parents: list) -> None:
            """Facts (s, p, o_) from columns of rows."""
            words = F.concat_ws(" ", *(F.col(x[1:]) if x.startswith("$") else F.lit(x) for x in axiom))
            shaped = rows.select(F.col("anchor").alias("_a"), F.col(s).alias("_s"), (F.lit(p) if p == TYPE else F.col(p)).alias("_p"), F.col(o_).alias("_o"), words.alias("_w"), F.array(*parents).alias("_f"))
            named = shaped.select(F.col("_a").alias("anchor"), F.col("_s").alias("s"), F.col("_p").alias("p"), F.col("_o").alias("o"), "_w", "_f")
            out.append(named.select(*FACT, F.lit(rule).alias("rule"), F.col("_w").alias("axiom"), F.col("_f").alias("parents")) if self.trace else named.select(*FACT))

        edge = fact("s", "p", "o")
        add(edges.join(o.inverses, "p"), "o", "q", "s", "inverse", ["$p", "inverse of", "$q"], [edge])
        add(edges.join(o.above, "p"), "s", "q", "o", "subproperty", ["$p", "below", "$q"], [edge])
        add(edges.join(o.domains, "p"), "s", TYPE, "c", "domain", ["domain of", "$p", "is", "$c"], [edge])
        add(edges.join(o.ranges, "p"), "o", TYPE, "c", "range", ["range of", "$p", "is", "$c"], [edge])
        add(types.join(o.up, F.col("o") == F.col("sub")), "s", TYPE, "sup", "subclass", ["$sub", "below", "$sup"], [fact("s", TYPE, "o")])
        second = lambda t: t.select("anchor", F.col("s").alias("o"), F.col("p").alias("second"), F.col("o").alias("end"))
        for a, b in ((edges, all_edges), (all_edges, edges)):
            way = a.join(o.chains, "p").join(second(b), ["anchor", "o", "second"])
            add(way, "s", "q", "end", "chain", ["$p", "then", "$second", "is", "$q"], [edge, fact("o", "second", "end")])
        for t, e in ((types, all_edges), (all_types, edges)):
            mine = t.select("anchor", "s", F.col("o").alias("c")).join(o.only, "c").join(e, ["anchor", "s", "p"])
            add(mine, "o", TYPE, "filler", "only", ["$c", "has only", "$filler", "as", "$p"], [fact("s", TYPE, "c"), edge])
        if o.wholes is not None:
            touched = types.join(o.wholes, F.col("o") == F.col("c")).select("anchor", "s", "whole").distinct()
            parts = o.wholes.groupBy("whole").agg(F.collect_set("c").alias("parts"))
            met = touched.join(o.wholes, "whole").join(all_types.select("anchor", "s", F.col("o").alias("c")), ["anchor", "s", "c"]).groupBy("anchor", "s", "whole").agg(F.count("*").alias("n"))
            whole = met.join(parts, "whole").filter(F.col("n") == F.size("parts"))
            add(whole.withColumn("_all", F.array_join(F.array_sort("parts"), " and ")), "s", TYPE, "whole", "intersection", ["$_all", "are", "$whole"], [])
        if o.exists is not None:
            mark = F.concat(F.lit(_VALUE), "p", F.lit(":"), "filler")
            due = types.select("anchor", "s", F.col("o").alias("c")).join(o.exists, "c").filter(~F.contains("s", mark) & (F.size(F.split("s", _VALUE)) <= self.most_depth))
            there = all_edges.join(all_types.select("anchor", F.col("s").alias("o"), F.col("o").alias("filler")), ["anchor", "o"]).select("anchor", "s", "p", "filler").distinct()
            due = due.join(there, ["anchor", "s", "p", "filler"], "left_anti").withColumn("made", F.concat("s", mark))
            add(due, "s", "p", "made", "exists", ["$c", "has some", "$filler", "as", "$p"], [fact("s", TYPE, "c")])
            add(due, "made", TYPE, "filler", "exists", ["$c", "has some", "$filler", "as", "$p"], [fact("s", TYPE, "c")])
        return out


def saturated(types: DataFrame, edges: DataFrame, o: Ontology) -> tuple[DataFrame, DataFrame]:
    """types (anchor, s, c) and edges (anchor, s, p, o) with all that follows."""
    found = Saturation(facts_of(types, edges), o)
    return found.types, found.edges


def clashes(types: DataFrame, edges: DataFrame, o: Ontology) -> DataFrame:
    """(anchor, s, one, other) for individuals with disjoint types, or with a part that their class never has."""
    found = _clash_facts(types, edges, o)
    return found.select("anchor", "s", "one", "other").distinct()


def _clash_facts(types: DataFrame, edges: DataFrame, o: Ontology) -> DataFrame:
    """(anchor, s, one, other, axiom, parents): the contradictions, with the facts that meet in each."""
    one, other = types.select("anchor", "s", F.col("c").alias("one")), types.select("anchor", "s", F.col("c").alias("other"))
    fact = lambda s, p, o_: F.struct(F.col(s).alias("s"), (F.lit(p) if p == TYPE else F.col(p)).alias("p"), F.col(o_).alias("o"))
    both = one.join(o.disjoint, "one").join(other, ["anchor", "s", "other"]).filter("one < other")
    both = both.select("anchor", "s", "one", "other", F.concat_ws(" ", "one", F.lit("is disjoint with"), "other").alias("axiom"), F.array(fact("s", TYPE, "one"), fact("s", TYPE, "other")).alias("parents"))
    part = types.join(o.never, "c").join(edges, ["anchor", "s", "p"]).select("anchor", "s", F.col("c").alias("one"), "p", "o", F.col("filler").alias("other"))
    bad = part.join(types.select("anchor", F.col("s").alias("o"), F.col("c").alias("other")), ["anchor", "o", "other"])
    bad = bad.select("anchor", "s", "one", "other", F.concat_ws(" ", "one", F.lit("has no"), "other", F.lit("as"), "p").alias("axiom"), F.array(fact("s", TYPE, "one"), fact("s", "p", "o"), fact("o", TYPE, "other")).alias("parents"))
    return both.unionByName(bad)


# -- cases -----------------------------------------------------------------------------------------------------------

_CASE = "\x1f"


def _choices(s: Saturation) -> DataFrame:
    """(anchor, s, choice, c): individuals of which a union says that they are in one of its alternatives c, where it isn't
    known of any."""
    o, types, edges = s.o, s.types, s.edges
    due = types.select("anchor", "s", F.col("c").alias("on")).join(o.covers, "on").select("anchor", "s", "choice")
    due = due.unionByName(edges.join(o.domain_unions, F.col("p") == F.col("on")).select("anchor", "s", "choice"))
    due = due.unionByName(edges.join(o.range_unions, F.col("p") == F.col("on")).select("anchor", F.col("o").alias("s"), "choice")).distinct()
    every = o.covers.unionByName(o.domain_unions).unionByName(o.range_unions).select("choice", "c").distinct()
    met = due.join(every, "choice").join(types, ["anchor", "s", "c"], "left_semi").select("anchor", "s", "choice")
    return due.join(met, ["anchor", "s", "choice"], "left_anti").join(every, "choice")


def refuted(types: DataFrame, edges: DataFrame, o: Ontology, most_splits: int = 8, trace: bool = False) -> tuple[DataFrame, list[tuple[Saturation, DataFrame]]]:
    """(anchor, clashes) of the worlds of types and edges that contradict themselves, and the saturations behind it with
    their contradictions.

    Where a union leaves an individual a choice, each alternative is followed in a copy of its world. An alternative
    whose copy has a contradiction is none; if no alternative is left the world is refuted, and a single one that is left
    becomes a fact, from which more may follow in the next of most_splits passes. So a proof may need many cases, one
    after the other, but none that holds only within another case. Copies are of worlds with a choice: as many as there are
    alternatives. This is for trees of anchors, of which each is small; instance data is one world and isn't split.
    """
    base = Saturation(facts_of(types, edges), o, trace)
    direct = written(_clash_facts(base.types, base.edges, o))
    proofs = [(base, direct)]
    out = direct.select("anchor", "s", "one", "other").distinct().groupBy("anchor").agg(F.count("*").alias("clashes"))
    for _ in range(most_splits):
        alive = base.facts.select("anchor").distinct().join(out.select("anchor"), "anchor", "left_anti")
        choices = written(_choices(base).join(alive, "anchor").withColumn("world", F.concat_ws(_CASE, "anchor", "s", "choice", "c")))
        if choices.isEmpty():
            break
        copies = base.facts.select(*FACT).join(choices.select("anchor", "world"), "anchor").select(F.col("world").alias("anchor"), "s", "p", "o")
        assumed = choices.select(F.col("world").alias("anchor"), "s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))
        cases = Saturation(assumed, o, trace, known=copies)
        closed = written(_clash_facts(cases.types, cases.edges, o))
        shut = closed.select(F.col("anchor").alias("world")).distinct().withColumn("shut", F.lit(True))
        left = choices.join(shut, "world", "left").groupBy("anchor", "s", "choice").agg(F.count_if(F.col("shut").isNull()).alias("n"), F.min(F.when(F.col("shut").isNull(), F.col("c"))).alias("c"))
        left = written(left.filter("n < 2"))
        if left.isEmpty():
            cases.drop()
            break
        proofs.append((cases, closed))
        lost = left.filter("n = 0").groupBy("anchor").agg(F.count("*").alias("clashes"))
        out = written(out.unionByName(lost))
        forced = left.filter("n = 1").join(out.select("anchor"), "anchor", "left_anti").select("anchor", "s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))
        if forced.isEmpty():
            continue
        base = Saturation(forced, o, trace, known=base.facts)
        more = written(_clash_facts(base.types, base.edges, o))
        proofs.append((base, more))
        out = written(out.unionByName(more.join(out.select("anchor"), "anchor", "left_anti").select("anchor", "s", "one", "other").distinct().groupBy("anchor").agg(F.count("*").alias("clashes"))))
    return out, proofs


def justified(proofs: list[tuple[Saturation, DataFrame]], most_rounds: int = 100) -> DataFrame:
    """(anchor, given, s, p, o, rule, axiom): for each contradiction's world the steps that lead to one of its contradictions,
    from traced saturations: facts with the rule and axiom that they follow by, and the contradiction itself, whose rule
    is clash. given is the case that was assumed in the world, null where there is none.

    One contradiction is taken of each world; a backward walk joins its facts with their derivations, round by round.
    """
    parts = []
    for s, bad in proofs:
        one = bad.groupBy("anchor").agg(F.min(F.struct("axiom", "parents", "s", "one", "other")).alias("b"))
        parts.append(one.select("anchor", "b.s", F.col("b.one").alias("p"), F.col("b.other").alias("o"), F.lit("clash").alias("rule"), F.col("b.axiom").alias("axiom")))
        ask = written(one.select("anchor", F.explode("b.parents").alias("f")).select("anchor", "f.*").distinct())
        seen = [ask]
        for _ in range(most_rounds):
            steps = written(s.facts.join(ask, FACT, "left_semi"))
            parts.append(steps.select(*FACT, "rule", "axiom"))
            more = steps.select("anchor", F.explode("parents").alias("f")).select("anchor", "f.*").distinct()
            ask = written(more.join(together(seen), FACT, "left_anti"))
            if ask.isEmpty():
                break
            seen.append(ask)
    rows = reduce(DataFrame.unionByName, parts)
    pieces = F.split("anchor", _CASE)
    given = F.when(F.size(pieces) > 1, F.concat(F.get(pieces, 1), F.lit(" is "), F.get(pieces, 3)))
    return rows.select(F.get(pieces, 0).alias("anchor"), given.alias("given"), "s", "p", "o", "rule", "axiom")


def alike(types: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types and edges of one anchor of each kind, and (anchor, same): all anchors with the one that stands for them.

    Anchors are of a kind if their facts differ at most in the anchor that their individuals' names begin with, so what
    follows is the same of both. Trees of anchors are small; how many kinds there are goes with the model's classes and
    patterns and not with its properties.
    """
    facts = written(facts_of(types, edges))
    own = lambda c: F.when(F.startswith(c, F.concat("anchor", F.lit(":"))), F.concat(F.lit(_CASE), F.expr(f"substring({c}, length(anchor) + 1)"))).otherwise(F.col(c))
    shape = facts.groupBy("anchor").agg(F.sort_array(F.collect_set(F.struct(own("s").alias("s"), "p", own("o").alias("o")))).alias("shape"))
    kinds = written(shape.select("anchor", F.sha2(F.to_json("shape"), 256).alias("kind")))
    first = kinds.groupBy("kind").agg(F.min("anchor").alias("same"))
    members = written(kinds.join(first, "kind").select("anchor", "same"))
    one = facts.join(members.filter("anchor = same").select("anchor"), "anchor", "left_semi")
    is_type = F.col("p") == TYPE
    return one.filter(is_type).select("anchor", "s", F.col("o").alias("c")), one.filter(~is_type), members


def unsatisfiable(spark: SparkSession, anchors: dict[str, Named | Some | All], classes: list[tuple[str, str]] = ()) -> DataFrame:
    """(anchor, clashes) of the anchors that cannot have instances, given a model's classes and what is above them."""
    types, edges = witnesses(anchors)
    t, e = small(spark, types, "anchor string, s string, c string"), small(spark, edges, "anchor string, s string, p string, o string")
    return refuted(t, e, Ontology(spark, list(classes)))[0]


def local(term: Column) -> Column:
    """A name of the upper ontology without its namespace; other names stay."""
    return F.when(F.startswith(term, F.lit(upper.NAMESPACE)), F.substring(term, len(upper.NAMESPACE) + 1, 1 << 30)).otherwise(term)


def model_anchors(classes: DataFrame, properties: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types (anchor, s, c), edges (anchor, s, p, o) and subclasses (sub, sup) of all models of tables as exports takes them:
    the trees of their patterns' anchors, and each class below its parent and what it is mapped to."""
    rows, _ = expressions.hops(exports.anchors(exports.grouped(properties, classes)))
    types, edges = expressions.witness_rows(rows)
    parents = classes.select("schema_id", F.col("id").alias("super_class_id"), F.col("url").alias("sup"))
    below = classes.join(parents, ["schema_id", "super_class_id"]).select(F.col("url").alias("sub"), "sup")
    mapped = classes.filter("maps_to_concept_iri <> ''").select(F.col("url").alias("sub"), local(F.col("maps_to_concept_iri")).alias("sup"))
    return types.select("anchor", "s", local(F.col("c")).alias("c")), edges.select("anchor", "s", local(F.col("p")).alias("p"), "o"), below.unionByName(mapped).distinct()


@dataclass(frozen=True)
class Mapped:
    """A model's property: what its subjects must be, and its values; of literal values, the XSD type. A property that is
    mapped several times must meet all of them, as an ontology reads several domains and ranges."""

    name: str
    domain: Named | Some | All
    range: Named | Some | All | None = None
    datatype: str | None = None


#: XSD types whose values are decimals too. Other types share no value with another.
DECIMALS = ("decimal", "integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger")


def unfolded(spark: SparkSession, edges: DataFrame, mapped: list[Mapped]) -> tuple[DataFrame, DataFrame]:
    """Types (s, c) and edges (s, p, o) that follow from data edges (s, p, o) of mapped properties: the tree of a
    property's domain grows at the subject, that of its range at the value, with individuals of their own below.

    Those are called like the one they grow at, a space and their place. What is added grows with the edges and with
    the size of the model's patterns, never with pairs of rows.
    """
    return _grown(spark, _members(spark, edges, mapped), mapped)


def _sides(mapped: list[Mapped]) -> list[tuple]:
    return [(m.name, "s", f"{k}s", m.domain) for k, m in enumerate(mapped)] + [(m.name, "o", f"{k}o", m.range) for k, m in enumerate(mapped) if m.range]


def _members(spark: SparkSession, edges: DataFrame, mapped: list[Mapped]) -> DataFrame:
    """(root, anchor): the individuals at which a tree grows."""
    uses = small(spark, [x[:3] for x in _sides(mapped)], "p string, side string, anchor string")
    return edges.join(uses, "p").select(F.when(F.col("side") == "s", F.col("s")).otherwise(F.col("o")).alias("root"), "anchor").distinct()


def _grown(spark: SparkSession, members: DataFrame, mapped: list[Mapped]) -> tuple[DataFrame, DataFrame]:
    """Types and edges of the trees of members (root, anchor), with what other columns those have."""
    types, links = witnesses({anchor: expression for _, _, anchor, expression in _sides(mapped)})
    others = [c for c in members.columns if c not in ("root", "anchor")]
    place = lambda at: F.when(F.col(at) == F.concat("anchor", F.lit(":0")), F.col("root")).otherwise(F.concat("root", F.lit(" "), at))
    t = members.join(small(spark, types, "anchor string, at string, c string"), "anchor").select(*others, place("at").alias("s"), "c")
    e = members.join(small(spark, links, "anchor string, at string, p string, to string"), "anchor").select(*others, place("at").alias("s"), "p", place("to").alias("o"))
    return t, e


def datatype_clashes(spark: SparkSession, edges: DataFrame, mapped: list[Mapped]) -> DataFrame:
    """(s, one, other) for individuals with a value of a property whose mappings ask for types that share no value."""
    asked: dict[str, set[str]] = {}
    for m in mapped:
        if m.datatype:
            asked.setdefault(m.name, set()).add("decimal" if m.datatype in DECIMALS else m.datatype)
    bad = small(spark, [(p, min(x), max(x)) for p, x in sorted(asked.items()) if len(x) > 1], "p string, one string, other string")
    return edges.join(bad, "p").select("s", "one", "other").distinct()


#: The properties of which a rule speaks, and that which states types.
_PREDICATES = {TYPE, *upper.TRANSITIVE, *(x for row in (*upper.INVERSES, *upper.SUBPROPERTIES, *upper.CHAINS) for x in row), *(row[0] for row in (*upper.DOMAINS, *upper.RANGES, *upper.DOMAIN_UNIONS, *upper.RANGE_UNIONS)), *(row[1] for row in (*upper.ONLY, *upper.NEVER))}


def data_clashes(spark: SparkSession, types: DataFrame, edges: DataFrame, classes: list[tuple[str, str]] = (), mapped: list[Mapped] = ()) -> DataFrame:
    """(s, one, other) for what contradicts itself in instance data (s, c) and (s, p, o), with what a model's classes and
    mapped properties say of it. An individual that a pattern only implies is reported as the one that it was grown at."""
    o, mapped = Ontology(spark, list(classes)), list(mapped)
    members, types = _members(spark, edges, mapped), types.select("s", "c")
    direct = edges.select("s", "p", "o").filter(F.col("p").isin(*sorted(_PREDICATES)))
    marks = types.select("s", F.concat(F.lit("c"), "c").alias("mark")).unionByName(members.select(F.col("root").alias("s"), F.concat(F.lit("a"), "anchor").alias("mark"))).filter("s IS NOT NULL")
    found = datatype_clashes(spark, edges, mapped)
    if not direct.isEmpty():
        tied = written(direct.select("s").unionByName(direct.select(F.col("o").alias("s"))).distinct())
        marks = marks.join(tied, "s", "left_anti")
        more, links = _grown(spark, members.join(tied.select(F.col("s").alias("root")), "root", "left_semi"), mapped)
        all_types, all_edges = types.join(tied, "s", "left_semi").unionByName(more), direct.unionByName(links)
        whole = saturated(all_types.select(F.lit("data").alias("anchor"), "s", "c"), all_edges.select(F.lit("data").alias("anchor"), "s", "p", "o"), o)
        found = found.unionByName(clashes(*whole, o).select(F.substring_index("s", " ", 1).alias("s"), "one", "other"))
    # no rule leads from one of the others to another: those with the same types and trees are followed once
    single = written(marks.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("mark")), _CASE).alias("anchor")))
    worlds = written(single.select("anchor").distinct())
    each = worlds.select("anchor", F.explode(F.split("anchor", _CASE)).alias("mark")).select(F.col("anchor").alias("world"), F.col("mark").substr(1, 1).alias("kind"), F.expr("substring(mark, 2)").alias("name"))
    more, links = _grown(spark, each.filter("kind = 'a'").select("world", F.lit("x").alias("root"), F.col("name").alias("anchor")), mapped)
    own = each.filter("kind = 'c'").select("world", F.lit("x").alias("s"), F.col("name").alias("c"))
    whole = saturated(own.unionByName(more).withColumnRenamed("world", "anchor"), links.withColumnRenamed("world", "anchor"), o)
    bad = clashes(*whole, o).select("anchor", "one", "other").distinct()
    return found.unionByName(single.join(bad, "anchor").select("s", "one", "other")).distinct()


def consistent(spark: SparkSession, types: DataFrame, edges: DataFrame, classes: list[tuple[str, str]] = (), mapped: list[Mapped] = ()) -> bool:
    """Whether instance data (s, c) and (s, p, o) meet no clash."""
    return data_clashes(spark, types, edges, classes, mapped).isEmpty()
