import pytest

from semloom.operators import consistency
from semloom.operators.consistency import Ontology, Saturation, clashes, facts_of, justified, refuted, unsatisfiable, witnesses
from semloom.operators.reasoning import small
from semloom.plans.pattern import Template as T
from semloom.plans.pattern import forward
from tests.test_consistency import BELOW, MODEL, SOUND

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def rows(spark, types, edges):
    return small(spark, types, "anchor string, s string, c string"), small(spark, edges, "anchor string, s string, p string, o string")


def parts(*classes):
    return [T("?this", "hasFeature", "?value"), *(x for k, c in enumerate(classes) for x in (T("?this", "hasPart", f"?o{k}"), T(f"?o{k}", TYPE, c)))]


def test_what_only_cases_refute(spark):
    """A bearer of a feature is an object or a process; an object has no process as a part, a process has only such."""
    anchors = {"both": forward(parts("Process", "SpatialObject"), None), "objects": forward(parts("SpatialObject", "SpatialObject"), None), "processes": forward(parts("Process"), None)}
    got = {r.anchor for r in unsatisfiable(spark, anchors).collect()}
    assert got == {"both"}
    t, e = rows(spark, [("a", "x", "Process"), ("a", "y", "SpatialObject"), ("b", "x", "Process")], [("a", "z", "hasPart", "x"), ("a", "z", "hasPart", "y"), ("a", "z", "hasFeature", "f"), ("b", "z", "hasPart", "x"), ("b", "z", "hasFeature", "f")])
    o = Ontology(spark)
    assert not {r.anchor for r in clashes(*consistency.saturated(t, e, o), o).collect()}
    out, proofs = refuted(t, e, o, trace=True)
    assert {r.anchor for r in out.collect()} == {"a"}
    steps = [r for r in justified(proofs).collect() if r.anchor == "a"]
    assert {r.given for r in steps} == {"z is Object", "z is Process"} and {r.rule for r in steps} >= {"clash", "only"}
    # in world b a single case is left, and becomes a fact
    assert ("b", "z", TYPE, "Process") in {(r.anchor, r.s, r.p, r.o) for s, _ in proofs for r in s.facts.collect()}


def test_a_case_that_leads_to_the_next(spark):
    types = [("n", "p", "Process"), ("n", "q", "SpatialObject")]
    edges = [("n", "z", "hasFeature", "f"), ("n", "z", "hasPart", "p"), ("n", "w", "hasFeature", "g"), ("n", "w", "hasPart", "z"), ("n", "w", "hasPart", "q")]
    out, proofs = refuted(*rows(spark, types, edges), Ontology(spark))
    assert [r.anchor for r in out.collect()] == ["n"]


def test_each_faulty_anchor_comes_with_its_proof(spark):
    anchors = {f"{k} {m.name} {side}": x for k, m in enumerate(MODEL) for side, x in (("domain", m.domain), ("range", m.range)) if x}
    t, e = rows(spark, *witnesses(anchors))
    o = Ontology(spark, BELOW)
    out, proofs = refuted(t, e, o, trace=True)
    bad = {r.anchor for r in out.collect()}
    steps = justified(proofs).collect()
    assert len(bad) == 44 and {r.anchor for r in steps} == bad and not any(int(a.split()[0]) < len(SOUND) for a in bad)
    given = {tuple(r) for r in facts_of(t, e).collect()}
    for a in bad:
        mine = [r for r in steps if r.anchor == a]
        assert sum(r.rule == "clash" for r in mine) == 1 and len(mine) < 40
        # what is given is in the pattern; what is derived comes with its axiom
        assert all((r.anchor, r.s, r.p, r.o) in given for r in mine if r.rule == "given") and all(r.axiom for r in mine if r.rule != "given")
        assert any(r.rule == "given" for r in mine)
    # a proof's given facts are enough for the contradiction
    least = [(r.anchor, r.s, r.p, r.o) for r in steps if r.rule == "given"]
    t1, e1 = rows(spark, [(a, s, x) for a, s, p, x in least if p == TYPE], [f for f in least if f[2] != TYPE])
    assert {r.anchor for r in clashes(*consistency.saturated(t1, e1, o), o).collect()} == bad


def test_a_round_derives_what_is_new_only(spark):
    """A chain of parts: facts of each round are new, and their number is that of the naive closure."""
    n = 12
    edges = [("a", f"x{k}", "hasDirectPart", f"x{k + 1}") for k in range(n)]
    s = Saturation(facts_of(*rows(spark, [("a", "x0", "SpatialObject")], edges)), Ontology(spark))
    tables = [t.collect() for t in s.tables]
    every = [tuple(r) for t in tables for r in t]
    assert len(every) == len(set(every)) and s.rounds < 12
    pairs = n * (n + 1) // 2
    found = {p: sum(1 for r in every if r[2] == p) for p in ("hasPart", "contains", "isPartOf", "isIn", "hasDirectPart", "isDirectPartOf")}
    assert found == {"hasPart": pairs, "contains": pairs, "isPartOf": pairs, "isIn": pairs, "hasDirectPart": n, "isDirectPartOf": n}
    assert {r[1] for r in every if r[2] == TYPE and r[3] == "SpatialObject"} == {f"x{k}" for k in range(n + 1)}


def test_axioms_of_a_model_inside_the_rounds(spark):
    classes = [("Male", "Person"), ("Visit", "Process"), ("Person", "SpatialObject"), ("Cat", "Animal"), ("Dog", "Animal")]
    wholes = [("Father", "Male"), ("Father", "Parent")]
    exists = [("Father", "hasChild", "Person"), ("Person", "hasParent", "Person"), ("Ward", "hasPart", "Visit"), ("Ward", "hasPart", "Visit")]
    o = Ontology(spark, classes, wholes, exists)
    t, e = rows(spark, [("w", "p", "Male"), ("w", "p", "Parent"), ("w", "q", "Male"), ("w", "c", "Cat"), ("v", "r", "Ward"), ("v", "r", "SpatialObject"), ("u", "r", "Ward")], [("w", "q", "hasParent", "p")])
    s = Saturation(facts_of(t, e), o)
    facts = {(r.anchor, r.s, r.p, r.o) for r in s.facts.collect()}
    assert ("w", "p", TYPE, "Father") in facts and ("w", "q", TYPE, "Father") not in facts and ("w", "c", TYPE, "Animal") in facts
    assert ("w", "p", "hasChild", "p#hasChild:Person") in facts and ("w", "p#hasChild:Person", TYPE, "SpatialObject") in facts
    # a cyclic axiom ends: no value is made for what a value of the same axiom was made for, nor where there is one
    assert ("w", "p", "hasParent", "p#hasParent:Person") in facts and not any("#hasParent:Person#hasParent" in f[1] for f in facts)
    assert not any(f[:3] == ("w", "q", "hasParent") and "#" in f[3] for f in facts)
    # an object that must have a process as a part
    assert {r.anchor for r in clashes(s.types, s.edges, o).collect()} == {"v"}


@pytest.mark.parametrize("empty", ["types", "edges"])
def test_empty_tables(spark, empty):
    t, e = rows(spark, [("a", "x", "Process")], [("a", "x", "atTime", "y")])
    t, e = (t.limit(0), e) if empty == "types" else (t, e.limit(0))
    out, proofs = refuted(t, e, Ontology(spark), trace=True)
    assert out.count() == 0 and justified(proofs).count() == 0
