from semloom.operators import consistency
from semloom.plans.pattern import Template, backward, forward

one = [Template("?this", "hasPart", "?value")]
MAPPED = [consistency.Mapped("dose", forward(one, "Quantity", "Order"), backward(one, "Order", "Quantity"))]
CLASSES = [("Order", "Process")]


def test_individuals_with_the_same_types_and_trees_are_followed_once(spark, monkeypatch):
    seen = []
    whole = consistency.saturated
    monkeypatch.setattr(consistency, "saturated", lambda t, e, o: (seen.append(t.select("anchor").distinct().count()), whole(t, e, o))[1])
    types = spark.createDataFrame([(f"s{k}", "Order") for k in range(9)], "s string, c string")
    edges = spark.createDataFrame([("s0", "dose", "d"), ("s1", "dose", "d"), ("s2", "hasPart", "q")], "s string, p string, o string")
    stated = types.unionByName(spark.createDataFrame([("q", "Quantity")], types.schema))
    found = {r.s for r in consistency.data_clashes(spark, stated, edges, CLASSES, MAPPED).collect()}
    # s2 and q are tied by an edge of the ontology; s0 and s1 are one world, d one, and the others one
    assert found == {"s0", "s1", "d", "q"}
    assert seen == [1, 3]


def test_anchors_of_a_kind_have_one_world(spark):
    types = spark.createDataFrame([(a, f"{a}:-1", "Process") for a in ("a", "b", "c")] + [("c", "c:-1", "Object")], "anchor string, s string, c string")
    edges = spark.createDataFrame([(a, f"{a}:-1", "hasPart", f"{a}:0") for a in ("a", "b", "c")], "anchor string, s string, p string, o string")
    t, e, members = consistency.alike(types, edges)
    assert {(r.anchor, r.same) for r in members.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert t.count() == 3 and e.count() == 2
