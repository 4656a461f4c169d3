from semloom.operators import concepts, reasoning


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _dealt_first(plan: str) -> bool:
    """Whether no aggregate stands below the lowest exchange."""
    return plan.rindex("Aggregate(") < plan.rindex("Exchange hashpartitioning")


def test_axioms_go_to_the_triples(spark):
    triples = spark.range(100).selectExpr("'s' || id AS s", "IF(id % 2 = 0, 'p', 'q') AS p", "'o' || id % 5 AS o")
    axioms = reasoning.small(spark, [("p", "C"), ("q", "D")], "p string, c string")
    for infer, n in ((reasoning.infer_domain, 100), (reasoning.infer_range, 10)):
        found = infer(triples.unionByName(triples), axioms)
        assert found.count() == n
        plan = _plan(infer(triples, axioms))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert _dealt_first(plan)


def test_concepts_are_sorted_after_they_are_dealt(spark):
    triples = spark.range(10).selectExpr("id AS ord", "'s' || id % 2 AS s", "'iri' AS s_kind", "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p", "'http://www.w3.org/2002/07/owl#Class' AS o", "'en' AS o_lang")
    found = concepts.concepts(triples)
    assert sorted(r.iri for r in found.collect()) == ["s0", "s1"]
    assert _dealt_first(_plan(concepts.concepts(triples)))
