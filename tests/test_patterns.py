import pytest

from semloom.model import TYPE
from semloom.plans.pattern import THING, All, Named, Some, Template, backward, evaluate, forward, turtle

T = Template
CHAIN = [T("?this", "hasParticipant", "?o1"), T("?o1", TYPE, "Role"), T("?o1", "isFeatureOf", "?value")]


def test_expressions():
    assert forward([], "C") == THING
    assert forward([T("?this", "hasValue", "?value")], "xsd:string") == Some("hasValue", Named("xsd:string"))
    assert forward(CHAIN, "C") == Some("hasParticipant", All((Named("Role"), Some("isFeatureOf", Named("C")))))
    assert backward(CHAIN, "D", "C") == All((Named("C"), Some("isFeatureOf", All((Named("Role"), Some("hasParticipant", Named("D"), True))), True)))
    meets = [T("?this", "p", "?o1"), T("?o1", "q", "?o2"), T("?o3", "r", "?o2"), T("?o3", "s", "?value")]
    assert forward(meets, "C") == Some("p", Some("q", Some("r", Some("s", Named("C")), True)))
    assert turtle(THING, {}) == "owl:Thing"
    assert "owl:inverseOf" in turtle(backward(CHAIN, "http://x/D"), {"x": "http://x/"})


def test_evaluation(spark):
    rows = [("a", "hasParticipant", "r1"), ("r1", TYPE, "Role"), ("r1", "isFeatureOf", "c"), ("b", "hasParticipant", "r2"), ("r2", "isFeatureOf", "c"), ("a", "hasParticipant", "r1")]
    view = spark.createDataFrame(rows, "s string, p string, o string")
    assert [tuple(r) for r in evaluate(CHAIN, view).collect()] == [("a", "c")]
    assert {tuple(r) for r in evaluate(CHAIN[:1] + CHAIN[2:] + [T("?this", "", "?o4")], view).collect()} == {("a", "c"), ("b", "c")}
    with pytest.raises(ValueError):
        evaluate([T("?this", "p", "?o1"), T("?o2", "q", "?value")], view)


def test_only_needed_columns_are_read(spark):
    from semloom.catalogue import PATTERNS
    from semloom.plans.abox import View

    plan = evaluate(PATTERNS["role_bearer"], View(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "Union" not in plan  # the type of a role goes without saying


def test_pairs_of_many_to_many_are_distinct_without_a_shuffle_of_all(spark, tmp_path):
    from semloom.catalogue import PATTERNS
    from semloom.plans.abox import View

    spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 7), (2, 8), (2, 8)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5, 7), (5, 8), (6, 7), (6, 7), (9, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = evaluate(PATTERNS["convergent"], View(spark, str(tmp_path)))
    assert sorted(map(tuple, pairs.collect())) == [("orders/1", "supplier/5"), ("orders/1", "supplier/6"), ("orders/2", "supplier/5"), ("orders/2", "supplier/6")]
    assert pairs._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_a_task_makes_the_pairs_of_few_meeting_points(spark, tmp_path):
    from pyspark.sql import functions as F

    from semloom.catalogue import PATTERNS
    from semloom.plans.abox import View

    spark.range(200).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).selectExpr("id AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(30).selectExpr("id AS s_suppkey", "CAST(id % 5 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = evaluate(PATTERNS["convergent"], View(spark, str(tmp_path))).select(F.spark_partition_id(), "this", "value").collect()
    assert len({r[1:] for r in rows}) == len(rows) == 200 * 6
    met = {(part, int(this.split("/")[1]) % 5) for part, this, _ in rows}
    assert len({part for part, _ in met}) == 4 and len(met) <= 5 + 4 - 1
