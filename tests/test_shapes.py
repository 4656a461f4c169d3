import random

from semloom.operators import shapes


def test_many_shapes_at_once_equal_each_alone(spark):
    rng = random.Random(9)
    names = [f"i{k}" for k in range(60)]
    types = [(rng.choice(names), f"C{rng.randrange(6)}") for _ in range(90)]
    values = ["12", "1.5", "x", "2020-02-30", "INF", *names[:20]]
    triples = [(rng.choice(names), f"p{rng.randrange(4)}", rng.choice(values)) for _ in range(200)] + [("i1", "p0", None)]
    closure = [("C0", "C1"), ("C1", "C2"), ("C0", "C2")]
    rows, single = [], []
    for k in range(25):
        path, least = f"p{rng.randrange(4)}", rng.randrange(3)
        datatype, classes = rng.choice([("integer", None), ("date", None), (None, ["C1"]), (None, ["C3", "C4"]), (None, None)])
        target = f"C{rng.randrange(6)}"
        rows.append((target, target, path, least, datatype, classes))
        single.append(shapes.Shape(target, (shapes.Property(path, least, tuple(classes or ()), datatype),)))
    df = spark.createDataFrame(triples, "s string, p string, o string")
    ty, up = spark.createDataFrame(types, "s string, c string"), spark.createDataFrame(closure, "sub string, sup string")
    table = spark.createDataFrame(rows, "shape string, target string, path string, least int, datatype string, classes array<string>")
    for c in (None, up):
        want = set()
        for s in single:
            want |= {tuple(r) for r in shapes.violations(df.filter("o IS NOT NULL"), ty, s, c).select("focus", "path", "kind", "value", "shape").collect()}
        got = [tuple(r) for r in shapes.report(df, ty, table, c).collect()]
        assert len(got) == len(set(got)) and set(got) == want and {r[2] for r in got} >= {"minCount", "datatype", "class", "or"}
    plans = [shapes.report(df, ty, t)._jdf.queryExecution().optimizedPlan().toString().count("\n") for t in (table, table.limit(1))]
    assert abs(plans[0] - plans[1]) < 12
    assert shapes.report(df, ty, table.limit(0)).count() == 0
