import random

from semloom.operators import equality
from semloom.sources import rdf


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"{a:03}", f"{rng.randrange(300):03}") for a in rng.choices(range(300), k=150)] + [(f"x{k:03}", f"x{k + 1:03}") for k in range(100)] + [("hub", f"h{k}") for k in range(200)] + [("a", "a"), (None, "b")]
    got = {r.member: r.representative for r in equality.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = components(p for p in pairs if p[0] is not None)
    assert got == {k: v for k, v in want.items() if k != v}


def brute(triples, functional, inverse):
    names = {}
    while True:
        now = {(names.get(s, s), p, o if lit else names.get(o, o), lit) for s, p, o, lit in triples}
        pairs = [(o, o2) for s, p, o, lit in now for s2, p2, o2, lit2 in now if (s, p) == (s2, p2) and p in functional and not lit and not lit2 and o < o2]
        pairs += [(s, s2) for s, p, o, lit in now for s2, p2, o2, lit2 in now if (o, p) == (o2, p2) and p in inverse and not lit and not lit2 and s < s2]
        if not pairs:
            return {k: v for k, v in names.items() if k != v}, now
        step = components([*pairs, *names.items()])
        names = {x: step.get(x, x) for t in triples for x in (t[0], t[2]) if x in step}


def test_functional_properties_merge_their_values(spark):
    rng = random.Random(4)
    triples = [(f"i{rng.randrange(60)}", rng.choice("fgn"), f"i{rng.randrange(60)}", False) for _ in range(45)]
    triples += [(f"i{rng.randrange(60)}", "f", f"text {rng.randrange(3)}", True) for _ in range(30)] + [("i1", "f", "i2", True)]
    df = spark.createDataFrame(triples, "s string, p string, o string, literal boolean")
    p = lambda *x: spark.createDataFrame([(y,) for y in x], "p string")
    names, facts = equality.same(df, p("f"), p("g"))
    want, now = brute(triples, {"f"}, {"g"})
    assert len(want) > 5 and {r.member: r.representative for r in names.collect() if r.member != r.representative} == want
    assert {tuple(r) for r in facts.collect()} == now
    several = {(s, q) for s, q, o, lit in now if q == "f" and lit and len({x[2] for x in now if x[:2] == (s, q) and x[3]}) > 1}
    assert {(r.s, r.p) for r in equality.literal_clashes(facts, p("f")).collect()} == several and several
    stated = spark.createDataFrame([("z2", "z1"), ("z2", "z3")], "a string, b string")
    names, facts = equality.same(spark.createDataFrame([("z3", "f", "y1", False), ("z1", "f", "y2", False)], df.schema), p("f"), p(), stated)
    assert {r.member: r.representative for r in names.collect()} == {"z2": "z1", "z3": "z1", "y2": "y1"} and [tuple(r) for r in facts.collect()] == [("z1", "f", "y1", False)]
    assert equality.same(df.limit(0), p("f"), p("g"))[0].count() == 0


GRAPH = [
    ("http://x/a", "iri", "p", "_:l1", "blank", None, None), ("_:l1", "blank", "first", "one", "literal", None, None), ("_:l1", "blank", "rest", "_:l2", "blank", None, None),
    ("_:l2", "blank", "first", "one", "literal", "en", None), ("_:l2", "blank", "rest", "http://x/nil", "iri", None, None), ("_:c", "blank", "knows", "_:c", "blank", None, None),
    ("http://x/a", "iri", "q", "_:l1", "literal", None, None),
]


def relabelled(source, names):
    of = lambda x, kind: names.get(x, x) if kind == "blank" else x
    return [(source, of(s, sk), sk, p, of(o, ok), ok, lang, dt) for s, sk, p, o, ok, lang, dt in GRAPH]


def test_merging_relabelled_copies_gives_one(spark):
    schema = "source string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string"
    rows = relabelled("one", {}) + relabelled("two", {"_:l1": "_:l2", "_:l2": "_:zz", "_:c": "_:l1"}) + [("two", "http://x/b", "iri", "p", "more", "literal", None, None)]
    got = [tuple(r) for r in rdf.merged(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(GRAPH) + 1 and len({r[0] for r in got if r[1] == "blank"}) == 3
    assert ("http://x/a", "iri", "q", "_:l1", "literal", None, None) in got
    # nodes of one source that nothing tells apart stay apart, and apart from those of another
    alike = [(src, f"_:{k}", "blank", "p", f"_:{1 - k}", "blank", None, None) for src in ("one", "two") for k in (0, 1)]
    got = rdf.merged(spark.createDataFrame(alike, schema)).collect()
    assert len(got) == 4 and not any(r.s == r.o for r in got)
    assert rdf.merged(spark.createDataFrame([], schema)).count() == 0


def test_rounds_read_no_triples_of_literals(spark, tmp_path):
    """What literals say of a node is counted once: what is written grows with nodes, by two numbers each."""
    schema = "source string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string"
    rows = [("one", f"_:{k}", "blank", "p", str(k % 3), "literal", None, None) for k in range(6)]
    got = rdf.merged(spark.createDataFrame(rows, schema))
    assert got.count() == 6 and all(len(r.s) == 34 for r in got.collect())


SCHEMA = "source string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string"


def told_apart(triples):
    """Classes of the blank nodes (source, label) of triples that rounds over all of them don't tell apart."""
    linked = lambda t: t[2] == t[5] == "blank" and t[1] != t[4]
    own, near = {}, {}
    for t in triples:
        source, s, sk, p, o, ok, lang, dtype = t
        for end, mine, kind, other, other_kind in (("s", s, sk, o, ok), ("o", o, ok, s, sk)):
            if kind == "blank":
                own.setdefault((source, mine), [])
                near.setdefault((source, mine), [])
                if linked(t):
                    near[source, mine].append((end, p, (source, other)))
                else:
                    own[source, mine].append(repr((end, p, "self" if other_kind == "blank" else (other, other_kind), lang, dtype)))
    colour = {n: repr(sorted(x)) for n, x in own.items()}
    while True:
        ids = {c: k for k, c in enumerate(sorted(set(colour.values())))}
        after = {n: repr((ids[c], sorted((e, p, ids[colour[m]]) for e, p, m in near[n]))) for n, c in colour.items()}
        if len(set(after.values())) == len(ids):
            return {n: colour[n] for n in colour}
        colour = after


def brute_merge(triples):
    classes = told_apart(triples)
    count = {}
    for (source, _), c in classes.items():
        count[source, c] = count.get((source, c), 0) + 1
    name = lambda source, x, kind: x if kind != "blank" else classes[source, x] if count[source, classes[source, x]] == 1 else f"{source} {x}"
    return {(name(t[0], t[1], t[2]), t[2], t[3], name(t[0], t[4], t[5]), *t[5:]) for t in triples}


def test_merging_random_graphs_is_as_by_brute_force(spark):
    rng = random.Random(8)
    triples = set()
    for k in range(150):
        size = rng.randrange(1, 6)
        part = set()
        for _ in range(rng.randrange(1, 9)):
            a, b = (f"n{k}_{rng.randrange(size)}" for _ in range(2))
            part.add(rng.choice([(a, "blank", rng.choice("pq"), b, "blank"), (a, "blank", "p", str(rng.randrange(3)), "literal"), ("x", "iri", "q", b, "blank"), (f"x{k % 9}", "iri", "p", "y", "iri")]))
        part = sorted(part)
        for source in ("one", "two", "three"):
            rows = [x for x in part if source == "one" or rng.random() < 0.95]
            relabelled = {f"n{k}_{j}": f"_:{source}{rng.randrange(10**9)}" for j in range(size)}
            triples |= {(source, relabelled.get(s, s), sk, p, relabelled.get(o, o), ok, None, None) for s, sk, p, o, ok in rows}
    # stars and chains, and a leaf that looks like another of its anchor
    for source in ("one", "two"):
        for k in range(6):
            triples |= {(source, f"_:{source}s{k}", "blank", "total", str(k), "literal", None, None)}
            for j in range(k):
                triples |= {(source, f"_:{source}s{k}", "blank", "line", f"_:{source}l{k}_{j}", "blank", None, None), (source, f"_:{source}l{k}_{j}", "blank", "number", str(j % 4), "literal", "en", None)}
            triples |= {(source, f"_:{source}c{j}", "blank", "next", f"_:{source}c{j + 1}", "blank", None, None) for j in range(k)}
    rows = sorted(triples, key=str)
    got = {tuple(r) for r in rdf.merged(spark.createDataFrame(rows + rows[::3], SCHEMA)).collect()}
    want = brute_merge(rows)
    shape = lambda graph: sorted(told_apart([("all", *t) for t in graph]).values())
    nodes = lambda graph: {x for t in graph for x in ((t[0], t[1]), (t[3], t[4])) if x[1] == "blank"}
    assert len(got) == len(want) < len(rows) and len(nodes(got)) == len(nodes(want))
    assert shape(got) == shape(want)
    assert {t for t in got if "blank" not in (t[1], t[4])} == {t for t in want if "blank" not in (t[1], t[4])}


def chain(source, last, n=5):
    typed = [(source, f"_:{k}", "blank", "type", f"T{k}", "iri", None, None) for k in range(n)]
    return typed + [(source, f"_:{k}", "blank", "next", f"_:{k + 1}", "blank", None, None) for k in range(n - 1)] + [(source, f"_:{n - 1}", "blank", "age", last, "literal", None, None)]


def test_nodes_that_differ_far_away_are_not_merged(spark):
    """Each node is known in its source at once, so the sources must be told apart together."""
    assert rdf.merged(spark.createDataFrame(chain("one", "5") + chain("two", "6"), SCHEMA)).count() == 20
    assert rdf.merged(spark.createDataFrame(chain("one", "5") + chain("two", "5"), SCHEMA)).count() == 10
    # what rounds don't settle stays apart
    assert rdf.merged(spark.createDataFrame(chain("one", "5") + chain("two", "6"), SCHEMA), most_rounds=2).count() == 20


def test_nodes_that_hang_from_one_node_need_no_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(rdf, "written", lambda df, whole=rdf.written, **x: tables.append(df.columns) or whole(df, **x))
    star = [x for s in ("one", "two") for k in range(3) for x in [(s, f"_:{s}{k}", "blank", "line", f"_:{s}{k}_{j}", "blank", None, None) for j in range(2)] + [(s, f"_:{s}{k}_{j}", "blank", "number", str(j), "literal", None, None) for j in range(2)] + [(s, f"_:{s}{k}", "blank", "total", str(k), "literal", None, None)]]
    assert rdf.merged(spark.createDataFrame(star, SCHEMA)).count() == 15
    assert len(tables) == 1
