from semloom.sources.catalog import upsert, value_of
from semloom.sources.rdf import parse_ntriples, star


def test_escapes_are_decoded_from_left_to_right(spark):
    cases = {r"C:\\new": "C:\\new", r"a\nb\tc\rd": "a\nb\tc\rd", r"\u00e9\U0001F642": "\u00e9\U0001F642", r"\\u00e9": "\\u00e9", r"say \"x\" \b\f": 'say "x" \b\f', "": ""}
    lines = [(k, f'<s> <p> "{x}"@en .') for k, x in enumerate(cases)]
    got = {r.ord: r.o for r in parse_ntriples(spark.createDataFrame(lines, "ord int, value string")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_optional_values_multiply(spark):
    rows = [("a", "n", "x"), ("a", "q", "1"), ("a", "q", "2"), ("a", "r", "3"), ("a", "r", "4"), ("b", "n", "y"), ("c", "q", "5")]
    got = star(spark.createDataFrame(rows, "s string, p string, o string"), "n", {"q": "q", "r": "r"}).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "1", "3"), ("a", "1", "4"), ("a", "2", "3"), ("a", "2", "4"), ("b", None, None)]


def test_changes_count_and_unbound_keys_are_null(spark):
    old, new = spark.createDataFrame([("k", 9, "old"), ("l", 1, "kept")], "key string, at int, value string"), spark.createDataFrame([("k", 1, "first"), ("k", 2, "change")], "key string, at int, value string")
    out = upsert(old, new, "key", "at")
    assert sorted(map(tuple, out.collect())) == [("k", 2, "change"), ("l", 1, "kept")]
    assert value_of(out, "k").first().value == "change" and value_of(out, "none").first().value is None
