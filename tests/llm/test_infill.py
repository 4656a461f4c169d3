import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from semloom.llm import infill


def brute(i, text, unit=None):
    text = text or ""
    units = unit(text) if unit else list(text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text)
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def rows():
    rng = random.Random(12)
    bits = ["a", "é", "🙂", "\x01", "\x02", "\x02a", "\x02b", "\n", "\r\n", "<", "<P", "S>", "$1", "\\", " ", "漢", "e\u0301", "\u2028", "\x00"]
    out = [(k, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 3, 9, 80])))) for k in range(400)]
    out += [(900, None), (901, ""), (902, "x<P>y"), (903, "<M>"), (None, "null id"), (5, out[5][1]), (5, out[5][1]), (904, "ab\x01" * 60_000), (905, "🙂" * 100_000)]
    return out


def test_against_brute_force_and_back(spark):
    docs = spark.createDataFrame([(i, t, "keep", 7) for i, t in rows()], "doc_id long, text string, _h string, n int")
    for unit, cut in ((infill.CODE_POINT, None), (infill.LINE, lambda t: [*_lines(t)])):
        got = infill.transformed(docs, unit=unit)
        back = got.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_units", "middle_units", "output")) for r in back), key=str) == sorted((brute(i, t, cut) for i, t in rows()), key=str)
        assert all(r.back == r.text and r["_h"] == "keep" for r in back)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert infill.transformed(docs.limit(0)).count() == 0


def _lines(text):
    at = 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        yield text[at:end]
        at = end


def test_query_and_sql_agree(spark):
    d = "/root/testdata/sf0.01"
    got = infill.op12_fill_in_middle(spark, d)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(infill.ORACLE_SQL)
    names = [c[0] for c in want.description]
    rows = got.select(*names).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)
    assert all(r.restored_sha256 for r in rows)
