import random
import re
from collections import Counter
from itertools import permutations

import duckdb

from semloom.llm import audit


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = Counter()
    for i, text, source in docs:
        text, part = text or "", source or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)),
            i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        )) if x}
        for order in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order):
                key = (part, "".join(order), k + 1)
                hit = f in fails
                for name, x in (("kept", not gone and not hit), ("removed", not gone and hit), ("redundant", gone and hit), ("unique_fails", fails == {f}), ("good_lost", not gone and hit and i in good), ("toxic_lost", not gone and hit and i in toxic)):
                    out[key, name] += x
                out[part, f] += not gone and hit
                gone |= hit
    keys = {k[0] for k in out if isinstance(k[0], tuple)}
    return sorted((*k, *(out[k, n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), out[k[0], k[1][k[2] - 1]]) for k in keys)


def text(rng):
    vocab = ["a", "B", "cé", "#x", " y", "Zed", "🙂"] + [f"w{k}" for k in range(rng.choice([0, 5, 400]))]
    return rng.choice(["", " \t", "\x1c"]) + rng.choice([" ", "\n", "\x0b", "  "]).join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 199, 200, 260])))


def test_against_brute_force(spark):
    rng = random.Random(11)
    docs = [(k, text(rng), rng.choice(["s1", "s1", "s2", "", None])) for k in range(120)]
    copy, other = text(rng), text(rng)
    docs += [(k, copy, "s1") for k in range(500, 560)] + [(k, other, None) for k in rng.sample(range(600, 700), 30)]
    docs += [(None, copy, "s2"), (None, copy, "s2"), (800, None, "s2"), (801, "", "s2"), (802, None, "s3"), (500, copy, "s1"), (499, copy, "s9"), (499, copy, "s9"), (None, "lone", "s9"), (0, docs[5][1], "s2")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in rng.sample(range(700), 300)] + [(500, 1, 0), (500, 0, 1), (None, 1, 1)]
    rng.shuffle(docs)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, source string, mask int, part string")
    la = spark.createDataFrame([(*r, "good") for r in labels], "doc_id long, quality int, toxic int, good string")
    want = brute(docs, labels)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for n in ("1", "4", "67"):  # runs of copies end within a range, and go through several
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert sorted(map(tuple, audit.audit(d, la).select(*names).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert audit.audit(d.limit(0), la).count() == 0
    none = audit.audit(d, la.limit(0)).collect()
    assert len(none) == len(want) and not any(r.good_lost or r.toxic_lost for r in none)


def test_masks_of_long_texts():
    long = "Word " * 400_000
    assert audit.text_mask(long) == 2 | 4 and audit.text_mask("x" * 3_000_000) == 1 and audit.text_mask("") == 1


def test_query_and_sql_agree(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(audit.ORACLE_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, audit.op11_filter_audit(spark, d).select(*names).collect())) == sorted(want.fetchall())
