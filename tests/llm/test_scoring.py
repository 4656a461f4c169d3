import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from semloom.llm import scoring


START = " start"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [START, *re.findall(r"[^\x20\x09-\x0D]+", low), " end"]


def brute(docs, order, strength):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    grams = Counter()
    for i, t in docs:
        if not held(i):
            w = tokens(t)
            grams.update(tuple(w[a : a + k]) for k in range(1, order + 1) for a in range(len(w) - k + 1))
    one = {g: n for g, n in grams.items() if len(g) == 1 and g != (START,)}
    total, types = sum(one.values()), len(one)

    def p(history, w):
        if not history:
            return (grams[(w,)] + 1) / (total + types + 1)
        k = strength[len(history) - 1]
        return (grams[(*history, w)] + k * p(history[1:], w)) / (grams[history] + k)

    out = []
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10(p((), x)) for x in w[1:])
        score = sum(math.log10(p(tuple(w[max(0, a - order + 1) : a]), w[a])) for a in range(1, len(w)))
        out.append((i, held(i), len(w) - 1, sum(grams[(x,)] > 0 for x in w[1:]), total, base, score))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), *(x if x is not None else -1 for x in r[1:5]), round(r[6], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=2e-6) and g[6] == pytest.approx(w[6], abs=2e-6)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(13)
    vocab = ["The", "the", "cat", "É", "é", "\x1c", " x", "of", "<s>", "</s>", "start", "end", "🙂"] + [f"w{k}" for k in range(60)]
    out = [(k, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\x0b\r"]).join(rng.choice(vocab[: rng.choice([6, 73])]) for _ in range(rng.choice([0, 1, 2, 3, 40, 300])))) for k in range(150)]
    copies = [(1000 + k, out[60][1] + " and more of it") for k in range(60)]
    return [*out, *copies, (900, None), (901, ""), (None, "the cat"), (None, None), (5, out[5][1]), (5, out[5][1]), (902, "only here " * 700)]


@pytest.mark.parametrize(("order", "chunk", "bucket"), [(3, 1 << 21, 1 << 20), (3, 400, 300), (2, 900, 2000), (1, 50, 500)])
def test_against_brute_force(spark, docs, order, chunk, bucket):
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, chunk string, score int").repartition(3)
    got = scoring.scores(df, order, (4.0, 0.5), chunk, 1 << 20, bucket)
    same(got.collect(), brute(docs, order, (4.0, 0.5)))


def test_edges(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert scoring.scores(df.limit(0)).count() == 0
    held = df.filter(scoring.held_out())
    rows = scoring.scores(held).collect()
    assert len(rows) == held.count() and all(r.train_tokens == r.n_known == 0 and r.base_score == r.score == 0 for r in rows)
    named = spark.createDataFrame([(None if i is None else f"doc-{i}", t) for i, t in docs[:40]], "doc_id string, text string")
    assert {r.doc_id for r in scoring.scores(named).collect()} == {f"doc-{i}" for i, _ in docs[:40]}
    long = spark.createDataFrame([(3, "one two three " * 200_000), (4, "x" * 2_000_000), (6, "one two")], "doc_id long, text string")
    want = brute([tuple(r) for r in long.collect()], 3, scoring.STRENGTH)
    got = {r.doc_id: r for r in scoring.scores(long, chunk_tokens=5000).collect()}
    assert all(tuple(got[w[0]])[:5] == w[:5] and got[w[0]].score == pytest.approx(w[6], rel=1e-9) for w in want)


def test_probabilities_of_the_next_token_add_up_to_one(docs):
    """Over the known tokens and one that isn't, in every state: walked by the brute-force model's formula."""
    texts = [(i, t) for i, t in docs[:60] if i % 7 != 2]
    grams = Counter()
    for _, t in texts:
        w = tokens(t)
        grams.update(tuple(w[a : a + k]) for k in (1, 2, 3) for a in range(len(w) - k + 1))
    vocab = {g[0] for g in grams if len(g) == 1} - {START}
    total = sum(grams[(w,)] for w in vocab)

    def p(history, w):
        if not history:
            return (grams[(w,)] + 1) / (total + len(vocab) + 1)
        k = scoring.STRENGTH[len(history) - 1]
        return (grams[(*history, w)] + k * p(history[1:], w)) / (grams[history] + k)

    for history in [(), (START,), ("the",), (START, "the"), ("never", "seen"), ("the", "cat")]:
        assert sum(p(history, w) for w in [*vocab, "unknown"]) == pytest.approx(1)


def test_query_agrees_with_sql_and_beats_the_base(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(scoring.ORACLE_SQL)
    names = [c[0] for c in want.description]
    rows = scoring.op13_lm_scoring(spark, d).select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.2
