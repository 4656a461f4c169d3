import random

import numpy as np

from semloom.llm import language


def test_vectors_are_bound_and_bundled():
    ids, counts, letter = language.trigrams("ab  AB!")
    assert letter and sorted(counts) == [1, 2, 2]  # "b a", and twice " ab" and "ab "
    assert not language.trigrams(" 12 .")[2] and not language.trigrams(None)[2]
    both, _ = language.encoded(["the cat", "THE CAT", "1", None])
    assert np.allclose(both[0], both[1]) and abs(np.linalg.norm(both[0]) - 1) < 1e-5 and not both[2].any() and not both[3].any()
    long = "aé b" * 600_000
    step = language._STEP
    ids, counts, _ = language.trigrams(long)
    language._STEP = 1 << 30
    try:
        assert all((x == y).all() for x, y in zip((ids, counts), language.trigrams(long)))
    finally:
        language._STEP = step


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    parts = {"xx": ["the", "ing", "tion", "er"], "yy": ["que", "éau", "le", "ment"], "zz": ["sch", "ung", "ei", "ß"]}
    rows = []
    for i in range(300):
        lang = "xyz"[i % 3] * 2
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(40)), lang))
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "12 !!", None), (None, rows[0][1], None), (5, rows[5][1], "yy"), (5, rows[5][1], "yy")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.identify(df, per_language=50).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:300]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", df.lang.substr(9, 1).cast("string")).filter("lang IS NULL")).collect()} <= {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_held_out_accuracy_on_given_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").filter("lang IS NOT NULL").collect()}
    held = [r for r in language.op6_language_id(spark, d).collect() if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98


def plain_vector(text):
    """The bundle of a text's trigrams, each bound on its own from the letters' rotated vectors."""
    letters, symbols = language._letters()[2].astype(np.float64), language._symbols()
    runs = [0]
    for c in text or "":
        x = int(symbols[ord(c)])
        if x or runs[-1]:
            runs.append(x)
    runs += [0] if runs[-1] else []
    out = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(runs, runs[1:], runs[2:]):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out / max(np.linalg.norm(out), 1e-12) if any(runs) else np.zeros(language.DIMENSIONS)


def test_against_brute_force_on_given_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", language.held_out().alias("held")).collect()
    vectors = {id(r): plain_vector(r.text) for r in rows}
    sums = {}
    for r in rows:
        if not r.held and r.lang is not None and r.text is not None:
            sums[r.lang] = sums.get(r.lang, 0) + vectors[id(r)]
    want = {}
    for r in rows:
        scores = {lang: float(vectors[id(r)] @ v / np.linalg.norm(v)) for lang, v in sums.items()}
        best = min(scores, key=lambda lang: (-scores[lang], lang))
        known = any(c.isalpha() for c in r.text or "")
        want.setdefault(r.doc_id, []).append((r.held, best if known else "und", min(1, max(0, scores[best])) if known else 0.0))
    got = language.op6_language_id(spark, d).collect()
    assert len(got) == len(rows) >= 100
    for r in got:
        assert any(r.held_out == h and r.lang_pred == lang and abs(r.score - score) < 1e-4 for h, lang, score in want[r.doc_id]), r
