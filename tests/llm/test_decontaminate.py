import hashlib
import random
import re

from semloom.llm.decontaminate import contamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(10, len(b))
            for s in range(len(b) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["The", "cat", "É", "x1", "of", "z"]
    text = lambda n: " ,".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([1, 3, 6, 9, 10, 11, 25, 40, 0])] + [(50, None), (None, "Only Once Here")]
    items[0] = (0, "unique")
    docs = [(k, text(rng.choice([0, 5, 12, 60, 300]))) for k in range(30)]
    docs += [(90 + k, f"{text(7)}. {t or ''} {text(20)}") for k, (_, t) in enumerate(items)]
    docs += [(200, None), (None, items[6][1]), (201, items[7][1].upper()), (201, items[7][1].upper()), (202, "only once-here")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 0):
        assert sorted(map(tuple, contamination(d, b, most=most).collect()), key=str) == sorted(brute(docs, items), key=str)
    assert contamination(d, b.limit(0)).filter("contaminated").count() == 0
    assert contamination(d.limit(0), b).count() == 0


def test_many_copies_of_a_text_and_repeated_passages(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(30))
    items = [(1, passage), (2, "Other words " * 8)]
    copy, clean = f"start {passage} middle {passage} end", "nothing of it " * 40
    docs = [(k, copy) for k in range(300)] + [(1000 + k, clean) for k in range(300)] + [(2000, passage + " other words" * 5)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r) for r in contamination(d, b).collect()}
    want = {r[0]: r for r in brute([(0, copy), (1000, clean), (2000, docs[-1][1])], items)}
    assert len(got) == len(docs)
    for i, row in got.items():
        assert row[1:] == want[0 if i < 1000 else 1000 if i < 2000 else 2000][1:]


def test_with_and_without_ansi_mode(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "nothing here"), (4, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two")], "item_id long, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(docs, items).collect()}
            assert got == {1: (0, 0, 0, False), 2: (0, 0, 0, False), 3: (2, 0, 0, False), 4: (2, 2, 1, True)}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_items_of_one_to_twelve_words_and_short_documents(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(k, f"w{k} {text(k - 1)}" if k % 2 else text(k)) for k in range(1, 13)]
    docs = [(k, text(k % 15)) for k in range(60)] + [(100 + k, f"{text(k)} {t} {text(9)}") for k, t in items] + [(200 + k, t) for k, t in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            for most in (1 << 20, 0):
                assert sorted(map(tuple, contamination(d, b, most=most).collect())) == sorted(brute(docs, items))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_texts_are_read_twice_whatever_the_number_of_window_sizes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from semloom.llm import decontaminate

    spoken, words = [], decontaminate._words
    monkeypatch.setattr(decontaminate, "_words", lambda text: spoken.append(1) or words(text))
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    counts = []
    for n in (1, 5):
        items = spark.createDataFrame([(k, "a b c d e f"[: 2 * k + 1]) for k in range(n)], "item_id long, text string")
        spoken.clear()
        assert contamination(docs, items).filter("contaminated").count() == 5
        counts.append(len(spoken))
    assert counts[0] == counts[1]
