import random

import numpy as np

from semloom.llm import quality


def test_fit_recovers_an_order():
    rng = np.random.default_rng(0)
    x = [np.array([1, 2 + k % 3], dtype=np.int32) for k in range(900)]
    v = [np.array([1.0, 1.0], dtype=np.float32)] * 900
    grade = np.array([min(2, max(0, (k % 3) + (rng.random() < 0.1) - (rng.random() < 0.1))) for k in range(900)], dtype=float)
    model = quality.fit(x, v, grade)
    assert list(model.grades) == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    tails = model.tails(np.array([model.weights[1] + model.weights[2 + k] for k in range(3)]))
    assert (np.diff(tails[:, 0]) > 0).all() and (np.diff(tails[:, 1]) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()


def test_held_out_and_edges(spark):
    rng = random.Random(1)
    good, bad = [f"good{i}" for i in range(60)], ["scum", "trash"]
    docs, rated = [], []
    for i in range(400):
        toxic, low = i % 5 == 0, i % 4 == 0
        words = [rng.choice(good) for _ in range(rng.randrange(20, 200))]
        words = [w if rng.random() > 0.1 else rng.choice(bad) for w in words] if toxic else words
        words = [w.upper() + "!!" for w in words] if low else words
        docs.append((i, " ".join(words), 1.5))
        if i < 300:
            rated.append((i, int(not low), int(toxic)))
    docs += [(900, None, 0.0), (901, "", 0.0), (None, "good1 good2", 0.0), (1, docs[1][1], 0.0), (1, docs[1][1], 0.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, grade double")
    r = quality.ratings(spark.createDataFrame(rated + [(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    rows = quality.assess(d, r).collect()
    assert len(rows) == len(docs)
    clean = [x.kept for x in rows if x.doc_id and x.doc_id >= 300 and x.doc_id < 400 and x.doc_id % 5 and x.doc_id % 4]
    rest = [x.kept for x in rows if x.doc_id and 300 <= x.doc_id < 400 and not (x.doc_id % 5 and x.doc_id % 4)]
    assert np.mean(clean) > 0.95 and np.mean(rest) < 0.1
    assert all(0 <= x.expected_grade <= 2 and 0 <= x.tail_probability <= 1 for x in rows)
    assert all(x.kept for x in quality.assess(d, r.limit(0)).collect())
    assert quality.assess(d.limit(0), r).count() == 0


def test_whole_words_and_unspaced_texts_are_read():
    features = quality.Features()

    def differ(one, other):
        (i, v), (j, w) = features(one), features(other)
        return dict(zip(i.tolist(), v.tolist())) != dict(zip(j.tolist(), w.tolist()))

    assert differ("assassin", "assassinate")
    assert differ("harmlesscompound", "harmlesspoisoned")
    assert differ("\u6587" * 100 + "\u597d\u4eba", "\u6587" * 100 + "\u574f\u4eba")
    assert differ("x" * 100 + "good", "x" * 100 + "evil") and differ("a" * 70, "a" * 70 + "1")
    for text in ("\u6587\u5b57\u5f88\u597d" * 500, "\u0e01\u0e02\u0e04" * 9, "\u6587", "https://" + "abc" * 50):
        _, v = features(text)
        assert np.isclose((v**2).sum(), 6)  # three beginnings, the shape, the n-grams together and no repeat


def test_repeats_of_a_rated_document_change_no_weight(spark):
    docs = [(i, f"good{i % 7} word{i % 3} " * 20 if i % 2 else f"bad{i % 5} word{i % 3} " * 20) for i in range(60)]
    rated = spark.createDataFrame([(i, float(i % 2)) for i in range(60)], "doc_id long, grade double")
    once, often = (spark.createDataFrame(docs + docs[:1] * n, "doc_id long, text string").repartition(3) for n in (0, 500))
    one, other = quality.train(once, rated), quality.train(often, rated)
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.thresholds, other.thresholds)


def test_scores_of_given_documents_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rated = quality.ratings(labels)
    model, features = quality.train(docs.select("doc_id", "text"), rated), quality.Features()
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id: r.grade == 2 for r in rated.collect()}
    rows = quality.op1_quality_classifier(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i, v = features(texts[r.doc_id])
        score = sum(model.weights[a] * b for a, b in zip(i, v))
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert np.isclose(r.tail_probability, tails[-1], atol=1e-4) and np.isclose(r.expected_grade, sum(tails), atol=1e-3)
    train, test = (rated.filter(f"pmod(hash(doc_id), 2) = {k}") for k in (0, 1))
    kept = {r.doc_id: r.kept for r in quality.assess(docs, train).collect()}
    held = [kept[r.doc_id] == good[r.doc_id] for r in test.collect() if r.doc_id in kept]
    assert len(held) > 20 and np.mean(held) > 0.75
