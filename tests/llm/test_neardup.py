import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from semloom.llm import neardup
from semloom.llm.neardup import near_duplicates


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        k = min(5, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low = min(comp[a], comp[b])
                    comp = {k: low if v in (comp[a], comp[b]) else v for k, v in comp.items()}
                    changed = True
    return {(i, len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["É", "é", "a b"]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 977, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(2001, None), (2002, ""), (2003, " \n "), (2004, "One"), (2005, "one"), (2006, "a b c d e"), (2007, "A B C D E F")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_large_groups_in_small_blocks(spark, monkeypatch):
    """Chains of near copies, which share keys with many and links with their neighbours only, compared block by block."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng, rows = random.Random(5), []
    for g in range(3):
        text = [f"g{g}w{k}" for k in range(150)]
        for _ in range(40):
            rows.append((rng.randrange(1 << 40), " ".join(text)))
            for _ in range(rng.choice([1, 2, 3, 4])):
                text[rng.randrange(150)] = f"g{g}n{rng.randrange(1000)}"
    rng.shuffle(rows)
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert len({r[2] for r in want}) < len(rows) / 2
    assert got == want


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_shingles string, component_id int")
    assert near_duplicates(empty).count() == 0
    rows = [(1, "x y z", 0), (1, "x y z", 0), (None, "x y z", 0), (3, "X Y Z", 0), (None, None, 0)]
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, id int")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False), (None, 1, None, None), (None, 0, None, None)], key=str)


def test_texts_that_share_an_id(spark):
    """Links are found by any of an id's texts, whichever row comes first."""
    one, other = ([f"{k}{i}" for i in range(80)] for k in "ab")
    near = lambda w: " ".join([*w[:40], "changed", *w[41:]])
    rows = [(1, " ".join(one)), (1, " ".join(other)), (2, near(one)), (3, near(other)), (4, "x y z")]
    for some in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(some, "doc_id long, text string").coalesce(1)).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_every_pair_that_shares_a_table_is_compared(spark):
    rng, make, rows, want = np.random.default_rng(8), neardup.MinHashes(), [], set()
    for _ in range(4000):  # pairs of similarity 0.75 to 0.8; those stay in which different minhashes look alike by a byte
        both = 2 * int(rng.integers(86, 89))
        own = (200 - both) // 2
        x = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64)
        pair, low, made = (np.sort(x[: both + own]), np.sort(np.concatenate([x[:both], x[both + own :]]))), [], []
        for s in pair:
            least = (((s >> np.uint64(32)).astype(np.uint32)[None, :] ^ make.b) * make.a).min(axis=1)
            low.append((least & 255).reshape(2, neardup.HALVES, neardup.ROWS))
            made.append(make(s))
        keys = [np.array([a, b]) for a, b, _ in made]
        if ((low[0] == low[1]).all(axis=2) & (keys[0] != keys[1])).any() and (keys[0] == keys[1]).any(axis=1).all():
            want.add((len(rows), len(rows) + 1))
            rows += [(len(rows) + k, len(s), a.tolist(), b.tolist(), sketch) for k, (s, (a, b, sketch)) in enumerate(zip(pair, made))]
    classes = neardup.materialise(spark.createDataFrame(pd.DataFrame(rows, columns=["id", "n_shingles", "a", "b", "sketch"]), "id long, n_shingles long, a array<long>, b array<long>, sketch binary"), "test")
    keys = neardup._tables(classes, neardup.HALVES)
    members = keys.join(keys.groupBy("key").agg(F.min("id").alias("main"), F.max("id").alias("most")).filter("main < most").drop("most"), "key").withColumn("component", F.col("id"))
    got = {(r.src, r.dst) for r in neardup.compared(members, classes, neardup.ROWS, neardup.HALVES).collect()}
    assert len(want) > 10 and want <= got, (len(want), len(want - got))
