import zlib
from collections import defaultdict

import numpy as np

from semloom.llm import packing, tokens


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for window, n in ((64, 5000), (64, 3), (1024, 20000)):
        histogram = np.bincount(rng.integers(1, window, n), minlength=window + 1)
        used = np.zeros_like(histogram)
        padding = 0
        for lengths, k in packing.plan(histogram, window):
            assert sum(lengths) <= window
            padding += k * (window - sum(lengths))
            for v in lengths:
                used[v] += k
        assert (used == histogram).all()
        if n > 1000:
            assert padding < 0.02 * (np.arange(window + 1) * histogram).sum()


def test_pieces_round_trip(spark):
    rows = [(i, " ".join(f"w{i * j % 997}" for j in range(i * 37 % 1500))) for i in range(60)] + [(7, None), (None, ""), (8, "a b"), (8, "a b")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string").repartition(3)
    got = packing.pack(df).collect()
    tokenizer = tokens.load()
    want, want_n = defaultdict(int), 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want_n += len(ids)
        for s in range(0, len(ids), 1024):
            want[(i, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], dtype="<u4").tobytes()), len(ids))] += 1
    have = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        have[tuple(r)[:5]] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want and sum(r.length for r in got) == want_n
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(df.limit(0)).count() == 0


def test_the_solution_packs_most_remainders_of_real_texts():
    import pyarrow.parquet as pq

    encode = tokens.Encoder()
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    sizes = [len(encode(t)) // 4 + 1 for t in texts]
    histogram = np.bincount([n % 1024 for n in sizes if n % 1024], minlength=1025)
    left = histogram.copy()
    packing.solution(left, 1024)
    assert left.sum() <= 0.2 * histogram.sum()
    sequences = sum(n // 1024 for n in sizes) + sum(n for _, n in packing.plan(histogram))
    assert sequences <= 1.011 * (sum(sizes) / 1024), sequences


def test_the_solver_comes_near_a_histogram_that_combos_fill():
    rng, combos = np.random.default_rng(7), packing.combinations(48)
    some = rng.choice(len(combos), 20, replace=False)
    histogram = np.zeros(49)
    for c in some:
        for v in combos[c]:
            histogram[v] += 50 * (v > 0)
    x = packing.solve(histogram, combos)
    made = sum(np.bincount(combos[:, k], weights=x, minlength=49) for k in range(3))
    weight = (np.arange(49) / 48) ** packing.POWER
    assert (x >= 0).all() and (x > 0).sum() <= 48
    assert ((weight * (made - histogram)) ** 2).sum() <= 1e-3 * ((weight * histogram) ** 2).sum()
