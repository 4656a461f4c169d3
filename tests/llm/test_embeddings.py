import numpy as np

from semloom.llm import embeddings


def brute(rows):
    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in ok if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.9} for i in ok}
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((i, len(links.get(i, ())), None if i is None else min(seen), None if i is None else min(seen) == i))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, key string")


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(25):
        base = rng.standard_normal(16)
        rows += [(len(rows) + k, (base + rng.standard_normal(16) * 0.25).tolist()) for k in range(8)]
    rows = [(int(i * 7919 % 1009), v) for i, v in rows]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0] * 15 + [float("nan")]), (5004, [1.0] * 15 + [None]), (5005, rows[0][1]), (5006, rows[0][1]), (5007, rows[0][1][:8]), (5008, [1e-30] * 16), (5009, [3e38] * 16), (None, rows[0][1])]
    rows += [rows[3]]
    for block in (1024, 3):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = sorted(map(tuple, embeddings.near_duplicates(table(spark, rows)).collect()), key=str)
        assert got == sorted(brute(rows), key=str)
    assert embeddings.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_vectors_that_share_an_id_are_compared_each(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    near = lambda v: (v + rng.standard_normal(16) * 0.02).tolist()
    rows = [(7, near(a)), (7, near(b)), (9, near(a)), (4, near(b)), (7, None), (8, near(-a))]
    rows += [rows[0]]
    got = sorted(map(tuple, embeddings.near_duplicates(table(spark, rows)).collect()))
    assert got == [(4, 1, 4, True), (7, 0, 7, True), (7, 1, 4, False), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True), (9, 1, 7, False)]


def test_a_dense_group_is_sent_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for spread in (0.1, 0.2):
        base = rng.standard_normal(32)
        rows += [(len(rows) + i, (base + rng.standard_normal(32) * spread).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(32).tolist()) for i in range(100)]
    sent, regrouped = [], embeddings._regrouped

    def counted(met):
        out = regrouped(met)
        sent.append((met.count(), out.count(), out.select("id").distinct().count()))
        return out

    monkeypatch.setattr(embeddings, "_regrouped", counted)
    want = sorted(brute(rows))
    for block in (8192, 100):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        assert sorted(map(tuple, embeddings.near_duplicates(table(spark, rows).repartition(3)).collect())) == want
    (before, after, ids), (_, cut, _) = sent
    assert before > 3 * ids and after <= 1.1 * ids and after < cut < before


def test_layout_keeps_its_recall():
    rng, p = np.random.default_rng(5), np.arccos(0.9) / np.pi
    for n in (10, 10_000, 10**7):
        bits, tables, most = embeddings.layout(n)
        masks = embeddings._masks(bits, tables)
        differ = np.packbits(rng.random((20_000, embeddings.SKETCH)) < p, axis=1, bitorder="little").view("<u8")
        share = ((differ[:, None, :] & masks[None]) == 0).all(axis=2).any(axis=1) & (np.bitwise_count(differ).sum(axis=1) <= most)
        assert share.mean() >= 0.995, (n, share.mean())


def test_large_groups_of_near_and_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(3)
    base, other = rng.standard_normal(32), rng.standard_normal(32)
    rows = [(i, (base + rng.standard_normal(32) * 0.3).tolist()) for i in range(500)]  # cosines on both sides of the limit
    rows += [(1000 + i, other.tolist()) for i in range(700)] + [(3000, (other + 0.01).tolist())]
    got, want = sorted(map(tuple, embeddings.near_duplicates(table(spark, rows).repartition(4)).collect())), sorted(brute(rows))
    assert [r[0::2] for r in got] == [r[0::2] for r in want] and got[500:] == want[500:]
    # of the many pairs near the limit, as many as the stated recall says; none that is below it
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.996 * sum(w[1] for w in want)


def test_doubles_are_compared_as_doubles(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e300, 0.0]), (3, [0.0, 1e-300]), (4, [1e-310, 1e-310])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_tiles_keep_what_earlier_ones_connected():
    rng = np.random.default_rng(4)
    for n, tile in ((7, 3), (40, 7), (60, 60)):
        for _ in range(100):
            near = np.triu(rng.random((n, n)) < 0.7 / n, 1)
            near |= near.T
            label = np.arange(n)
            for at in range(0, n, tile):
                label = embeddings._joined(label, slice(at, min(n, at + tile)), near[at : at + tile])
            want = np.arange(n)
            for _ in range(n):
                want = np.minimum(want, np.where(near, want[None, :], n).min(axis=1))
            assert (label == want).all()
