"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, connected components.

A vector's sketch is the signs of its products with SKETCH random directions. A table's key is a fixed choice of `bits`
of them, so that a sketch holds the keys of all tables; a pair is dealt with in the first table whose key it shares.
Only sketches are dealt into the tables: a pair meets there, and goes on if its sketches differ in few enough signs.
Vectors are sent only to blocks in which they have such a partner, and there cosines decide. Equal vectors are one class.
Where vectors have partners in many tables, as in a dense group, what partners connect is cut into blocks of its own
instead, if fewer copies of its vectors are sent so.

Keys grow with the logarithm of the rows, so that about 1,000 vectors share one, and the number of tables with the
0.22nd power of the rows: those that make a pair at the least cosine go on with probability RECALL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import drop_scratch, materialise, runs
from semloom.llm.components import connected_components

LEAST, RECALL, SEED = 0.9, 0.998, 20_240_811
SKETCH, BLOCK, TILE = 128, 8192, 512
#: Tables in which a vector has partners before its group may be dealt with as one.
OFTEN = 2
#: So many of the pairs at the least cosine may be lost by the number of differing signs alone.
_FAR = 1e-4


@lru_cache(maxsize=8)
def layout(rows: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int, int]:
    """Bits of a table's key, the number of tables, and the most signs in which a pair's sketches may differ."""
    bits = min(24, max(6, math.ceil(math.log2(max(rows, 2))) - 10))
    p = math.acos(least) / math.pi
    chance = [math.comb(SKETCH, d) * p**d * (1 - p) ** (SKETCH - d) for d in range(SKETCH + 1)]
    most = next(d for d in range(SKETCH + 1) if sum(chance[: d + 1]) >= 1 - _FAR)
    same = [math.comb(SKETCH - d, bits) / math.comb(SKETCH, bits) for d in range(most + 1)]
    for tables in range(1, 1 << 14):
        if sum(c * (1 - (1 - s) ** tables) for c, s in zip(chance, same)) >= recall:
            return bits, tables, most
    raise ValueError("no number of tables reaches this recall")


@lru_cache(maxsize=8)
def _masks(bits: int, tables: int) -> np.ndarray:
    """Of each table, the signs that make its key, as two 64-bit numbers."""
    rng, out = np.random.default_rng([SEED, bits]), np.zeros((tables, 2), dtype=np.uint64)
    for t in range(tables):
        for k in rng.choice(SKETCH, bits, replace=False):
            out[t, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    return out


@lru_cache(maxsize=8)
def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, SKETCH))


def _matrix(embeddings: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in embeddings])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square runs over
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketched(vectors: DataFrame) -> DataFrame:
    """(vec_id, h1, h2, dims, s1, s2) for each row of vectors (vec_id, h1, h2, embedding)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len).to_numpy()
            for d in np.unique(sizes):
                part = batch[sizes == d]
                signs = _unit(_matrix(part["embedding"])) @ _planes(int(d)) > 0
                s = np.packbits(signs, axis=1, bitorder="little").view("<i8")
                yield pd.DataFrame({"vec_id": part["vec_id"], "h1": part["h1"], "h2": part["h2"], "dims": d, "s1": s[:, 0], "s2": s[:, 1]})

    return vectors.mapInPandas(make, "vec_id long, h1 long, h2 long, dims long, s1 long, s2 long")


def dealt(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(tab, key, dims, id, s1, s2) for each table and row of classes (id, dims, s1, s2)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks, step = _masks(bits, tables), max(1, 65_536 // tables)
        for batch in batches:
            for at in range(0, len(batch), step):
                few = batch.iloc[at : at + step]
                s = few[["s1", "s2"]].to_numpy().view(np.uint64)
                own = s[:, None, :] & masks[None, :, :]
                keys = ((own[..., 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (own[..., 1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))).view(np.int64)
                row, tab = np.divmod(np.arange(keys.size), tables)
                yield pd.DataFrame({"tab": tab, "key": keys.ravel()} | {c: few[c].to_numpy()[row] for c in ("dims", "id", "s1", "s2")})

    return classes.select("id", "dims", "s1", "s2").mapInPandas(make, "tab int, key long, dims long, id long, s1 long, s2 long")


def _meeting(group: pd.DataFrame, bits: int, tables: int, most: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Of a block, tile after tile, which rows meet which: those of like sketches that share no earlier table, and in
    a block of two halves only rows of different halves. In a block of a group that is no table's, all rows meet."""
    tab, masks = int(group["tab"].iat[0]), _masks(bits, tables)
    s = np.ascontiguousarray(group[["s1", "s2"]].to_numpy()).view(np.uint64)
    own = group["own"].to_numpy() if group["x"].iat[0] != group["y"].iat[0] else None
    for at in range(0, len(s), TILE):
        here = slice(at, min(len(s), at + TILE))
        if tab < 0:
            meets = np.ones((here.stop - at, len(s)), dtype=bool)
            meets[np.arange(here.stop - at), np.arange(at, here.stop)] = False
            if own is not None:
                meets &= own[here, None] != own[None, :]
            yield here, meets
            continue
        x, y = s[here, 0][:, None] ^ s[None, :, 0], s[here, 1][:, None] ^ s[None, :, 1]
        meets = np.bitwise_count(x) + np.bitwise_count(y) <= most
        meets[np.arange(here.stop - at), np.arange(at, here.stop)] = False
        if own is not None:
            meets &= own[here, None] != own[None, :]
        i, j = np.nonzero(meets)
        if len(i):
            dx, dy = x[i, j], y[i, j]
            # two different keys can have one hash: then this table is not shared either
            good = ((dx & masks[tab, 0]) | (dy & masks[tab, 1])) == 0
            for t in range(tab):
                good &= ((dx & masks[t, 0]) | (dy & masks[t, 1])) != 0
            meets[i[~good], j[~good]] = False
        yield here, meets


def _joined(label: np.ndarray, here: slice, meets: np.ndarray) -> np.ndarray:
    """Labels, roots of themselves, after linking the rows `here` with those they meet: the smallest row that each is
    connected with. One partner of each row and of each column is linked at a time, until none is apart."""
    while True:
        apart = meets & (label[here, None] != label[None, :])
        rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
        if not len(rows):
            return label
        one = label[np.concatenate([rows + here.start, apart[:, columns].argmax(axis=0) + here.start])]
        other = label[np.concatenate([apart[rows].argmax(axis=1), columns])]
        label, low = label.copy(), np.minimum(one, other)
        # roots are linked, so that what was connected before stays so
        np.minimum.at(label, one, low)
        np.minimum.at(label, other, low)
        while ((up := label[label]) != label).any():
            label = up


_BLOCKS = ["tab", "key", "dims", "x", "y"]


def _placed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (tab, key, dims, id, s1, s2) with their blocks (x, y): sizes (tab, key, dims, n) names the large keys, of
    which a row is in `own` and goes to the blocks of that with every other. Large keys are few."""
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
    cut = rows.join(sizes, ["tab", "key", "dims"], "left").withColumn("b", blocks).withColumn("own", F.pmod(F.hash("id"), F.col("b")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    return cut.select("tab", "key", "dims", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "s1", "s2")


def _regrouped(members: DataFrame) -> DataFrame:
    """members with the dense groups dealt as one: where partners connect ids that have on average more than OFTEN rows
    each, and blocks over all of them need fewer rows, these stand in place of the tables' blocks. Every pair of
    partners is in one such group or in none, so none is lost and none is met twice."""
    plain = members.drop("root")
    often = members.groupBy("id").agg(F.count("*").alias("rows"))
    if often.filter(f"rows > {OFTEN}").isEmpty():
        return plain
    comps = connected_components(members.filter("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    comps = materialise(comps.withColumnRenamed("node", "id"), "groups")
    sizes = comps.join(often, "id").groupBy("component").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    dense = materialise(sizes.filter((F.col("rows") > OFTEN * F.col("n")) & (F.col("rows") > F.col("n") * F.ceil(F.col("n") / BLOCK))), "dense")
    inside = materialise(comps.join(dense.select("component", "n"), "component"), "inside")
    signs = members.join(inside, "id").groupBy("id").agg(*(F.first(c).alias(c) for c in ("component", "dims", "s1", "s2")))
    rows = signs.select(F.lit(-1).alias("tab"), F.col("component").alias("key"), "dims", "id", "s1", "s2")
    large = dense.filter(f"n > {BLOCK}").select(F.lit(-1).alias("tab"), F.col("component").alias("key"), "n")
    large = large.join(rows.select("key", "dims").distinct(), "key")
    own = _placed(rows, materialise(large, "large"))
    return materialise(plain.join(inside.select("id"), "id", "left_anti").select(own.columns).unionByName(own), "regrouped")


def linked(classes: DataFrame, vectors: DataFrame, least: float = LEAST, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Counts (id, n_links) and edges (src, dst) that connect what is linked, of classes (id, vec_id, h1, h2, n, dims,
    s1, s2) of n equal vectors each; vectors (vec_id, h1, h2, embedding) hold those of the vec_ids.

    Ids with a common key meet in blocks of about BLOCK x BLOCK, so that no task holds a large key. No pair leaves a
    block: it reports who takes part, then counts, and an edge for each vector.
    """
    bits, tables, most = layout(classes.count(), least, recall)
    flat = dealt(classes, bits, tables)
    sizes = materialise(flat.groupBy("tab", "key", "dims").agg(F.count("*").alias("n")).filter(f"n > {BLOCK}"), "sizes")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, _BLOCKS):
            some, label = np.zeros(len(group), dtype=bool), np.arange(len(group))
            for here, meets in _meeting(group, bits, tables, most) if len(group) > 1 else ():
                some[here] = meets.any(axis=1)
                label = _joined(label, here, meets)
            if some.any():
                yield group.assign(root=group["id"].to_numpy()[label])[some]

    schema = "tab int, key long, dims long, x int, y int, own int, id long, s1 long, s2 long, root long"
    met = materialise(_placed(flat, sizes).repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS).mapInPandas(meet, schema), "members")
    members = _regrouped(met)
    wanted = materialise(met.select("id").distinct().join(classes.select("id", "vec_id", "h1", "h2", "n"), "id"), "wanted")
    # equal rows may repeat: one of them is taken
    found = vectors.join(wanted, ["vec_id", "h1", "h2"]).groupBy("id").agg(F.first("n").alias("n"), F.first("embedding").alias("embedding"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, _BLOCKS):
            if len(group) < 2:
                continue
            ids, n, unit = group["id"].to_numpy(), group["n"].to_numpy(), _unit(_matrix(group["embedding"]))
            sums, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            for here, meets in _meeting(group, bits, tables, most):
                near = meets & (unit[here] @ unit.T >= least)
                sums[here] = near @ n
                label = _joined(label, here, near)
            some = sums > 0
            if some.any():
                yield pd.DataFrame({"src": ids[some], "dst": ids[label[some]], "n": sums[some]})

    full = members.join(found, "id").repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS)
    pairs = materialise(full.mapInPandas(verify, "src long, dst long, n long"), "pairs")
    drop_scratch(met)
    return pairs.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n_links")), pairs.filter("src <> dst").select("src", "dst")


def near_duplicates(table: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of a table (vec_id, embedding).

    Vectors of the same length are linked if their cosine, in double precision, is at least `least`; a pair at just
    that is found with probability `recall`, nearer ones with a higher one, equal ones in any case. Vectors that are
    null, empty or zero or have null or non-finite components, and rows with a null vec_id, are linked with nothing.
    component_id is the smallest vec_id reachable by links, kept is vec_id = component_id. Rows that share a vec_id but
    not a vector are vectors of their own, each with its own results; rows that share both are one. Equal vectors are
    one class that is compared once. Other columns are not read.
    """
    # floats stay floats, which doubles hold exactly; all other numbers are compared as doubles
    kind = "float" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = table.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)))
    hashed = lambda t: t.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    sound = hashed(sound)
    rows = materialise(sketched(sound), "sketches")
    facts, same = ("dims", "s1", "s2"), ["h1", "h2"]
    own = rows.groupBy("vec_id", *same).agg(*(F.first(c).alias(c) for c in facts))
    classes = own.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in facts))
    # a vec_id may be the least of several classes: they are numbered, and written, so that the numbers stay
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    counts, edges = linked(classes, sound, least, recall)
    comps = materialise(connected_components(edges).withColumnRenamed("node", "id"), "components")
    names = comps.join(classes.select("id", "vec_id"), "id").groupBy("component").agg(F.min("vec_id").alias("name"))
    comps = comps.join(materialise(names, "names"), "component").select("id", "name")
    known = classes.join(counts, "id", "left").join(comps, "id", "left")
    known = known.select(*same, (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("name", "vec_id").alias("component"))
    # only what has a link is looked up
    known = materialise(known.filter("n_links > 0"), "known")
    linked_ids = materialise(own.select("vec_id", *same).join(known, same), "linked")
    out = hashed(table).select("vec_id", *same).join(linked_ids, ["vec_id", *same], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
pairs AS (
  SELECT a.vec_id AS one, b.vec_id AS other FROM n a JOIN n b ON a.vec_id <> b.vec_id
  WHERE a.l > 0 AND b.l > 0 AND list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS pos FROM v UNION SELECT r.node, p.other FROM reach r JOIN pairs p ON r.pos = p.one
), least AS (SELECT node, min(pos) AS component_id FROM reach GROUP BY node),
counts AS (SELECT one, count(*) AS n FROM pairs GROUP BY one)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON l.node = v.vec_id LEFT JOIN counts c ON c.one = v.vec_id
"""
