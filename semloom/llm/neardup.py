"""MinHash near-duplicates with tensored banding.

Two small collections of half keys, each of ROWS minhashes, are made for a document; every pair of a half key of the
first and one of the second collection is the key of one table. HALVES x HALVES tables thus cost 2 x HALVES x ROWS
minhashes, not HALVES x HALVES x 2 x ROWS. A pair of similarity s shares a table with probability
(1 - (1 - s**ROWS)**HALVES)**2: 0.9997 at 0.75. Candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import WordHashes, drop_scratch, gram_hashes, materialise, runs, space_words
from semloom.llm.components import connected_components

SHINGLE, ROWS, HALVES, PERCENT = 5, 3, 16, 75
SAMPLE, BLOCK, KEY = 256, 2048, 8
_SEED = 20_240_229


def shingles(words: list[bytes], hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of k consecutive words; of all words, where there are fewer."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(hashes(words), min(k, len(words))) ^ np.uint64(min(k, len(words))))


class MinHashes:
    """2 x halves half keys of a set, of rows minhashes each."""

    def __init__(self, rows: int = ROWS, halves: int = HALVES):
        rng = np.random.default_rng(_SEED)
        n = 2 * halves * rows
        self.rows, self.halves = rows, halves
        self.a = (rng.integers(0, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def __call__(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The half keys of the two collections of a sorted set, and its sketch.

        The sketch holds the 2 x halves half keys as KEY bytes each, then a sample of the set, see Samples.
        """
        x = (elements >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), 1 << 14):
            part = x[None, at : at + (1 << 14)]
            np.minimum(least, ((part ^ self.b) * self.a).min(axis=1), out=least)
        keys = gram_hashes(least.astype(np.uint64), self.rows)[:: self.rows].view(np.int64)
        return keys[: self.halves], keys[self.halves :], keys.astype("<i8").tobytes() + sample(elements)


def sample(elements: np.ndarray) -> bytes:
    """At most about SAMPLE elements of a set as 16-bit numbers: those whose hash ends in as many zero bits as the level
    says, first those that end in one more. At level 0 it is the whole set, and so comparisons miss nothing."""
    level = max(0, int(np.ceil(np.log2(max(1, len(elements)) / SAMPLE))))
    chosen = elements[elements & np.uint64((1 << level) - 1) == 0]
    finer = chosen & np.uint64(1 << level) > 0
    chosen = np.concatenate([chosen[~finer], chosen[finer]])
    head = np.array([level, len(chosen) - int(finer.sum())], dtype="<u4").tobytes()
    return head + (chosen >> np.uint64(40)).astype("<u2").tobytes()


class Samples:
    """Samples side by side, to be compared with one of them."""

    def __init__(self, sketches: list[bytes], skip: int):
        heads = [np.frombuffer(x, "<u4", 2, skip) for x in sketches]
        self.level, self.fewer = (np.array([h[i] for h in heads], dtype=np.int64) for i in (0, 1))
        parts = [np.frombuffer(x, "<u2", -1, skip + 8) for x in sketches]
        self.full = np.array([len(x) for x in parts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.full)[:-1]])
        self.every = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint16)

    def alike(self, i: int, percent: int) -> np.ndarray:
        """Of each sample, whether it and the i-th share so much as percent asks for. Above level 0 no less will do
        than 4.5 deviations below that, which a pair that similar misses once in 200,000 times."""
        mine, out = self.every[self.start[i] : self.start[i] + self.full[i]], np.zeros(len(self.full), dtype=bool)
        for step in (0, 1):  # with samples of my level and of the one below it, then with those of the one above it
            size = self.fewer[i] if step else self.full[i]
            which = self.level == self.level[i] + 1 if step else (self.level <= self.level[i]) & (self.level >= self.level[i] - 1)
            if not which.any():
                continue
            there = np.zeros(1 << 16, dtype=np.int32)
            there[mine[:size]] = 1
            hits = np.zeros(len(self.every) + 1, dtype=np.int32)
            np.cumsum(there[self.every], out=hits[1:])
            theirs = np.where(self.level < self.level[i] + step, self.fewer, self.full)
            both = hits[self.start + theirs] - hits[self.start]
            union, share = np.maximum(size + theirs - both, 0), percent / 100
            slack = np.where(np.maximum(self.level, self.level[i]) > 0, 4.5 * np.sqrt(union * share * (1 - share)), 0)
            out |= which & (both + slack >= union * share - 1e-9)
        return out


def signatures(docs: DataFrame, rows: int = ROWS, halves: int = HALVES) -> DataFrame:
    """(doc_id, n_shingles, set_hash, a, b, sketch) for each row of docs (doc_id, text)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, minhashes = WordHashes(), MinHashes(rows, halves)
        for batch in batches:
            n, digests, made = [], [], []
            for text in batch["text"]:
                s = shingles(space_words(text), hashes)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                made.append(minhashes(s) if len(s) else (None, None, None))
            columns = {c: [x[k] for x in made] for k, c in enumerate(("a", "b", "sketch"))}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": n, "set_hash": digests} | columns)

    schema = "doc_id long, n_shingles long, set_hash binary, a array<long>, b array<long>, sketch binary"
    return docs.select("doc_id", "text").mapInPandas(make, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, elements): the full sets."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(space_words(t), hashes).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "elements": sets})

    return docs.select("doc_id", "text").mapInPandas(make, "doc_id long, elements array<long>")


def _half_keys(sigs: DataFrame, side: str) -> DataFrame:
    """(id, at, half) of the half keys that at least two ids share."""
    flat = sigs.select("id", F.posexplode(side).alias("at", "half"))
    shared = flat.groupBy("at", "half").agg(F.count("*").alias("n")).filter("n > 1").select("at", "half")
    return flat.join(materialise(shared, "shared"), ["at", "half"])


def _tables(sigs: DataFrame, halves: int) -> DataFrame:
    """(key, at, id) of each table's key whose half keys other ids have too: every shared a with every shared b of an id."""
    a = _half_keys(sigs, "a").groupBy("id").agg(F.collect_list(F.struct("at", "half")).alias("a"))
    b = _half_keys(sigs, "b").groupBy("id").agg(F.collect_list(F.struct("at", "half")).alias("b"))
    pairs = a.join(b, "id").select("id", "b", F.explode("a").alias("x")).select("id", "x", F.explode("b").alias("y"))
    key = F.xxhash64("x.at", "x.half", "y.at", "y.half").alias("key")
    return materialise(pairs.select(key, (F.col("x.at") * halves + F.col("y.at")).alias("at"), "id"), "keys")


def likely(pairs: DataFrame, classes: DataFrame, skip: int, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    for side in ("dst", "src"):
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    fits = pairs.filter(F.least("n_src", "n_dst") * 100 >= F.greatest("n_src", "n_dst") * percent)

    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([bool(Samples([x, y], skip).alike(0, percent)[1]) for x, y in zip(one, other)], dtype=bool)

    return fits.filter(F.pandas_udf(alike, "boolean")("s_src", "s_dst")).select("src", "dst")


def compared(members: DataFrame, classes: DataFrame, rows: int, halves: int, percent: int = PERCENT) -> DataFrame:
    """Pairs (src, dst) of members (key, id, component, main) with equal keys, other components and likely sketches.

    In each key, the ids outside the main component meet all ids, in blocks of about BLOCK x BLOCK, so that no task
    holds a large key. Of the tables that a pair shares, the first one by the half keys reports it.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("main")).alias("m"))
    blocks = materialise(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("all"), F.ceil(F.col("m") / BLOCK).cast("int").alias("few")), "blocks")
    cut = members.join(blocks, "key").join(classes.select("id", "n_shingles", "sketch"), "id")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.hash("id"), F.col(n))
    skip = 2 * halves * KEY
    keep = ["key", "at", "id", "component", "n_shingles", "sketch"]
    whole = cut.withColumn("x", own("all")).withColumn("y", other("few")).select(*keep, "x", "y", F.lit(False).alias("minor"))
    minor = cut.filter("component <> main").withColumn("y", own("few")).withColumn("x", other("all")).select(*keep, "x", "y", F.lit(True).alias("minor"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["key", "x", "y"]):
            few, every = group[group["minor"]], group[~group["minor"]]
            if not len(few) or not len(every):
                continue
            at, comps, ids, n = (every[c].to_numpy() for c in ("at", "component", "id", "n_shingles"))
            where = {i: k for k, i in enumerate(ids)}
            samples = Samples([*every["sketch"], *(x for x, i in zip(few["sketch"], few["id"]) if i not in where)], skip)
            halfs = np.frombuffer(b"".join(x[:skip] for x in every["sketch"]), dtype="<i8").reshape(len(every), 2, halves)
            minors, extra = set(few["id"]), iter(range(len(every), len(every) + len(few)))
            both = np.fromiter((i in minors for i in ids), dtype=bool, count=len(ids))
            src, dst = [], []
            for sketch, comp, i, size in zip(few["sketch"], few["component"], few["id"], few["n_shingles"]):
                mine = where[i] if i in where else next(extra)
                fits = (comps != comp) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & ~(both & (ids < i))
                if fits.any():
                    fits &= samples.alike(mine, percent)[: len(ids)]
                if fits.any():  # the first a and the first b that both share must be those of this table
                    same = halfs[fits] == np.frombuffer(sketch[:skip], dtype="<i8").reshape(2, halves)
                    fits[fits] = same[:, 0].argmax(axis=1) * halves + same[:, 1].argmax(axis=1) == at[fits]
                    dst.append(ids[fits])
                    src.append(np.full(len(dst[-1]), i))
            if src:
                x, y = np.concatenate(src), np.concatenate(dst)
                yield pd.DataFrame({"src": np.minimum(x, y), "dst": np.maximum(x, y)})

    dealt = whole.unionByName(minor).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInPandas(meet, "src long, dst long")


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, skip: int, percent: int = PERCENT) -> DataFrame:
    """The rows of pairs (src, dst) whose full sets are similar enough. A src's set is sent to all its pairs once."""
    left = likely(pairs, classes, skip, percent).join(sets.select(F.col("doc_id").alias("dst"), F.col("elements").alias("_d")), "dst")
    both = left.join(sets.select(F.col("doc_id").alias("src"), F.col("elements").alias("_s")), "src")
    same = both.select("src", "dst", (F.size("_s") + F.size("_d")).alias("n"), F.size(F.array_intersect("_s", "_d")).alias("i"))
    return same.filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("src", "dst")


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members (key, id) with component: the id's own where comps has none."""
    return members.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def links(docs: DataFrame, sigs: DataFrame, rows: int = ROWS, halves: int = HALVES, percent: int = PERCENT) -> DataFrame:
    """Links (src, dst) between one document of each class of equal sets; they connect all that is similar enough.

    Candidates are the ids that share a table's key. Each id is compared with the smallest id that it meets; then,
    where a key still joins several components, with the smallest id of each such key; then every pair of ids that
    share a key but not a component is compared in blocks, by sketch and, if alike, by set. No pair that could join two
    components is left out but for what the stated chances are.
    """
    classes = materialise(
        sigs.filter("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "a", "b", "sketch"))), "classes")
    keys = _tables(classes, halves)
    buckets = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "lo")
    members = materialise(keys.join(materialise(buckets, "buckets"), "key"), "members")
    drop_scratch(keys)
    met = members.select("id").distinct()
    sets = materialise(shingle_sets(docs.select("doc_id", "text").join(met.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").distinct()), "sets")

    first = materialise(members.filter("id <> lo").groupBy(F.col("id").alias("dst")).agg(F.min("lo").alias("src")).select("src", "dst"), "first")
    edges = materialise(verified(first, classes, sets, 2 * halves * KEY, percent), "edges")
    tried = first

    comps = connected_components(edges)
    open_ = _open(members, comps)
    second = open_.filter("component <> main AND id <> lo").select(F.col("lo").alias("src"), F.col("id").alias("dst")).distinct()
    second = materialise(second.join(tried, ["src", "dst"], "left_anti"), "second")
    edges = materialise(edges.unionByName(verified(second, classes, sets, 2 * halves * KEY, percent)), "edges")
    tried = tried.unionByName(second)

    comps = connected_components(edges)
    open_ = materialise(_open(members, comps), "open")
    rest = compared(open_, classes, rows, halves, percent).distinct().join(tried, ["src", "dst"], "left_anti")
    return edges.unionByName(verified(materialise(rest, "rest"), classes, sets, 2 * halves * KEY, percent))


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members (key, id, lo, component, main) of the keys that join several components; main is one of these."""
    now = materialise(_labelled(members, comps), "labelled")
    many = now.groupBy("key").agg(F.min("component").alias("main"), F.max("component").alias("most")).filter("main < most").select("key", "main")
    return now.join(materialise(many, "many"), "key")


def near_duplicates(docs: DataFrame, rows: int = ROWS, halves: int = HALVES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    A document's set holds its distinct shingles of five lower-cased words; with fewer words, all of them as one.
    Documents are linked whose sets have 100 * intersection >= percent * union. component_id is the smallest doc_id
    reachable by links, kept is doc_id = component_id. Null and blank texts have no set and are linked with nothing.
    Equal sets are one class from the start, so copies are never compared with each other. Repeated rows come back
    repeated; rows that share a doc_id count as one document when links are followed, linked by any of its texts. A null
    doc_id is linked with nothing and has a null component. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = materialise(signatures(docs, rows, halves), "signatures")
    least = materialise(sigs.filter("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("least")), "least")
    named = sigs.filter("doc_id IS NOT NULL")
    comps = materialise(connected_components(links(docs.filter("doc_id IS NOT NULL"), named, rows, halves, percent)), "components")
    labels = least.join(comps.select(F.col("node").alias("least"), "component"), "least", "left").select("set_hash", F.coalesce("component", "least").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "set_hash").join(materialise(labels, "labels"), "set_hash", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS one, b.doc_id AS other FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS pos FROM documents
  UNION SELECT r.node, p.other FROM reach r JOIN pairs p ON r.pos = p.one
), least AS (SELECT node, min(pos) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON l.node = s.doc_id
"""
