"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with hierarchical Dirichlet smoothing (MacKay and Peto, 1995): with a history h that occurs
n(h) times in the training texts, p(w | h) = (n(h w) + K p(w | h')) / (n(h) + K), h' being h without its first token; at
the root p(w) = (n(w) + 1) / (N + V + 1). As an automaton, a state is a known history; an arc is a known n-gram with its
log-probability; where a state has no arc for a token, its failure arc leads to h' at the weight K / (n(h) + K).

Texts are encoded once into chunks of a bounded size. A chunk's distinct n-grams go, as sorted blocks of hashes, to the
task that holds their range of hashes; it adds up the training counts of all chunks and answers each block with the
totals. Of these a chunk builds the part of the automaton that its texts can reach, and traverses it. So the model has
no bound and is at no place as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from semloom.llm.common import materialise, mixed, space_words

#: Words of an n-gram, and K by the length of an n-gram, from two on.
ORDER, STRENGTH = 3, (30.0, 10.0)
#: A chunk ends with the document that brings it to so many tokens or bytes of text.
CHUNK_TOKENS, CHUNK_BYTES = 1 << 20, 1 << 26
#: About so many tokens' n-grams are added up in one group.
BUCKET_TOKENS = 1 << 20
#: Texts are traversed in stretches of so many tokens, side by side.
STRETCH = 256
_START, _END = 0, 1
#: A key is a hash but for its last bits, which tell the length; those of n-grams of several words are shorter, since
#: they are most of what is sent.
_LEVEL_BITS, _SHORT_BITS = np.uint64(3), np.uint64(1023)


def _digest(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


#: Hashes of the tokens before and after a text; no word has white space.
_FIXED = np.array([_digest(b" start"), _digest(b" end")], dtype=np.uint64)


# -- blocks of numbers -----------------------------------------------------------------------------------------------


def _packed(x: np.ndarray, effort: int = 1) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.compress(planes.tobytes(), effort)


def _unpacked(block: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(block), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


# -- chunks ----------------------------------------------------------------------------------------------------------


class _Ids(dict):
    """Local numbers of words, given when first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + len(_FIXED)
        return n


def _encoder(schema: pa.Schema, most_tokens: int, most_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, docs, n_tokens, n_bytes = TaskContext.get().partitionId() << 32, _Ids(), [], [], 0, 0

        def chunk() -> pa.RecordBatch:
            words = np.fromiter(map(_digest, ids), dtype=np.uint64, count=len(ids))
            tokens = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
            doc_ids, held, sizes = zip(*docs)
            row = (number, list(doc_ids), list(held), list(sizes), words.tobytes(), _packed(tokens, 3))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
                words = space_words(text.as_py())
                parts.append(np.fromiter(map(ids.__getitem__, words), dtype=np.uint32, count=len(words)))
                docs.append((doc_id, held, len(words)))
                n_tokens, n_bytes = n_tokens + len(words) + 1, n_bytes + sum(map(len, words))
                if n_tokens >= most_tokens or n_bytes >= most_bytes:
                    yield chunk()
                    number, ids, parts, docs, n_tokens, n_bytes = number + 1, _Ids(), [], [], 0, 0
        if docs:
            yield chunk()

    return encode


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in ascending order, where each stands, and for each place which of them is there."""
    order = np.argsort(x, kind="stable").astype(np.int32)
    x = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    back = np.empty(len(x), dtype=np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], order[new], back


@dataclass
class Level:
    """The distinct n-grams of one length in a chunk: the n-gram without its last token, and without its first, each as a
    place in the level before; the last token; a hash; and where the n-gram stands."""

    prefix: np.ndarray
    suffix: np.ndarray
    word: np.ndarray
    key: np.ndarray
    at: np.ndarray  # by position: the n-gram that ends there, -1 where there is none
    trained: np.ndarray


class Texts:
    """A chunk's token sequences, each with a start and an end, and their n-grams level by level."""

    def __init__(self, sizes: np.ndarray, held: np.ndarray, words: bytes, tokens: bytes, order: int):
        sizes = sizes.astype(np.int64)
        self.hashes = np.concatenate([_FIXED, np.frombuffer(words, dtype=np.uint64)])
        self.width = len(self.hashes)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]).astype(np.int64)
        self.lengths = sizes + 1  # tokens to be predicted
        total = int((sizes + 2).sum())
        inside = np.ones(total, dtype=bool)
        inside[self.starts] = False
        inside[self.starts + sizes + 1] = False
        self.tokens = np.zeros(total, dtype=np.int32)
        self.tokens[inside] = _unpacked(tokens, np.uint32)
        self.tokens[self.starts] = _START
        self.tokens[self.starts + sizes + 1] = _END
        train = np.repeat(~held, sizes + 2)
        none = np.zeros(0, dtype=np.int32)
        key = (mixed(self.hashes) & ~_LEVEL_BITS) | np.uint64(1)
        trained = np.bincount(self.tokens[train], minlength=self.width)
        self.levels = [Level(none, none, np.arange(self.width, dtype=np.int32), key, self.tokens, trained.astype(np.uint32))]
        for k in range(2, order + 1):
            below = self.levels[-1]
            whole = below.at[:-1] >= 0  # an n-gram of this length ends at the next place of the same text
            whole &= self.tokens[1:] != _START
            spots = np.flatnonzero(whole).astype(np.int32) + 1
            pairs = below.at[spots - 1].astype(np.int64) * self.width + self.tokens[spots]
            pairs, first, back = _distinct(pairs)
            at = np.full(total, -1, dtype=np.int32)
            at[spots] = back
            prefix, word = (pairs // self.width).astype(np.int32), (pairs % self.width).astype(np.int32)
            key = mixed(below.key[prefix] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[word])
            trained = np.bincount(back[train[spots]], minlength=len(pairs)).astype(np.uint32)
            self.levels.append(Level(prefix, below.at[spots[first]], word, (key & ~_SHORT_BITS) | np.uint64(k), at, trained))

    def sorted_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams' hashes in ascending order, and the order that sorts them."""
        keys = np.concatenate([x.key for x in self.levels])
        order = np.argsort(keys, kind="stable")
        return keys[order], order


def _edges(buckets: int) -> np.ndarray:
    """The least hash of each range but the first."""
    return np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)


def _asker(order: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for batch in batches:
            for row in _rows(batch):
                yield blocks(row, edges)

    def blocks(row: dict, edges: np.ndarray) -> pa.RecordBatch:
        texts = Texts(row["sizes"], row["held"], row["words"], row["tokens"], order)
        keys, by_key = texts.sorted_keys()
        counts = np.concatenate([x.trained for x in texts.levels])[by_key]
        cuts = [0, *np.searchsorted(keys, edges), len(keys)]
        out = [(b, row["chunk"], _packed(_gaps(keys[x:y])), _packed(counts[x:y])) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "keys", "counts"])

    return ask


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Chunk rows one by one, their numbers as arrays."""
    for k in range(batch.num_rows):
        at = lambda c: batch.column(c)[k]
        yield {
            "chunk": at("chunk").as_py(), "doc_ids": at("doc_ids").values, "held": at("held").values.to_numpy(zero_copy_only=False).astype(bool),
            "sizes": at("sizes").values.to_numpy(), "words": at("words").as_py(), "tokens": at("tokens").as_py(),
        }


_ANSWER = "chunk long, bucket int, counts binary, n_tokens long, n_types long"


def _answered(blocks: pd.DataFrame) -> pd.DataFrame:
    """For the blocks of a range of hashes, as many blocks with the totals of all, and a row of what the root needs: how
    many training tokens there are, and how many distinct ones."""
    keys = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in blocks["keys"]]
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(found), dtype=np.uint64)
    cuts = np.cumsum([0, *map(len, keys)])
    for block, x, y in zip(blocks["counts"], cuts, cuts[1:]):
        totals[back[x:y]] += _unpacked(block, np.uint32)  # a block has each hash once
    words = (found & _LEVEL_BITS) == 1
    words &= found != (mixed(_FIXED[:1]) & ~_LEVEL_BITS | np.uint64(1))
    bucket = blocks["bucket"].iat[0]
    rows = [(c, bucket, _packed(totals[back[x:y]]), None, None) for c, x, y in zip(blocks["chunk"], cuts, cuts[1:])]
    rows.append((None, bucket, None, int(totals[words].sum()), int((totals[words] > 0).sum())))
    out = pd.DataFrame(rows, columns=["chunk", "bucket", "counts", "n_tokens", "n_types"])
    return out.astype({"chunk": "Int64", "n_tokens": "Int64", "n_types": "Int64"})


# -- the automaton ---------------------------------------------------------------------------------------------------


class Automaton:
    """The part of the model that a chunk's texts reach. State 0 is the root; the others are known n-grams of fewer than
    ORDER tokens. Arcs are sorted by state and token; every token of the chunk has an arc at the root."""

    def __init__(self, texts: Texts, counts: list[np.ndarray], n_tokens: int, n_types: int, strength: tuple[float, ...]):
        order, self.width = len(texts.levels), texts.width
        #: By level and n-gram: the state of its longest known ending.
        self.state: list[np.ndarray] = []
        fails, weights, arcs, targets, logs, states = [np.zeros(1, dtype=np.int32)], [np.zeros(1)], [], [], [], 1
        for k, level in enumerate(texts.levels):
            n, known = counts[k].astype(np.float64), counts[k] > 0
            if k:
                shorter = self.state[k - 1][level.suffix]
                p = (n + strength[k - 1] * p[level.suffix]) / (counts[k - 1][level.prefix] + strength[k - 1])
            else:
                shorter = np.zeros(len(n), dtype=np.int32)
                p = (n + 1) / (n_tokens + n_types + 1)
                self.unigrams = np.log10(p)
            own = shorter
            if k + 1 < order:
                own = np.where(known, states - 1 + np.cumsum(known, dtype=np.int32), shorter)
                states += int(known.sum())
                fails.append(shorter[known])
                weights.append(np.log10(strength[k] / (n[known] + strength[k])))
            self.state.append(own)
            there = known if k else np.ones(len(n), dtype=bool)
            start = self.state[k - 1][level.prefix[there]].astype(np.int64) if k else np.zeros(len(n), dtype=np.int64)
            arcs.append(start * self.width + level.word[there])
            targets.append(own[there])
            logs.append(np.log10(p[there]))
        self.fail, self.weight = np.concatenate(fails), np.concatenate(weights)
        arcs = np.concatenate(arcs)
        by = np.argsort(arcs, kind="stable")
        self.arc = arcs[by]
        del arcs
        self.target, self.log = np.concatenate(targets)[by], np.concatenate(logs)[by]

    def traversed(self, texts: Texts, stretch: int = STRETCH) -> np.ndarray:
        """The log-probability of each text, from left to right: a token takes the state's arc, or else failure arcs until
        there is one. Stretches of texts go side by side, each from the state that the tokens before it lead to."""
        per = -(-texts.lengths // stretch)
        text = np.repeat(np.arange(len(per)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        at = texts.starts[text] + 1 + nth * stretch
        left = np.minimum(texts.lengths[text] - nth * stretch, stretch)
        by = np.argsort(-left, kind="stable")
        text, at, left = text[by], at[by], left[by]
        state = self._reached(texts, at - 1)
        sums = np.zeros(len(at))
        active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
        for step, n in enumerate(active):
            token, now = texts.tokens[at[:n] + step], state[:n]
            seek = np.arange(n)
            while len(seek):
                key = now[seek] * self.width + token[seek]
                found = np.searchsorted(self.arc, key)
                hit = self.arc[np.minimum(found, len(self.arc) - 1)] == key
                mine, arc = seek[hit], found[hit]
                sums[mine] += self.log[arc]
                now[mine] = self.target[arc]
                seek = seek[~hit]
                sums[seek] += self.weight[now[seek]]
                now[seek] = self.fail[now[seek]]
        return np.bincount(text, weights=sums, minlength=len(texts.lengths))

    def _reached(self, texts: Texts, at: np.ndarray) -> np.ndarray:
        """The state after the token at a position: of the longest n-gram of the text that ends there."""
        out = np.zeros(len(at), dtype=np.int64)
        for level, state in zip(texts.levels[:-1] or texts.levels, self.state):
            there = level.at[at]
            out = np.where(there >= 0, state[there], out)
        return out


def _scorer(schema: pa.Schema, order: int, n_tokens: int, n_types: int, strength: tuple[float, ...]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(_rows(batch)):
                yield scored(row, batch.column("answers")[k])

    def scored(row: dict, answers: pa.Scalar) -> pa.RecordBatch:
        texts = Texts(row["sizes"], row["held"], row["words"], row["tokens"], order)
        by_key = texts.sorted_keys()[1]
        sizes = [len(x.key) for x in texts.levels]
        for level in texts.levels:  # what only the keys were made for
            level.key = level.trained = None
        totals = np.empty(len(by_key), dtype=np.uint64)
        totals[by_key] = np.concatenate([_unpacked(x["counts"].as_py(), np.uint64) for x in answers])
        del by_key
        counts = np.split(totals, np.cumsum(sizes)[:-1])
        model = Automaton(texts, counts, n_tokens, n_types, strength)
        predicted = np.ones(len(texts.tokens), dtype=bool)
        predicted[texts.starts] = False
        known = np.add.reduceat((counts[0] > 0)[texts.tokens] & predicted, texts.starts, dtype=np.int64)
        base = np.add.reduceat(np.where(predicted, model.unigrams[texts.tokens], 0.0), texts.starts)
        out = [row["doc_ids"], pa.array(row["held"]), pa.array(texts.lengths), pa.array(known), pa.array(np.full(len(known), n_tokens, dtype=np.int64)), pa.array(base), pa.array(model.traversed(texts))]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)

    return score


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def scores(
    docs: DataFrame, order: int = ORDER, strength: tuple[float, ...] = STRENGTH, chunk_tokens: int = CHUNK_TOKENS, chunk_bytes: int = CHUNK_BYTES, bucket_tokens: int = BUCKET_TOKENS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Learns from all rows that are not held out: those whose crc32 of doc_id as text leaves 2 modulo 7 are. Tokens are words
    between ASCII white space, A-Z lower-cased, and one end a text. base_score adds up log10 of the root's probabilities,
    score those of the automaton; n_known counts tokens that training texts have. order is one to three.

    A null or empty text is its end alone; a null doc_id counts as the empty text when rows are held out. Without training
    rows every probability is 1 and both scores are 0. Repeated rows are read, and come back, each time; an empty table
    gives no row; other columns are not read. A very long text makes a chunk of its own and is read whole, in one task.
    Words are told apart by 62 bits of a hash, n-grams of several words by 54: where two have the same, their counts add
    up, of 10^9 distinct n-grams some thirty pairs.
    """
    if not 1 <= order <= 3 or len(strength) < order - 1:
        raise ValueError("order is 1 to 3, with a strength for each length from two on")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = lambda ddl: to_arrow_schema(spark.createDataFrame([], ddl).schema)
    ddl = f"chunk long, doc_ids array<{kind}>, held array<boolean>, sizes array<int>, words binary, tokens binary"
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    chunks = materialise(rows.mapInArrow(_encoder(arrow(ddl), chunk_tokens, chunk_bytes), ddl), "chunks")
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x + 1))).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))
    blocks = chunks.mapInArrow(_asker(order, buckets), "bucket int, chunk long, keys binary, counts binary")
    answers = materialise(blocks.groupBy("bucket").applyInPandas(_answered, _ANSWER), "answers")
    n_tokens, n_types = answers.filter("chunk IS NULL").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    # a chunk's answers are about as large as it is
    own = answers.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("answers"))
    ddl = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.join(own.hint("merge"), "chunk").mapInArrow(_scorer(arrow(ddl), order, int(n_tokens), int(n_types), tuple(strength)), ddl)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # sums of logarithms, to six places: their last digits depend on the order in which they are added up
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, xor(list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, c)), 4294967295), 4294967295) % 7 = 2 AS held_out,
    list_concat([' start'], list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), [' end']) AS w
  FROM documents
), t AS (SELECT k, held_out, unnest(range(len(w))) AS i, unnest(w) AS w FROM d),
g AS (SELECT k, held_out, i, w, lag(w) OVER (PARTITION BY k ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY k ORDER BY i) AS u FROM t),
c1 AS (SELECT w, count(*) AS c1 FROM g WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c2 FROM g WHERE NOT held_out AND i > 0 GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c3 FROM g WHERE NOT held_out AND i > 1 GROUP BY u, v, w),
n AS (SELECT coalesce(sum(c1), 0) AS n, count(*) AS types FROM c1 WHERE w <> ' start'),
p1 AS (SELECT g.k, g.i, g.u, g.v, g.w, coalesce(c1.c1, 0) AS c, (coalesce(c1.c1, 0) + 1) / CAST(n + types + 1 AS DOUBLE) AS p1 FROM g LEFT JOIN c1 USING (w), n WHERE i > 0),
p2 AS (SELECT p1.*, (coalesce(c2.c2, 0) + {STRENGTH[0]} * p1) / CAST(coalesce(h.c1, 0) + {STRENGTH[0]} AS DOUBLE) AS p2 FROM p1 LEFT JOIN c2 USING (v, w) LEFT JOIN c1 h ON h.w = p1.v),
p3 AS (SELECT p2.k, p2.c, p1, CASE WHEN i < 2 THEN p2 ELSE (coalesce(c3.c3, 0) + {STRENGTH[1]} * p2) / CAST(coalesce(h.c2, 0) + {STRENGTH[1]} AS DOUBLE) END AS p3
  FROM p2 LEFT JOIN c3 ON c3.u = p2.u AND c3.v = p2.v AND c3.w = p2.w LEFT JOIN c2 h ON h.v = p2.u AND h.w = p2.v),
s AS (SELECT k, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, round(sum(log10(p1)), 6) AS base_score, round(sum(log10(p3)), 6) AS score FROM p3 GROUP BY k)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, base_score, score FROM d JOIN s USING (k), n
"""
