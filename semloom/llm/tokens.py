"""Token counts and ids of whole texts, huge ones by overlap resynchronisation.

Texts of up to WHOLE characters are encoded at once. A longer one is cut into chunks that overlap; each chunk is
encoded by itself, and two neighbours are spliced at a boundary that both found and that is proven stable: it starts a
pre-token in both, and at least MARGIN characters of the overlap lie on either side of it. The pre-tokeniser looks no
further back than the start of a pre-token and two characters ahead, and an added token is shorter than MARGIN, so
what follows such a boundary is the same in both. Where two neighbours share none, the overlap is widened.
"""

from __future__ import annotations

import os
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from semloom.llm.common import materialise

TOKENIZER = "byte_bpe_50k.json"
WHOLE, CHUNK, OVERLAP, MARGIN = 32_768, 16_384, 512, 40
LIMIT = 1024


def load(name: str = TOKENIZER) -> Tokenizer:
    """The tokenizer of a vocabulary file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Signs that a word often ends in; before each of them, after a Latin letter, a pre-token ends.
_SIGNS = ".,;:!?*%$&#|"


def units(text: str) -> list[str]:
    """Cuts a text where the byte-level pre-tokeniser ends a pre-token in any case, so that the tokens of the text are
    those of its units, one after the other:

    - before a space that follows a character other than white space: no pre-token goes on from there to a space;
    - on both sides of a single line feed between characters other than white space, which is a pre-token of its own;
    - between a Latin letter and signs: a run of letters ends there. What holds the start of an added token stays whole.
    """
    out, open_ = [], False
    add = out.append
    for k, part in enumerate(text.split(" ")):
        if k and not open_ and part.isalpha():
            add(" " + part)
            continue
        if k:
            part = " " + part
        if open_:
            out[-1] += part
            part = out.pop()
        if not part or part[-1].isspace():
            add(part)
            open_ = True
            continue
        open_ = False
        if "<|" in part:
            add(part)
            continue
        if "\n" in part:
            lines = part.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines[1:]) and lines[0] and not lines[0][-1].isspace():
                for line in lines[:-1]:
                    _cut(line, add)
                    add("\n")
                part = lines[-1]
            else:
                add(part)
                continue
        if part[-1] in _SIGNS:
            _cut(part, add)
        else:
            add(part)
    return out


def _cut(part: str, add: Callable[[str], None]) -> None:
    word = part.rstrip(_SIGNS)
    if len(word) < len(part) and word and word[-1].isalpha() and word[-1] < "\u0250":
        add(word)
        add(part[len(word) :])
    else:
        add(part)


#: Units of more characters are rarely seen twice, and are not kept; the others are, in about so many bytes.
KEPT_LENGTH, KEPT_BYTES = 64, 160 << 20


class _Units(dict):
    """The ids of units, made when first asked for; those of short units are kept in about so many bytes."""

    def __init__(self, tokenizer: Tokenizer, room: int):
        super().__init__()
        self.tokenizer, self.room, self.left = tokenizer, room, room

    def __missing__(self, unit: str) -> bytes:
        ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= KEPT_LENGTH:
            self.left -= 150 + 4 * len(unit) + len(found)
            if self.left < 0:
                self.clear()
                self.left = self.room
            self[unit] = found
        return found


class Encoder:
    """Ids of texts as little-endian 32-bit integers; keeps the ids of short units in about so many bytes, which changes no
    result."""

    def __init__(self, name: str = TOKENIZER, room: int = KEPT_BYTES):
        self.tokenizer = load(name)
        self.seen = _Units(self.tokenizer, room)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self._slice, _slices(text)))

    def _slice(self, text: str) -> bytes:
        return b"".join(map(self.seen.__getitem__, units(text)))


@lru_cache(maxsize=1)
def encoder(name: str = TOKENIZER) -> Encoder:
    """The Encoder of a worker process, which goes on from task to task."""
    return Encoder(name)


def _slices(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A text in slices cut where units() cuts, so that no call takes a very long one. Where a long stretch has no such
    place, it stays whole."""
    at = 0
    while at < len(text):
        end, seek = min(len(text), at + size), at + size
        while end < len(text):
            end = text.find(" ", seek)
            if end < 0:
                end = len(text)
            elif text[end - 1].isspace():
                seek, end = end + 1, at
            else:
                break
        yield text[at:end]
        at = end


def boundaries(tokenizer: Tokenizer, text: str) -> tuple[int, list[int], list[int]]:
    """The number of tokens of a text, where its pre-tokens end, and how many tokens lie before each of these places."""
    found = tokenizer.encode(text, add_special_tokens=False)
    words, offsets = found.word_ids, found.offsets
    at = [k for k in range(1, len(words)) if words[k] != words[k - 1]]
    return len(words), [offsets[k - 1][1] for k in at], at


def _between(ends: list[int], counts: list[int], low: int, high: int, base: int) -> list[dict]:
    x, y = bisect_left(ends, low), bisect_left(ends, high)
    return [{"at": e + base, "n": c} for e, c in zip(ends[x:y], counts[x:y])]


def chunked_counts(texts: DataFrame, name: str = TOKENIZER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of texts (key, text) by overlapping chunks; key must be unique.

    Each round chunks the texts that the one before could not splice, with chunks and overlaps four times as wide; a
    chunk that spans the text needs no splice, so rounds end.
    """
    spark, done = texts.sparkSession, None
    left = texts

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(name)
        for batch in batches:
            rows = []
            for key, k, start, part, last, lap in zip(batch["key"], batch["k"], batch["start"], batch["part"], batch["last"], batch["lap"]):
                n, ends, counts = boundaries(tokenizer, part)
                head = [] if k == 0 else _between(ends, counts, MARGIN, lap - MARGIN, start)
                tail = [] if last else _between(ends, counts, len(part) - lap + MARGIN, len(part) - MARGIN, start)
                rows.append((key, k, last, n, head, tail))
            yield pd.DataFrame(rows, columns=["key", "k", "last", "n", "head", "tail"])

    def cutter(chunk: int, overlap: int):
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, text in zip(batch["key"], batch["text"]):
                    # a text is walked through once, and goes out in rows of few chunks
                    n = max(1, -(-(len(text) - overlap) // chunk))
                    for first in range(0, n, 64):
                        ks = range(first, min(n, first + 64))
                        rows = [(key, k, k * chunk, text[k * chunk : (k + 1) * chunk + overlap], k == n - 1, overlap) for k in ks]
                        yield pd.DataFrame(rows, columns=["key", "k", "start", "part", "last", "lap"])

        return cut

    spots = "array<struct<at:long,n:long>>"
    while True:
        parts = left.select("key", "text").mapInPandas(cutter(chunk, overlap), "key binary, k int, start long, part string, last boolean, lap int")
        coded = parts.repartition("key", "k").mapInPandas(encode, f"key binary, k int, last boolean, n long, head {spots}, tail {spots}")
        order = Window.partitionBy("key").orderBy("k")
        before = F.lag("tail").over(order)
        meets = F.filter("head", lambda h: F.exists("before", lambda b: b["at"] == h["at"]))
        joined = coded.withColumn("before", before).withColumn("meet", F.when(F.col("k") > 0, F.get(meets, 0)))
        joined = joined.withColumn("enter", F.when(F.col("k") > 0, F.col("meet.n")).otherwise(0))
        earlier = F.filter("before", lambda b: b["at"] == F.col("meet.at"))
        # what the chunk before counted beyond the place of the splice is taken away again
        part = joined.withColumn("cut", F.when(F.col("k") > 0, F.get(earlier, 0)["n"]).otherwise(0)).withColumn("prior", F.coalesce(F.lag("n").over(order), F.lit(0)))
        sums = part.groupBy("key").agg(F.sum(F.col("n") - F.col("enter") - (F.col("prior") - F.col("cut"))).alias("n_tokens"), F.bool_or(F.col("enter").isNull()).alias("failed"))
        sums = materialise(sums, "chunks")
        good = sums.filter("NOT failed").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        if sums.filter("failed").isEmpty():
            return done
        left = left.join(sums.filter("failed"), "key", "left_semi")
        chunk, overlap = chunk * 4, overlap * 4


def token_counts(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT, whole: int = WHOLE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text).

    Counts what the library gives for the whole text without begin, end or added special tokens; special strings
    inside a text are what the library takes them for. A null text counts as empty, an empty table gives no row. Copies of a
    huge text are encoded once; a very long one without spaces is cut into chunks as any other, which widen until they can
    be spliced. Repeated rows and rows with a null doc_id come back as they are; other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(name)
        for batch in texts:
            yield batch.map(lambda t: len(encode(t)) // 4).astype("int64")

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    short = docs.filter(F.length("text") <= whole).select("doc_id", n_bytes, F.pandas_udf(count, "long")("text").alias("n_tokens"))
    huge = docs.filter(F.length("text") > whole).withColumn("key", F.unhex(F.sha2("text", 256)))
    counts = chunked_counts(huge.select("key", "text").dropDuplicates(["key"]), name, chunk, overlap)
    long = huge.select("doc_id", n_bytes, "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
