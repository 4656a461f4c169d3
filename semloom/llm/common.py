"""Scratch tables, word rules and hashing that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters and digits are word characters, as is everything beyond ASCII.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: As UTF-8 bytes: A-Z become a-z, every other ASCII separator a space.
_WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, as in tests, one is made where the session names
    none; a cluster's executors would not see the driver's folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="semloom-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_scratch(table: DataFrame) -> None:
    """Removes a table that materialise() returned and that no later result reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_bytes(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters and digits and of characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space, as UTF-8; bytes know no other white space and no other case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes:
    """64-bit hashes of words; keeps those of up to 4 * limit words of no more than 64 bytes, which changes no hash."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.seen = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > self.limit:
            seen.clear()
        out = np.empty(len(words), dtype=np.uint64)
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)]
            long = False
            for w in set(part).difference(seen):
                if len(w) <= 64:
                    seen[w] = digest(w)
                else:
                    long = True
            own = (seen[w] if len(w) <= 64 else digest(w) for w in part) if long else map(seen.__getitem__, part)
            out[at : at + len(part)] = np.fromiter(own, dtype=np.uint64, count=len(part))
            if len(seen) > 4 * self.limit:
                seen.clear()
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit integers over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mixed(out)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, one key after the other, from batches that are sorted by keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        now = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            now[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(now), len(batch)]
        for x, y in zip(starts, starts[1:]):
            part = batch.iloc[x:y]
            if held and (x or any(held[-1][k].iat[-1] != part[k].iat[0] for k in keys)):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
