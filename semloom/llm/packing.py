"""Packing documents into sequences of fixed length by non-negative least squares on the histogram of lengths.

A document's ids are cut after every WINDOW; the full windows are sequences of their own, and what remains is a piece
of 1 to WINDOW - 1 ids. Of these only the histogram matters: the combinations of up to three lengths that fill a
window exactly are enumerated, how often each is to be used is solved as non-negative least squares against the
histogram by an active set, the solution is rounded within what there is, and the residual is packed greedily. All this
is bounded by the window. The pieces then look up their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.llm.common import materialise
from semloom.llm.tokens import TOKENIZER, encoder

WINDOW, END = 1024, 0
#: A length's weight is its share of the window to this power: a long piece left over needs a sequence of its own, short
#: ones fit in anywhere.
POWER = 6


def combinations(window: int) -> np.ndarray:
    """The rows (a, b, c), a >= b >= c, of up to three lengths that fill a window: c is 0 where two do."""
    b, c = np.meshgrid(np.arange(1, window), np.arange(0, window), indexing="ij")
    a = window - b - c
    fits = (a >= b) & (b >= c)
    return np.stack([a[fits], b[fits], c[fits]], axis=1)


def solve(histogram: np.ndarray, combos: np.ndarray, batch: int = 96, rounds: int = 40, enough: float = 1e-3) -> np.ndarray:
    """Repeats >= 0 of the combos whose lengths come near the histogram, by weighted least squares and an active set, so
    that no more combos are in use than there are lengths.

    Each round takes in the columns of steepest descent, of which no two share a length, solves for the set, and lets
    those go that would be negative. It ends when so little of the squared histogram is left, or no column helps.
    """
    weight = (np.arange(len(histogram)) / max(1, len(histogram) - 1)) ** POWER
    target = histogram * weight
    norms = np.sqrt(sum(weight[combos[:, k]] ** 2 for k in range(3)))
    used, matrix, gap = np.empty(0, dtype=np.int64), np.empty((len(target), 0)), target
    least, kept, repeats, stale = np.inf, used, np.empty(0), 0
    for _ in range(rounds):
        pull = weight * gap
        gain = sum(pull[combos[:, k]] for k in range(3)) / norms
        gain[used] = 0
        free, new = np.ones(len(target), dtype=bool), []
        for c in np.argsort(-gain, kind="stable")[: 40 * batch]:
            rows = combos[c][combos[c] > 0]
            if gain[c] <= 1e-7 or len(new) == batch:
                break
            if free[rows].all():
                free[rows] = False
                new.append(c)
        if not new:
            break
        more = np.zeros((len(target), len(new)))
        for k in range(3):
            np.add.at(more, (combos[new, k], np.arange(len(new))), weight[combos[new, k]])
        used, matrix = np.concatenate([used, new]).astype(np.int64), np.hstack([matrix, more])
        square, right = matrix.T @ matrix, matrix.T @ target
        while True:
            x = np.linalg.solve(square + 1e-9 * np.eye(len(square)), right)
            good = x > 1e-9
            if good.all():
                break
            used, matrix, square, right = used[good], matrix[:, good], square[np.ix_(good, good)], right[good]
        gap = target - matrix @ x
        left = gap @ gap
        stale = 0 if left < least else stale + 1
        if left < least:
            least, kept, repeats = left, used, x
        if stale == 3 or left <= enough * (target @ target):
            break
    out = np.zeros(len(combos))
    out[kept] = repeats
    return out


def rounded(left: np.ndarray, combos: np.ndarray, repeats: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats of combos, taken from what is left: first what each has in full, then by largest remainder one more
    wherever its lengths are still there."""
    out, whole = [], np.floor(repeats + 1e-9).astype(np.int64)
    rest = repeats - whole
    for order, times in ((np.argsort(-whole, kind="stable"), whole), (np.argsort(-rest, kind="stable"), (rest > 1e-6).astype(np.int64))):
        for k in order:
            if not times[k]:
                break
            out += _take(left, tuple(int(v) for v in combos[k] if v), int(times[k]))
    return out


def solution(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Solves and rounds, again for what rounding leaves while that places a twentieth of them."""
    every, out = combinations(window), []
    while True:
        combos = every[(left[every] > 0).sum(axis=1) >= (every > 0).sum(axis=1)]
        before = int(left.sum())
        if not len(combos) or not before:
            return out
        out += rounded(left, combos, solve(left.astype(float), combos))
        if (before - int(left.sum())) * 20 < before:
            return out


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): sequences that hold every piece of the histogram (pieces by length) once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out = solution(left, window)
    # the residual: what still fills a window exactly, then the longest piece, and again and again the longest that fits
    combos = combinations(window)
    for k in np.flatnonzero((left[combos] > 0).sum(axis=1) >= (combos > 0).sum(axis=1)):
        out += _take(left, tuple(int(v) for v in combos[k] if v), window * int(left.sum()))
    while (longest := np.flatnonzero(left)).size:
        lengths, room, used = [int(longest[-1])], window - int(longest[-1]), {int(longest[-1]): 1}
        while room > 0:
            fits = [v for v in np.flatnonzero(left[: room + 1])[::-1] if left[v] > used.get(int(v), 0)]
            if not fits:
                break
            v = int(fits[0])
            lengths.append(v)
            used[v] = used.get(v, 0) + 1
            room -= v
        out += _take(left, tuple(lengths), int(left.sum()))
    return out


def _take(left: np.ndarray, lengths: tuple[int, ...], most: int) -> list[tuple[tuple[int, ...], int]]:
    need = {v: lengths.count(v) for v in lengths}
    n = min(most, *(int(left[v]) // m for v, m in need.items()))
    for v, m in need.items():
        left[v] -= n * m
    return [(lengths, n)] if n > 0 else []


def _slots(packed: list[tuple[tuple[int, ...], int]], first: int) -> dict[int, np.ndarray]:
    """By length, rows (rank, sequence, offset): pieces from that rank on take the sequences from that one on."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    for lengths, n in packed:
        offset = 0
        for v in lengths:
            rows.setdefault(v, []).append((taken.get(v, 0), first, offset))
            taken[v] = taken.get(v, 0) + n
            offset += v
        first += n
    return {v: np.array(r, dtype=np.int64) for v, r in rows.items()}


def pieces(docs: DataFrame, name: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank) of every piece; rank counts the pieces of a length
    in a partition."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part, ranks, end = encoder(name), TaskContext.get().partitionId(), {}, np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rank = ranks[length] = ranks.get(length, -1) + 1
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, rank))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, schema)


def pack(docs: DataFrame, name: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of docs (doc_id, text).

    A document is its ids without added special tokens, then END; a null text is empty and so has one id. Pieces are
    written before they are counted, so a lost executor cannot deal them anew. Repeated rows are documents of their
    own, null doc_ids stay null, an empty table gives no row. Other columns are not read.
    """
    cut = materialise(pieces(docs, name, window), "pieces")
    counts = materialise(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in totals.items():
        histogram[length] = n
    full, histogram[window] = int(histogram[window]), 0
    slots = _slots(plan(histogram, window), full)
    slots[window] = np.array([(0, 0, 0)], dtype=np.int64)
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part", "length", ahead.alias("base"))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for v in np.unique(lengths):
            rows, mine = slots[int(v)], lengths == v
            at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
            sequence[mine], offset[mine] = rows[at, 1] + ranks[mine] - rows[at, 0], rows[at, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = cut.join(bases, ["part", "length"]).withColumn("at", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("rank") + F.col("base")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
