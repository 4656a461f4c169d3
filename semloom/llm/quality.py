"""Quality as an ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = logistic(threshold[k] - w . x): all grades share the weights w of the hashed features x, and ordered
thresholds cut the scale. The model gives a text's expected grade and the probability of its tail, grade >= g.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import gram_hashes

BUCKETS = 1 << 16
#: Tokens of more characters than this, or of scripts without spaces between words, are read as character n-grams.
LONG = 24
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: The fit takes at most so many rated documents, those of least hash of doc_id, so that its cost has a bound.
RATED = 6000
RIDGE, ROUNDS = 1e-5, 80
#: Documents stay whose probability of the top grade is at least this.
LEAST_TAIL = 0.75


def _shape(token: str) -> str:
    """Runs of capitals, small letters, digits and of each other sign, as one sign each."""
    out = []
    for c in token:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class Features:
    """Hashed features of texts: of each token three beginnings of its word, the whole word and its shape, and whether it
    repeats the one before; of long and unspaced tokens, instead of the whole word, the n-grams of all characters, which
    share one token's count. A feature's value is the root of its share, so the length of a text doesn't matter."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.seen = limit, {}
        self.again = [self._bucket("again:" + x) for x in ("no", "yes")]

    @staticmethod
    def _bucket(feature: str) -> int:
        return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) % BUCKETS

    def _of(self, token: str) -> tuple[int, ...]:
        low = token.lower()
        word = "".join(c for c in low if c.isalnum()) or low
        whole = ("w:" + word,) if len(word) > 5 and not self._split(token) else ()
        return tuple(map(self._bucket, ("3:" + word[:3], "4:" + word[:4], "5:" + word[:5], "s:" + _shape(token), *whole)))

    @staticmethod
    def _split(token: str) -> bool:
        return len(token) > LONG or not token.isascii() and _UNSPACED.search(token) is not None

    @staticmethod
    def _grams(token: str) -> tuple[list[int], list[float]]:
        """The buckets of a token's character n-grams and their shares of it: of two characters in unspaced scripts, else three."""
        codes = np.frombuffer(token.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        k = min(2 if _UNSPACED.search(token) else 3, len(codes))
        buckets, counts = np.unique(gram_hashes(codes, k) % np.uint64(BUCKETS), return_counts=True)
        return buckets.tolist(), (counts / counts.sum()).tolist()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or "").split()
        if not tokens:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
        if len(self.seen) > self.limit:
            self.seen.clear()
        counts, seen, sums = Counter(tokens), self.seen, {}
        for token, n in counts.items():
            found = seen.get(token)
            if found is None:
                found = self._of(token)
                if self._split(token):
                    for b, share in zip(*self._grams(token)):
                        sums[b] = sums.get(b, 0) + n * share
                else:
                    seen[token] = found
            for b in found:
                sums[b] = sums.get(b, 0) + n
        again = sum(map(str.__eq__, tokens, tokens[1:]))
        for b, n in zip(self.again, (len(tokens) - again, again)):
            if n:
                sums[b] = sums.get(b, 0) + n
        index = np.fromiter(sums, dtype=np.int32, count=len(sums))
        value = np.sqrt(np.fromiter(sums.values(), dtype=np.float32, count=len(sums)) / np.float32(len(tokens)))
        return index, value


class Ordinal:
    """Weights, thresholds and the grades between them."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k from 1, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit(index: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray) -> Ordinal:
    """The maximum of the likelihood less a ridge, by limited-memory quasi-Newton steps on the driver."""
    grades = np.unique(grade)
    k, y = len(grades), np.searchsorted(grades, grade)
    if k < 2:
        return Ordinal(np.zeros(BUCKETS), np.zeros(0), grades if k else np.zeros(1))
    rows = np.repeat(np.arange(len(index)), [len(x) for x in index])
    cols, vals = np.concatenate(index).astype(np.int64), np.concatenate(value).astype(np.float32)
    by = np.argsort(cols, kind="stable")  # the same entries by column, for sums without random writes
    by_rows, by_vals = rows[by], vals[by]
    used, first_of = np.unique(cols[by], return_index=True)
    full = np.flatnonzero([len(x) > 0 for x in index])
    first_in = np.concatenate([[0], np.cumsum([len(index[i]) for i in full])[:-1]]).astype(np.int64)

    def cuts(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = p[:BUCKETS], p[BUCKETS:]
        score = np.zeros(len(y))
        if len(full):
            score[full] = np.add.reduceat(vals * w[cols], first_in)
        edge = np.concatenate([[-np.inf], cuts(t), [np.inf]])
        up, low = (1 / (1 + np.exp(-np.clip(edge[y + d] - score, -40, 40))) for d in (1, 0))
        prob = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up), low * (1 - low)
        ds = (du - dl) / prob / len(y)  # of the mean loss by the score
        grad = 2 * RIDGE * w
        if len(used):
            grad[used] += np.add.reduceat(by_vals * ds[by_rows], first_of)
        de = np.bincount(y, weights=-du / prob / len(y), minlength=k)[: k - 1] + np.bincount(y, weights=dl / prob / len(y), minlength=k)[1:]
        later = np.cumsum(de[::-1])[::-1]  # every later threshold holds this step
        return -np.log(prob).mean() + RIDGE * (w @ w), np.concatenate([grad, [later[0]], later[1:] * np.exp(t[1:])])

    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
    first = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(BUCKETS), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ROUNDS):
        d, alphas = -g, []
        for s, v, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * v
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, v, r), a in zip(past, reversed(alphas)):
            d = d + (a - r * (v @ d)) * s
        step, slope = 1.0 if past else 1 / max(1e-9, np.abs(g).sum()) * 10, g @ d
        while True:
            new_f, new_g = loss(x + step * d)
            if new_f <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, v = step * d, new_g - g
        done = abs(f - new_f) < 1e-8 * max(1, abs(f))
        x, f, g = x + s, new_f, new_g
        if s @ v > 1e-12:
            past = [*past, (s, v, 1 / (s @ v))][-8:]
        if done:
            break
    return Ordinal(x[:BUCKETS], cuts(x[BUCKETS:]), grades)


def train(docs: DataFrame, ratings: DataFrame, rated: int = RATED) -> Ordinal:
    """Fits on documents (doc_id, text) with ratings (doc_id, grade): at most so many, those of least hash of doc_id.
    Of several ratings of a document the lowest counts, of several texts the least; null ids and grades are left out."""
    known = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rated)  # the limit bounds what is broadcast

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": batch["grade"], "i": [x[0] for x in found], "v": [x[1] for x in found]})

    # of repeated rows of a document one text counts, the least: what reaches the driver is bounded by the ids
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text"))
    table = joined.mapInPandas(make, "doc_id long, grade double, i array<int>, v array<float>").toArrow()
    order = np.lexsort((table["grade"].to_numpy(), table["doc_id"].to_numpy()))  # the same fit whatever the partitions
    index, value = ([c[k].values.to_numpy() for k in order] for c in (table["i"], table["v"]))
    if not len(order):
        return Ordinal(np.zeros(BUCKETS), np.zeros(0), np.zeros(1))
    return fit(index, value, table["grade"].to_numpy()[order])


def scored(model: Ordinal):
    """A pandas UDF from text to (expected, tail): the expected grade, and the probability of the top grade."""
    weights, thresholds, grades = model.weights.astype(np.float32), model.thresholds, model.grades

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, own = Features(), Ordinal(weights, thresholds, grades)
        for texts in batches:
            s = np.array([float(weights[i] @ v) for i, v in map(features, texts)])
            tails = own.tails(s)
            expected = grades[0] + tails @ np.diff(grades)
            yield pd.DataFrame({"expected": expected, "tail": tails[:, -1] if tails.shape[1] else np.ones(len(s))})

    return F.pandas_udf(score, "expected double, tail double")


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of labels (doc_id, quality, toxic): 2 for good text, 1 if it is toxic or of low quality, 0 if both."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("double").alias("grade"))


def assess(docs: DataFrame, rated: DataFrame, most: int = RATED, least_tail: float = LEAST_TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) for each row of docs (doc_id, text), by ratings (doc_id, grade).

    tail_probability is that of the top grade, kept whether it is at least least_tail. A null or blank text has no
    features and gets what the thresholds alone say. Without ratings every document is kept. Repeated rows come back
    repeated. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(docs, rated, most)
    out = docs.select("doc_id", scored(model)("text").alias("p"))
    return out.select("doc_id", F.col("p.expected").alias("expected_grade"), F.col("p.tail").alias("tail_probability"), (F.col("p.tail") >= least_tail).alias("kept"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
