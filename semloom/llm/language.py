"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds those of its letters, each rotated by its
place; a text bundles the vectors of its trigrams; a language's prototype bundles those of its texts. A text has the
language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS, SYMBOLS, SEED = 1024, 2048, 20_240_607
#: The fit takes about so many texts of each language, chosen by a hash of doc_id, so that its cost has a bound.
TEXTS_PER_LANGUAGE = 2000
UNKNOWN = "und"
#: In a pipeline, a text goes whose nearest language is not nearer than this: vectors of unlike letters come to about 0.03,
#: a single word of a known language to 0.1 and more, clean prose to over 0.5.
LEAST_SCORE = 0.05
_STEP, _GROUP = 1 << 20, 128


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """By code point: the symbol of a letter, cases alike; 0 for everything else."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = 1 + ord(x.lower()[0]) * 2_654_435_761 % (SYMBOLS - 1)
    return out


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of the symbols, rotated by two places, one and none."""
    v = (np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIMENSIONS), dtype=np.int8) * 2 - 1).astype(np.float32)
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """The distinct trigrams of a text's letters and gaps with their counts, and whether it has a letter."""
    table, total, letter, carry = _symbols(), {}, False, np.zeros(1, dtype=np.int64)
    ids, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    text = text or ""
    for at in range(0, len(text), _STEP):
        piece = text[at : at + _STEP]
        s = np.concatenate([carry, table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], np.zeros(int(at + _STEP >= len(text)), dtype=np.int64)])
        letter |= bool(s[1:].any())
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = (s[1:] > 0) | (s[:-1] > 0)  # a gap is one symbol however long
        s = s[fresh]
        carry = s[-2:]
        x, n = np.unique((s[:-2] << 22) | (s[1:-1] << 11) | s[2:], return_counts=True)
        if not len(ids):
            ids, counts = x, n
        else:
            both, back = np.unique(np.concatenate([ids, x]), return_inverse=True)
            ids, counts = both, np.bincount(back, weights=np.concatenate([counts, n])).astype(np.int64)
    return ids, counts, letter


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, zero where a text has no letter; and which texts have one."""
    found = [trigrams(t) for t in texts]
    letter = np.array([x[2] for x in found], dtype=bool)
    sizes = [len(x[0]) for x in found]
    if not sum(sizes):
        return np.zeros((len(texts), DIMENSIONS), dtype=np.float32), letter
    ids, back = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    two, one, none = _letters()
    rows, counts = np.repeat(np.arange(len(texts)), sizes), np.concatenate([x[1] for x in found]).astype(np.float32)
    for at in range(0, len(ids), 4096):
        part = ids[at : at + 4096]
        mine = (back >= at) & (back < at + len(part))
        weights = np.zeros((len(texts), len(part)), dtype=np.float32)
        weights[rows[mine], back[mine] - at] = counts[mine]
        out += weights @ (two[part >> 22] * one[(part >> 11) & 2047] * none[part & 2047])
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
    out[~letter] = 0
    return out, letter


def fit(samples: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes, from samples (doc_id, text, lang): about per_language texts of each."""
    known = samples.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, DIMENSIONS), dtype=np.float32)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    some = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), _GROUP):
                part = batch.iloc[at : at + _GROUP]
                vectors, langs = encoded([*part["text"]])[0], part["lang"].to_numpy()
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "k": np.arange(DIMENSIONS), "v": v})

    sums = some.select("text", "lang").mapInPandas(bundle, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).toPandas()
    langs = sorted(sums["lang"].unique())
    out = np.zeros((len(langs), DIMENSIONS))
    out[sums["lang"].map({x: i for i, x in enumerate(langs)}), sums["k"]] = sums["v"]
    return langs, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predicted(langs: list[str], prototypes: np.ndarray):
    """A pandas UDF from text to (lang, score): und and 0 where a text has no letter or no language is known."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = [], []
            for at in range(0, len(texts), _GROUP):
                vectors, letter = encoded([*texts.iloc[at : at + _GROUP]])
                if not langs:
                    letter[:] = False
                cosines = vectors @ prototypes.T if langs else np.zeros((len(vectors), 1))
                best = cosines.argmax(axis=1)
                lang += [langs[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
                score += [float(min(1, max(0, c[b]))) if ok else 0.0 for c, b, ok in zip(cosines, best, letter)]
            yield pd.DataFrame({"lang": lang, "score": score})

    return F.pandas_udf(predict, "lang string, score double")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    Learns from the rows with text and lang that are not held out: those whose crc32 of doc_id as text leaves 2 modulo
    4 are. Predictions see the text only. A text that is null or has no letter is und with score 0; of equally near
    languages the first by name is taken. Repeated rows come back repeated, an empty table gives no row, and a null
    doc_id counts as the empty text. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = fit(docs.filter(~held_out()), per_language)
    out = docs.select("doc_id", held_out().alias("held_out"), predicted(*model)("text").alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
