"""Fuzzy search for short licence notices.

A notice that may hold up to e errors is split into e + 1 pieces: one of them must stand unchanged in any occurrence.
All pieces are sought at once as exact seeds; around each seed every span of whole words that can be the notice is
verified by a bounded-error match of the whole span. Texts and notices are compared as words with one space between.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import word_bytes


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int
    base: bool = False


#: Phrases of public licences with the labels they stand for. Those of `base` count where all their words
#: stand consecutively; with errors, and for the other phrases, the label is the notice's own.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("agpl", "affero general public license", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by", "licensed under cc by", 1),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mpl", "mozilla public license", 2),
    Notice("proprietary", "all rights reserved", 1),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
)


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of a phrase with where they start."""
    cuts = [len(phrase) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds all places of notices in a text."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for at, piece in pieces(notice.phrase, notice.errors):
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.phrase)}){{e<={n.errors}}}") for n in notices]
        self.seen: dict[tuple[int, str], int | None] = {}

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of each place in a text of words with one space between, by start.

        Every exact place between word bounds is reported; of places with errors that overlap another place of the
        same notice, the one with the fewest errors, then the first. An approximate place too starts and ends with a
        word. What a text costs grows with its seeds, not with their square.
        """
        starts: set[tuple[int, int]] = set()
        for end, (size, uses) in self.automaton.iter(text):
            for k, at in uses:
                start, most = end + 1 - size - at, self.notices[k].errors
                starts.update((k, s) for s in range(max(0, start - most), start + most + 1) if s == 0 or text[s - 1] == " ")
        out: list[tuple[int, int, int, int]] = []
        near: list[tuple[int, int, int, int]] = []
        for k, s in starts:
            size, most = len(self.notices[k].phrase), self.notices[k].errors
            for e in range(max(s + 1, s + size - most), min(len(text), s + size + most) + 1):
                if e == len(text) or text[e] == " ":
                    n = self.errors(k, text[s:e])
                    if n is not None:
                        (near if n else out).append((k, s, e, n))
        taken: dict[int, bytearray] = {}
        for k, s, e, _ in out:
            taken.setdefault(k, bytearray(len(text)))[s:e] = b"\1" * (e - s)
        for k, s, e, n in sorted(near, key=lambda x: (x[0], x[3], x[1], x[2])):
            mine = taken.setdefault(k, bytearray(len(text)))
            if mine.find(1, s, e) < 0:
                mine[s:e] = b"\1" * (e - s)
                out.append((k, s, e, n))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def errors(self, k: int, span: str) -> int | None:
        """The least number of errors that make a span of a notice; none where it takes more than the notice may hold.
        Spans are verified by bounded-error matching of the whole span; those seen last are kept, which changes no result."""
        known = self.seen.get((k, span), -1)
        if known == -1:
            if len(self.seen) >= 100_000:
                self.seen.clear()
            match = self.patterns[k].fullmatch(span)
            known = self.seen[k, span] = None if match is None else sum(match.fuzzy_counts)
        return known


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...] = NOTICES) -> Scanner:
    return Scanner(notices)


_SPANS = "array<struct<label:string,base:boolean,first_word:long,last_word:long,errors:int,score:double>>"


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, spans) for each row of docs (doc_id, text): of each place of a notice its label, whether it is
    one of the base places, the first and the last of its words (from 0), its errors and 1 - errors / length.

    A null or empty text has no words and no spans; a very long one is read whole. Of places of a notice with equally
    many errors that overlap, the first is given; places of different notices may overlap, and all are given. Repeated
    rows come back repeated, an empty table gives no row, and other columns are not read.
    """

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        look = scanner(notices)
        for batch in texts:
            sizes, spans = [], []
            for text in batch:
                words = word_bytes(text)
                line = b" ".join(words).decode("utf-8", "surrogatepass")
                sizes.append(len(words))
                own, at, w = [], 0, 0
                for k, start, end, errors in look(line):
                    w, at = w + line.count(" ", at, start), start
                    n = notices[k]
                    label = n.label if n.base and not errors else n.label + "-like" if errors else n.label
                    own.append({"label": label, "base": n.base and not errors, "first_word": w, "last_word": w + line.count(" ", start, end), "errors": errors, "score": 1 - errors / len(n.phrase)})
                spans.append(own)
            yield pd.DataFrame({"n_words": sizes, "spans": spans})

    found = F.pandas_udf(find, f"n_words long, spans {_SPANS}")(F.col("text").cast("string"))
    return docs.select("doc_id", found.alias("f")).select("doc_id", "f.n_words", "f.spans")


def report(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_fuzzy) of scan(docs): first_word
    and last_word are the least and the greatest start of base places, score is the best of any place, 0 without one."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    labels = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan(docs, notices).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.size(F.filter("spans", lambda s: s["errors"] > 0)).cast("long").alias("n_fuzzy"),
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
