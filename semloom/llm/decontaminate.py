"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the hashes of k consecutive words, the least of every w successive ones is a fingerprint. Texts that share
k + w - 1 words in a row share the fingerprint of that stretch, so with k + w - 1 equal to the window's words no
occurrence can be missed. Documents and benchmark items are joined on fingerprints; where a document has one of an
item, the windows around it are laid against the items' windows as whole words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import WORD_SEPARATORS, ascii_lower, materialise

WINDOW = 10
#: Benchmark tables of up to so many bytes, summed first, are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: So many values has the hash by which texts without a hit are held back from the shuffle.
SIEVE = 1 << 18


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), WORD_SEPARATORS), lambda w: w != "")


def _count(x: Column) -> Column:
    """The length of an array, 0 for null: size() of null is null or -1, as the session's ANSI mode will have it."""
    return F.when(x.isNull(), 0).otherwise(F.size(x)).cast("long")


def _each(n: Column, f) -> Column:
    """f(i) for i from 0 to n - 1."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")), f)


def _winnowing(size: int) -> tuple[int, int]:
    """k and w with k + w - 1 equal to a window's words."""
    k = (size + 1) // 2
    return k, size - k + 1


def _grams(hashes: Column, size: int) -> Column:
    """The hashes of k consecutive words; windows of different sizes have different ones."""
    k, _ = _winnowing(size)
    return _each(F.size(hashes) - (k - 1), lambda i: F.xxhash64(F.lit(size), *(F.get(hashes, i + j) for j in range(k))))


def _winnowed(grams: Column, w: int) -> Column:
    return F.array_distinct(_each(F.size(grams) - (w - 1), lambda i: F.array_min(F.slice(grams, i + 1, w))))


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """df, of one column, with a broadcast hint if it takes no more bytes than that, 32 of them for each row."""
    used = df.agg(F.sum(F.octet_length(F.col(df.columns[0]).cast("string")) + 32)).first()[0] or 0
    return F.broadcast(df) if used <= most else df


def _hashed(df: DataFrame, words: Column, sizes: list[int]) -> DataFrame:
    """df with the hashes of words as _h and, for each size of windows, its k-grams as _g<size>."""
    hashed = df.withColumn("_h", F.transform(words, lambda x: F.xxhash64(x)))
    return hashed.withColumns({f"_g{n}": _grams(F.col("_h"), n) for n in sizes})


def _occurrences(docs: DataFrame, windows: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """(key, at, size, window) wherever a window stands in docs (key, text); windows: (size, window), of these sizes.

    A text is cut into words and hashed once for the fingerprints of all sizes, and once more where it has one."""
    w = {n: _winnowing(n)[1] for n in sizes}
    prints = _hashed(windows, F.split("window", " "), sizes)
    prints = prints.select(F.explode(F.coalesce(*(F.when(F.col("size") == n, _winnowed(F.col(f"_g{n}"), w[n])) for n in sizes))).alias("print")).distinct()
    prints = _bounded(materialise(prints, "prints"), most)
    # a text of fewer words has no fingerprint; a filter on its words would have them cut and hashed once more
    marks = _hashed(docs, _words(F.col("text")), sizes)
    marks = marks.select("key", F.explode(F.flatten(F.array(*(_winnowed(F.col(f"_g{n}"), w[n]) for n in sizes)))).alias("print"))
    hits = materialise(marks.join(prints, "print").groupBy("key").agg(F.collect_set("print").alias("prints")), "hits")
    # most texts without a hit stay where they are: a hash of the keys that hit has no more than SIEVE values, whatever
    # their number, so these can be broadcast
    sieve = lambda key: F.pmod(F.xxhash64(key), F.lit(SIEVE)).cast("int")
    near = docs.join(F.broadcast(hits.select(sieve("key").alias("_sieve")).distinct()), sieve(docs["key"]) == F.col("_sieve"), "left_semi")
    # copies of a text become one row before they are dealt, and its partitioning serves the join; hits grow with the
    # documents and so are never broadcast
    texts = near.groupBy("key").agg(F.first("text").alias("text"))
    near = _hashed(texts.join(hits.hint("merge"), "key").withColumn("_w", _words(F.col("text"))), F.col("_w"), sizes)

    def spans(n: int) -> Column:
        grams = F.col(f"_g{n}")
        # a window holds its fingerprint in one of its w places
        places = F.filter(_each(F.size(grams), lambda i: i), lambda i: F.array_contains("prints", F.get(grams, i)))
        starts = F.transform(places, lambda q: F.when(F.size("_w") >= n, F.sequence(F.greatest(q - (w[n] - 1), F.lit(0)), F.least(q, F.size("_w") - n))))
        at = F.array_distinct(F.flatten(F.filter(starts, lambda x: x.isNotNull())))
        return F.transform(at, lambda p: F.struct(p.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("_w", p + 1, n), " ").alias("window")))

    found = near.select("key", F.explode(F.flatten(F.array(*(spans(n) for n in sizes)))).alias("s")).select("key", "s.at", "s.size", "s.window")
    return found.join(_bounded(windows.select("window"), most), "window").select("key", "at", "size", "window")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs (doc_id, text).

    Words are lower-cased runs of ASCII letters and digits and of characters beyond ASCII. A window is so many
    consecutive words of a benchmark item (item_id, text); an item with fewer words, but not none, is one window. A
    word of a document is hit if it lies in an occurrence of a window; n_items counts the items that have occurring
    windows, items_sha256 is of their ids, sorted as strings and comma-joined. A null or empty text has no words; a very
    long one is read whole. Repeated rows come back repeated, an empty table gives no row or no hit; a null item_id counts with the empty string as its id. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(F.col("text").cast("string")).alias("w"))
    size = F.least(F.size("w"), F.lit(window))
    spans = _each(F.size("w") - size + 1, lambda i: F.array_join(F.slice("w", i + 1, size), " "))
    owned = items.filter("size(w) > 0").select("item", size.alias("size"), F.explode(spans).alias("window")).distinct()
    owned = materialise(owned, "windows")
    sizes = sorted(r["size"] for r in owned.select("size").distinct().collect())  # no more than there are words in a window
    texts = docs.filter("text <> ''").select("key", "text")
    if sizes:
        found = _occurrences(texts, owned.select("size", "window").distinct(), sizes, most)
    else:
        found = spark.createDataFrame([], "key string, at int, size int, window string")
    found = materialise(found.distinct(), "found")
    ordered = F.sort_array(F.collect_set(F.struct("at", "size")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["at"] + x["size"])
        return F.struct(end.alias("end"), (acc["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(acc["end"], x["at"]))).alias("n"))

    hit = found.groupBy("key").agg(F.aggregate(ordered, start, cover)["n"].cast("long").alias("n_hit"))
    own = found.select("key", "window").distinct().join(owned.select("window", "item"), "window").select("key", "item").distinct()
    named = own.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    facts = materialise(hit.join(named, "key"), "facts")
    out = docs.select("doc_id", "key", _count(_words(F.col("text"))).alias("n_words")).join(facts, "key", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), _count(F.col("items")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' '))) AS x
  FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS x
  FROM d, sizes WHERE len(w) >= n
), hits AS (SELECT DISTINCT doc_id, pos, dw.n, item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
words AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS k FROM hits),
h AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
