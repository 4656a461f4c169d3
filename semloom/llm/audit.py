"""How filters interact: what each removes in any order, for each part of a corpus.

Duplicates are found by sorting: texts are dealt into ranges of (fingerprint, doc_id), each range is sorted by
fingerprint, text and doc_id, and every row is compared with the one before it. A range's first row is compared with the
last row of the range before. The failures of a document are a mask; counts of masks are added up for each part, and
what an order of the filters does follows from these counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from semloom.llm.common import materialise

#: A filter's bit in a mask is 1 << its place.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
_CAPITALS, _SIGNS = bytes(range(0x41, 0x5B)), b"#$%&*|"
_MASKS = range(1 << len(FILTERS))


def text_mask(text: str) -> int:
    """The failures that a text shows by itself: A too few words, B too few distinct ones, C too many capitals, D signs."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # between ASCII white space
    out = len(words) < LEAST_WORDS
    out |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    out |= (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text)) << 2
    return out | any(s in raw for s in _SIGNS) << 3


_SORTED = "doc_id {id}, part string, mask int, pid int, run_least {id}, in_first boolean, head string, tail string, whole boolean"


def _compared(schema: pa.Schema):
    """A range's rows in order (pid, part, doc_id, text): their masks without duplicates, and the least doc_id of the run of
    equal texts that each row is in. The range's first row carries its text as head; its last row carries tail, and
    whole: whether all rows of the range have one text."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, text, mask, least, first = None, None, 0, None, True
        for batch in batches:
            for pid, part, doc_id, now in zip(*(batch.column(c).to_pylist() for c in ("pid", "part", "doc_id", "text"))):
                head = None
                if held is None:
                    head = now
                elif now != text:
                    first = False
                if held is None or now != text:
                    mask, least = text_mask(now), doc_id  # null ids come last in a run
                if held is not None:
                    rows.append(held)
                    if len(rows) >= 8192:
                        yield _batch(rows, schema)
                        rows.clear()
                else:
                    rows = []
                held, text = (doc_id, part, mask, pid, least, first, head, None, None), now
        if held is not None:
            yield _batch([*rows, (*held[:7], text, first)], schema)

    return compare


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for each row of docs (doc_id, text, source): which filters it fails, wherever they stand.

    Bits from the lowest: A, fewer than 200 words; B, fewer than half of the words distinct; C, over 2 % of the code points
    are A-Z; D, a sign of #$%&*|; E, the text is that of a row with a smaller doc_id. Words lie between ASCII white
    space. A null text counts as empty; a null doc_id is neither smaller nor greater than another, so such a row
    never fails E; of rows with one doc_id and text, all fail E or none. A part is a source, the empty string if it is null.
    An empty table gives no row, repeated rows come back repeated, other columns are not read. A text of any length is
    judged whole, one at a time; a text that many rows share spreads over as many ranges as its rows fill.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    base = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the ranges' bounds are sampled: by digests, so that no text goes to the driver; equal digests of unequal texts,
    # should there be any, stand side by side within a range, sorted by the texts
    dealt = base.withColumn("fingerprint", F.unhex(F.sha2("text", 256))).repartitionByRange(F.col("fingerprint"), F.asc_nulls_last("doc_id"))
    ordered = dealt.sortWithinPartitions("fingerprint", "text", F.asc_nulls_last("doc_id")).select("doc_id", "part", "text", F.spark_partition_id().alias("pid"))
    ddl = _SORTED.format(id=id_type.simpleString())
    schema = spark.createDataFrame([], ddl).schema

    rows = materialise(ordered.mapInArrow(_compared(to_arrow_schema(schema)), ddl), "sorted")

    # one row for each range, of which there are as many as partitions
    heads = rows.filter("head IS NOT NULL").select("pid", "head", F.col("run_least").alias("first_least"))
    tails = rows.filter("tail IS NOT NULL").select("pid", "tail", "whole", F.col("run_least").alias("last_least"))
    order = Window.orderBy("pid")
    before = tails.select("pid").withColumn("before", F.lag("pid").over(order))
    ends = tails.select(F.col("pid").alias("before"), "tail", "last_least", F.col("whole").alias("before_whole"))
    met = heads.join(before, "pid").join(ends, "before", "left")
    goes_on = F.coalesce(F.col("head") == F.col("tail"), F.lit(False))
    met = materialise(met.select("pid", goes_on.alias("goes_on"), (goes_on & F.col("before_whole")).alias("through"), F.when(goes_on, F.col("last_least")).otherwise(F.col("first_least")).alias("seed")), "bounds")
    # ranges of one text form a chain: what its first range has from the one before holds for all of them
    chained = met.withColumn("chain", F.count_if(~F.coalesce("through", F.lit(False))).over(order))
    carried = chained.withColumn("carried", F.first("seed").over(Window.partitionBy("chain").orderBy("pid"))).select("pid", "carried")
    least = F.when(F.col("in_first"), F.col("carried")).otherwise(F.col("run_least"))
    copy = F.coalesce(least < F.col("doc_id"), F.lit(False))
    # as many rows as partitions: a bounded side
    return rows.join(F.broadcast(carried), "pid").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def _counted(masks: DataFrame) -> DataFrame:
    """(part, all, good, toxic): for each part, how many documents, good ones and toxic ones have each mask."""
    def counts(on: Column | None) -> Column:
        hit = [F.col("mask") == m for m in _MASKS]
        return F.array(*(F.count_if(h if on is None else h & on) for h in hit))

    return masks.groupBy("part").agg(counts(None).alias("all"), counts(F.col("good")).alias("good"), counts(F.col("toxic")).alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, from counters (part, all, good, toxic): 600 rows a part."""
    orders = permutations(range(len(FILTERS)))
    steps = [("".join(FILTERS[f] for f in order), k + 1, sum(1 << f for f in order[:k]), 1 << order[k]) for order in orders for k in range(len(order))]
    fixed = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("bit")) for o, k, b, f in steps))
    rows = counts.withColumn("s", F.explode(fixed)).select("part", "all", "good", "toxic", "s.*")
    first, bit, through = F.col("before"), F.col("bit"), F.col("before").bitwiseOR(F.col("bit"))
    masks = F.array(*map(F.lit, _MASKS))

    def total(column: str, weight) -> Column:
        """The sum over masks m of weight(m) times their count."""
        products = F.zip_with(F.col(column), masks, lambda n, m: n * weight(m))
        return F.aggregate(products, F.lit(0).cast("long"), lambda a, x: a + x)

    has = lambda m: m.bitwiseAND(bit) != 0
    clear = lambda m, of: m.bitwiseAND(of) == 0
    flag = lambda c: c.cast("long")
    here = lambda m: flag(has(m) & clear(m, first))
    # of the filters that a document fails, each comes first in an equal share of the orders
    n_orders = F.lit(len(steps) // len(FILTERS))
    share = lambda m: F.when(has(m), F.floor(n_orders / F.greatest(F.bit_count(m), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "part", "filter_order", "step", total("all", lambda m: flag(clear(m, through))).alias("kept"), total("all", here).alias("removed"),
        total("all", lambda m: flag(has(m) & ~clear(m, first))).alias("redundant"), total("all", lambda m: flag(m == bit)).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("all", share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    For docs as failure_masks() takes them and labels (doc_id, quality, toxic): every part, order and step has its row, with
    zeros where nothing happens. A document is good or toxic if any row of labels says so (quality = 1, toxic = 1); a null
    doc_id has no labels. An empty table of documents gives no row, empty labels no loss.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    return interactions(_counted(failure_masks(docs).join(known, "doc_id", "left")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(least < doc_id, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o AS (SELECT '' AS o, 0 AS k UNION ALL SELECT o || f, k + 1 FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE k < 5 AND NOT contains(o, f)),
s AS (SELECT o AS filter_order, step, 1 << (ascii(substring(o, step, 1)) - 65) AS bit,
    CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substring(o, CAST(i AS INT), 1)) - 65))), 0) AS INT) AS before
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step) WHERE k = 5),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN x ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
