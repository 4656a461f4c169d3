"""Fill-in-the-middle transformation by escaped marker injection, in DataFrame functions.

A text's delimiter characters are escaped; regexp_replace appends a delimiter to each unit; the delimiters are counted,
and substring_index extracts the units up to, between and after two ranks. What it extracts loses its delimiters, is
unescaped and put together anew around sentinels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import fresh

DELIMITER, ESCAPE = "\x01", "\x02"
#: Units as patterns over escaped text, where a delimiter is written as the escape and b, the escape as itself and a. A
#: unit must not end within such a pair, and units must cover the text.
CODE_POINT = "(?s:\x02[ab]|.)"
LINE = "[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Marks:
    """The sentinels before a prefix, a suffix and a middle: none may be part of another, or begin as another ends."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __iter__(self):
        return iter((self.prefix, self.suffix, self.middle))


def escaped(text: Column) -> Column:
    """text without delimiters; unescaped() is its inverse."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "a"))
    return F.replace(out, F.lit(DELIMITER), F.lit(ESCAPE + "b"))


def unescaped(text: Column) -> Column:
    """An extracted piece as it was: its delimiters go, then pairs become what they stand for."""
    out = F.replace(text, F.lit(DELIMITER), F.lit(""))
    out = F.replace(out, F.lit(ESCAPE + "b"), F.lit(DELIMITER))
    return F.replace(out, F.lit(ESCAPE + "a"), F.lit(ESCAPE))


def marked(text: Column, unit: str = CODE_POINT) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), F.lit(f"({unit})"), F.lit("$1" + DELIMITER))


def ranked(text: Column, n: Column, low: Column, high: Column) -> Column:
    """Of a marked text of n units, the units of ranks low to high - 1, from 0, as they were."""
    upto = F.call_function("substring_index", text, F.lit(DELIMITER), high.cast("int"))
    # after the last unit stands a delimiter too, so the rest of the whole text is one rank further from its end
    back = F.when(high == n, low - n - 1).otherwise(low - high)
    piece = F.call_function("substring_index", F.when(high == n, text).otherwise(upto), F.lit(DELIMITER), back.cast("int"))
    return unescaped(F.when(low >= high, F.lit("")).otherwise(piece))


def part(hex_digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, from 1, as a number."""
    return F.conv(F.substring(hex_digest, 8 * k - 7, 8), 16, 10).cast("long")


def drawn(doc_id: Column, seed: str = "1") -> Column:
    """The four numbers that decide of a document: the same in each run, and of a null id those of an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.struct(*(part(digest, k).alias(f"h{k}") for k in range(1, 5)))


def transformed(docs: DataFrame, marks: Marks = Marks(), unit: str = CODE_POINT, plain_from: int = 90, suffix_first: int = 20, seed: str = "1") -> DataFrame:
    """docs with n, form, prefix_units, middle_units and output: what a text becomes.

    Two cuts are drawn for each document from its doc_id. A text is plain, and its own output, if it is empty or holds a
    sentinel, or for 100 - plain_from documents in a hundred; of the others, suffix_first in a hundred have the form spm
    (suffix, prefix, middle), the rest psm (prefix, suffix, middle). restored() is the inverse. A null text counts as
    empty and a null doc_id as the empty text; repeated rows come back repeated, each as the same; an empty table gives
    none. Texts of any length are cut whole, within one row, while Spark can hold one at about twice its length; no
    row meets another. Columns of docs other than doc_id and text stay; one that is called like a new one is replaced.
    """
    names = ["text", "n", "form", "prefix_units", "middle_units", "output"]
    kept = [c for c in docs.columns if c not in names]
    h, m, low, high = (fresh(docs, f"_{c}") for c in ("h", "marked", "low", "high"))
    # each step is a projection of its own: what is used several times is computed once
    out = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumns({h: drawn(F.col("doc_id"), seed), m: marked(F.col("text"), unit)})
    out = out.withColumn("n", (F.octet_length(m) - F.octet_length(F.replace(F.col(m), F.lit(DELIMITER), F.lit("")))).cast("long"))
    one, two = (F.col(h)[f"h{k}"] % (F.col("n") + 1) for k in (1, 2))
    held = [F.contains("text", F.lit(x)) for x in marks]
    plain = (F.col("n") == 0) | held[0] | held[1] | held[2] | (F.col(h)["h3"] % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col(h)["h4"] % 100 < suffix_first, "spm").otherwise("psm")
    out = out.withColumns({low: F.least(one, two), high: F.greatest(one, two), "form": form})
    n, a, b = F.col("n"), F.col(low), F.col(high)
    pieces = F.struct(*(ranked(F.col(m), n, x, y).alias(c) for c, x, y in (("p", F.lit(0), a), ("m", a, b), ("s", b, n))))
    p = fresh(docs, "_pieces")
    cut = F.col("form") != "plain"
    out = out.withColumn(p, F.when(cut, pieces))
    prefix, middle, suffix = (F.col(p)[c] for c in "pms")
    psm = F.concat(F.lit(marks.prefix), prefix, F.lit(marks.suffix), suffix, F.lit(marks.middle), middle)
    spm = F.concat(F.lit(marks.suffix), suffix, F.lit(marks.prefix), prefix, F.lit(marks.middle), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return out.withColumns({"prefix_units": F.when(cut, a), "middle_units": F.when(cut, b - a), "output": output}).select(*(F.col(f"`{c}`") for c in kept), *names)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text from what it became: the sentinels occur once each, so each piece ends where the next one begins."""
    ends = lambda text, mark: (F.substring_index(text, mark, 1), F.substring_index(text, mark, -1))
    front, middle = ends(output, marks.middle)
    psm_prefix, psm_suffix = ends(F.substring_index(front, marks.prefix, -1), marks.suffix)
    spm_suffix, spm_prefix = ends(F.substring_index(front, marks.suffix, -1), marks.prefix)
    return F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _sql_part(k: int) -> str:
    return f"CAST('0x' || substring(d, {8 * k - 7}, 8) AS BIGINT) AS h{k}"


ORACLE_SQL = f"""
WITH h AS (SELECT doc_id, t, length(t) AS n, {', '.join(_sql_part(k) for k in range(1, 5))}
  FROM (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents)),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
