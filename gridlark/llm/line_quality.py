"""Quality rules with cross-document line frequency.

Lines are normalised (ASCII lower case, digits as 0, white space runs as one space) and hashed.  For each host the
number of distinct documents that hold a line is counted, where documents of equal text are one document.  A line that
more than ``max_docs`` documents of its host hold is removed, whatever the size of the host; a document that keeps less than
``min_left`` of its words is rejected.

Null texts have no words and fail the base rules; a null host is a host of its own.  Repeated rows are one document to
the line counts and each get a row of the result.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, cut, lower_ascii, words

SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column, window: int = 5) -> Column:
    """The number of words of array ``w`` that lie in a window of so many words that ``w`` has twice or more.

    Windows are told apart by 64-bit hashes.  Most texts repeat none, which one distinct() shows; else windows are
    sorted with their places, those equal to a neighbour are kept, and the union of the places they cover is measured.
    """

    def windows(codes: Column) -> Column:
        # Each word is hashed once; a window is hashed from the hashes of its words.
        of = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))
        return let(F.transform(codes, lambda x: F.xxhash64(x)), of)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        hash_at = lambda p, i: F.get(p, i)["h"]
        twins = let(pairs, lambda p: F.filter(F.transform(p, lambda x, i: F.when((x["h"] == hash_at(p, i - 1)) | (x["h"] == hash_at(p, i + 1)), x["i"])), lambda x: x.isNotNull()))
        return let(F.sort_array(twins), lambda q: F.aggregate(F.transform(q, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(q, i + 1) - x, F.lit(window)))), F.lit(0), lambda s, x: s + x))

    counted = let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) > window, counted).otherwise(0)


def line_key(line: Column) -> Column:
    x = F.translate(lower_ascii(line), "123456789", "000000000")
    return F.trim(F.regexp_replace(x, f"[{SPACE}]+", " "))


def score_lines(docs: DataFrame, max_docs: int = 20, min_left: float = 0.3, min_words: int = 10, repeat_percent: int = 20, host: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, host) to doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines, n_lines_removed, n_words_left and ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", *keep, F.col(host).alias("host"), text.alias("text"), words(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"))
    base = base.select(
        "doc_id", *keep, "host", F.md5(F.col("text").cast("binary")).alias("same"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(line_key(x)).alias("h"), F.size(words(x)).alias("n"))).alias("lines"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    base = base.withColumn("base_failed", failed).withColumn("uid", F.md5(F.concat_ws("|", "same", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("h"), "host"), F.lit("-"))).cast("binary")))
    base = cut(base)
    once = base.groupBy("uid").agg(F.first("host").alias("host"), F.first("same").alias("same"), F.first("lines").alias("lines"))
    held = once.select("uid", "host", "same", F.explode("lines").alias("line")).select("uid", "host", "same", "line.h", "line.n")
    over = held.select("host", "h", "same").distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "h")
    lost = held.alias("l").join(over.alias("v"), F.expr("l.host <=> v.host AND l.h = v.h"), "left_semi")
    lost = lost.groupBy("uid").agg(F.sum("n").alias("n_lost"), F.count("*").alias("n_lines_removed"))
    out = base.join(lost, "uid", "left").withColumns({"n_lost": F.coalesce("n_lost", F.lit(0)), "n_lines_removed": F.coalesce("n_lines_removed", F.lit(0))})
    left = F.col("n_words") - F.col("n_lost")
    fine = ~F.col("base_failed") & (left >= min_left * F.col("n_words"))
    return out.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", fine.alias("kept"), F.size("lines").cast("long").alias("n_lines"), "n_lines_removed", left.alias("n_words_left"))


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT DISTINCT doc_id, w FROM b),
g AS (SELECT doc_id, unnest(generate_series(1, greatest(len(w) - 4, 0))) AS i, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM u),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, (VALUES (0), (1), (2), (3), (4)) o(j) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT b.*, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM b LEFT JOIN r ON b.doc_id IS NOT DISTINCT FROM r.doc_id),
l AS (SELECT DISTINCT doc_id, host, t, unnest(generate_series(1, len(lines))) AS i, lines FROM s),
m AS (SELECT doc_id, host, t, trim(regexp_replace(translate(lower(lines[i]), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS h, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS n FROM l),
f AS (SELECT host, h, count(DISTINCT t) AS docs FROM m GROUP BY ALL),
v AS (SELECT host, h FROM f WHERE docs > 20),
x AS (SELECT doc_id, sum(n) AS n_lost, count(*) AS removed FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host AND m.h = v.h GROUP BY doc_id),
y AS (SELECT s.*, coalesce(n_lost, 0) AS n_lost, coalesce(removed, 0) AS removed, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
    FROM s LEFT JOIN x ON s.doc_id IS NOT DISTINCT FROM x.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_lost >= 0.3 * n_words AS kept,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(removed AS BIGINT) AS n_lines_removed, CAST(n_words - n_lost AS BIGINT) AS n_words_left FROM y
"""
