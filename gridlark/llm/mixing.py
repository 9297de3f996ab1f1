"""Mixing sources to target weights by capped water-filling.

Every source is to have a share of the mix in proportion to its weight, but none may be repeated more than
``max_epochs`` times: sources that would be are clamped there and what they leave is shared again among the others by
weight, until no source is above its cap.  A source's target is then met by seeded repetitions: every document is taken
``floor(target / size)`` times, and the fraction that is left goes to documents in a seeded order, the last of them in
part.

Null texts and blank texts have size 0 and are never taken; a null source is a source of its own, last in order.
Repeated rows are documents like any other.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fixed_order_bound, free_name, words

#: Hex digits of the seeded key that part a source into buckets; only one bucket of each source is cut by its target.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """``sizes`` (skey, source_size), one row a source; skey sorts the sources.  Weights are dealt in that order and
    repeat.  Adds target, whole (repetitions of each document) and part (words that fractional repetitions give).

    The common level is the largest of the levels that follow from clamping the 0, 1, 2, ... sources that fill first:
    that is where repeated clamping and sharing ends.
    """
    everything = Window.partitionBy(F.lit(1))
    fills = everything.orderBy("ratio", "skey")
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy("skey")) - 1)
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = ranked.withColumn("weight", choose).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = level.withColumn("before", F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    level = level.withColumn("left", F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)))
    level = level.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = level.withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("left")).over(everything))
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    out = level.withColumn("target", target).withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    part = F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    return out.withColumn("part", part).select("skey", "source_size", "target", "whole", "part")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2, seed: int = 0, size: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, source) to doc_id, size, source_size, target, taken and the columns in ``keep``.

    ``size`` is the size of a document (words by default).  Sources can be of any size and number: a source's rows are
    ordered in buckets of its seeded key, whose sums say which bucket its target cuts.
    """
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    size = F.size(words(F.col("text"))) if size is None else size
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    d = cut(docs.select("doc_id", *keep, skey.alias("skey"), size.cast("long").alias("size"), key.alias("key")))
    d = d.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = d.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = targets(sums.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    ahead = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("run", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    d = d.join(sums.join(plan, "skey"), ["skey", "bucket"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("offset") - F.col("run")))
    return d.select("doc_id", *keep, "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))


def repeat(docs: DataFrame, max_broadcast: int = 500_000, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes its document, the last of a source rounded to a whole one.  Rows that
    share an id (null ones too) are taken as often as the one taken most."""
    i, n, again = (free_name(docs, x) for x in ("taken_id", "times", "again"))
    taken = mix(docs.select("doc_id", "text", "source"), **options).where("taken > 0").groupBy("doc_id").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias(n))
    taken = cut(taken.where(F.col(n) > 0).withColumnRenamed("doc_id", i))
    chosen = docs.join(fixed_order_bound(taken, taken.count(), max_broadcast), F.col("doc_id").eqNullSafe(F.col(i)))
    return chosen.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
r AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
    sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM r),
t AS (SELECT skey, source_size, least(cap, weight * max((total - before) / rest) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
q AS (SELECT d.*, source_size, target, whole, greatest(0, CAST(round(target) AS BIGINT) - whole * source_size) AS part,
    coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
    FROM d JOIN p ON d.skey = p.skey)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - run)) AS BIGINT) AS taken FROM q
"""
