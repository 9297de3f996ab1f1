"""Sharding by sampled splitters.

Records are ordered by a hash of their text, then by a hash of their id, so that equal texts stand side by side.  Key
samples drawn with chances in proportion to size give the quantile boundaries of fine ranges; records are partitioned
into those ranges, and a range that is still too large is subdivided by further splitters from its own records.  A shard
is a run of whole ranges: a range goes to the shard in whose equal part of all bytes its middle lies.  Sizes are near
equal: a shard departs from its part by half a range at either end.  Only a range over ``whole_group`` of a shard is
divided between shards, by the places of its records; records of equal text share a shard unless they weigh more than
that themselves, and then they are split by id.

Null texts have no bytes and form one group; null ids sort first.  Repeated rows are records like any other.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RECORD = 8


def _searcher(keys: np.ndarray, seconds: np.ndarray):
    """A pandas UDF: the number of splitters (key, second) at or below each row's."""

    @F.pandas_udf("long")
    def place(k: pd.Series, d: pd.Series) -> pd.Series:
        k, d = k.to_numpy(np.int64), d.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        tied = high > low
        for x in np.unique(k[tied]):
            rows = k == x
            a, b = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
            low[rows] = a + np.searchsorted(seconds[a:b], d[rows], "right")
        return pd.Series(low)

    return place


def splitters(sample: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``n`` - 1 boundaries at the quantiles of ``sample``.  A key that is a boundary once takes all its rows with
    it; one that is a boundary more often is a hot group and is divided by the second hash."""
    s = sorted(sample)
    picked = sorted({s[i * len(s) // n] for i in range(1, n)}) if s else []
    keys = np.array([k for k, _ in picked], dtype=np.int64)
    seconds = np.array([d for _, d in picked], dtype=np.int64)
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    seconds[first[count == 1]] = np.iinfo(np.int64).min
    return keys, seconds


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 0, ranges_per_shard: int = 128, draws_per_range: int = 16, rows_per_range: int = 1_000_000, whole_group: float = 0.02, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, size, text_crc32, law, shard, slot, grown_shard, range_id and ``keep``.

    Size is UTF-8 bytes plus 8; slot numbers a shard's records from 0.  The samples gathered on the driver number about
    ``draws_per_range`` a range, and there are ``ranges_per_shard`` ranges a shard or one for ``rows_per_range`` records,
    whichever is more.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + RECORD
    rows = docs.select(
        "doc_id", *keep, size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(-1)).otherwise(F.xxhash64(F.lit(seed), text)).alias("k"), F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1))).alias("d"),
    )
    rows = cut(rows)
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        total = 1
    n = max(n_shards * ranges_per_shard, count // rows_per_range)

    def draw(of: DataFrame, wanted: int, weight: int) -> list[tuple[int, int]]:
        u = (F.pmod(F.xxhash64(F.lit(seed + 1), "k", "d"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        return [(r[0], r[1]) for r in of.where(u * float(weight) < F.col("size") * float(wanted)).select("k", "d").collect()]

    keys, seconds = splitters(draw(rows, n * draws_per_range, total), n)
    placed = rows.withColumn("range_id", _searcher(keys, seconds)("k", "d"))
    placed = cut(placed)
    sums = placed.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # A range that came out several times too large is divided again by draws from its own records.
    large = [r[0] for r in sums.where((F.col("bytes") > 4 * total / n) & (F.col("n") > 64)).select("range_id").collect()]
    if large:
        more = draw(placed.where(F.col("range_id").isin(large)), n * draws_per_range * 4, total)
        again = sorted({(int(k), int(d)) for k, d in zip(keys, seconds, strict=True)} | set(sorted(more)[:: draws_per_range]))
        keys, seconds = np.array([k for k, _ in again], dtype=np.int64), np.array([d for _, d in again], dtype=np.int64)
        placed = rows.withColumn("range_id", _searcher(keys, seconds)("k", "d"))
        sums = placed.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range_id", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_offset"))
    inside = Window.partitionBy("range_id").orderBy("k", "d", "doc_id", "size")
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = Window.partitionBy("range_id", "k")
    located = placed.withColumns({"run": ahead, "rank": F.row_number().over(inside) - 1})
    located = located.withColumns({"group_run": F.min("run").over(group), "group_bytes": F.sum("size").over(group)})
    located = located.join(offsets, "range_id")
    together = F.col("group_bytes") <= whole_group * total / n_shards
    whole = F.col("bytes") <= whole_group * total / n_shards
    middle = F.col("byte_offset") + F.when(whole, F.col("bytes") / 2).when(together, F.col("group_run") + F.col("group_bytes") / 2).otherwise(F.col("run") + F.col("size") / 2)
    numbered = located.withColumns({"shard": F.least(F.floor(middle * n_shards / total), F.lit(n_shards - 1)).cast("int"), "at": F.col("row_offset") + F.col("rank")})
    numbered = cut(numbered.select("doc_id", *keep, "size", "text_crc32", "shard", "at", "range_id"))
    first = numbered.groupBy("shard").agg(F.min("at").alias("first_at"))
    out = numbered.join(F.broadcast(first), "shard")  # one row a shard
    return out.select("doc_id", *keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "range_id")
