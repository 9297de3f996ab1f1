"""ROC, accuracy, splits, zonal statistics, grids and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roc(points: DataFrame, cutoffs: int) -> DataFrame:
    """cutoff, tpr, tnr, fpr, dist for cutoffs 0, 1/n, ..., 1.

    Points are counted by the cutoffs they lie strictly above and strictly below (a partial aggregation of the data to at
    most that many rows), and running sums over the cutoffs do the rest; points never meet cutoffs in a join."""
    n = float(cutoffs)
    # k / n < score for k below ceil(score * n); k / n > score for k above floor(score * n)
    exact = F.round(F.col("score") * n)
    on = exact / n == F.col("score")
    above = F.when(on, exact).otherwise(F.ceil(F.col("score") * n)).cast("long")
    below = F.when(on, exact).otherwise(F.floor(F.col("score") * n)).cast("long")
    spark = points.sparkSession
    ks = spark.range(0, cutoffs + 1).withColumnRenamed("id", "k")
    pos = points.where("is_target = 1").groupBy(above.alias("k")).agg(F.count("*").alias("p"))
    neg = points.where("is_target = 0").groupBy((below + 1).alias("k")).agg(F.count("*").alias("q"))
    all_rows = Window.partitionBy(F.lit(1))
    j = ks.join(pos, "k", "full").join(neg, "k", "full").select("k", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    later = all_rows.orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    upto = all_rows.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    j = j.select("k", F.try_divide(F.coalesce(F.sum("p").over(later), F.lit(0)), F.sum("p").over(all_rows)).alias("tpr"), F.try_divide(F.sum("q").over(upto), F.sum("q").over(all_rows)).alias("tnr"))
    j = j.where(F.col("k").between(0, cutoffs))
    fpr = 1 - F.col("tnr")
    return j.select((F.col("k") / n).alias("cutoff"), "tpr", "tnr", fpr.alias("fpr"), F.sqrt((1 - F.col("tpr")) ** 2 + fpr**2).alias("dist"))


def auc(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(1)).orderBy("cutoff")
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return curve.select(area.alias("a")).agg(F.abs(F.sum("a")).alias("auc"))


def best_cutoff(curve: DataFrame) -> DataFrame:
    return curve.orderBy("dist", "cutoff").limit(1).select("cutoff", "dist")


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).cast("long").alias("actual"), F.col(predicted).cast("long").alias("predicted")).agg(F.count("*").alias("n"))


def accuracies(matrix: DataFrame) -> DataFrame:
    """class, producers, users, overall."""
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    a = matrix.groupBy(F.col("actual").alias("class")).agg(F.try_divide(F.sum(right), F.sum("n")).alias("producers"))
    p = matrix.groupBy(F.col("predicted").alias("class")).agg(F.try_divide(F.sum(right), F.sum("n")).alias("users"))
    o = matrix.agg(F.try_divide(F.sum(right), F.sum("n")).alias("overall"))
    return a.join(p, "class", "full").join(F.broadcast(o))  # one row


def uniform(key: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from 52 bits of a digest of the seed and the key (of any type): the same on every run,
    and independent between seeds.  A null key has its own number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def kfold(df: DataFrame, key: str, k: int, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """Contiguous folds of floor(N / k) rows in random order, the rows left over one each to the first folds.

    Rows are ordered within buckets of their random number, which are near equal, and the buckets' counts say where each
    begins; no task orders all rows."""
    u = df.select(key, uniform(F.col(key), seed).alias("random")).withColumn("bucket", F.floor(F.col("random") * buckets))
    one = Window.partitionBy(F.lit(1))
    counts = u.groupBy("bucket").agg(F.count("*").alias("c"))
    begins = counts.select("bucket", (F.sum("c").over(one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.sum("c").over(one).alias("total"))
    r = u.join(F.broadcast(begins), "bucket")  # at most ``buckets`` rows
    r = r.withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("random", key)))
    base = F.floor(F.col("total") / k)
    fold = F.when(F.col("rn") <= k * base, F.floor((F.col("rn") - 1) / F.greatest(base, F.lit(1)))).otherwise(F.col("rn") - k * base - 1)
    return r.select(key, "random", fold.cast("long").alias("fold"))


def generate_grid(df: DataFrame, x: str, y: str, dx: float, dy: float) -> DataFrame:
    """Cells dx by dy over the bounds of the points, centred on the lattice from the lower corner."""
    b = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    n = lambda lo, hi, d: F.sequence(F.lit(0), F.floor((F.col(hi) - F.col(lo)) / d).cast("int"))
    cells = b.withColumn("i", F.explode(n("x0", "x1", dx))).withColumn("j", F.explode(n("y0", "y1", dy)))
    cx, cy = F.col("x0") + F.col("i") * dx, F.col("y0") + F.col("j") * dy
    return cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (cx - dx / 2).alias("west"), (cx + dx / 2).alias("east"), (cy - dy / 2).alias("south"), (cy + dy / 2).alias("north"))


def running_sums(places: DataFrame, bits: int = 16, width: int = 64) -> DataFrame:
    """``places`` (c, d, at), one row for each c (long), to c, d, n, after: n is the sum of d up to c, after the ``at`` of the
    next c (null for the last).

    Places are summed in blocks of 2 ** bits, and the blocks' sums likewise, so no task orders more rows than a block has."""
    block = F.shiftright("c", bits) if width > bits else F.lit(0)
    b = places.withColumn("block", block)
    w = Window.partitionBy("block").orderBy("c")
    within = b.withColumns({"n": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.lead("at").over(w)})
    if width <= bits:
        return within.select("c", "d", "n", "after")
    sums = b.groupBy(F.col("block").alias("c")).agg(F.sum("d").alias("d"), F.min("at").alias("at"))
    blocks = running_sums(sums, bits, width - bits).select(F.col("c").alias("block"), (F.col("n") - F.col("d")).alias("before"), F.col("after").alias("then"))
    return within.join(blocks, "block").select("c", "d", (F.col("n") + F.col("before")).alias("n"), F.coalesce("after", "then").alias("after"))


def overlap_count(intervals: DataFrame, start: str, end: str, step: int, bits: int = 16) -> DataFrame:
    """cell, n: how many intervals [start, end] cover each multiple of ``step``, by events and their running sums.  Cells are
    listed in blocks of 2 ** bits, so an interval of any length makes no longer array of cells."""
    first, last = F.ceil(F.col(start) / step), F.floor(F.col(end) / step)
    e = intervals.where(first <= last).select(F.explode(F.array(F.struct(first.alias("c"), F.lit(1).alias("d")), F.struct((last + 1).alias("c"), F.lit(-1).alias("d")))).alias("e"))
    e = e.groupBy(F.col("e.c").cast("long").alias("c")).agg(F.sum("e.d").alias("d")).withColumn("at", F.col("c"))
    spans = running_sums(e, bits).where("n > 0").select("c", "n", (F.col("after") - 1).alias("to"))
    parts = spans.select("c", "n", "to", F.explode(F.sequence(F.shiftright("c", bits), F.shiftright("to", bits))).alias("block"))
    low = F.shiftleft("block", bits)
    cells = F.sequence(F.greatest("c", low), F.least("to", low + ((1 << bits) - 1)))
    return parts.select(F.explode(cells).alias("c"), "n").select((F.col("c") * step).alias("cell"), "n")
