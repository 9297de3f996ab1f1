"""Composites, terrain, resampling and time series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.neighborhood import box_stats, shifted


def reduce_collection(df: DataFrame, key: list[str], v: str = "v") -> DataFrame:
    return df.groupBy(*key).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def percentile_composite(df: DataFrame, key: list[str], percents: list[float], v: str = "v") -> DataFrame:
    return df.groupBy(*key).agg(*[F.percentile(v, p / 100).alias(f"p{p:g}") for p in percents])


def quality_mosaic(df: DataFrame, key: list[str], quality: list[str], bands: list[str]) -> DataFrame:
    """All bands from the row that maximises the quality; rows of NULL quality are never chosen."""
    best = F.max_by(F.struct(*bands), F.struct(*quality))
    return df.where(F.col(quality[0]).isNotNull()).groupBy(*key).agg(best.alias("best")).select(*key, "best.*")


def least_cloudy_composite(df: DataFrame, key: list[str], cloud: str, reach: float, percents: list[float], v: str = "v") -> DataFrame:
    """Percentiles of each pixel's values whose cloud score is within ``reach`` of its least one; rows without a value or a
    score count nowhere."""
    seen = df.where(F.col(v).isNotNull() & F.col(cloud).isNotNull())
    clear = seen.withColumn("_least", F.min(cloud).over(Window.partitionBy(*key))).where(F.col(cloud) <= F.col("_least") + reach)
    return percentile_composite(clear, key, percents, v)


def latest_mosaic(df: DataFrame, key: list[str], order: list[str], v: str = "v") -> DataFrame:
    return df.where(F.col(v).isNotNull()).groupBy(*key).agg(F.max_by(v, F.struct(*order)).alias(v))


def coarser(grid: DataFrame, factor: int) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / factor).alias(c)
    return grid.groupBy(cell("y"), cell("x")).agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.count("v").alias("n"))


def terrain(grid: DataFrame, cell: float = 1.0) -> DataFrame:
    """y, x, slope and aspect in radians, from Horn's weighted differences over the eight neighbours; NULL where one of
    them is masked or missing."""
    g = grid.withColumns({"_w": shifted(dx=-1), "_e": shifted(dx=1)})
    g = g.withColumns({"_d": F.col("_e") - F.col("_w"), "_s": F.col("_w") + 2 * F.col("v") + F.col("_e")})
    gx = (shifted(dy=-1, v="_d") + 2 * F.col("_d") + shifted(dy=1, v="_d")) / (8 * cell)
    gy = (shifted(dy=1, v="_s") - shifted(dy=-1, v="_s")) / (8 * cell)
    g = g.withColumns({"gx": gx, "gy": gy})
    return g.select("y", "x", F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("slope"), F.atan2("gy", "gx").alias("aspect"))


def hillshade(grid: DataFrame, azimuth: float, zenith: float) -> DataFrame:
    az, ze = F.radians(F.lit(azimuth)), F.radians(F.lit(zenith))
    light = F.cos(az - F.col("aspect")) * F.sin("slope") * F.sin(ze) + F.cos(ze) * F.cos("slope")
    return terrain(grid).where(F.col("slope").isNotNull()).select("y", "x", light.alias("shade"))


def shift_difference(grid: DataFrame) -> DataFrame:
    """The mean of (left - v) and (up - v); NULL where either neighbour is masked or missing."""
    left, up = shifted(dx=-1), shifted(dy=-1)
    return grid.select("y", "x", ((left - F.col("v") + up - F.col("v")) / 2).alias("noise"))


def doy_series(df: DataFrame, region: Column) -> DataFrame:
    """Mean over a region's pixels of each pixel's mean of a day of the year."""
    pixels = df.groupBy(F.dayofyear("ts").cast("long").alias("doy"), region.alias("region"), "user_id").agg(F.avg("v").alias("v"))
    return pixels.groupBy("doy", "region").agg(F.avg("v").alias("mean"), F.count("*").alias("pixels"))


def multitemporal_ratio(df: DataFrame, radius: int, before_days: int, after_days: int, orbit: str = "orbit", time: str = "day") -> DataFrame:
    """Images (orbit, time, y, x, v) without speckle: m times the average of v / m over images of the same orbit in
    [t - before, t + after), where m is the mean of the cell's square neighbourhood in each image."""
    local = box_stats(df, radius, by=(orbit, time)).withColumnRenamed("mean", "m")
    r = local.withColumn("ratio", F.try_divide("v", "m")).withColumn("t", F.datediff(time, F.lit("1970-01-01")).cast("long"))
    window = Window.partitionBy(orbit, "y", "x").orderBy("t").rangeBetween(-before_days, after_days - 1)
    return r.select(orbit, time, "y", "x", (F.col("m") * F.avg("ratio").over(window)).alias("v"))


#: Weights of a quadratic fit over 11 points, times 429.
SMOOTH = [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]


def fit_weights(window: int, order: int, derivative: int = 0) -> list[float]:
    """What each of ``window`` points (odd) adds to the derivative, at the middle one, of a polynomial fit to them."""
    if window % 2 == 0 or order >= window or derivative > order:
        raise ValueError("an odd window, longer than the order, and a derivative within the order are needed")
    places = np.arange(window) - window // 2
    rows = np.linalg.pinv(np.vander(places, order + 1, increasing=True).astype(float))
    return [float(w) * math.factorial(derivative) for w in rows[derivative]]


def savitzky_golay(series: DataFrame, window: int = 11, order: int = 2, derivative: int = 0) -> DataFrame:
    """series (series, t, v) in order of t: series, t, smooth.  The ends are mirrored about the first and the last value; a
    series is one group, ordered by its row number.  Series shorter than the window give NULL where it does not fit."""
    weights = fit_weights(window, order, derivative)
    half = window // 2
    numbered = series.select("series", "t", "v", F.row_number().over(Window.partitionBy("series").orderBy("t")).alias("i"))
    ends = numbered.groupBy("series").agg(F.max("i").alias("n"), F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"))
    j = numbered.join(ends, "series")
    head = j.where(F.col("i").between(2, half + 1)).select("series", (2 - F.col("i")).alias("i"), (F.col("first") - F.abs(F.col("v") - F.col("first"))).alias("v"))
    tail = j.where(F.col("i").between(F.col("n") - half, F.col("n") - 1)).select("series", (2 * F.col("n") - F.col("i")).alias("i"), (F.col("last") + F.abs(F.col("v") - F.col("last"))).alias("v"))
    body = j.select("series", "i", "v", "t").unionByName(head.withColumn("t", F.lit(None).cast("string"))).unionByName(tail.withColumn("t", F.lit(None).cast("string")))
    w = Window.partitionBy("series").orderBy("i")
    at = lambda k: F.max("v").over(w.rangeBetween(k, k))
    total = sum((at(k - half) * c for k, c in enumerate(weights) if k != half), F.col("v") * weights[half])
    return body.withColumn("smooth", total).where(F.col("t").isNotNull()).select("series", "t", "smooth")


def cubic_weights(factor: int) -> list[tuple[int, float, bool]]:
    """(t, weight, own): what a cell gives to target ``factor * cell + t``; own targets lie within the cell."""
    out = []
    for t in range(-2 * factor, 3 * factor):
        a = abs((t + 0.5) / factor - 0.5)
        w = 1.5 * a**3 - 2.5 * a**2 + 1 if a < 1 else -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2
        if a < 2:
            out.append((t, w, 0 <= t < factor))
    return out


def bicubic(grid: DataFrame, factor: int) -> DataFrame:
    """The grid at ``factor`` times its resolution, by cubic convolution along x, then y; weights of missing and masked
    cells are shared among the others."""
    offsets = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(own).alias("own")) for t, w, own in cubic_weights(factor)])
    for axis, other in (("x", "y"), ("y", "x")):
        dealt = grid.select(other, axis, "v", F.explode(offsets).alias("k")).select(other, (F.col(axis) * factor + F.col("k.t")).alias(axis), "v", "k.w", "k.own")
        v = F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))))
        grid = dealt.groupBy(other, axis).agg(v.alias("v"), F.max("own").alias("own")).where("own").drop("own")
    return grid.select("y", "x", "v")
