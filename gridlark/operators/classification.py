"""Classified maps: training on sampled points, votes of several models, masks, and correction over years.

An image is a table of pixels with key columns and bands; training points are rows of the same bands with a class.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.kernels import Kernel
from gridlark.operators.evaluation import uniform
from gridlark.operators.learning import make_classifier
from gridlark.operators.neighborhood import closing, morph_adjust


def sample_training(image: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """A seeded ``share`` of the pixels that have a class."""
    return image.where(F.col(label).isNotNull() & (uniform(F.col(key), seed) < share))


def classify(image: DataFrame, training: DataFrame, bands: list[str], label: str, name: str = "cart", out: str = "class", **options) -> DataFrame:
    """The image with the class that a model of the training rows gives every pixel; pixels with a masked band are NULL.

    Training rows with a masked band are left out; the model is fitted on executors and applied within the scan."""
    whole = reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in bands])
    make = VectorAssembler(inputCols=bands, outputCol="features", handleInvalid="keep")
    rows = make.transform(training.where(whole)).select("features", F.col(label).cast("double").alias("label"))
    model = make_classifier(name, **options).fit(rows)
    filled = image.select("*", *[F.coalesce(b, F.lit(0.0)).cast("double").alias(f"_{b}") for b in bands])
    vector = VectorAssembler(inputCols=[f"_{b}" for b in bands], outputCol="features")
    got = model.transform(vector.transform(filled))
    return got.select(*image.columns, F.when(whole, F.col("prediction").cast("int")).alias(out))


def vote(columns: Sequence[str]) -> Column:
    """The median of the classes that are not masked."""
    a = F.array_sort(F.array_compact(F.array(*[F.col(c).cast("double") for c in columns])))
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def multi_classify(image: DataFrame, trainings: list[DataFrame], bands: list[str], label: str, names: Sequence[str] = ("cart",), out: str = "class", water: Column | None = None) -> DataFrame:
    """The median of the maps of all training samples and classifiers, 0 where ``water`` holds."""
    models = [(t, n) for n in names for t in trainings]
    for i, (t, n) in enumerate(models):
        image = classify(image, t, bands, label, n, f"_c{i}")
    cols = [f"_c{i}" for i in range(len(models))]
    got = vote(cols)
    return image.withColumn(out, got if water is None else F.when(water, F.lit(0.0)).otherwise(got)).drop(*cols)


def zero_where(c: Column, *conditions: Column) -> Column:
    """0 where any condition holds; a masked condition does not."""
    for k in conditions:
        c = F.when(k, F.lit(0.0)).otherwise(c)
    return c


def clean_map(grid: DataFrame, first: Kernel, second: Kernel) -> DataFrame:
    """A map of votes (y, x, v) as 0 and 1, a half counting as 1, after the morphological adjustment."""
    whole = F.when(F.col("v") == 0.5, F.col("v") + 0.5).otherwise(F.col("v")).cast("int")
    return morph_adjust(grid.select("y", "x", F.greatest(F.lit(0), F.least(F.lit(1), whole)).alias("v")), first, second)


def available_years(maps: DataFrame, last: int, step: int, count: int) -> list[int]:
    """The years of a series back from ``last`` in steps; where a year has no cells the next one before it stands in."""
    have = {r[0] for r in maps.select("year").distinct().collect()}  # a row a year
    out, year = [], last
    while year > last - count:
        tried = next((y for y in range(year, year - step - 1, -1) if y in have), None)
        if tried is not None:
            out.append(tried)
        year = (year if tried is None else tried) - step
    return out


def correct_years(maps: DataFrame, years: list[int], kernel: Kernel) -> DataFrame:
    """year, y, x, v: each year's map where any year has a cell set and the closed map of the first (newest) year has too."""
    newest = maps.where(F.col("year") == years[0]).select("y", "x", "v")
    closed = closing(newest, kernel).select("y", "x", (F.col("v") != 0).alias("closed"))
    used = maps.where(F.col("year").isin(years))
    ever = used.groupBy("y", "x").agg(F.max((F.col("v") != 0)).alias("ever")).join(closed, ["y", "x"]).select("y", "x", (F.col("ever") & F.col("closed")).alias("mask"))
    return used.join(ever, ["y", "x"]).select("year", "y", "x", ((F.col("v") != 0) & F.col("mask")).cast("int").alias("v"))


def running_and(maps: DataFrame, years: list[int]) -> DataFrame:
    """year, y, x, v: set where this and all newer years of the list are."""
    newer = Window.partitionBy("y", "x").orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, 0)
    used = maps.where(F.col("year").isin(years))
    return used.select("year", "y", "x", F.min((F.col("v") != 0).cast("int")).over(newer).alias("v"))
