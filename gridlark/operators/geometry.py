"""Polygons and what lies in them.

A ring is an array of structs (x, y) whose last point joins the first.  Rings meet a pixel table by listing the cells of
their bounds whose centre they hold, so that the join is on cells and no ring meets every pixel.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.evaluation import uniform


def ring(points: Iterable[tuple]) -> Column:
    """A ring of numbers or columns."""
    lit = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in points])


def rectangle(west, south, east, north) -> Column:
    return ring([(west, south), (east, south), (east, north), (west, north)])


def _edges(r: Column, make) -> Column:
    """``make(p, q)`` of each edge."""
    return F.transform(r, lambda p, i: make(p, F.get(r, F.pmod(i + 1, F.size(r)))))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def signed_area(r: Column) -> Column:
    return _total(_edges(r, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def area(r: Column) -> Column:
    return F.abs(signed_area(r))


def perimeter(r: Column) -> Column:
    return _total(_edges(r, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))))


def centroid(r: Column) -> Column:
    """The centre of gravity; null where the ring has no area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    at = lambda c: F.try_divide(_total(_edges(r, lambda p, q: (p[c] + q[c]) * cross(p, q))), signed_area(r) * 6)
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def bounds(r: Column) -> Column:
    of = lambda c: F.transform(r, lambda p: p[c])
    return F.struct(F.array_min(of("x")).alias("west"), F.array_min(of("y")).alias("south"), F.array_max(of("x")).alias("east"), F.array_max(of("y")).alias("north"))


def buffered(b: Column, distance: float) -> Column:
    """Bounds grown by ``distance``, shrunk where it is negative; null where nothing is left."""
    grown = F.struct((b["west"] - distance).alias("west"), (b["south"] - distance).alias("south"), (b["east"] + distance).alias("east"), (b["north"] + distance).alias("north"))
    return F.when((b["east"] - b["west"] >= -2 * distance) & (b["north"] - b["south"] >= -2 * distance), grown)


def intersects(a: Column, b: Column) -> Column:
    """Whether two bounds share a point."""
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def contains(r: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring: its ray to the east crosses an odd number of edges."""
    crosses = _edges(r, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & F.coalesce(x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"], F.lit(False)))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def pixel_area(latitude: Column, dx: float, dy: float, degree: float = 111_320.0) -> Column:
    """Square metres of a cell of dx by dy degrees."""
    return F.cos(F.radians(latitude)) * (dx * dy * degree * degree)


def cells_in(features: DataFrame, r: str = "ring") -> DataFrame:
    """The features' other columns and y, x of every unit cell whose centre a feature holds."""
    b = features.withColumn("_b", bounds(F.col(r)))
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"_b.{lo}")), F.floor(F.col(f"_b.{hi}")))
    rows = b.where(F.col("_b").isNotNull() & F.col("_b.west").isNotNull()).withColumn("y", F.explode(span("south", "north"))).withColumn("x", F.explode(span("west", "east")))
    return rows.where(contains(F.col(r), F.col("x") + 0.5, F.col("y") + 0.5)).drop(r, "_b")


def rasterize(features: DataFrame, r: str = "ring", value: str | None = None) -> DataFrame:
    """y, x, n (features over the cell) and, for ``value``, the sum of that property."""
    more = [F.sum(value).alias("v")] if value else []
    return cells_in(features, r).groupBy("y", "x").agg(F.count("*").alias("n"), *more)


def paint(grid: DataFrame, features: DataFrame, value: str, r: str = "ring") -> DataFrame:
    """The grid with the largest ``value`` of the features over a cell in place of its own."""
    over = cells_in(features, r).groupBy("y", "x").agg(F.max(value).alias("_p"))
    return grid.join(over, ["y", "x"], "left").withColumn("v", F.coalesce("_p", "v")).drop("_p")


def clip(grid: DataFrame, r: Column) -> DataFrame:
    """Cells outside the ring are masked."""
    return grid.withColumn("v", F.when(contains(r, F.col("x") + 0.5, F.col("y") + 0.5), F.col("v")))


def sample_regions(grid: DataFrame, features: DataFrame, properties: list[str], r: str = "ring") -> DataFrame:
    """One row for each unmasked cell in each feature, with the feature's properties."""
    return grid.where(F.col("v").isNotNull()).join(cells_in(features.select(*properties, r), r), ["y", "x"])


def reduce_regions(grid: DataFrame, features: DataFrame, key: str, aggregates: dict[str, Column], r: str = "ring") -> DataFrame:
    """key and the aggregates over the unmasked cells of each feature; features without any stay, with nulls."""
    got = sample_regions(grid, features, [key], r).groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])
    return features.select(key).join(got, key, "left")


def within(points: DataFrame, features: DataFrame, x: str, y: str, r: str = "ring") -> DataFrame:
    """The points that lie in any of the features: points and the cells of the rings' bounds meet in an equi-join, and the
    ring decides."""
    b = features.select(F.col(r).alias("_r"), bounds(F.col(r)).alias("_b"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"_b.{lo}")), F.floor(F.col(f"_b.{hi}")))
    cells = b.where(F.col("_b.west").isNotNull()).withColumn("_y", F.explode(span("south", "north"))).withColumn("_x", F.explode(span("west", "east")))
    met = (F.floor(y) == F.col("_y")) & (F.floor(x) == F.col("_x")) & contains(F.col("_r"), F.col(x), F.col(y))
    return points.join(cells.select("_r", "_y", "_x"), met, "left_semi")


def sample_pixels(grid: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` unmasked cells by a uniform of the cell's place; the same cells on every run."""
    u = uniform(F.concat_ws(":", "y", "x"), seed)
    return grid.where(F.col("v").isNotNull()).withColumn("random", u).orderBy("random", "y", "x").limit(n)


def random_points(spark, n: int, west: float, south: float, east: float, north: float, seed: int = 0) -> DataFrame:
    """id, x, y: seeded uniform points of a rectangle."""
    u = lambda s, lo, hi: uniform(F.col("id"), 2 * seed + s) * (hi - lo) + lo
    return spark.range(n).select("id", u(1, west, east).alias("x"), u(2, south, north).alias("y"))


def vectorize(labelled: DataFrame, label: str) -> DataFrame:
    """label, n, bounds and mean place of the cells of each label."""
    x, y = F.col("x"), F.col("y")
    box = F.struct(F.min(x).alias("west"), F.min(y).alias("south"), (F.max(x) + 1).alias("east"), (F.max(y) + 1).alias("north"))
    return labelled.groupBy(label).agg(F.count("*").alias("n"), box.alias("bounds"), (F.avg(x) + 0.5).alias("cx"), (F.avg(y) + 0.5).alias("cy"))


def _hull(p: pd.DataFrame) -> list[dict]:
    points = sorted({(float(x), float(y)) for x, lo, hi in zip(p["x"], p["lo"], p["hi"], strict=True) for y in (lo, hi)})
    if len(points) < 3:
        return [{"x": x, "y": y} for x, y in points]

    def side(ordered):
        out: list[tuple[float, float]] = []
        for q in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return [{"x": x, "y": y} for x, y in side(points) + side(points[::-1])]


def convex_hull(points: DataFrame, key: str, strips: int = 4096) -> DataFrame:
    """key (whole numbers) and the ring around its points (x, y).

    Only the lowest and highest point of an x can be on a hull, so points are first reduced to those; then each of
    ``strips`` hash parts of a key gives its own hull, and the hull of these is the key's.
    """
    ends = points.groupBy(key, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    of = lambda p: pd.DataFrame({key: [p[key].iloc[0]], "ring": [_hull(p)]})
    schema = f"{key} bigint, ring array<struct<x:double,y:double>>"
    part = F.pmod(F.xxhash64("x"), F.lit(strips)).alias("part")
    few = ends.select(F.col(key).cast("long").alias(key), "x", "lo", "hi", part).groupBy(key, "part").applyInPandas(of, schema)
    corners = few.select(key, F.inline("ring")).select(key, "x", F.col("y").alias("lo"), F.col("y").alias("hi"))
    return corners.groupBy(key).applyInPandas(of, schema)
