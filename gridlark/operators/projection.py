"""Where the cells of a grid lie: a coordinate system and an affine transform, and grids of other transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Projection:
    """East = a * x + c and north = e * y + f for the lower corner of a cell (x, y); rows and columns are not sheared."""

    crs: str
    a: float
    c: float
    e: float
    f: float

    @property
    def transform(self) -> tuple[float, float, float, float, float, float]:
        return (self.a, 0.0, self.c, 0.0, self.e, self.f)

    def scaled(self, ratio: float) -> Projection:
        """Cells ``ratio`` times as wide and high."""
        return Projection(self.crs, self.a * ratio, self.c, self.e * ratio, self.f)

    def nominal_scale(self) -> float:
        return abs(self.a)

    def east(self, x: Column) -> Column:
        """Of a cell's centre."""
        return (x + 0.5) * self.a + self.c

    def north(self, y: Column) -> Column:
        return (y + 0.5) * self.e + self.f

    def cell(self, east: Column, north: Column) -> tuple[Column, Column]:
        """y and x of the cell that holds a place."""
        return F.floor((north - self.f) / self.e), F.floor((east - self.c) / self.a)


def with_projection(scenes: DataFrame, p: Projection) -> DataFrame:
    """Scenes with their grid's metadata."""
    return scenes.withColumn("projection", F.struct(F.lit(p.crs).alias("crs"), F.array(*map(F.lit, p.transform)).alias("transform"), F.lit(p.nominal_scale()).alias("scale")))


def with_places(grid: DataFrame, p: Projection) -> DataFrame:
    return grid.withColumns({"east": p.east(F.col("x")), "north": p.north(F.col("y"))})


def reproject(grid: DataFrame, source: Projection, target: Projection) -> DataFrame:
    """The grid on another grid of the same system: every target cell takes the source cell that its centre lies in.

    A source cell lists the target cells whose centres it can hold, so nothing is joined or shuffled."""
    if source.crs != target.crs:
        raise ValueError("grids of different systems need their own formula of places")

    def span(k: Column, size: float, start: float, to_size: float, to_start: float) -> Column:
        ends = [F.floor((k * size + start - to_start) / to_size), F.floor(((k + 1) * size + start - to_start) / to_size)]
        return F.sequence(F.least(*ends) - 1, F.greatest(*ends) + 1)

    rows = grid.select(F.col("y").alias("_y"), F.col("x").alias("_x"), "v", F.explode(span(F.col("y"), source.e, source.f, target.e, target.f)).alias("y"))
    cells = rows.select("_y", "_x", "v", "y", F.explode(span(F.col("_x"), source.a, source.c, target.a, target.c)).alias("x"))
    y, x = source.cell(target.east(F.col("x")), target.north(F.col("y")))
    return cells.where((y == F.col("_y")) & (x == F.col("_x"))).select("y", "x", "v")
