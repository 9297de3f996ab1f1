"""Dates, dictionaries, features and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("years", "months", "weeks", "days", "hours", "mins", "secs")


def advance(date: Column, n: Column | int, unit: str) -> Column:
    """``n`` units (years, months, weeks, days, hours, mins or secs; negative ones go back) after a date or time.  A day that
    the month lacks becomes its last."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    return date.cast("timestamp_ntz") + F.make_interval(**{unit: n if isinstance(n, Column) else F.lit(n)})


def date_text(date: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(date, pattern)


def dictionary(properties: dict[str, Column]) -> Column:
    """A map from names to values, which share the type of the first."""
    return F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v)])


def dictionary_values(d: Column) -> Column:
    """The values in the order of their keys."""
    return F.transform(F.array_sort(F.map_entries(d)), lambda e: e["value"])


def feature(geometry: Column | None, properties: dict[str, Column]) -> Column:
    """A geometry (null if there is none) with a dictionary of properties."""
    return F.struct((F.lit(None).cast("array<struct<x:double,y:double>>") if geometry is None else geometry).alias("geometry"), dictionary(properties).alias("properties"))


def geometry_json(ring: Column) -> Column:
    """A ring as the JSON text of its coordinates, closed."""
    return F.to_json(F.array(F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"]))))
