"""Per-pixel band functions: a masked cell is NULL, and NaN or infinity becomes NULL on the way out."""

from __future__ import annotations

import re

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), NULL where the sum is 0."""
    return F.try_divide(a - b, a + b)


def pairwise_differences(bands: list[str]) -> dict[str, Column]:
    """(second - first) / (second + first) for every pair of bands."""
    return {f"nd_{a}_{b}": normalized_difference(F.col(b), F.col(a)) for a, b in combinations(bands, 2)}


def to_db(c: Column) -> Column:
    return 10 * F.log10(c)


def to_natural(c: Column) -> Column:
    return F.pow(F.lit(10.0), c / 10)


def gamma_nought(db: Column, angle_degrees: Column) -> Column:
    return db - 10 * F.log10(F.cos(F.radians(angle_degrees)))


def calibrated(c: Column, log_bias: Column, log_gain: Column) -> Column:
    return F.try_divide(c - log_bias, log_gain)


def unmask(c: Column, fill: Column | float) -> Column:
    return F.coalesce(c, fill if isinstance(fill, Column) else F.lit(fill))


def update_mask(c: Column, mask: Column) -> Column:
    return F.when(mask != 0, c)


def where_band(c: Column, condition: Column, value: Column) -> Column:
    """``value`` where the condition holds; a NULL condition keeps ``c``."""
    return F.when(condition, value).otherwise(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def strict_and(a: Column, b: Column) -> Column:
    """1 or 0, NULL where either side is masked."""
    return F.when(a.isNotNull() & b.isNotNull(), ((a != 0) & (b != 0)).cast("int"))


def band_sum(*bands: Column) -> Column:
    """The sum of the valid bands, NULL only where all are masked."""
    total = sum((F.coalesce(b, F.lit(0.0)) for b in bands[1:]), F.coalesce(bands[0], F.lit(0.0)))
    return F.when(F.coalesce(*bands).isNotNull(), total)


def stretch(c: Column, low: float, high: float, gamma: float = 1.0) -> Column:
    """0..255 for display."""
    return F.floor(255 * F.pow(clamp((c - low) / (high - low), 0.0, 1.0), F.lit(1.0 / gamma)))


def expression(text: str) -> Column:
    """Band arithmetic as text, with bands as b('name') or as bare names; a division by zero is masked."""
    return F.expr(re.sub(r"""b\(\s*['"]([^'"]+)['"]\s*\)""", r"`\1`", text))


def matching(names: list[str], pattern: str) -> list[str]:
    """The names that a regular expression matches as a whole."""
    return [n for n in names if re.fullmatch(pattern, n)]


def palette(c: Column, low: float, high: float, colours: list[str]) -> Column:
    """The colour of ``c`` among equal steps from low to high; values outside take the end colours."""
    step = F.floor((c - low) / (high - low) * len(colours)).cast("int")
    return F.get(F.array(*[F.lit(x) for x in colours]), F.greatest(F.lit(0), F.least(F.lit(len(colours) - 1), F.when(c.isNotNull(), step))))


def rescaled(c: Column, low: float, high: float) -> Column:
    """Where ``c`` lies between two values, as a share; ``low`` may be the larger."""
    return (c - low) / (high - low)


def cloud_score(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column, thermal: Column) -> Column:
    """How like a cloud a pixel is, 0 to 100: the least of what tests of brightness in the blue, the visible and the infrared
    bands, of cold and of difference from snow say; masked where a band is."""
    # The ranges of the published tests, for reflectances and kelvin.
    tests = [rescaled(blue, 0.1, 0.3), rescaled(red + green + blue, 0.2, 0.8), rescaled(nir + swir1 + swir2, 0.3, 0.8), rescaled(thermal, 300.0, 290.0), rescaled(normalized_difference(green, swir1), 0.8, 0.6)]
    known = sum((c.isNotNull().cast("int") for c in tests[1:]), tests[0].isNotNull().cast("int")) == len(tests)
    return F.when(known, F.floor(100 * clamp(F.least(F.lit(1.0), *tests), 0.0, 1.0)))


def clear(score: Column, most: float, bands: list[Column]) -> list[Column]:
    """The bands, all masked where the score is over ``most`` or any band is masked."""
    fine = score <= most
    for b in bands:
        fine = fine & b.isNotNull()
    return [F.when(fine, b) for b in bands]


def constants(*values: float, names: list[str] | None = None) -> list[Column]:
    """Bands that are the same everywhere; the other operand gives the extent."""
    return [F.lit(float(v)).alias(n) for v, n in zip(values, names or [f"constant_{i}" for i in range(len(values))], strict=True)]
