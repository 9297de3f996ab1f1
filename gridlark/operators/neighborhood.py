"""Neighbourhood operators on pixel tables (y, x, v); a table of several images has columns ``by`` that tell them apart, and
no neighbourhood crosses from one to another.

Square windows of sums run as two passes (along rows, then along columns); on a lattice without holes each cell is read
once a pass however large the window.  Any other kernel deals each cell to the cells it reaches, which partial aggregation shrinks before
the shuffle; the result is kept to the cells of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.kernels import Kernel, circle, square


By = tuple[str, ...]


def centred(grid: DataFrame, v: str, by: By = ()) -> DataFrame:
    """The grid with ``_c``, the mean of the image: squares of what is left of it do not cancel where values are large."""
    mean = grid.groupBy(*by).agg(F.avg(v).alias("_c"))
    if not by:
        return grid.crossJoin(F.broadcast(mean))  # one row
    return grid.join(mean.select(*[F.col(b).alias(f"_{b}") for b in by], "_c"), [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]).drop(*[f"_{b}" for b in by])


def box_sums(grid: DataFrame, parts: dict[str, Column], radius: int, by: By = (), holes: bool = True) -> DataFrame:
    """The grid with ``_name``, the sum over the square window, for each of ``parts``.

    Along rows each cell is dealt to the columns it reaches, so that a row counts in a window even where it has no cell in
    the window's middle column; ``holes=False`` is for lattices whose cells are all there (masked ones as NULL), where
    window functions do without dealing."""
    col = Window.partitionBy(*by, "x").orderBy("y").rangeBetween(-radius, radius)
    if not holes:
        row = Window.partitionBy(*by, "y").orderBy("x").rangeBetween(-radius, radius)
        a = grid.withColumns({f"_{k}": F.sum(c).over(row) for k, c in parts.items()})
        return a.withColumns({f"_{k}": F.sum(f"_{k}").over(col) for k in parts})
    valued = grid.select(*by, "y", F.explode(F.sequence(F.col("x") - radius, F.col("x") + radius)).alias("x"), *[c.alias(f"_{k}") for k, c in parts.items()])
    rows = valued.groupBy(*by, "y", "x").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in parts])
    return grid.join(rows.withColumns({f"_{k}": F.sum(f"_{k}").over(col) for k in parts}), [*by, "y", "x"])


def box_stats(grid: DataFrame, radius: int, v: str = "v", by: By = (), holes: bool = True) -> DataFrame:
    """y, x, v, n, mean, var (population) over the square window; masked and missing cells are skipped (``holes``: see
    ``box_sums``)."""
    d = F.col(v) - F.col("_c")
    a = box_sums(centred(grid, v, by), {"n": F.when(d.isNotNull(), 1).otherwise(0), "s": d, "q": d * d}, radius, by, holes)
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    out = a.withColumns({"n": F.col("_n"), "mean": F.col("_c") + mean, "var": F.greatest(F.lit(0.0), F.try_divide(F.col("_q"), F.col("_n")) - mean * mean)})
    return out.drop("_n", "_s", "_q", "_c")


def reduce_kernel(grid: DataFrame, kernel: Kernel, aggregates: dict[str, Column], by: By = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """by, y, x and aggregates of columns nv (a neighbour's value) and w (its weight) over the kernel's cells; they skip NULL.

    The cells of the input are told by the row that each deals to itself (of no weight, if the kernel lacks its middle), so
    the grid is read once however many of these follow each other.  By that row each cell also keeps its columns ``keep``."""
    middle = any(dx == 0 and dy == 0 for dx, dy, _ in kernel)
    places = [(dx, dy, F.lit(float(w)), dx == 0 and dy == 0) for dx, dy, w in kernel] + ([] if middle else [(0, 0, F.lit(None).cast("double"), True)])
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), w.alias("w"), F.lit(own).alias("own")) for dx, dy, w, own in places])
    placed = grid.dropna(subset=[*by, "y", "x"])
    nv = F.col("v") if middle else F.when(F.col("k.w").isNotNull(), F.col("v"))
    dealt = placed.select(*by, "y", "x", "v", *keep, F.explode(offsets).alias("k")).select(*by, (F.col("y") - F.col("k.dy")).alias("y"), (F.col("x") - F.col("k.dx")).alias("x"), nv.alias("nv"), F.col("k.w").alias("w"), F.col("k.own").alias("_own"), *[F.when(F.col("k.own"), F.col(c)).alias(c) for c in keep])
    named = {f"_{n}": c for n, c in aggregates.items()}
    reduced = dealt.groupBy(*by, "y", "x").agg(*[c.alias(n) for n, c in named.items()], F.max("_own").alias("_own"), F.count("w").alias("_w"), *[F.max(c).alias(c) for c in keep])
    return reduced.where("_own AND _w > 0").select(*by, "y", "x", *[F.col(n).alias(n[1:]) for n in named], *keep)


def convolve(grid: DataFrame, kernel: Kernel, by: By = ()) -> DataFrame:
    return reduce_kernel(grid, kernel, {"v": F.sum(F.col("nv") * F.col("w"))}, by)


def focal(grid: DataFrame, how: str, kernel: Kernel, by: By = (), keep: tuple[str, ...] = ()) -> DataFrame:
    make = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "sum": F.sum}[how]
    return reduce_kernel(grid, kernel, {"v": make("nv")}, by, keep)


def erode(grid: DataFrame, kernel: Kernel, by: By = (), keep: tuple[str, ...] = ()) -> DataFrame:
    return focal(grid, "min", kernel, by, keep)


def dilate(grid: DataFrame, kernel: Kernel, by: By = (), keep: tuple[str, ...] = ()) -> DataFrame:
    return focal(grid, "max", kernel, by, keep)


def opening(grid: DataFrame, kernel: Kernel, by: By = (), keep: tuple[str, ...] = ()) -> DataFrame:
    return dilate(erode(grid, kernel, by, keep), kernel, by, keep)


def closing(grid: DataFrame, kernel: Kernel, by: By = (), keep: tuple[str, ...] = ()) -> DataFrame:
    return erode(dilate(grid, kernel, by, keep), kernel, by, keep)


def morph_adjust(grid: DataFrame, first: Kernel, second: Kernel) -> DataFrame:
    """Close, open, keep what the input has too, close again.

    Cells keep their input through the chain, so nothing is joined: plans' estimates of a grid's size are too small by
    far, and Spark would broadcast it."""
    marked = grid.select("y", "x", "v", (F.col("v") != 0).alias("set"))
    smooth = opening(closing(marked, first, keep=("set",)), first, keep=("set",))
    return closing(smooth.select("y", "x", (F.col("set") & (F.col("v") != 0)).cast("int").alias("v")), second)


def entropy(grid: DataFrame, kernel: Kernel, scale: int) -> DataFrame:
    """Shannon entropy in bits of floor(v * scale) over the kernel's cells; masked cells are no values."""
    coded = grid.where("v IS NOT NULL").select("y", "x", F.floor(F.col("v") * scale).alias("v"))
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy, _ in kernel])
    dealt = coded.select("y", "x", "v", F.explode(offsets).alias("k")).select((F.col("y") - F.col("k.dy")).alias("y"), (F.col("x") - F.col("k.dx")).alias("x"), "v")
    counts = dealt.groupBy("y", "x", "v").agg(F.count("*").alias("c"))
    sums = counts.groupBy("y", "x").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))
    return sums.join(grid.select("y", "x"), ["y", "x"], "left_semi")


def mask_low_entropy(grid: DataFrame, radius: int = 5, scale: int = 10_000, least: float = 3.2, grow: int = 5) -> DataFrame:
    """Masks cells whose surroundings (a circle) have little entropy, and all cells within ``grow`` of such a cell."""
    low = entropy(grid, circle(radius), scale).select("y", "x", (F.col("entropy") < least).cast("int").alias("v"))
    bad = dilate(low, circle(grow)).withColumnRenamed("v", "bad")
    return grid.join(bad, ["y", "x"], "left").withColumn("v", F.when(F.coalesce("bad", F.lit(0)) == 0, F.col("v"))).drop("bad")


def patches_at(grid: DataFrame, points: DataFrame, radius: int, fill: float = 0.0) -> DataFrame:
    """The points' rows (y, x and more) with the window around each as a patch in row order; masked and missing cells are
    ``fill``.  Points ask for their cells, so cells far from any point are never dealt."""
    places = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dx, dy, _ in square(radius)])
    asked = points.withColumn("k", F.explode(places)).withColumns({"ny": F.col("y") + F.col("k.dy"), "nx": F.col("x") + F.col("k.dx")})
    cells = grid.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("nv"))
    got = asked.join(cells, ["ny", "nx"], "left")
    rows = F.sort_array(F.collect_list(F.struct("k.dy", "k.dx", F.coalesce("nv", F.lit(fill)).alias("v"))))
    return got.groupBy(*points.columns).agg(F.transform(rows, lambda s: s["v"]).alias("patch"))


def patches(grid: DataFrame, radius: int) -> DataFrame:
    """y, x and the window's values in row order; a full patch has (2 radius + 1) ** 2 of them."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy, _ in square(radius)])
    dealt = grid.select("y", "x", "v", F.explode(offsets).alias("k")).select((F.col("y") - F.col("k.dy")).alias("y"), (F.col("x") - F.col("k.dx")).alias("x"), F.col("k.dy").alias("dy"), F.col("k.dx").alias("dx"), "v")
    got = dealt.groupBy("y", "x").agg(F.transform(F.sort_array(F.collect_list(F.struct("dy", "dx", "v"))), lambda s: s["v"]).alias("patch"))
    return got.join(grid.select("y", "x"), ["y", "x"], "left_semi")


def shifted(dx: int = 0, dy: int = 0, v: str = "v", by: By = ()) -> Column:
    """The value ``dx`` cells to the right or ``dy`` down (one of both), NULL where that cell is masked or missing."""
    line, along, step = ("y", "x", dx) if dx else ("x", "y", dy)
    return F.max(v).over(Window.partitionBy(*by, line).orderBy(along).rangeBetween(step, step))


def _stars(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), u > v, to u and the least node v that it reaches, by alternating large and small stars.

    Rounds grow with the logarithm of the largest component; they end when the edges are stars, so none is cut short.
    """
    e = edges.distinct().checkpoint()
    while True:
        rows, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        if rows == nodes and e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()


def components(grid: DataFrame) -> DataFrame:
    """Labels of 8-connected regions of cells with v <> 0 (the least y, x of each): cells make runs along rows, runs that
    touch are edges, and stars of edges give each run the least one of its region."""
    key = F.col("y") * F.lit(1 << 31) + F.col("x")
    row = Window.partitionBy("y").orderBy("x")
    first = F.when(F.coalesce(F.col("x") - F.lag("x").over(row) != 1, F.lit(True)), key)
    cells = grid.where("v <> 0").select("y", "x", first.alias("first")).select("y", "x", F.max("first").over(row).alias("run")).checkpoint()
    below = cells.select((F.col("y") - 1).alias("y"), F.explode(F.array(*[F.col("x") + i for i in (-1, 0, 1)])).alias("x"), F.col("run").alias("u"))
    least = _stars(below.join(cells, ["y", "x"]).select("u", F.col("run").alias("v")))
    return cells.join(least, F.col("run") == F.col("u"), "left").select("y", "x", F.coalesce("v", "run").alias("label"))


def neighborhood_bands(grid: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """y, x and a band n0, n1, ... for each (dx, dy): the value of that neighbour, NULL where it is masked or missing."""
    numbered = [(dx, dy, float(i)) for i, (dx, dy) in enumerate(offsets)]
    return reduce_kernel(grid, numbered, {f"n{i}": F.max(F.when(F.col("w") == i, F.col("nv"))) for i in range(len(offsets))})
