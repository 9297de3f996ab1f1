"""Speckle filters and gap filling on pixel tables (y, x, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.kernels import Kernel, fixed, rotate
from gridlark.operators.neighborhood import box_stats, box_sums, centred, shifted


def gamma_map(grid: DataFrame, looks: float = 5, size: int = 3, holes: bool = True) -> DataFrame:
    """Maximum a posteriori filter: the mean where variation is speckle, the input where it is structure, and the root of
    a quadratic in between."""
    cu = 1 / math.sqrt(looks)
    top = math.sqrt(2) * cu
    s = box_stats(grid, size // 2, holes=holes).withColumn("ci", F.try_divide(F.sqrt("var"), F.col("mean")))
    a = F.try_divide(F.lit(1 + cu * cu), F.col("ci") * F.col("ci") - cu * cu)
    b = a - looks - 1
    d = F.col("mean") * F.col("mean") * b * b + 4 * looks * a * F.col("mean") * F.col("v")
    root = F.when(d >= 0, F.try_divide(b * F.col("mean") + F.sqrt(F.when(d >= 0, d)), 2 * a))
    return s.select("y", "x", F.when(F.col("ci") <= cu, F.col("mean")).when(F.col("ci") >= top, F.col("v")).otherwise(root).alias("v"))


def _direction_kernels() -> list[Kernel]:
    half = fixed([[0.0] * 7 for _ in range(3)] + [[1.0] * 7 for _ in range(4)])
    corner = fixed([[1.0 if x <= y else 0.0 for x in range(7)] for y in range(7)])
    return [k for i in range(4) for k in (rotate(half, i), rotate(corner, i))]


def refined_lee(grid: DataFrame, use_abs: bool = False, holes: bool = True) -> DataFrame:
    """Edge-directed local statistics.  Nine 3 x 3 means at the places 2 cells apart give four gradients; the steepest and
    its convexity choose one of eight half windows, whose mean and variance filter the cell.  Ties of gradients add their
    codes, so flat areas match no window and come out NULL."""
    s = box_stats(grid, 1, holes=holes)
    places = [(dx, dy) for dy in (-2, 0, 2) for dx in (-2, 0, 2)]
    at = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(i).alias("i")) for i, (dx, dy) in enumerate(places)])
    dealt = s.select("y", "x", "mean", "var", F.explode(at).alias("k")).select((F.col("y") - F.col("k.dy")).alias("y"), (F.col("x") - F.col("k.dx")).alias("x"), F.col("k.i").alias("i"), "mean", "var")
    m = [F.max(F.when(F.col("i") == i, F.col("mean"))).alias(f"m{i}") for i in range(9)]
    ratio = F.sort_array(F.collect_list(F.try_divide(F.col("var"), F.col("mean") * F.col("mean"))))
    nine = dealt.groupBy("y", "x").agg(*m, F.slice(ratio, 1, 5).alias("least"))
    pairs = [(1, 7), (6, 2), (3, 5), (0, 8)]
    nine = nine.withColumns({f"g{i}": F.abs(F.col(f"m{a}") - F.col(f"m{b}")) for i, (a, b) in enumerate(pairs)})
    nine = nine.withColumn("top", F.greatest(*[F.col(f"g{i}") for i in range(4)]))
    code = F.lit(0)
    for i, (a, b) in enumerate(pairs):
        first, second = F.col(f"m{a}") - F.col("m4"), F.col("m4") - F.col(f"m{b}")
        steeper = F.abs(first) > F.abs(second) if use_abs else first > second
        code = code + F.when(F.col(f"g{i}") == F.col("top"), F.when(steeper, i + 1).otherwise(i + 5)).otherwise(0)
    sigma = F.aggregate("least", F.lit(0.0), lambda t, v: t + v) / F.size("least")
    chosen = nine.where(F.col("m4").isNotNull() & F.col("top").isNotNull()).select("y", "x", code.alias("code"), sigma.alias("sigma"))
    offsets = F.create_map(*[z for i, k in enumerate(_direction_kernels()) for z in (F.lit(i + 1), F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy, w in k if w]))])
    reach = chosen.withColumn("k", F.explode(offsets[F.col("code")])).select("y", "x", "sigma", (F.col("y") + F.col("k.dy")).alias("ny"), (F.col("x") + F.col("k.dx")).alias("nx"))
    near = reach.join(grid.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("nv")), ["ny", "nx"])
    stats = near.groupBy("y", "x").agg(F.avg("nv").alias("dm"), F.var_pop("nv").alias("dv"), F.first("sigma").alias("sigma"))
    spread = (F.col("dv") - F.col("dm") * F.col("dm") * F.col("sigma")) / (F.col("sigma") + 1)
    out = F.col("dm") + F.try_divide(spread, F.col("dv")) * (F.col("v") - F.col("dm"))
    return grid.join(stats, ["y", "x"], "left").select("y", "x", out.alias("v"))


def perona_malik(grid: DataFrame, steps: int = 10, k: float = 3, method: int = 1, cut_every: int = 5) -> DataFrame:
    """Anisotropic diffusion: each step adds a fifth of the four differences, weighted down where they are steep.  Lineage
    is cut by checkpoints."""
    out = grid.select("y", "x", "v")
    for step in range(1, steps + 1):
        total = F.lit(0.0)
        for near in (shifted(dx=-1), shifted(dx=1), shifted(dy=-1), shifted(dy=1)):
            d = near - F.col("v")
            c = F.exp(-d * d / k) if method == 1 else 1 / (1 + d * d / (k * k))
            total = total + F.coalesce(c * d, F.lit(0.0))
        out = out.select("y", "x", (F.col("v") + 0.2 * total).alias("v"))
        if step % cut_every == 0:
            out = out.checkpoint()
    return out


def gap_fill_coarse(src: DataFrame, fill: DataFrame, radius: int = 2, least: int = 144, factor: int = 5) -> DataFrame:
    """``gap_fill`` whose regression runs on medians of ``factor`` by ``factor`` cells; ``radius`` counts coarse cells, and
    ``least`` the fine common cells of the coarse window."""
    common = fill.select("y", "x", F.col("v").alias("f")).join(src.select("y", "x", F.col("v").alias("s")), ["y", "x"], "full")
    both = F.col("f").isNotNull() & F.col("s").isNotNull()
    cell = lambda c: F.floor(F.col(c) / factor).alias(c)
    medians = common.groupBy(cell("y"), cell("x")).agg(*[F.median(F.when(both, F.col(c))).alias(f"c{c}") for c in "fs"], *[F.median(c).alias(c) for c in "fs"], F.count(F.when(both, 1)).alias("m"))
    line = _regression(medians, F.col("cf"), F.col("cs"), radius, True).withColumnRenamed("y", "cy").withColumnRenamed("x", "cx")
    fine = common.withColumns({"cy": F.floor(F.col("y") / factor), "cx": F.floor(F.col("x") / factor)}).join(line, ["cy", "cx"], "left")
    return fine.select("y", "x", F.coalesce(F.col("s"), F.when(F.col("near") >= least, F.col("f") * F.col("scale") + F.col("offset"))).alias("v"))


def _regression(j: DataFrame, cf, cs, radius: int, holes: bool) -> DataFrame:
    """y, x, near (cells with both, each counting its ``m``), and scale and offset that lead from f to s, from windows of
    the grid ``j`` (y, x, f, s, m); ``cf`` and ``cs`` are the values where both are known."""
    j = centred(j, "f").withColumnRenamed("_c", "_of").transform(lambda x: centred(x, "s")).withColumnRenamed("_c", "_os")
    f, s, both = F.col("f") - F.col("_of"), F.col("s") - F.col("_os"), cf.isNotNull() & cs.isNotNull()
    bf, bs = cf - F.col("_of"), cs - F.col("_os")
    only = lambda c: F.when(both, c)
    parts = {"n": only(F.lit(1)), "m": only(F.col("m")), "sf": only(bf), "ss": only(bs), "sff": only(bf * bf), "sfs": only(bf * bs), "nf": F.when(f.isNotNull(), 1), "af": f, "aff": f * f, "ns": F.when(s.isNotNull(), 1), "as_": s, "ass": s * s}
    w = box_sums(j, {k: c.cast("double") for k, c in parts.items()}, radius, holes=holes)
    c = lambda k: F.col(f"_{k}")
    slope = F.try_divide(c("n") * c("sfs") - c("sf") * c("ss"), c("n") * c("sff") - c("sf") * c("sf"))
    mf, ms = F.try_divide(c("af"), c("nf")), F.try_divide(c("as_"), c("ns"))
    vf, vs = F.try_divide(c("aff"), c("nf")) - mf * mf, F.try_divide(c("ass"), c("ns")) - ms * ms
    w = w.withColumns({"slope": slope, "ratio": F.try_divide(F.sqrt(F.greatest(vs, F.lit(0.0))), F.sqrt(F.greatest(vf, F.lit(0.0)))), "mf": mf, "ms": ms})
    fine = lambda x: x.between(1 / 3, 3)
    scale = F.when(fine(F.col("slope")), F.col("slope")).when(fine(F.col("ratio")), F.col("ratio")).otherwise(1.0)
    offset = F.when(fine(F.col("slope")), (c("ss") - F.col("slope") * c("sf")) / c("n")).when(fine(F.col("ratio")), F.col("ms") - F.col("mf") * F.col("ratio")).otherwise(F.col("ms") - F.col("mf"))
    return w.select("y", "x", c("m").alias("near"), scale.alias("scale"), (offset + F.col("_os") - F.col("_of") * scale).alias("offset"))


def gap_fill(src: DataFrame, fill: DataFrame, radius: int = 10, least: int = 144, holes: bool = True) -> DataFrame:
    """Fills NULL cells of ``src`` by a windowed regression of it on ``fill`` over their common cells.

    A slope outside [1/3, 3] gives way to the ratio of standard deviations, one that is still outside to 1; a gap needs
    ``least`` common neighbours.  Sums of the window make all statistics, in two window passes."""
    j = fill.select("y", "x", F.col("v").alias("f")).join(src.select("y", "x", F.col("v").alias("s")), ["y", "x"], "full")
    line = _regression(j.withColumn("m", F.lit(1)), F.col("f"), F.col("s"), radius, holes)
    filled = F.when(F.col("near") >= least, F.col("f") * F.col("scale") + F.col("offset"))
    return j.join(line, ["y", "x"]).select("y", "x", F.coalesce(F.col("s"), filled).alias("v"))
