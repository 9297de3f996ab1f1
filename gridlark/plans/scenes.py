"""Queries that select scenes, compare epochs and gather training points; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions.kernels import square
from gridlark.operators import geometry as G
from gridlark.operators import neighborhood as N
from gridlark.plans.catalog import COLL, GRID, POS, _near, query, r6, uniform_sql
from gridlark.sources import tables as T


@query(f"WITH {POS}, raw AS (SELECT vec_id AS y, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), a AS ({_near('pos', 1, 'median(b.v) AS m')}), b AS ({_near('raw', 1, 'median(b.v) AS m')}) SELECT a.y, a.x, round(b.m - a.m, 6) AS diff FROM a JOIN b USING (y, x) JOIN raw r USING (y, x) WHERE r.v > 0 AND b.m - a.m < -1.05")
def flood_map(spark, d):
    """Cells above zero whose smoothed value fell by more than the threshold between two images."""
    smooth = lambda g, name: N.focal(g, "median", square(1)).withColumnRenamed("v", name)
    ground = T.grid(spark, d)
    both = smooth(T.grid(spark, d, positive=True), "before").join(smooth(ground, "after"), ["y", "x"]).join(ground, ["y", "x"])
    diff = F.col("after") - F.col("before")
    return both.where((F.col("v") > 0) & (diff < -1.05)).select("y", "x", r6("diff", diff))


_EPOCH = "CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, median(v) * 2.55::DOUBLE))) AS BIGINT)"


@query(f"WITH {COLL}, a AS (SELECT event_type, user_id, {_EPOCH} AS v FROM coll WHERE day < DATE '2024-01-16' AND v IS NOT NULL GROUP BY ALL), b AS (SELECT event_type, user_id, {_EPOCH} AS v FROM coll WHERE day >= DATE '2024-01-16' AND v IS NOT NULL GROUP BY ALL) SELECT event_type, user_id, a.v AS before, b.v AS after, CAST(sign(b.v - a.v) AS BIGINT) AS change FROM a JOIN b USING (event_type, user_id)")
def two_epoch_change(spark, d):
    """Medians of two epochs as bytes, where both have data."""
    c = T.collection_in_order(spark, d).where(F.col("v").isNotNull())
    late = F.col("day") >= F.lit("2024-01-16").cast("date")
    byte = lambda cond: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.median(F.when(cond, F.col("v"))) * 2.55)))
    both = c.groupBy("event_type", "user_id").agg(byte(~late).alias("before"), byte(late).alias("after"), F.max(late).alias("has_late"), F.min(late).alias("only_late"))
    return both.where("has_late AND NOT only_late").select("event_type", "user_id", "before", "after", F.signum(F.col("after") - F.col("before")).cast("long").alias("change"))


@query(f"WITH {COLL} SELECT 'greenest' AS mode, user_id, round(max(v), 6) AS v FROM coll GROUP BY ALL UNION ALL SELECT 'standard', user_id, round(median(v), 6) FROM coll WHERE day >= DATE '2024-01-05' AND day < DATE '2024-01-25' AND event_type IN ('view', 'click') AND v < 80 GROUP BY ALL UNION ALL SELECT 'simple', user_id, round(quantile_cont(v, 0.5), 6) FROM coll GROUP BY ALL")
def input_selector(spark, d):
    """A composite in each of three modes: best pixel, median of the clear scenes of a period, percentile."""
    c = T.collection(spark, d)
    greenest = c.groupBy("user_id").agg(F.max("v").alias("v")).withColumn("mode", F.lit("greenest"))
    clear = c.where("day >= DATE'2024-01-05' AND day < DATE'2024-01-25' AND event_type IN ('view', 'click') AND v < 80")
    standard = clear.groupBy("user_id").agg(F.median("v").alias("v")).withColumn("mode", F.lit("standard"))
    simple = c.groupBy("user_id").agg(F.percentile("v", 0.5).alias("v")).withColumn("mode", F.lit("simple"))
    return greenest.unionByName(standard).unionByName(simple).select("mode", "user_id", r6("v"))


def _u(seed: int) -> str:
    return uniform_sql("id", seed)


@query(f"WITH p AS (SELECT id, {_u(3)} AS x, {_u(4)} AS y FROM range(1000) t(id)), t AS (SELECT *, CAST(x < 0.3 AND y < 0.6 AS INT) AS inside FROM p), need AS (SELECT greatest(0, (sum(1 - inside) - sum(inside)) // 2) AS n FROM t), e AS (SELECT id, {_u(5)} * 0.3::DOUBLE AS x, {_u(6)} * 0.6::DOUBLE AS y FROM range(1000) t(id)) SELECT id, round(x, 6) AS x, round(y, 6) AS y, inside FROM t UNION ALL SELECT 1000 + id, round(x, 6), round(y, 6), 1 FROM e, need WHERE id < n")
def training_points(spark, d):
    """Random points of the unit square tagged by a region, and half as many points within it as it lacks."""
    west, south, east, north = 0.0, 0.0, 0.3, 0.6
    inside = (F.col("x") < east) & (F.col("y") < north)
    p = G.random_points(spark, 1000, 0.0, 0.0, 1.0, 1.0, seed=1).withColumn("inside", inside.cast("int"))
    need = p.agg(F.floor((F.sum(1 - F.col("inside")) - F.sum("inside")) / 2).alias("need"))  # one row
    extra = G.random_points(spark, 1000, west, south, east, north, seed=2).crossJoin(F.broadcast(need)).where("id < need")
    both = p.unionByName(extra.select((F.col("id") + 1000).alias("id"), "x", "y", F.lit(1).alias("inside")))
    return both.select("id", r6("x"), r6("y"), "inside")


@query(f"WITH {GRID}, c AS (SELECT y, x, CAST(floor(v * 4) <> 0 AS INT) AS v FROM grid), s AS ({_near('c', 1, 'min(b.v) + max(b.v) AS w')}) SELECT y, x, CAST(w / 2 AS INTEGER) AS urban FROM s WHERE w <> 1")
def unmixed_points(spark, d):
    """One class against the others, only where the whole window agrees."""
    c = T.grid(spark, d).select("y", "x", (F.floor(F.col("v") * 4) != 0).cast("int").alias("v"))
    s = N.reduce_kernel(c, square(1), {"v": F.min("nv") + F.max("nv")})
    return s.where("v <> 1").select("y", "x", (F.col("v") / 2).cast("int").alias("urban"))
