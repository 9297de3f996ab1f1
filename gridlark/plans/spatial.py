"""Queries on polygons, resampling, band expressions and models; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import bands as B
from gridlark.operators import collections as C
from gridlark.operators import geometry as G
from gridlark.operators import learning as M
from gridlark.operators import neighborhood as N
from gridlark.plans.catalog import BANDS, COLL, GRID, HORN, KEYS, K, query, r6, uniform_sql
from gridlark.sources import tables as T

# A triangle for each vector, about the row of the grid that the vector is.
TRI = "tri AS (SELECT vec_id, " + ", ".join(f"30 * CAST(embedding[{2 * i + 1}] AS DOUBLE) + 32 AS x{i}, 30 * CAST(embedding[{2 * i + 2}] AS DOUBLE) + vec_id AS y{i}" for i in range(3)) + " FROM embeddings)"
_EDGES = [(0, 1), (1, 2), (2, 0)]
_LEAST = {c: f"least({c}0, {c}1, {c}2)" for c in "xy"}
_MOST = {c: f"greatest({c}0, {c}1, {c}2)" for c in "xy"}


def _inside(at) -> str:
    """SQL for an odd number of crossings; ``at(c, i)`` names a coordinate of a corner."""
    return "(" + " + ".join(f"CAST(({at('y', a)} > y + 0.5::DOUBLE) <> ({at('y', b)} > y + 0.5::DOUBLE) AND x + 0.5::DOUBLE < ({at('x', b)} - {at('x', a)}) * (y + 0.5::DOUBLE - {at('y', a)}) / ({at('y', b)} - {at('y', a)}) + {at('x', a)} AS INT)" for a, b in _EDGES) + ") % 2 = 1"


CELLS = f"{TRI}, rows_of AS (SELECT *, unnest(generate_series(CAST(floor({_LEAST['y']}) AS BIGINT), CAST(floor({_MOST['y']}) AS BIGINT))) AS y FROM tri), boxes AS (SELECT *, unnest(generate_series(CAST(floor({_LEAST['x']}) AS BIGINT), CAST(floor({_MOST['x']}) AS BIGINT))) AS x FROM rows_of), cells AS (SELECT vec_id, y, x FROM boxes WHERE {_inside(lambda c, i: f'{c}{i}')})"
_CROSS = [f"(x{a} * y{b} - x{b} * y{a})" for a, b in _EDGES]
_AREA2 = "(" + " + ".join(_CROSS) + ")"


def triangles(spark, d):
    e = T.scan(spark, d, "embeddings")
    at = lambda i, plus: F.get("embedding", F.lit(i)).cast("double") * 30 + plus
    return e.select("vec_id", G.ring([(at(2 * i, F.lit(32)), at(2 * i + 1, F.col("vec_id"))) for i in range(3)]).alias("ring"))


@query(f"WITH {TRI} SELECT vec_id, round(abs({_AREA2}) / 2, 6) AS area, round(" + " + ".join(f"sqrt((x{b} - x{a}) * (x{b} - x{a}) + (y{b} - y{a}) * (y{b} - y{a}))" for a, b in _EDGES) + ", 6) AS perimeter, round((x0 + x1 + x2) / 3, 4) AS cx, round((y0 + y1 + y2) / 3, 4) AS cy FROM tri")
def polygon_measures(spark, d):
    t = triangles(spark, d).withColumn("c", G.centroid(F.col("ring")))
    return t.select("vec_id", r6("area", G.area(F.col("ring"))), r6("perimeter", G.perimeter(F.col("ring"))), F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@query(f"WITH {TRI}, b AS (SELECT vec_id, {_LEAST['x']} + 1 AS west, {_LEAST['y']} + 1 AS south, {_MOST['x']} - 1 AS east, {_MOST['y']} - 1 AS north FROM tri) SELECT vec_id, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM b WHERE east >= west AND north >= south AND west <= 40 AND east >= 20 AND south <= 300 AND north >= 10")
def shrunk_bounds_meet(spark, d):
    t = triangles(spark, d).select("vec_id", G.buffered(G.bounds(F.col("ring")), -1.0).alias("b"))
    box = G.bounds(G.rectangle(20, 10, 40, 300))
    return t.where(F.col("b").isNotNull() & G.intersects(F.col("b"), box)).select("vec_id", *[r6(c, F.col(f"b.{c}")) for c in ("west", "south", "east", "north")])


@query(f"WITH {CELLS} SELECT y, x, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS v FROM cells GROUP BY ALL")
def rasterize_features(spark, d):
    return G.rasterize(triangles(spark, d), value="vec_id")


@query(f"WITH {GRID}, {CELLS} SELECT vec_id, y, x, round(v, 6) AS v FROM cells JOIN grid USING (y, x)")
def sample_regions(spark, d):
    return G.sample_regions(T.grid(spark, d), triangles(spark, d), ["vec_id"]).select("vec_id", "y", "x", r6("v"))


@query(f"WITH {GRID}, {CELLS}, s AS (SELECT vec_id, avg(v) AS mean, max(v) AS high, count(*) AS n FROM cells JOIN grid USING (y, x) GROUP BY ALL) SELECT t.vec_id, round(mean, 6) AS mean, round(high, 6) AS high, n FROM embeddings t LEFT JOIN s USING (vec_id)")
def reduce_regions(spark, d):
    got = G.reduce_regions(T.grid(spark, d), triangles(spark, d), "vec_id", {"mean": F.avg("v"), "high": F.max("v"), "n": F.count("v")})
    return got.select("vec_id", r6("mean"), r6("high"), "n")


@query(f"WITH {GRID}, {CELLS}, p AS (SELECT y, x, max(vec_id) AS p FROM cells GROUP BY ALL) SELECT y, x, round(coalesce(p, v), 6) AS v FROM grid LEFT JOIN p USING (y, x)")
def paint_features(spark, d):
    return G.paint(T.grid(spark, d), triangles(spark, d), "vec_id").select("y", "x", r6("v"))


_FIXED = [(5, 10), (60, 40), (20, 300)]


@query(f"WITH {GRID} SELECT y, x, CASE WHEN {_inside(lambda c, i: str(_FIXED[i]['xy'.index(c)]) + '.0::DOUBLE')} THEN round(v, 6) END AS v FROM grid")
def clip_polygon(spark, d):
    return G.clip(T.grid(spark, d), G.ring(_FIXED)).select("y", "x", r6("v"))


@query(f"WITH {GRID}, u AS (SELECT y, x, v, {uniform_sql(chr(39).join(['y || ', ':', ' || x']), 7)} AS random FROM grid) SELECT y, x, round(v, 6) AS v, round(random, 9) AS random FROM u ORDER BY u.random, y, x LIMIT 200")
def sample_pixels(spark, d):
    return G.sample_pixels(T.grid(spark, d), 200, seed=7).select("y", "x", r6("v"), F.round("random", 9).alias("random"))


@query(f"WITH {GRID} SELECT CAST(floor(v * 4) AS BIGINT) AS class, round(sum(cos(radians(y * 0.01)) * (0.01::DOUBLE * 0.01::DOUBLE * 111320.0::DOUBLE * 111320.0::DOUBLE)), 2) AS area FROM grid GROUP BY ALL")
def area_by_class(spark, d):
    g = T.grid(spark, d).withColumn("area", G.pixel_area(F.col("y") * 0.01, 0.01, 0.01))
    return g.groupBy(F.floor(F.col("v") * 4).alias("class")).agg(F.round(F.sum("area"), 2).alias("area"))


_CUBIC = "k(t, w, own) AS (VALUES " + ", ".join(f"({t}, {w!r}::DOUBLE, {int(own)})" for t, w, own in C.cubic_weights(2)) + ")"


@query(f"WITH {GRID}, {_CUBIC}, h AS (SELECT y, x * 2 + t AS x, sum(v * w) / sum(w) AS v FROM grid, k GROUP BY ALL HAVING max(own) = 1), o AS (SELECT a.y, a.x FROM (SELECT y * 2 + t AS y, x, max(own) AS own FROM h, k GROUP BY ALL) a WHERE own = 1) SELECT y, x, round(v, 6) AS v FROM (SELECT y * 2 + t AS y, x, sum(v * w) / sum(w) AS v FROM h, k GROUP BY ALL) JOIN o USING (y, x)")
def bicubic_resample(spark, d):
    return C.bicubic(T.grid(spark, d), 2).select("y", "x", r6("v"))


_NEAR = [(-1, -1), (1, -1), (0, 0), (-1, 1), (1, 1)]


@query(f"WITH {GRID} SELECT a.y, a.x, " + ", ".join(f"round(n{i}.v, 6) AS n{i}" for i in range(5)) + " FROM grid a " + " ".join(f"LEFT JOIN grid n{i} ON n{i}.y = a.y + ({dy}) AND n{i}.x = a.x + ({dx})" for i, (dx, dy) in enumerate(_NEAR)))
def neighborhood_bands(spark, d):
    return N.neighborhood_bands(T.grid(spark, d), _NEAR).select("y", "x", *[r6(f"n{i}") for i in range(5)])


@query(f"WITH {GRID}, {HORN} SELECT grid.y, grid.x, CAST(coalesce(degrees(atan(sqrt(gx * gx + gy * gy))) < 5, false) AS INT) AS flat, CAST(v > 0 AS INT) AS high FROM grid LEFT JOIN g USING (y, x)")
def terrain_masks(spark, d):
    g = T.grid(spark, d)
    flat = C.terrain(g).select("y", "x", F.coalesce(F.degrees("slope") < 5, F.lit(False)).cast("int").alias("flat"))
    return g.join(flat, ["y", "x"]).select("y", "x", "flat", (F.col("v") > 0).cast("int").alias("high"))


@query(f"WITH {COLL} SELECT event_type, user_id, round(regr_slope(v, dayofyear(day)), 6) AS scale, round(regr_intercept(v, dayofyear(day)), 6) AS offset_, count(*) AS n FROM coll GROUP BY ALL HAVING count(DISTINCT day) > 1")
def linear_fit(spark, d):
    doy = F.dayofyear("day")
    got = T.collection(spark, d).groupBy("event_type", "user_id").agg(F.regr_slope("v", doy).alias("scale"), F.regr_intercept("v", doy).alias("offset_"), F.count("*").alias("n"), F.countDistinct("day").alias("days"))
    return got.where("days > 1").select("event_type", "user_id", r6("scale"), r6("offset_"), "n")


@query(f"WITH {BANDS} SELECT {K}, round(2.5::DOUBLE * (b2 - b1) / (b2 + 6 * b1 - 7.5::DOUBLE * b3 + 1), 6) AS evi FROM bands")
def band_expression(spark, d):
    return T.bands(spark, d).select(*KEYS, r6("evi", B.expression("2.5D * (b('b2') - b('b1')) / (b('b2') + 6 * b('b1') - 7.5D * b('b3') + 1)")))


@query(f"WITH {BANDS} SELECT {K}, CASE WHEN b3 < 0.025 THEN 'white' WHEN b3 < 0.05 THEN 'yellow' WHEN b3 < 0.075 THEN 'orange' ELSE 'red' END AS colour FROM bands")
def palette_colours(spark, d):
    return T.bands(spark, d).select(*KEYS, B.palette(F.col("b3"), 0.0, 0.1, ["white", "yellow", "orange", "red"]).alias("colour"))


_MATRIX = [[1.0, 0.5, 0.0, -1.0], [0.0, 2.0, 1.0, 0.25]]


@query("SELECT vec_id, " + ", ".join("round(" + " + ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) * ({w!r}::DOUBLE)" for j, w in enumerate(row)) + f", 6) AS m{i}" for i, row in enumerate(_MATRIX)) + " FROM embeddings")
def matrix_product(spark, d):
    e = T.scan(spark, d, "embeddings")
    m = M.matrix_times(_MATRIX, F.slice(F.col("embedding").cast("array<double>"), 1, 4))
    return e.select("vec_id", m.alias("m")).select("vec_id", *[r6(f"m{i}", F.get("m", F.lit(i))) for i in range(2)])


@query()
def convex_hulls(spark, d):
    """The hull of the first two dimensions of each label's vectors, its corners and its area."""
    p = T.scan(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return G.convex_hull(p, "label").select("label", F.size("ring").cast("long").alias("corners"), r6("area", G.area(F.col("ring"))))


@query()
def forest_regression(spark, d):
    return M.regress(T.scan(spark, d, "embeddings").withColumn("y", F.get("embedding", F.lit(0)).cast("double")), "embedding", "y", numTrees=5, seed=1).select("vec_id", r6("prediction"))


@query()
def perceptron_classes(spark, d):
    return M.perceptron(T.scan(spark, d, "embeddings"), "embedding", "label").select("vec_id", F.col("prediction").cast("long").alias("prediction"))
