"""Queries that chain operators: clouds, training, classified maps, years, projections; importing this adds them to the
catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import bands as B
from gridlark.functions import values as V
from gridlark.functions.kernels import square
from gridlark.operators import classification as L
from gridlark.operators import collections as C
from gridlark.operators import geometry as G
from gridlark.operators import learning as M
from gridlark.operators import neighborhood as N
from gridlark.operators import projection as P
from gridlark.operators import speckle as S
from gridlark.plans.catalog import BANDS, COLL, GRID, KEYS, POS, K, _morph, _near, query, r6, uniform_sql
from gridlark.plans.spatial import _FIXED, CELLS, TRI, _inside, triangles
from gridlark.sources import tables as T

# ---------------------------------------------------------------- values


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 5 MONTH, '%Y-%m-%d') AS later, strftime(o_orderdate - INTERVAL 12 MONTH, '%Y-%m-%d') AS earlier, strftime(o_orderdate + INTERVAL 2 YEAR, '%Y/%m') AS years, strftime(o_orderdate - INTERVAL 3 DAY, '%d.%m.%Y') AS days FROM orders")
def date_advance_format(spark, d):
    o, at = T.scan(spark, d, "orders"), F.col("o_orderdate")
    return o.select("o_orderkey", V.date_text(V.advance(at, 5, "months")).alias("later"), V.date_text(V.advance(at, -12, "months")).alias("earlier"), V.date_text(V.advance(at, 2, "years"), "yyyy/MM").alias("years"), V.date_text(V.advance(at, -3, "days"), "dd.MM.yyyy").alias("days"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS no_geometry, CAST(n_regionkey AS VARCHAR) || ',' || r_name || ',' || n_name AS in_key_order FROM nation JOIN region ON n_regionkey = r_regionkey")
def feature_dictionary(spark, d):
    """Features of a geometry, null for every other nation, and a dictionary whose values come in the order of the keys."""
    n = T.scan(spark, d, "nation").join(T.scan(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    props = {"name": F.col("n_name"), "key": F.col("n_regionkey").cast("string"), "label": F.col("r_name")}
    f = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, V.feature(None, props)).otherwise(V.feature(G.rectangle(0, 0, 1, 1), props)).alias("f"))
    return f.select("n_nationkey", F.col("f.geometry").isNull().alias("no_geometry"), F.array_join(V.dictionary_values(F.col("f.properties")), ",").alias("in_key_order"))


@query("SELECT vec_id, '[[[' || CAST(vec_id AS VARCHAR) || '.0,0.0],[' || CAST(vec_id + 2 AS VARCHAR) || '.0,0.0],[' || CAST(vec_id + 2 AS VARCHAR) || '.0,1.5],[' || CAST(vec_id AS VARCHAR) || '.0,1.5],[' || CAST(vec_id AS VARCHAR) || '.0,0.0]]]' AS json FROM embeddings")
def geometry_json(spark, d):
    return T.scan(spark, d, "embeddings").select("vec_id", V.geometry_json(G.rectangle(F.col("vec_id"), 0, F.col("vec_id") + 2, 1.5)).alias("json"))


@query(f"WITH {GRID} SELECT y, x, 3.0::DOUBLE AS c0, -1.5::DOUBLE AS c1, CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS painted FROM grid")
def constant_image(spark, d):
    g = T.grid(spark, d)
    return g.select("y", "x", *B.constants(3, -1.5, names=["c0", "c1"]), B.where_band(F.lit(0.0), F.col("v") > 0, F.lit(1.0)).alias("painted"))


# ---------------------------------------------------------------- clouds

_REFLECT = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate, b3 * 4 AS blue, b4 * 5 AS green, b1 / 50 AS red, (b1 + 5) / 60 AS nir, b2 / 100000 AS swir1, b4 * 8 AS swir2, 290 + b3 * 100 AS thermal FROM (SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity AS b1, l_extendedprice AS b2, l_discount AS b3, l_tax AS b4 FROM lineitem))"
_TESTS = "least(1.0::DOUBLE, (blue - 0.1::DOUBLE) / (0.3::DOUBLE - 0.1::DOUBLE), (red + green + blue - 0.2::DOUBLE) / (0.8::DOUBLE - 0.2::DOUBLE), (nir + swir1 + swir2 - 0.3::DOUBLE) / (0.8::DOUBLE - 0.3::DOUBLE), (thermal - 300.0::DOUBLE) / (290.0::DOUBLE - 300.0::DOUBLE), ((green - swir1) / nullif(green + swir1, 0) - 0.8::DOUBLE) / (0.6::DOUBLE - 0.8::DOUBLE))"
_SCORED = f"{_REFLECT}, s AS (SELECT *, CASE WHEN green + swir1 <> 0 THEN CAST(floor(100 * greatest(0.0::DOUBLE, {_TESTS})) AS BIGINT) END AS cloud FROM b)"
REFLECT = ["blue", "green", "red", "nir", "swir1", "swir2", "thermal"]


def reflectance(spark, d):
    """lineitem as pixels of seven optical bands, with their cloud score."""
    b = T.bands(spark, d, "l_shipdate")
    c = F.col
    named = b.select(*KEYS, "l_returnflag", "l_shipdate", (c("b3") * 4).alias("blue"), (c("b4") * 5).alias("green"), (c("b1") / 50).alias("red"), ((c("b1") + 5) / 60).alias("nir"), (c("b2") / 100000).alias("swir1"), (c("b4") * 8).alias("swir2"), (c("b3") * 100 + 290).alias("thermal"))
    return named.withColumn("cloud", B.cloud_score(*[c(x) for x in REFLECT]))


@query(f"WITH {_SCORED} SELECT {K}, cloud, CASE WHEN cloud <= 20 THEN round(red, 6) END AS red, CASE WHEN cloud <= 20 THEN round(nir, 6) END AS nir FROM s")
def cloud_masked(spark, d):
    """Bands where the cloud score is 20 at most and no band is masked."""
    r = reflectance(spark, d)
    return r.select(*KEYS, "cloud", *[r6(n, c) for n, c in zip(REFLECT, B.clear(F.col("cloud"), 20, [F.col(x) for x in REFLECT]), strict=True) if n in ("red", "nir")])


@query(f"WITH {_SCORED}, l AS (SELECT *, min(cloud) OVER (PARTITION BY l_suppkey) AS least FROM s WHERE cloud IS NOT NULL) SELECT l_suppkey, round(quantile_cont(nir, 0.1), 6) AS p10, round(quantile_cont(nir, 0.5), 6) AS p50, round(quantile_cont(nir, 0.9), 6) AS p90 FROM l WHERE cloud <= least + 5 GROUP BY ALL")
def least_cloudy_composite(spark, d):
    """Percentiles over each pixel's least cloudy values."""
    got = C.least_cloudy_composite(reflectance(spark, d), ["l_suppkey"], "cloud", 5, [10, 50, 90], "nir")
    return got.select("l_suppkey", *[r6(f"p{p}") for p in (10, 50, 90)])


def _epoch_sql(names: dict[str, tuple[str, str]], years: tuple[int, int]) -> str:
    parts = [f"SELECT l_suppkey, {red} AS red, {nir} AS nir FROM s WHERE l_returnflag = '{flag}' AND cloud <= 60 AND year(l_shipdate) BETWEEN {years[0]} AND {years[1]} AND dayofyear(l_shipdate) BETWEEN 180 AND 365" for flag, (red, nir) in names.items()]
    return f"SELECT l_suppkey, CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, median(red) * 255))) AS BIGINT) AS red, CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, median(nir) * 255))) AS BIGINT) AS nir FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


_EARLY, _LATE = {"A": ("red", "nir"), "R": ("nir", "red")}, {"A": ("red", "nir"), "R": ("nir", "red"), "N": ("green", "swir1")}


@query(f"WITH {_SCORED}, e1 AS ({_epoch_sql(_EARLY, (1992, 1994))}), e2 AS ({_epoch_sql(_LATE, (1992, 2100))}) SELECT l_suppkey, e1.red AS red1, e1.nir AS nir1, e2.red AS red2, e2.nir AS nir2 FROM e1 JOIN e2 USING (l_suppkey)")
def multi_sensor_change(spark, d):
    """Two epochs from sensors whose bands have places of their own: days of a season, clouds masked, medians as bytes, where
    both epochs have data."""
    r = reflectance(spark, d).where((F.col("cloud") <= 60) & F.dayofyear("l_shipdate").between(180, 365))

    def epoch(sensors: dict[str, tuple[str, str]], years: tuple[int, int], i: int):
        parts = [r.where((F.col("l_returnflag") == s) & F.year("l_shipdate").between(*years)).select("l_suppkey", F.col(red).alias("red"), F.col(nir).alias("nir")) for s, (red, nir) in sensors.items()]
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        byte = lambda c: F.floor(B.clamp(F.median(c) * 255, 0.0, 255.0)).alias(f"{c}{i}")
        return merged.groupBy("l_suppkey").agg(byte("red"), byte("nir"))

    return epoch(_EARLY, (1992, 1994), 1).join(epoch(_LATE, (1992, 2100), 2), "l_suppkey")


# ---------------------------------------------------------------- masks, gaps, projections, patches, series

_DISK = "generate_series(-5, 5) p(dy), generate_series(-5, 5) r(dx) WHERE dx * dx + dy * dy <= 25"


@query(f"WITH {GRID}, q AS (SELECT y, x, CAST(floor(v * 4) AS BIGINT) AS v FROM grid), a AS (SELECT y + dy AS y, x + dx AS x, q.v FROM q, {_DISK}), c AS (SELECT y, x, v, count(*) AS c FROM a GROUP BY ALL), e AS (SELECT y, x, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c GROUP BY ALL), low AS (SELECT y, x FROM e JOIN grid USING (y, x) WHERE h < 0.7), bad AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM low, {_DISK}) SELECT grid.y, grid.x, CASE WHEN bad.y IS NULL THEN round(v, 6) END AS v FROM grid LEFT JOIN bad ON bad.y = grid.y AND bad.x = grid.x")
def low_entropy_mask(spark, d):
    return N.mask_low_entropy(T.grid(spark, d), 5, 4, 0.7, 5).select("y", "x", r6("v"))


_GAPS = "s AS (SELECT y, x, CASE WHEN (y * 7 + x) % 11 <> 0 THEN 2 * v + 1 END AS v FROM grid), f AS (SELECT y, x, CASE WHEN (y + x * 3) % 13 <> 0 THEN v END AS v FROM grid), j AS (SELECT s.y, s.x, s.v AS s, f.v AS f FROM s JOIN f USING (y, x))"


@query(f"WITH {GRID}, {_GAPS}, m AS (SELECT CAST(floor(y / 5) AS BIGINT) AS y, CAST(floor(x / 5) AS BIGINT) AS x, median(CASE WHEN s IS NOT NULL THEN f END) AS cf, median(CASE WHEN f IS NOT NULL THEN s END) AS cs, median(f) AS f, median(s) AS s, count(CASE WHEN s IS NOT NULL AND f IS NOT NULL THEN 1 END) AS m FROM j GROUP BY ALL), "
    "n AS (SELECT a.y AS cy, a.x AS cx, sum(CASE WHEN b.cf IS NOT NULL AND b.cs IS NOT NULL THEN b.m END) AS n, regr_slope(b.cs, b.cf) AS slope, regr_intercept(b.cs, b.cf) AS icept, avg(b.s) AS ms, avg(b.f) AS mf, stddev_pop(b.s) / stddev_pop(b.f) AS ratio FROM (SELECT m.y, m.x, m.y + dy AS ny, m.x + dx AS nx FROM m, generate_series(-2, 2) p(dy), generate_series(-2, 2) q(dx)) a JOIN m b ON b.y = ny AND b.x = nx GROUP BY a.y, a.x) "
    "SELECT y, x, round(coalesce(s, CASE WHEN n >= 144 THEN CASE WHEN slope BETWEEN 1/3.0::DOUBLE AND 3 THEN f * slope + icept WHEN ratio BETWEEN 1/3.0::DOUBLE AND 3 THEN f * ratio + ms - mf * ratio ELSE f + ms - mf END END), 6) AS v FROM j LEFT JOIN n ON cy = y // 5 AND cx = x // 5")
def gap_fill_coarse(spark, d):
    g = T.grid(spark, d)
    src = g.withColumn("v", F.when((F.col("y") * 7 + F.col("x")) % 11 != 0, 2 * F.col("v") + 1))
    fill = g.withColumn("v", F.when((F.col("y") + F.col("x") * 3) % 13 != 0, F.col("v")))
    return S.gap_fill_coarse(src, fill).select("y", "x", r6("v"))


_FROM, _TO = P.Projection("EPSG:32648", 30.0, 500_000.0, -30.0, 1_200_000.0), P.Projection("EPSG:32648", 45.0, 500_010.0, -20.0, 1_200_015.0)


@query(f"WITH {GRID}, t AS (SELECT y, x, (x + 0.5::DOUBLE) * 45.0::DOUBLE + 500010.0::DOUBLE AS east, (y + 0.5::DOUBLE) * -20.0::DOUBLE + 1200015.0::DOUBLE AS north FROM (SELECT unnest(generate_series(-10, (SELECT 2 * max(y) + 10 FROM grid))) AS y), (SELECT unnest(generate_series(-10, 60)) AS x)) SELECT t.y, t.x, round(g.v, 6) AS v FROM t JOIN grid g ON g.y = CAST(floor((north - 1200000.0::DOUBLE) / -30.0::DOUBLE) AS BIGINT) AND g.x = CAST(floor((east - 500000.0::DOUBLE) / 30.0::DOUBLE) AS BIGINT)")
def reproject_nearest(spark, d):
    return P.reproject(T.grid(spark, d), _FROM, _TO).select("y", "x", r6("v"))


@query(f"WITH {COLL} SELECT event_type, CAST(day AS VARCHAR) AS day, 'EPSG:32648' AS crs, 150.0::DOUBLE AS scale, 500000.0::DOUBLE AS west, -150.0::DOUBLE AS height FROM coll GROUP BY ALL")
def scene_projection(spark, d):
    """Each scene's system and transform at five times its cells."""
    s = P.with_projection(T.collection(spark, d).select("event_type", F.col("day").cast("string").alias("day")).distinct(), _FROM.scaled(5))
    return s.select("event_type", "day", F.col("projection.crs").alias("crs"), F.col("projection.scale").alias("scale"), F.get("projection.transform", F.lit(2)).alias("west"), F.get("projection.transform", F.lit(4)).alias("height"))


@query(f"WITH {GRID}, u AS (SELECT y, x, v, {uniform_sql(chr(39).join(['y || ', ':', ' || x']), 3)} AS random FROM grid), p AS (SELECT y, x, CAST(floor(v * 4) AS BIGINT) AS label FROM u ORDER BY u.random, y, x LIMIT 300), o AS (SELECT dy, dx FROM generate_series(-32, 32) a(dy), generate_series(-32, 32) b(dx)) SELECT p.y, p.x, label, CAST(count(*) AS BIGINT) AS n, CAST(sum((dy * 67 + dx) * CAST(round(coalesce(g.v, -9.0::DOUBLE) * 1000) AS BIGINT)) AS BIGINT) AS code FROM p CROSS JOIN o LEFT JOIN grid g ON g.y = p.y + dy AND g.x = p.x + dx GROUP BY ALL")
def labelled_patches(spark, d):
    """Patches of 65 by 65 cells and the class at random points; the code depends on every value and its place."""
    g = T.grid(spark, d)
    points = G.sample_pixels(g, 300, seed=3).select("y", "x", F.floor(F.col("v") * 4).alias("label"))
    p = N.patches_at(g, points, 32, fill=-9.0)
    each = F.transform("patch", lambda v, i: ((F.floor(i / 65) - 32).cast("long") * 67 + i % 65 - 32) * F.round(v * 1000).cast("long"))
    return p.select("y", "x", "label", F.size("patch").cast("long").alias("n"), F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x).alias("code"))


# Weights of the first derivative of a cubic fit over 7 points, times 252.
_CUBIC_SLOPE = [22, -67, -58, 0, 58, 67, -22]


@query("WITH s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS t, avg(value) AS v FROM events GROUP BY ALL), n AS (SELECT t, v, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n, first_value(v) OVER (ORDER BY t) AS f, last_value(v) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM s), "
    "e AS (SELECT t, i, v FROM n UNION ALL SELECT NULL, 2 - i, f - abs(v - f) FROM n WHERE i BETWEEN 2 AND 4 UNION ALL SELECT NULL, 2 * n - i, l + abs(v - l) FROM n WHERE i BETWEEN n - 3 AND n - 1), "
    "w(k, c) AS (VALUES " + ", ".join(f"({i - 3}, {c})" for i, c in enumerate(_CUBIC_SLOPE)) + ") SELECT a.t, round(sum(b.v * c) / 252, 6) AS smooth FROM e a, w JOIN e b ON b.i = a.i + k WHERE a.t IS NOT NULL GROUP BY a.t")
def savitzky_golay_slope(spark, d):
    """The slope of a series by cubic fits over 7 points."""
    s = T.scan(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("t")).agg(F.avg("value").alias("v")).withColumn("series", F.lit("all"))
    return C.savitzky_golay(s, 7, 3, 1).select("t", r6("smooth"))


@query("WITH m AS (SELECT row_number() OVER (ORDER BY i) AS k, avg(e) AS endmember FROM (SELECT unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS e, label FROM embeddings) WHERE label = 1 GROUP BY i) SELECT vec_id, CAST(k AS BIGINT) AS band, round(CAST(embedding[k + 4] AS DOUBLE), 6) AS v, round(endmember, 6) AS endmember FROM embeddings, m WHERE vec_id IN (1, 3, 5) AND k + 4 <= len(embedding)")
def spectral_profiles(spark, d):
    """Three places' bands without the four that lead, beside the mean spectrum of a class."""
    e = T.scan(spark, d, "embeddings")
    mean = e.where("label = 1").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e")).groupBy((F.col("i") + 1).cast("long").alias("band")).agg(F.avg("e").alias("endmember"))
    rows = e.where(F.col("vec_id").isin(1, 3, 5)).select("vec_id", F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 5, F.size("embedding"))).alias("i", "v"))
    return rows.withColumn("band", (F.col("i") + 1).cast("long")).join(mean, "band").select("vec_id", "band", r6("v"), r6("endmember"))


# ---------------------------------------------------------------- vectors


@query(f"WITH {GRID}, {CELLS}, s AS (SELECT vec_id, max(v) AS score, CAST(vec_id % 3 = 0 AS INTEGER) AS is_target FROM cells JOIN grid USING (y, x) GROUP BY vec_id) SELECT vec_id, round(score, 6) AS score, is_target FROM s")
def reference_samples(spark, d):
    """The input of a ROC curve: the largest value over each reference polygon, targets and others in one table."""
    g, t = T.grid(spark, d), triangles(spark, d)
    part = lambda cond, tag: G.reduce_regions(g, t.where(cond), "vec_id", {"score": F.max("v"), "n": F.count("v")}).where("n > 0").select("vec_id", r6("score"), F.lit(tag).alias("is_target"))
    return part("vec_id % 3 = 0", 1).unionByName(part("vec_id % 3 <> 0", 0))


_POINT = "p AS (SELECT vec_id AS id, 32 + 30 * CAST(embedding[7] AS DOUBLE) - 0.5::DOUBLE AS x, vec_id + 30 * CAST(embedding[8] AS DOUBLE) - 0.5::DOUBLE AS y FROM embeddings)"


@query(f"WITH {TRI}, {_POINT} SELECT DISTINCT p.id FROM p JOIN tri ON {_inside(lambda c, i: f'tri.{c}{i}')}")
def points_in_polygons(spark, d):
    """Points that lie in any polygon, by the cells that both touch."""
    e = T.scan(spark, d, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 30
    p = e.select(F.col("vec_id").alias("id"), (at(6) + 32).alias("px"), (at(7) + F.col("vec_id")).alias("py"))
    return G.within(p, triangles(spark, d), "px", "py").select("id")


@query(f"WITH {GRID}, {CELLS}, road AS (SELECT DISTINCT y, x FROM cells WHERE vec_id % 5 = 0), m AS (SELECT g.y, g.x, CASE WHEN r.y IS NOT NULL THEN NULL WHEN {_inside(lambda c, i: str(_FIXED[i]['xy'.index(c)]) + '.0::DOUBLE').replace('y + 0.5', 'g.y + 0.5').replace('x + 0.5', 'g.x + 0.5')} THEN g.v END AS v FROM grid g LEFT JOIN road r ON r.y = g.y AND r.x = g.x) SELECT y, x, round(v, 6) AS v FROM m WHERE v IS NOT NULL")
def mask_by_vectors(spark, d):
    """What is left of a grid in a polygon once other polygons are burnt out."""
    return _masked(spark, d).select("y", "x", r6("v"))


def _masked(spark, d):
    road = G.cells_in(triangles(spark, d).where("vec_id % 5 = 0")).select("y", "x").distinct()
    return G.clip(T.grid(spark, d), G.ring(_FIXED)).join(road, ["y", "x"], "left_anti").where("v IS NOT NULL")


@query()
def masked_kmeans(spark, d):
    """Seven clusters of the masked grid's cells, learnt from 5,000 sampled ones."""
    cells = _masked(spark, d).withColumn("bands", F.array("v", F.col("v") * F.col("v")))
    train = G.sample_pixels(cells, 5000, seed=1)
    return M.kmeans_by(train, cells, "bands", 7).select("y", "x", F.col("cluster").cast("long").alias("cluster"))


# ---------------------------------------------------------------- classified maps

PAIRS = [f"nd_{a}_{b}" for i, a in enumerate(("b1", "b2", "b3", "b4")) for b in ("b1", "b2", "b3", "b4")[i + 1 :]]


def _ndsv(spark, d):
    b = T.bands(spark, d, "l_linestatus").withColumn("key", F.concat_ws(":", *KEYS))
    nd = B.pairwise_differences(["b1", "b2", "b3", "b4"])
    return b.select("*", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in nd.items()], (F.col("b1") > 25).cast("int").alias("number"))


@query()
def classification_chain(spark, d):
    """Pairwise band differences, three seeded training samples, three classifiers, the median of all their maps, water and
    vegetation set to 0."""
    image = _ndsv(spark, d)
    trainings = [L.sample_training(image, "key", "number", 0.05, seed) for seed in (1, 2, 3)]
    got = L.multi_classify(image, trainings, PAIRS, "number", ("cart", "logistic", "random_forest"), "v", water=F.col("b4") > 0.07)
    ndvi = B.normalized_difference(F.col("b2"), F.col("b1") * 2000)
    return got.select(*KEYS, "number", L.zero_where(F.col("v"), ndvi > 0.5, ndvi <= -0.5).alias("v"))


@query()
def classify_zonal_area(spark, d):
    """A support-vector map, cells without data set to -9999, and the area of its class by zone."""
    image = _ndsv(spark, d)
    got = L.classify(image, L.sample_training(image, "key", "number", 0.2, 1), PAIRS, "number", "svm", "class")
    filled = B.unmask(F.when(F.col("b3") > 0.01, F.col("class")), -9999)
    return got.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum((filled == -9999).cast("int")).alias("no_data"), r6("area", F.sum(F.when(filled != -9999, filled) * 900.0) / 10000))


_VOTES = "m AS (SELECT y, x, greatest(0, least(1, CASE WHEN w = 0.5 THEN 1 ELSE CAST(floor(w) AS INT) END)) AS v FROM (SELECT y, x, CASE WHEN y % 17 = 0 THEN 0.0 ELSE list_sort([CAST(v > 0 AS INT), CAST(v > 0.1 AS INT), CAST(v > -0.1 AS INT)])[2] END AS w FROM grid))"


@query(f"WITH {GRID}, {_VOTES}, a AS ({_morph('m', 'max')}), b AS ({_morph('a', 'min')}), c AS ({_morph('b', 'min')}), e AS ({_morph('c', 'max')}), f AS (SELECT m.y, m.x, CAST(m.v <> 0 AND e.v <> 0 AS INT) AS v FROM m JOIN e USING (y, x)), g AS ({_morph('f', 'max')}), h AS ({_morph('g', 'min')}) SELECT y, x, v FROM h")
def voted_map(spark, d):
    """The median of three maps, a mask set to 0, and the morphological adjustment."""
    g = T.grid(spark, d)
    maps = g.select("y", "x", *[(F.col("v") > t).cast("int").alias(f"m{i}") for i, t in enumerate((0.0, 0.1, -0.1))])
    v = maps.select("y", "x", L.zero_where(L.vote(["m0", "m1", "m2"]), F.col("y") % 17 == 0).alias("v"))
    return L.clean_map(v, square(1), square(1)).select("y", "x", "v")


_YEARS = {2014: -0.02, 2012: 0.0, 2011: 0.03, 2008: 0.08}


def _year_maps(spark, d):
    """Maps of years that are not all there."""
    g = T.grid(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.lit(t).alias("t")) for y, t in _YEARS.items()]))
    return g.withColumn("k", each).select(F.col("k.year").alias("year"), "y", "x", (F.col("v") > F.col("k.t")).cast("int").alias("v"))


_MAPS = "maps AS (SELECT year, y, x, CAST(v > t AS INT) AS v FROM grid, (VALUES " + ", ".join(f"({y}, {t}::DOUBLE)" for y, t in _YEARS.items()) + ") k(year, t))"


@query(f"WITH {GRID}, {_MAPS}, n AS (SELECT y, x, v FROM maps WHERE year = 2014), a AS ({_morph('n', 'max')}), c AS ({_morph('a', 'min')}), u AS (SELECT * FROM maps WHERE year IN (2014, 2012, 2008)), o AS (SELECT y, x, max(v) AS o FROM u GROUP BY ALL) SELECT year, u.y, u.x, CAST(u.v <> 0 AND o <> 0 AND c.v <> 0 AS INTEGER) AS v FROM u JOIN o USING (y, x) JOIN c USING (y, x)")
def multi_year_correction(spark, d):
    """Steps of two years back from the newest map, empty years giving way to the one before; a cell stays only where the
    closed newest map has it."""
    maps = _year_maps(spark, d)
    years = L.available_years(maps, 2014, 2, 7)
    return L.correct_years(maps, years, square(1)).select("year", "y", "x", "v")


@query(f"WITH {GRID}, {_MAPS} SELECT a.year, a.y, a.x, CAST(min(b.v) AS INTEGER) AS v FROM maps a JOIN maps b ON b.y = a.y AND b.x = a.x AND b.year >= a.year GROUP BY ALL")
def multi_year_and(spark, d):
    return L.running_and(_year_maps(spark, d), list(_YEARS)).select("year", "y", "x", "v")


@query(f"WITH {POS} SELECT y, x, CASE WHEN v > 1.3 AND y BETWEEN 20 AND 200 THEN 0.0::DOUBLE ELSE round(v, 6) END AS v FROM pos")
def dem_mask_in_area(spark, d):
    """0 where the elevation is over a threshold, within a sub-area only."""
    g = T.grid(spark, d, positive=True)
    area = G.contains(G.rectangle(-1, 20, 10_000, 201), F.col("x") + 0.5, F.col("y") + 0.5)
    return g.select("y", "x", r6("v", L.zero_where(F.col("v"), (F.col("v") > 1.3) & area)))
