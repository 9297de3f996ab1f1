"""All queries of the library proper, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import bands as B
from gridlark.functions.kernels import circle, fixed, rotate, square
from gridlark.operators import collections as C
from gridlark.operators import evaluation as E
from gridlark.operators import learning as M
from gridlark.operators import neighborhood as N
from gridlark.operators import speckle as S
from gridlark.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

GRID = "grid AS (SELECT vec_id AS y, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
POS = f"{GRID}, pos AS (SELECT y, x, abs(v) + 1 AS v FROM grid)"
COLL = "coll AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id, avg(value) AS v, min(ts) AS ts FROM events GROUP BY ALL)"
BANDS = "bands AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity AS b1, l_extendedprice AS b2, l_discount AS b3, l_tax AS b4 FROM lineitem)"
SCORES = "scores AS (SELECT doc_id, least(n_chars / 3000.0::DOUBLE, 1.0) AS score, quality AS is_target FROM documents JOIN labels USING (doc_id))"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)


def r6(name: str, c=None):
    return F.round(F.col(name) if c is None else c, 6).alias(name)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def uniform_sql(key: str, seed: int) -> str:
    """SQL for the number that ``evaluation.uniform`` gives a key."""
    return f"(('0x' || substr(md5('{seed}:' || coalesce(CAST({key} AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


day = lambda: F.col("day").cast("string").alias("day")


# ---------------------------------------------------------------- scans, filters, metadata


@query(f"WITH {COLL} SELECT CAST(day AS VARCHAR) AS day, event_type, user_id, round(v, 6) AS v FROM coll WHERE dayofyear(ts) BETWEEN 5 AND 20 AND event_type IN ('click', 'view')")
def scene_filter(spark, d):
    c = T.collection(spark, d)
    return c.where(F.dayofyear("ts").between(5, 20) & F.col("event_type").isin("click", "view")).select(day(), "event_type", "user_id", r6("v"))


@query(f"WITH {COLL} SELECT CAST(day AS VARCHAR) || '/' || event_type AS image, count(*) AS n FROM coll GROUP BY ALL ORDER BY n DESC, image LIMIT 50")
def scene_ids_topk(spark, d):
    c = T.collection(spark, d).groupBy(F.concat_ws("/", F.col("day").cast("string"), "event_type").alias("image")).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "image").limit(50)


@query(f"WITH {COLL}, p AS (SELECT day, user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM coll GROUP BY ALL) SELECT CAST(day AS VARCHAR) AS day, user_id, CAST(len(kinds) AS BIGINT) AS n_kinds, array_to_string(kinds, ',') AS kinds FROM p WHERE list_contains(kinds, 'purchase')")
def list_contains_filter(spark, d):
    p = T.collection(spark, d).groupBy("day", "user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    return p.where(F.array_contains("kinds", "purchase")).select(day(), "user_id", F.size("kinds").cast("long").alias("n_kinds"), F.array_join("kinds", ",").alias("kinds"))


@query(f"WITH {COLL} SELECT event_type, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(DISTINCT day) AS images, count(*) AS pixels FROM coll GROUP BY ALL")
def scene_metadata(spark, d):
    return T.collection(spark, d).groupBy("event_type").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.countDistinct("day").alias("images"), F.count("*").alias("pixels"))


@query(f"WITH {COLL}, m AS (SELECT date_trunc('month', day) AS mon, event_type, min(day) AS day FROM coll GROUP BY ALL) SELECT CAST(CAST(m.day AS DATE) AS VARCHAR) AS day, event_type, user_id, round(v, 6) AS v FROM m JOIN coll USING (day, event_type)")
def first_image_of_month(spark, d):
    c = T.collection(spark, d)
    m = c.groupBy(F.trunc("day", "month").alias("mon"), "event_type").agg(F.min("day").alias("day"))
    return c.join(m.select("day", "event_type"), ["day", "event_type"]).select(day(), "event_type", "user_id", r6("v"))


# ---------------------------------------------------------------- bands


@query(f"WITH {BANDS} SELECT {K}, round((b1 - b4) / nullif(b1 + b4, 0), 6) AS nd FROM bands")
def band_math_nd(spark, d):
    return T.bands(spark, d).select(*KEYS, r6("nd", B.normalized_difference(F.col("b1"), F.col("b4"))))


@query(f"WITH {BANDS} SELECT {K}, " + ", ".join(f"round((b{j} - b{i}) / nullif(b{j} + b{i}, 0), 6) AS nd_b{i}_b{j}" for i in range(1, 5) for j in range(i + 1, 5)) + " FROM bands")
def ndsv_all_pairs(spark, d):
    return T.bands(spark, d).select(*KEYS, *[r6(n, c) for n, c in B.pairwise_differences(["b1", "b2", "b3", "b4"]).items()])


@query(f"WITH {BANDS} SELECT {K}, round(10 * log10(b1), 6) AS db, round(pow(10.0::DOUBLE, 10 * log10(b1) / 10), 6) AS back FROM bands")
def db_roundtrip(spark, d):
    return T.bands(spark, d).select(*KEYS, r6("db", B.to_db(F.col("b1"))), r6("back", B.to_natural(B.to_db(F.col("b1")))))


@query(f"WITH {BANDS} SELECT {K}, round(10 * log10(b1) - 10 * log10(cos(radians(30 + b3 * 100))), 6) AS gamma0 FROM bands")
def gamma0(spark, d):
    return T.bands(spark, d).select(*KEYS, r6("gamma0", B.gamma_nought(B.to_db(F.col("b1")), 30 + F.col("b3") * 100)))


@query(f"WITH {BANDS} SELECT {K}, round((b2 - b3) / nullif(b4, 0), 6) AS calibrated FROM bands")
def calibration(spark, d):
    return T.bands(spark, d).select(*KEYS, r6("calibrated", B.calibrated(F.col("b2"), F.col("b3"), F.col("b4"))))


@query(f"WITH {BANDS}, m AS (SELECT *, CASE WHEN b3 >= 0.05 THEN b1 END AS masked FROM bands) SELECT {K}, masked, coalesce(masked, -1.0) AS unmasked, CASE WHEN b4 > 0.04 THEN 0.0 ELSE b1 END AS replaced, greatest(10.0, least(40.0, b1)) AS clamped, CAST(CASE WHEN masked IS NOT NULL THEN (masked <> 0 AND b4 <> 0)::INT END AS INTEGER) AS both FROM m")
def mask_unmask_where_clamp(spark, d):
    m = T.bands(spark, d).withColumn("masked", B.update_mask(F.col("b1"), (F.col("b3") >= 0.05).cast("int")))
    return m.select(*KEYS, "masked", B.unmask(F.col("masked"), -1.0).alias("unmasked"), B.where_band(F.col("b1"), F.col("b4") > 0.04, F.lit(0.0)).alias("replaced"), B.clamp(F.col("b1"), 10.0, 40.0).alias("clamped"), B.strict_and(F.col("masked"), F.col("b4")).alias("both"))


@query(f"WITH {BANDS}, m AS (SELECT 'A' AS sensor, b1 AS red, b2 AS nir FROM bands WHERE l_returnflag = 'A' UNION ALL SELECT 'N', b2, b1 FROM bands WHERE l_returnflag = 'N') SELECT sensor, count(*) AS n, round(sum(red), 2) AS red, round(sum(nir), 2) AS nir FROM m GROUP BY ALL")
def merge_sensors(spark, d):
    b = T.bands(spark, d)
    pick = lambda s, red, nir: b.where(F.col("l_returnflag") == s).select(F.lit(s).alias("sensor"), F.col(red).alias("red"), F.col(nir).alias("nir"))
    return pick("A", "b1", "b2").unionByName(pick("N", "b2", "b1")).groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.sum("red"), 2).alias("red"), F.round(F.sum("nir"), 2).alias("nir"))


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 ELSE -1 END AS INTEGER) AS urban FROM orders")
def recode_lookup(spark, d):
    codes = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 1), ("3-MEDIUM", 0)], "o_orderpriority string, urban int")
    return T.scan(spark, d, "orders").join(F.broadcast(codes), "o_orderpriority", "left").select("o_orderkey", F.coalesce("urban", F.lit(-1)).alias("urban"))


@query(f"WITH {BANDS} SELECT {K}, " + ", ".join(f"CAST(floor(255 * pow(greatest(0.0, least(1.0, (b{i} - {lo}) / ({hi} - {lo}))), 1.0::DOUBLE / 1.3::DOUBLE)) AS BIGINT) AS s{i}" for i, lo, hi in ((1, "1.0::DOUBLE", "50.0::DOUBLE"), (2, "900.0::DOUBLE", "100000.0::DOUBLE"))) + " FROM bands")
def stretch_visual(spark, d):
    return T.bands(spark, d).select(*KEYS, B.stretch(F.col("b1"), 1.0, 50.0, 1.3).alias("s1"), B.stretch(F.col("b2"), 900.0, 100000.0, 1.3).alias("s2"))


# ---------------------------------------------------------------- composites


@query(f"WITH {COLL} SELECT event_type, user_id, round(avg(v), 9) AS mean, round(median(v), 9) AS median, count(v) AS n, round(min(v), 9) AS low, round(max(v), 9) AS high FROM coll GROUP BY ALL")
def composite_mean_median_count(spark, d):
    c = C.reduce_collection(T.collection(spark, d), ["event_type", "user_id"])
    return c.select("event_type", "user_id", *[F.round(k, 9).alias(k) for k in ("mean", "median", "low", "high")], "n")


@query(f"WITH {COLL} SELECT user_id, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in (10, 50, 90)) + " FROM coll GROUP BY ALL")
def percentile_composite(spark, d):
    return C.percentile_composite(T.collection(spark, d), ["user_id"], [10, 50, 90]).select("user_id", *[r6(f"p{p}") for p in (10, 50, 90)])


@query("SELECT event_type, user_id, arg_max(event_id, row(value, event_id)) AS event_id, round(max(value), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL")
def quality_mosaic(spark, d):
    m = C.quality_mosaic(T.scan(spark, d, "events"), ["event_type", "user_id"], ["value", "event_id"], ["event_id", "value"])
    return m.select("event_type", "user_id", "event_id", r6("value"))


@query("SELECT event_type, user_id, round(arg_max(value, row(ts, event_id)), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL")
def latest_mosaic(spark, d):
    return C.latest_mosaic(T.scan(spark, d, "events"), ["event_type", "user_id"], ["ts", "event_id"], "value").select("event_type", "user_id", r6("value"))


@query("SELECT o_orderpriority, CAST(quarter(o_orderdate) AS BIGINT) AS season, round(median(o_totalprice), 6) AS median, count(*) AS n FROM orders GROUP BY ALL")
def seasonal_median(spark, d):
    return T.scan(spark, d, "orders").groupBy("o_orderpriority", F.quarter("o_orderdate").cast("long").alias("season")).agg(r6("median", F.median("o_totalprice")), F.count("*").alias("n"))


@query(f"WITH {COLL}, p AS (SELECT CAST(dayofyear(ts) AS BIGINT) AS doy, user_id % 5 AS k, user_id, avg(v) AS v FROM coll GROUP BY ALL) SELECT doy, r_name AS region, round(avg(v), 9) AS mean, count(*) AS pixels FROM p JOIN region ON k = r_regionkey GROUP BY ALL")
def doy_series_by_region(spark, d):
    s = C.doy_series(T.collection(spark, d), F.col("user_id") % 5)
    return s.join(T.scan(spark, d, "region"), F.col("region") == F.col("r_regionkey")).select("doy", F.col("r_name").alias("region"), F.round("mean", 9).alias("mean"), "pixels")


@query(f"WITH {COLL}, p AS (SELECT CAST(dayofyear(ts) AS BIGINT) AS doy, user_id % 5 AS k, user_id, avg(v) AS v FROM coll GROUP BY ALL) SELECT doy, " + ", ".join(f"round(avg(CASE WHEN k = {k} THEN v END), 9) AS region_{k}" for k in range(5)) + " FROM p GROUP BY doy")
def doy_series_pivot(spark, d):
    s = C.doy_series(T.collection(spark, d), F.col("user_id") % 5)
    return s.groupBy("doy").pivot("region", list(range(5))).agg(F.round(F.first("mean"), 9)).select("doy", *[F.col(str(k)).alias(f"region_{k}") for k in range(5)])


@query("SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std, round(min(c_acctbal), 6) AS low, round(max(c_acctbal), 6) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def zonal_stats(spark, d):
    j = T.scan(spark, d, "customer").join(T.scan(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), r6("mean", F.avg("c_acctbal")), r6("std", F.stddev_pop("c_acctbal")), r6("low", F.min("c_acctbal")), r6("high", F.max("c_acctbal")))


@query("SELECT n_name, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY total, n_name LIMIT 1")
def zonal_top1(spark, d):
    j = T.scan(spark, d, "customer").join(T.scan(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 4).alias("total")).orderBy("total", "n_name").limit(1)


@query("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def containment_tag(spark, d):
    inside = T.scan(spark, d, "nation").join(T.scan(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T.scan(spark, d, "customer").join(inside, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")


@query("WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr, max(CAST(o_totalprice > 250000 AS INT)) AS hit FROM orders GROUP BY ALL), f AS (SELECT min(yr) AS first FROM y) SELECT o_custkey, CAST(max(hit) AS INTEGER) AS any_year, CAST(min(hit) AS INTEGER) AS all_years, CAST(max(CASE WHEN yr = first THEN hit ELSE 0 END) AS INTEGER) AS first_year FROM y, f GROUP BY ALL")
def year_logic_or_and(spark, d):
    y = T.scan(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.max((F.col("o_totalprice") > 250000).cast("int")).alias("hit"))
    j = y.crossJoin(F.broadcast(y.agg(F.min("yr").alias("first"))))  # one row
    return j.groupBy("o_custkey").agg(F.max("hit").alias("any_year"), F.min("hit").alias("all_years"), F.max(F.when(F.col("yr") == F.col("first"), F.col("hit")).otherwise(0)).alias("first_year"))


# ---------------------------------------------------------------- neighbourhoods

_BOX = "SELECT a.y, a.x, a.v, count(b.v) AS n, avg(b.v) AS mean, var_pop(b.v) AS var FROM {t} a JOIN {t} b ON b.y BETWEEN a.y - {r} AND a.y + {r} AND b.x BETWEEN a.x - {r} AND a.x + {r} GROUP BY ALL"


def _near(t: str, r: int, agg: str, cond: str = "") -> str:
    """Aggregate over a square window, by an equi-join on offsets."""
    o = f"(SELECT dy, dx FROM generate_series(-{r}, {r}) p(dy), generate_series(-{r}, {r}) q(dx) {cond})"
    return f"SELECT a.y, a.x, a.v, {agg} FROM (SELECT g.y, g.x, g.v, g.y + dy AS ny, g.x + dx AS nx FROM {t} g, {o} o) a JOIN {t} b ON b.y = ny AND b.x = nx GROUP BY ALL"


@query(f"WITH {GRID}, s AS ({_near('grid', 1, 'count(b.v) AS n, avg(b.v) AS mean, var_pop(b.v) AS var')}) SELECT y, x, n, round(mean, 6) AS mean, round(var, 6) AS var FROM s")
def box3_mean_var(spark, d):
    return N.box_stats(T.grid(spark, d), 1, holes=False).select("y", "x", "n", r6("mean"), r6("var"))


@query(f"WITH {GRID}, s AS ({_near('grid', 3, 'avg(b.v) AS mean')}) SELECT y, x, round(mean, 6) AS mean FROM s")
def boxcar(spark, d):
    return N.box_stats(T.grid(spark, d), 3, holes=False).select("y", "x", r6("mean"))


_CU = "(1 / sqrt(5.0::DOUBLE))"


@query(f"""WITH {POS}, s AS ({_near('pos', 1, 'avg(b.v) AS m, var_pop(b.v) AS s2')}), c AS (SELECT *, sqrt(s2) / m AS ci FROM s),
a AS (SELECT *, (1 + {_CU} * {_CU}) / nullif(ci * ci - {_CU} * {_CU}, 0) AS a FROM c), b AS (SELECT *, a - 6 AS b FROM a), e AS (SELECT *, m * m * b * b + 20 * a * m * v AS d FROM b)
SELECT y, x, round(CASE WHEN ci <= {_CU} THEN m WHEN ci >= sqrt(2.0::DOUBLE) * {_CU} THEN v WHEN d >= 0 THEN (b * m + sqrt(CASE WHEN d >= 0 THEN d END)) / (2 * a) END, 6) AS v FROM e""")
def gamma_map(spark, d):
    return S.gamma_map(T.grid(spark, d, positive=True), holes=False).select("y", "x", r6("v"))


_PLACES = "p(i, dx, dy) AS (VALUES " + ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate((dx, dy) for dy in (-2, 0, 2) for dx in (-2, 0, 2))) + ")"
_OPPOSITE = [(1, 7), (6, 2), (3, 5), (0, 8)]
_CODE = " + ".join(f"CASE WHEN g{i} = top THEN CASE WHEN m{a} - m4 > m4 - m{b} THEN {i + 1} ELSE {i + 5} END ELSE 0 END" for i, (a, b) in enumerate(_OPPOSITE))
# The half windows of the eight directions.
_SIDE = "CASE code WHEN 1 THEN dy >= 0 WHEN 2 THEN dx <= dy WHEN 3 THEN dx <= 0 WHEN 4 THEN dx + dy <= 0 WHEN 5 THEN dy <= 0 WHEN 6 THEN dx >= dy WHEN 7 THEN dx >= 0 WHEN 8 THEN dx + dy >= 0 ELSE false END"


@query(f"""WITH {POS}, {_PLACES}, s AS ({_near('pos', 1, 'avg(b.v) AS mean, var_pop(b.v) AS var')}),
n AS (SELECT a.y, a.x, {", ".join(f"max(CASE WHEN i = {i} THEN s.mean END) AS m{i}" for i in range(9))}, list_avg(list_slice(list_sort(list(s.var / (s.mean * s.mean))), 1, 5)) AS sigma FROM pos a CROSS JOIN p JOIN s ON s.y = a.y + dy AND s.x = a.x + dx GROUP BY a.y, a.x),
g AS (SELECT *, {", ".join(f"abs(m{a} - m{b}) AS g{i}" for i, (a, b) in enumerate(_OPPOSITE))} FROM n), t AS (SELECT *, greatest(g0, g1, g2, g3) AS top FROM g), c AS (SELECT y, x, sigma, {_CODE} AS code FROM t WHERE m4 IS NOT NULL AND top IS NOT NULL),
w AS (SELECT c.y, c.x, avg(b.v) AS dm, var_pop(b.v) AS dv, any_value(sigma) AS sigma FROM c CROSS JOIN generate_series(-3, 3) j(dy) CROSS JOIN generate_series(-3, 3) k(dx) JOIN pos b ON b.y = c.y + dy AND b.x = c.x + dx WHERE {_SIDE} GROUP BY c.y, c.x)
SELECT y, x, round(dm + (dv - dm * dm * sigma) / (sigma + 1) / dv * (v - dm), 6) AS v FROM pos LEFT JOIN w USING (y, x)""")
def refined_lee(spark, d):
    return S.refined_lee(T.grid(spark, d, positive=True), holes=False).select("y", "x", r6("v"))


def _diffuse(t: str) -> str:
    near = {"w": "lag(v) OVER r", "e": "lead(v) OVER r", "n": "lag(v) OVER c", "s": "lead(v) OVER c"}
    terms = " + ".join(f"coalesce(exp(-({z} - v) * ({z} - v) / 3) * ({z} - v), 0)" for z in near)
    return f"SELECT y, x, v + 0.2::DOUBLE * ({terms}) AS v FROM (SELECT *, {', '.join(f'{q} AS {z}' for z, q in near.items())} FROM {t} WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))"


@query(f"WITH {GRID}, a0 AS (SELECT * FROM grid), " + ", ".join(f"a{i + 1} AS ({_diffuse(f'a{i}')})" for i in range(10)) + " SELECT y, x, round(v, 6) AS v FROM a10")
def perona_malik(spark, d):
    T_checkpoint(spark)
    return S.perona_malik(T.grid(spark, d)).select("y", "x", r6("v"))


def _morph(t: str, f: str) -> str:
    return f"SELECT y, x, m AS v FROM ({_near(t, 1, f'{f}(b.v) AS m')})"


@query(f"WITH {GRID}, m AS (SELECT y, x, CAST(v > 0 AS INT) AS v FROM grid), a AS ({_morph('m', 'min')}), o AS ({_morph('a', 'max')}), b AS ({_morph('m', 'max')}), c AS ({_morph('b', 'min')}) SELECT m.y, m.x, m.v AS mask, o.v AS opened, c.v AS closed FROM m JOIN o USING (y, x) JOIN c USING (y, x)")
def morph_open_close(spark, d):
    m = T.grid(spark, d).select("y", "x", (F.col("v") > 0).cast("int").alias("v"))
    o, c = N.opening(m, square(1)).withColumnRenamed("v", "opened"), N.closing(m, square(1)).withColumnRenamed("v", "closed")
    return m.withColumnRenamed("v", "mask").join(o, ["y", "x"]).join(c, ["y", "x"])


@query(f"WITH {GRID}, m AS (SELECT y, x, CAST(v > 0 AS INT) AS v FROM grid), a AS ({_morph('m', 'max')}), b AS ({_morph('a', 'min')}), c AS ({_morph('b', 'min')}), e AS ({_morph('c', 'max')}), f AS (SELECT m.y, m.x, CAST(m.v <> 0 AND e.v <> 0 AS INT) AS v FROM m JOIN e USING (y, x)), g AS ({_morph('f', 'max')}), h AS ({_morph('g', 'min')}) SELECT y, x, v FROM h")
def morph_adjustment(spark, d):
    m = T.grid(spark, d).select("y", "x", (F.col("v") > 0).cast("int").alias("v"))
    return N.morph_adjust(m, square(1), square(1)).select("y", "x", "v")


@query(f"WITH {GRID}, p AS (SELECT y, x, abs(v) AS v FROM grid), a AS ({_near('grid', 1, 'median(b.v) AS m')}), b AS ({_near('p', 1, 'median(b.v) AS m')}) SELECT a.y, a.x, round(a.m - b.m, 6) AS diff FROM a JOIN b USING (y, x) WHERE a.m - b.m < -0.05")
def focal_median_diff(spark, d):
    g = T.grid(spark, d)
    a = N.focal(g, "median", square(1)).withColumnRenamed("v", "before")
    b = N.focal(g.withColumn("v", F.abs("v")), "median", square(1)).withColumnRenamed("v", "after")
    return a.join(b, ["y", "x"]).withColumn("diff", F.col("before") - F.col("after")).where("diff < -0.05").select("y", "x", r6("diff"))


@query(f"WITH {GRID}, q AS (SELECT y, x, CAST(floor(v * 20) AS BIGINT) AS v FROM grid), a AS (SELECT y + dy AS y, x + dx AS x, q.v FROM q, generate_series(-2, 2) p(dy), generate_series(-2, 2) r(dx) WHERE dx * dx + dy * dy <= 4), c AS (SELECT y, x, v, count(*) AS c FROM a GROUP BY ALL), e AS (SELECT y, x, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c GROUP BY ALL) SELECT y, x, round(h, 6) AS entropy FROM e JOIN grid USING (y, x)")
def entropy_window(spark, d):
    return N.entropy(T.grid(spark, d), circle(2), 20).select("y", "x", r6("entropy"))


@query(f"WITH {GRID} SELECT CAST(floor(y / 5) AS BIGINT) AS y, CAST(floor(x / 5) AS BIGINT) AS x, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(v) AS n FROM grid GROUP BY ALL")
def reduce_resolution(spark, d):
    return C.coarser(T.grid(spark, d), 5).select("y", "x", r6("mean"), r6("median"), "n")


@query(f"WITH {GRID} SELECT y, x, round((lag(v) OVER (PARTITION BY y ORDER BY x) - v + lag(v) OVER (PARTITION BY x ORDER BY y) - v) / 2, 6) AS noise FROM grid")
def shift_difference(spark, d):
    return C.shift_difference(T.grid(spark, d)).select("y", "x", r6("noise"))


HORN = "g AS (SELECT a.y, a.x, sum(dx * (2 - abs(dy)) * b.v) / 8.0::DOUBLE AS gx, sum(dy * (2 - abs(dx)) * b.v) / 8.0::DOUBLE AS gy FROM grid a CROSS JOIN generate_series(-1, 1) p(dy) CROSS JOIN generate_series(-1, 1) q(dx) JOIN grid b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x HAVING count(b.v) = 9)"


@query(f"WITH {GRID}, {HORN}, t AS (SELECT y, x, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(gy, gx) AS aspect FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL) SELECT y, x, round(cos(radians(300.0::DOUBLE) - aspect) * sin(slope) * sin(radians(40.0::DOUBLE)) + cos(radians(40.0::DOUBLE)) * cos(slope), 6) AS shade FROM t")
def hillshade(spark, d):
    return C.hillshade(T.grid(spark, d), 300.0, 40.0).select("y", "x", r6("shade"))


@query(f"WITH {GRID}, k(dy, dx, w) AS (VALUES (-1, 0, 1.0::DOUBLE), (0, -1, 1.0::DOUBLE), (0, 0, -4.0::DOUBLE), (0, 1, 1.0::DOUBLE), (1, 0, 1.0::DOUBLE)) SELECT a.y, a.x, round(sum(b.v * w), 6) AS v FROM grid a, k JOIN grid b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL")
def laplacian_convolve(spark, d):
    k = [z for z in rotate(fixed([[0, 1, 0], [1, -4, 1], [0, 1, 0]])) if z[2]]
    return N.convolve(T.grid(spark, d), k).select("y", "x", r6("v"))


@query(f"WITH {GRID}, s AS (SELECT y, x, CASE WHEN (y * 7 + x) % 11 <> 0 THEN 2 * v + 1 END AS v FROM grid), f AS (SELECT y, x, CASE WHEN (y + x * 3) % 13 <> 0 THEN v END AS v FROM grid), j AS (SELECT s.y, s.x, s.v AS s, f.v AS f FROM s JOIN f USING (y, x)), "
    "n AS (SELECT a.y, a.x, a.s AS s0, a.f AS f0, count(CASE WHEN b.s IS NOT NULL AND b.f IS NOT NULL THEN 1 END) AS n, regr_slope(b.s, b.f) AS slope, regr_intercept(b.s, b.f) AS icept, avg(b.s) AS ms, avg(b.f) AS mf, stddev_pop(b.s) / stddev_pop(b.f) AS ratio FROM (SELECT j.*, j.y + dy AS ny, j.x + dx AS nx FROM j, generate_series(-10, 10) p(dy), generate_series(-10, 10) q(dx) WHERE j.s IS NULL) a JOIN j b ON b.y = ny AND b.x = nx GROUP BY a.y, a.x, a.s, a.f) "
    "SELECT y, x, round(CASE WHEN n >= 144 THEN CASE WHEN slope BETWEEN 1/3.0::DOUBLE AND 3 THEN f0 * slope + icept WHEN ratio BETWEEN 1/3.0::DOUBLE AND 3 THEN f0 * ratio + ms - mf * ratio ELSE f0 + ms - mf END END, 6) AS v FROM n UNION ALL SELECT y, x, round(s, 6) FROM j WHERE s IS NOT NULL")
def gap_fill(spark, d):
    g = T.grid(spark, d)
    src = g.withColumn("v", F.when((F.col("y") * 7 + F.col("x")) % 11 != 0, 2 * F.col("v") + 1))
    fill = g.withColumn("v", F.when((F.col("y") + F.col("x") * 3) % 13 != 0, F.col("v")))
    return S.gap_fill(src, fill, holes=False).select("y", "x", r6("v"))


@query(f"WITH {GRID}, o(dy, dx) AS (SELECT dy, dx FROM generate_series(-1, 1) p(dy), generate_series(-1, 1) q(dx)), s AS (SELECT a.y, a.x, string_agg(CAST(CAST(round(b.v * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY dy, dx) AS patch, count(*) AS n FROM grid a, o JOIN grid b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x) SELECT y, x, patch FROM s WHERE n = 9")
def patch_arrays(spark, d):
    p = N.patches(T.grid(spark, d), 1).where(F.size("patch") == 9)
    return p.select("y", "x", F.array_join(F.transform("patch", lambda v: F.round(v * 1000).cast("long").cast("string")), ",").alias("patch"))


@query(f"WITH {GRID}, s AS ({_near('grid', 1, 'stddev_pop(b.v) AS sd')}), m AS (SELECT min(sd) + 0.5::DOUBLE * (max(sd) - min(sd)) AS t FROM s) SELECT y, x, round(sd, 6) AS sd FROM s, m WHERE sd < t")
def rms_minmax_threshold(spark, d):
    s = N.box_stats(T.grid(spark, d), 1, holes=False).withColumn("sd", F.sqrt("var"))
    j = s.crossJoin(F.broadcast(s.agg(F.min("sd").alias("low"), F.max("sd").alias("high"))))  # one row
    return j.where(F.col("sd") < F.col("low") + 0.5 * (F.col("high") - F.col("low"))).select("y", "x", r6("sd"))


@query()
def homogeneous_islands(spark, d):
    g = T.grid(spark, d).select("y", "x", (F.col("v") > 0.1).cast("int").alias("v"))
    T_checkpoint(spark)
    return N.components(g).groupBy("label").agg(F.count("*").alias("cells")).where("cells >= 3")


def T_checkpoint(spark) -> None:
    """Sees to a folder for checkpoints: the one the session names; else, one of the warehouse, which a cluster shares."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


# ---------------------------------------------------------------- time series


@query(f"WITH {COLL}, p AS (SELECT *, user_id // 16 AS y, user_id % 16 AS x FROM coll), m AS (SELECT a.event_type, a.day, a.y, a.x, a.v, avg(b.v) AS m FROM p a JOIN p b ON a.event_type = b.event_type AND a.day = b.day AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL), r AS (SELECT *, v / nullif(m, 0) AS ratio FROM m) SELECT CAST(a.day AS VARCHAR) AS day, a.event_type, a.y, a.x, round(any_value(a.m) * avg(b.ratio), 6) AS v FROM r a JOIN r b ON a.event_type = b.event_type AND a.y = b.y AND a.x = b.x AND b.day >= a.day - 3 AND b.day < a.day + 3 GROUP BY a.day, a.event_type, a.y, a.x")
def multitemporal_ratio(spark, d):
    images = T.collection(spark, d).withColumns({"y": F.floor(F.col("user_id") / 16), "x": F.col("user_id") % 16})
    return C.multitemporal_ratio(images, 2, 3, 3, orbit="event_type").select(day(), "event_type", "y", "x", r6("v"))


@query("WITH s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS t, avg(value) AS v FROM events GROUP BY ALL), n AS (SELECT t, v, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n, first_value(v) OVER (ORDER BY t) AS f, last_value(v) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM s), "
    "e AS (SELECT t, i, v FROM n UNION ALL SELECT NULL, 2 - i, f - abs(v - f) FROM n WHERE i BETWEEN 2 AND 6 UNION ALL SELECT NULL, 2 * n - i, l + abs(v - l) FROM n WHERE i BETWEEN n - 5 AND n - 1), "
    "w(k, c) AS (VALUES " + ", ".join(f"({i - 5}, {c})" for i, c in enumerate(C.SMOOTH)) + ") SELECT a.t, round(sum(b.v * c) / 429, 6) AS smooth FROM e a, w JOIN e b ON b.i = a.i + k WHERE a.t IS NOT NULL GROUP BY a.t")
def savitzky_golay(spark, d):
    s = T.scan(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("t")).agg(F.avg("value").alias("v")).withColumn("series", F.lit("all"))
    return C.savitzky_golay(s).select("t", r6("smooth"))


# ---------------------------------------------------------------- evaluation

_ROC = f"{SCORES}, k AS (SELECT unnest(generate_series(0, 1000)) / 1000.0::DOUBLE AS cutoff), roc AS (SELECT cutoff, sum(CASE WHEN is_target = 1 AND score > cutoff THEN 1 ELSE 0 END) / sum(CASE WHEN is_target = 1 THEN 1 ELSE 0 END)::DOUBLE AS tpr, sum(CASE WHEN is_target = 0 AND score < cutoff THEN 1 ELSE 0 END) / sum(CASE WHEN is_target = 0 THEN 1 ELSE 0 END)::DOUBLE AS tnr FROM scores, k GROUP BY cutoff)"


@query(f"WITH {_ROC} SELECT round(cutoff, 6) AS cutoff, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round(1 - tnr, 6) AS fpr, round(sqrt((1 - tpr) ** 2 + (1 - tnr) ** 2), 6) AS dist FROM roc")
def roc_curve(spark, d):
    return E.roc(T.scores(spark, d), 1000).select(*[r6(c) for c in ("cutoff", "tpr", "tnr", "fpr", "dist")])


@query(f"WITH {_ROC}, l AS (SELECT tpr, 1 - tnr AS fpr, lag(tpr) OVER (ORDER BY cutoff) AS t0, lag(1 - tnr) OVER (ORDER BY cutoff) AS f0 FROM roc) SELECT round(abs(sum((fpr - f0) * (tpr + t0) / 2)), 6) AS auc FROM l")
def roc_auc(spark, d):
    return E.auc(E.roc(T.scores(spark, d), 1000)).select(r6("auc"))


@query(f"WITH {_ROC} SELECT round(cutoff, 6) AS cutoff, round(sqrt((1 - tpr) ** 2 + (1 - tnr) ** 2), 6) AS dist FROM roc ORDER BY sqrt((1 - tpr) ** 2 + (1 - tnr) ** 2), cutoff LIMIT 1")
def roc_best(spark, d):
    return E.best_cutoff(E.roc(T.scores(spark, d), 1000)).select(r6("cutoff"), r6("dist"))


@query("SELECT CAST(quality AS BIGINT) AS actual, CAST(toxic AS BIGINT) AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark, d):
    return E.confusion_matrix(T.scan(spark, d, "labels"), "quality", "toxic")


@query("WITH m AS (SELECT CAST(quality AS BIGINT) AS a, CAST(toxic AS BIGINT) AS p, count(*) AS n FROM labels GROUP BY ALL), r AS (SELECT a AS class, sum(CASE WHEN a = p THEN n ELSE 0 END) / sum(n)::DOUBLE AS pa FROM m GROUP BY a), c AS (SELECT p AS class, sum(CASE WHEN a = p THEN n ELSE 0 END) / sum(n)::DOUBLE AS ua FROM m GROUP BY p), o AS (SELECT sum(CASE WHEN a = p THEN n ELSE 0 END) / sum(n)::DOUBLE AS oa FROM m) SELECT class, round(pa, 6) AS producers, round(ua, 6) AS users, round(oa, 6) AS overall FROM r FULL JOIN c USING (class), o")
def accuracy(spark, d):
    return E.accuracies(E.confusion_matrix(T.scan(spark, d, "labels"), "quality", "toxic")).select("class", r6("producers"), r6("users"), r6("overall"))


@query(f"SELECT doc_id, CASE WHEN {uniform_sql('doc_id', 7)} < 0.7 THEN 'train' ELSE 'test' END AS part FROM labels")
def split_70_30(spark, d):
    return T.scan(spark, d, "labels").select("doc_id", F.when(E.uniform(F.col("doc_id"), 7) < 0.7, "train").otherwise("test").alias("part"))


@query(f"WITH u AS (SELECT doc_id, {uniform_sql('doc_id', 42)} AS random FROM labels), r AS (SELECT *, row_number() OVER (ORDER BY random, doc_id) AS rn, count(*) OVER () AS n FROM u) SELECT doc_id, round(random, 6) AS random, CAST(CASE WHEN rn <= 7 * (n // 7) THEN (rn - 1) // (n // 7) ELSE rn - 7 * (n // 7) - 1 END AS BIGINT) AS fold FROM r")
def kfold_assign(spark, d):
    return E.kfold(T.scan(spark, d, "labels").select("doc_id"), "doc_id", 7).select("doc_id", r6("random"), "fold")


# ---------------------------------------------------------------- grids, vectors, arrays


@query("WITH b AS (SELECT min(user_id % 16) AS x0, max(user_id % 16) AS x1, min(user_id // 16) AS y0, max(user_id // 16) AS y1 FROM events) SELECT i, j, round(x0 + i * 4 - 2.0, 6)::DOUBLE AS west, round(x0 + i * 4 + 2.0, 6)::DOUBLE AS east, round(y0 + j * 4 - 2.0, 6)::DOUBLE AS south, round(y0 + j * 4 + 2.0, 6)::DOUBLE AS north FROM b, generate_series(0, 100) p(i), generate_series(0, 100) q(j) WHERE i <= (x1 - x0) // 4 AND j <= (y1 - y0) // 4")
def grid_cells(spark, d):
    e = T.scan(spark, d, "events").select((F.col("user_id") % 16).alias("px"), F.floor(F.col("user_id") / 16).alias("py"))
    return E.generate_grid(e, "px", "py", 4.0, 4.0).select("i", "j", r6("west"), r6("east"), r6("south"), r6("north"))


@query("SELECT CAST(((user_id % 16) + 2) // 4 AS BIGINT) AS i, CAST(((user_id // 16) + 2) // 4 AS BIGINT) AS j, count(*) AS n, round(sum(value) / 10000, 6) AS area FROM events GROUP BY ALL")
def grid_zonal_area(spark, d):
    e = T.scan(spark, d, "events")
    cell = lambda c: F.floor((c + 2) / 4)
    return e.groupBy(cell(F.col("user_id") % 16).alias("i"), cell(F.floor(F.col("user_id") / 16)).alias("j")).agg(F.count("*").alias("n"), F.round(F.sum("value") / 10000, 6).alias("area"))


@query("WITH f AS (SELECT CAST(ceil((o_totalprice - 2000) / 5000) AS BIGINT) AS a, CAST(floor((o_totalprice + 2000) / 5000) AS BIGINT) AS b FROM orders), c AS (SELECT unnest(generate_series(a, b)) * 5000 AS cell FROM f WHERE a <= b) SELECT CAST(cell AS BIGINT) AS cell, count(*) AS n FROM c GROUP BY ALL")
def footprint_overlap_count(spark, d):
    f = T.scan(spark, d, "orders").select((F.col("o_totalprice") - 2000).alias("a"), (F.col("o_totalprice") + 2000).alias("b"))
    return E.overlap_count(f, "a", "b", 5000).select(F.col("cell").cast("long").alias("cell"), "n")


@query("SELECT vec_id, printf('%.2f', CAST(embedding[1] AS DOUBLE)) AS lon, printf('%.2f', CAST(embedding[2] AS DOUBLE)) AS lat FROM embeddings")
def coord_format(spark, d):
    e = T.scan(spark, d, "embeddings")
    at = lambda i: F.format_string("%.2f", F.get("embedding", F.lit(i)).cast("double"))
    return e.select("vec_id", at(0).alias("lon"), at(1).alias("lat"))


@query("SELECT vec_id, round(list_avg(list_slice(list_sort(CAST(embedding AS DOUBLE[])), 1, 5)), 6) AS low5, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def array_sort_slice_mean(spark, d):
    least = F.slice(F.sort_array(F.col("embedding").cast("array<double>")), 1, 5)
    return T.scan(spark, d, "embeddings").select("vec_id", r6("low5", F.aggregate(least, F.lit(0.0), lambda a, x: a + x) / F.size(least)), F.size("embedding").cast("long").alias("n"))


VECTORS = "e AS (SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), m AS (SELECT i, avg(e) AS m, var_pop(e) AS v FROM e GROUP BY i)"


@query(f"WITH {VECTORS} SELECT a.i, b.i AS j, round(covar_pop(a.e, b.e), 6) AS c FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def covariance_matrix(spark, d):
    return M.array_covariance(T.scan(spark, d, "embeddings"), "embedding").select("i", "j", r6("c"))


@query(f"WITH {VECTORS}, t AS (SELECT i, e - m AS t, v FROM e JOIN m USING (i) WHERE vec_id = 0) SELECT vec_id, round(sum((e - m) * t / t.v) / sum(t * t / t.v), 6) AS mf FROM e JOIN m USING (i) JOIN t USING (i) GROUP BY vec_id")
def matched_filter(spark, d):
    """The share of the first vector in each, all bands, with the bands' variances as the diagonal."""
    e = T.scan(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    means, variances = M.moments(e, "e")
    target = [a - b for a, b in zip(e.where("vec_id = 0").first()["e"], means, strict=True)]
    bands = [F.get("e", F.lit(i)) - m for i, m in enumerate(means)]
    return e.select("vec_id", r6("mf", M.matched_filter(bands, target, variances)))


@query()
def mnf_unmixing(spark, d):
    """Noise-whitened bands, matched-filter score and infeasibility of each vector, all bands."""
    e = T.scan(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    noise = F.transform("e", lambda x, i: x - F.get("e", F.pmod(i + 1, F.size("e"))) + x * 0.1)
    means, rotation, values = M.array_noise_fraction(e.withColumn("n", noise), "e", "n")
    p = e.select("vec_id", M.matrix_times(rotation.T.tolist(), F.transform("e", lambda x, i: x - F.get(F.array(*map(F.lit, means)), i))).alias("k"))
    target, lam = [float(x) for x in p.where("vec_id = 0").first()["k"]], [max(float(v), 1e-9) for v in values]
    ks = [F.get("k", F.lit(i)) for i in range(len(lam))]
    out = p.withColumn("mf", M.matched_filter(ks, target, lam))
    return out.select("vec_id", r6("mf"), r6("infeasibility", M.infeasibility(ks, F.col("mf"), target, lam)))


@query()
def kmeans_7(spark, d):
    return M.kmeans(T.scan(spark, d, "embeddings"), "embedding", 7).select("vec_id", F.col("cluster").cast("long").alias("cluster"))


@query()
def cart_bagging(spark, d):
    return M.bagged_variance(T.scan(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query()
def rf_kfold(spark, d):
    return M.cross_validate(T.scan(spark, d, "embeddings"), "vec_id", "embedding", "label", 3, numTrees=5, seed=1)


@query(f"WITH p AS (SELECT id, {uniform_sql('id', 1)} AS x, {uniform_sql('id', 2)} AS y FROM range(1000) t(id)) SELECT id, round(x, 6) AS x, round(y, 6) AS y, n_name FROM p JOIN nation ON CAST(floor(x * 25) AS BIGINT) = n_nationkey")
def random_points_in_regions(spark, d):
    """Seeded points over the unit square, tagged by the nation whose strip they fall in."""
    n = T.scan(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("strip"))
    p = spark.range(0, 1000).select("id", E.uniform(F.col("id"), 1).alias("x"), E.uniform(F.col("id"), 2).alias("y"))
    return p.join(n, F.floor(F.col("x") * 25) == F.col("strip")).select("id", r6("x"), r6("y"), "n_name")
