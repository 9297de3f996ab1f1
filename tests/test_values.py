"""What queries without SQL return, against plain versions; uniforms; and operators on several images, holes and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import bands as B
from gridlark.functions.kernels import square
from gridlark.operators import classification as L
from gridlark.operators import collections as C
from gridlark.operators import evaluation as E
from gridlark.operators import neighborhood as N
from gridlark.operators import projection as P
from gridlark.plans import catalog, chains, scenes, spatial  # noqa: F401 - add their queries to the catalog
from gridlark.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = T.scan(spark, SF, "embeddings").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], dtype=float), np.array([r["label"] for r in rows])


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_uniforms_of_seeds_are_independent(spark):
    u = np.array(spark.range(4000).select(*[E.uniform(F.col("id") * 10**15, s) for s in (1, 2, 3)]).collect())
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    assert np.abs(np.corrcoef(u.T) - np.eye(3)).max() < 0.06 and len(np.unique(u[:, 0])) == 4000
    assert abs(((u[:, 0] < 0.8) & (u[:, 1] < 0.8)).mean() - 0.64) < 0.03
    assert spark.range(1).select(E.uniform(F.lit(None).cast("long"))).first()[0] is not None


def test_points_fill_the_square(spark):
    p = np.array([(r["x"], r["y"]) for r in run(spark, "random_points_in_regions")])
    assert abs(np.corrcoef(p.T)[0, 1]) < 0.1


def test_mnf_unmixing(spark, vectors):
    e, _ = vectors
    noise = e - np.roll(e, -1, axis=1) + 0.1 * e
    values, vec = np.linalg.eigh(np.cov(noise.T, bias=True))
    white = vec / np.sqrt(np.maximum(values, 1e-12))
    lam, rot = np.linalg.eigh(white.T @ np.cov(e.T, bias=True) @ white)
    k = (e - e.mean(axis=0)) @ white @ rot
    mf = (k * k[0] / lam).sum(axis=1) / (k[0] * k[0] / lam).sum()
    far = np.sqrt(((k - mf[:, None] * k[0]) ** 2).sum(axis=1))
    spread = (np.sqrt(lam) - mf[:, None] * (np.sqrt(lam) - 1)) ** 4
    want = far / np.sqrt(spread.sum(axis=1))
    rows = sorted(run(spark, "mnf_unmixing"))
    assert np.allclose([r["mf"] for r in rows], mf, atol=1e-5) and np.allclose([r["infeasibility"] for r in rows], want, rtol=1e-4, atol=1e-5)


def test_clusters_are_nearest_to_their_means(spark, vectors):
    e, _ = vectors
    c = np.array([r["cluster"] for r in sorted(run(spark, "kmeans_7"))])
    means = np.stack([e[c == k].mean(axis=0) for k in range(7)])
    near = ((e[:, None] - means) ** 2).sum(axis=2)
    assert len(set(c)) == 7 and (near.argmin(axis=1) == c).mean() > 0.95
    v, c = np.array([(r["v"], r["cluster"]) for r in T.grid(spark, SF).join(catalog.queries()["masked_kmeans"](spark, SF), ["y", "x"]).collect()]).T
    assert {r["cluster"] for r in run(spark, "masked_kmeans")} == set(range(7))
    inside, between = sum(((v[c == k] - v[c == k].mean()) ** 2).sum() for k in range(7)), ((v - v.mean()) ** 2).sum()
    assert inside < 0.2 * between


def test_bags_differ(spark, vectors):
    _, label = vectors
    var = np.array([r["variance"] for r in sorted(run(spark, "cart_bagging"))])
    assert len(var) == len(label) and (var > 0).mean() > 0.2 and var.max() <= (label.max() - label.min()) ** 2 / 4


def test_folds_are_predicted_by_others(spark, vectors):
    _, label = vectors
    rows = sorted(run(spark, "rf_kfold"))
    assert [r["observed"] for r in rows] == label.tolist() and {r["fold"] for r in rows} == {0, 1, 2}
    assert {r["predicted"] for r in rows} <= set(label.tolist())
    sizes = np.bincount([r["fold"] for r in rows])
    assert sizes.max() - sizes.min() <= 1


def test_hulls_hold_all_points(spark, vectors):
    e, label = vectors
    for r in run(spark, "convex_hulls"):
        p = e[label == r["label"], :2]
        # An edge of the hull has all points on one side: a plain test of every pair.
        corners, area = set(), 0.0
        for i in range(len(p)):
            d = p - p[i]
            for j in range(len(p)):
                cross = d[j, 0] * d[:, 1] - d[j, 1] * d[:, 0]
                if i != j and (cross >= -1e-15).all():
                    corners |= {i, j}
                    area += (p[i, 0] * p[j, 1] - p[j, 0] * p[i, 1]) / 2
        assert r["corners"] == len(corners) and abs(r["area"] - area) < 1e-5


def test_regression_and_perceptron_learn(spark, vectors):
    e, label = vectors
    p = np.array([r["prediction"] for r in sorted(run(spark, "forest_regression"))])
    assert np.corrcoef(p, e[:, 0])[0, 1] > 0.8 and ((p - e[:, 0]) ** 2).mean() < 0.6 * e[:, 0].var()
    got = np.array([r["prediction"] for r in sorted(run(spark, "perceptron_classes"))])
    assert (got == label).mean() > 2 * np.bincount(label).max() / len(label) or (got == label).mean() > 0.8


def test_classification_chain(spark):
    rows = run(spark, "classification_chain")
    every = T.bands(spark, SF).collect()
    b = {tuple(r[k] for k in catalog.KEYS): r for r in every}  # a key occurs twice
    left = []
    for r in rows:
        x = b[tuple(r[k] for k in catalog.KEYS)]
        nd = (x["b2"] - 2000 * x["b1"]) / (x["b2"] + 2000 * x["b1"])
        if (x["b1"] > 25) != r["number"]:
            continue
        if x["b4"] > 0.07 or nd > 0.5 or nd <= -0.5:
            assert r["v"] == 0
        else:
            left.append(r["v"] == r["number"])
    assert len(rows) == len(every) and len(left) > 1000 and np.mean(left) > 0.8
    area = run(spark, "classify_zonal_area")
    assert sum(r["n"] for r in area) == len(every) and all(0 <= r["area"] <= r["n"] * 0.09 + 1e-9 for r in area) and sum(r["no_data"] for r in area) == sum(x["b3"] <= 0.01 for x in every)


def test_vote_is_the_median(spark):
    d = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (0, None, 1), (None, None, None), (2, None, None)], "a int, b int, c int")
    assert [r[0] for r in d.select(L.vote(["a", "b", "c"])).collect()] == [1, 0, 0.5, None, 2]


def test_empty_years_give_way(spark):
    maps = spark.createDataFrame([(y, 0, 0, 1) for y in (2014, 2011, 2010, 2006)], "year int, y long, x long, v int")
    assert L.available_years(maps, 2014, 2, 9) == [2014, 2011, 2006] and L.available_years(maps, 2009, 1, 2) == []


def test_images_do_not_mix_and_holes_have_no_neighbours(spark):
    g = spark.createDataFrame([(i, y, x, float(100 * i + x)) for i in (0, 1) for y in range(3) for x in range(5) if (y, x) != (1, 2)], "i int, y long, x long, v double")
    s = {(r["i"], r["y"], r["x"]): r for r in N.box_stats(g, 1, by=("i",)).collect()}
    assert s[(0, 1, 1)]["n"] == 8 and s[(1, 0, 0)]["mean"] == 100.5 and s[(0, 0, 0)]["mean"] == 0.5
    assert s[(0, 0, 2)]["n"] == 5 and s[(1, 2, 2)]["mean"] == 102
    f = {(r["i"], r["y"], r["x"]): r["v"] for r in N.focal(g, "max", square(1), by=("i",)).collect()}
    assert f[(0, 0, 0)] == 1 and f[(1, 0, 0)] == 101
    one = g.where("i = 0").drop("i")
    d = {(r["y"], r["x"]): r["noise"] for r in C.shift_difference(one).collect()}
    assert d[(1, 3)] is None and d[(2, 2)] is None and d[(2, 1)] == -0.5
    assert all(r["slope"] is None for r in C.terrain(one).collect())


def test_dealt_sums_equal_windows(spark):
    g = spark.createDataFrame([(y, x, None if (x + y) % 5 == 0 else float(x * y % 7)) for y in range(7) for x in range(9)], "y long, x long, v double")
    key = lambda r: (r["y"], r["x"], r["n"], round(r["mean"], 9), round(r["var"], 9))
    assert sorted(map(key, N.box_stats(g, 2).collect())) == sorted(map(key, N.box_stats(g, 2, holes=False).collect()))


def test_variance_of_large_values_does_not_cancel(spark):
    g = spark.createDataFrame([(y, x, 1e9 + (x + y) % 2) for y in range(4) for x in range(4)], "y long, x long, v double")
    assert all(abs(r["var"] - 0.25) < 0.01 for r in N.box_stats(g, 1).collect() if r["n"] in (4, 6))


def test_slope_of_a_plane(spark):
    g = spark.createDataFrame([(y, x, 3.0 * x + 4.0 * y) for y in range(5) for x in range(5)], "y long, x long, v double")
    inner = C.terrain(g).where("slope IS NOT NULL").collect()
    assert len(inner) == 9 and all(abs(np.tan(r["slope"]) - 5) < 1e-9 and abs(r["aspect"] - np.arctan2(4, 3)) < 1e-9 for r in inner)


def test_smoothing_weights():
    assert np.allclose(np.array(C.fit_weights(11, 2)) * 429, C.SMOOTH)
    assert np.allclose(np.array(C.fit_weights(5, 2, 1)) * 10, [-2, -1, 0, 1, 2]) and np.allclose(np.array(C.fit_weights(5, 2, 2)) * 7, [2, -1, -2, -1, 2])
    for bad in ((4, 2, 0), (5, 5, 0), (5, 2, 3)):
        with pytest.raises(ValueError):
            C.fit_weights(*bad)


def test_reprojection_there_and_back(spark):
    a = P.Projection("EPSG:4326", 2.0, 10.0, -2.0, 50.0)
    g = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(3) for x in range(4)], "y long, x long, v double")
    fine = P.reproject(g, a, a.scaled(0.5))
    assert fine.count() == 48 and {tuple(r) for r in P.reproject(fine, a.scaled(0.5), a).collect()} == {tuple(r) for r in g.collect()}
    with pytest.raises(ValueError):
        P.reproject(g, a, P.Projection("EPSG:32648", 2.0, 10.0, -2.0, 50.0))


def test_cloud_score_of_cloud_and_of_none(spark):
    d = spark.createDataFrame([(0.5, 0.5, 0.5, 0.6, 0.5, 0.5, 280.0), (0.05, 0.1, 0.1, 0.3, 0.2, 0.1, 300.0), (0.5, 0.5, None, 0.6, 0.5, 0.5, 280.0)], "a double, b double, c double, d double, e double, f double, g double")
    assert [r[0] for r in d.select(B.cloud_score(*map(F.col, "abcdefg"))).collect()] == [100, 0, None]
    assert [r[0] for r in d.select(B.clear(F.lit(10), 20, [F.col("a"), F.col("c")])[0].alias("x")).collect()] == [0.5, 0.05, None]
