"""Classifiers, clustering, and the linear algebra of spectral unmixing."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.evaluation import kfold, uniform

MAKERS = {"cart": DecisionTreeClassifier, "random_forest": RandomForestClassifier, "svm": LinearSVC, "bayes": NaiveBayes, "logistic": LogisticRegression}


def make_classifier(name: str, **options):
    return MAKERS[name](featuresCol="features", labelCol="label", **options)


def vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def kmeans(df: DataFrame, column: str, k: int, seed: int = 1) -> DataFrame:
    data = vectors(df, column)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data).drop("features")


def kmeans_by(train: DataFrame, df: DataFrame, column: str, k: int, seed: int = 1) -> DataFrame:
    """``df`` with the cluster of each row, of clusters learnt from other rows."""
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors(train, column))
    return model.transform(vectors(df, column)).drop("features")


def bagged_variance(df: DataFrame, key: str, column: str, label: str, bags: int = 10, share: float = 0.8, name: str = "cart") -> DataFrame:
    """key, variance of the classes that models of ``bags`` subsamples predict."""
    data = vectors(df, column).withColumn("label", F.col(label).cast("double"))
    out = data
    for seed in range(1, bags + 1):
        model = make_classifier(name).fit(data.where(uniform(F.col(key), seed) < share))
        out = model.setPredictionCol(f"p{seed}").setRawPredictionCol(f"r{seed}").setProbabilityCol(f"q{seed}").transform(out)
    mean = sum((F.col(f"p{s}") for s in range(1, bags + 1)), F.lit(0.0)) / bags
    square = sum((F.col(f"p{s}") * F.col(f"p{s}") for s in range(1, bags + 1)), F.lit(0.0)) / bags
    return out.select(key, F.greatest(F.lit(0.0), square - mean * mean).alias("variance"))


def cross_validate(df: DataFrame, key: str, column: str, label: str, k: int, name: str = "random_forest", **options) -> DataFrame:
    """key, observed, predicted, fold: every row predicted by a model of the other folds."""
    data = vectors(df, column).withColumn("label", F.col(label).cast("double")).join(kfold(df, key, k).select(key, "fold"), key)
    parts = [make_classifier(name, **options).fit(data.where(F.col("fold") != i)).transform(data.where(F.col("fold") == i)) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, F.col("label").cast("long").alias("observed"), F.col("prediction").cast("long").alias("predicted"), "fold")


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariance, in one aggregation; only their few numbers reach the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    n = len(columns)
    cov = np.zeros((n, n))
    for (i, j), v in zip(pairs, row[n:], strict=True):
        cov[i, j] = cov[j, i] = v
    return np.array(row[:n], dtype=float), cov


def array_covariance(df: DataFrame, column: str) -> DataFrame:
    """i, j, c: the population covariance of each pair of bands (i <= j) of an array column, by partial aggregation."""
    each = F.posexplode(F.col(column).cast("array<double>"))
    a = df.select(F.col(column).alias("_e"), each.alias("i", "a"))
    pairs = a.select("i", "a", F.posexplode(F.slice(F.col("_e").cast("array<double>"), F.col("i") + 1, F.size("_e"))).alias("k", "b"))
    return pairs.groupBy(F.col("i").cast("long").alias("i"), (F.col("i") + F.col("k")).cast("long").alias("j")).agg(F.covar_pop("a", "b").alias("c"))


def moments(df: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Mean and population variance of each band of an array column."""
    rows = df.select(F.posexplode(column).alias("i", "e")).groupBy("i").agg(F.avg("e"), F.var_pop("e")).orderBy("i").collect()  # a row a band
    return [r[1] for r in rows], [r[2] for r in rows]


def covariance_of(df: DataFrame, column: str) -> np.ndarray:
    """The covariance of an array column's bands as a matrix."""
    rows = array_covariance(df, column).collect()  # a number for each pair of bands
    out = np.zeros((max((r["j"] for r in rows), default=-1) + 1,) * 2)
    for i, j, c in rows:
        out[i, j] = out[j, i] = c
    return out


def array_noise_fraction(df: DataFrame, column: str, noise: str) -> tuple[list[float], np.ndarray, np.ndarray]:
    """(means, rotation, eigenvalues), as ``minimum_noise_fraction``, of all bands of an array column."""
    return (moments(df, column)[0], *_noise_rotation(covariance_of(df, noise), covariance_of(df, column)))


def minimum_noise_fraction(df: DataFrame, columns: list[str], noise: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, rotation, eigenvalues): whitens by the noise columns' covariance, then rotates to falling variance; the
    largest entry of each direction is positive."""
    _, noise_cov = covariance(df, noise)
    means, cov = covariance(df, columns)
    return (means, *_noise_rotation(noise_cov, cov))


def _noise_rotation(noise_cov: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vec = np.linalg.eigh(noise_cov)
    white = vec / np.sqrt(np.maximum(values, 1e-12))
    lam, rot = np.linalg.eigh(white.T @ cov @ white)
    order = np.argsort(-lam)
    rotation = white @ rot[:, order]
    rotation *= np.sign(rotation[np.abs(rotation).argmax(axis=0), range(rotation.shape[1])])
    return rotation, lam[order]


def project(columns: list[str], means: np.ndarray, rotation: np.ndarray) -> list[Column]:
    return [sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, means, rotation[:, k], strict=True)), F.lit(0.0)) for k in range(rotation.shape[1])]


def matched_filter(bands: list[Column], target: list[float], variances: list[float]) -> Column:
    """x C^-1 t / (t C^-1 t) with a diagonal C."""
    bottom = sum(t * t / v for t, v in zip(target, variances, strict=True))
    return sum((b * (t / v / bottom) for b, t, v in zip(bands, target, variances, strict=True)), F.lit(0.0))


def infeasibility(bands: list[Column], score: Column, target: list[float], variances: list[float]) -> Column:
    """Distance from the mixing line over the spread that the score leaves."""
    far = sum(((b - score * t) * (b - score * t) for b, t in zip(bands, target, strict=True)), F.lit(0.0))
    spread = [F.lit(v**0.5) - score * (v**0.5 - 1) for v in variances]
    return F.try_divide(F.sqrt(far), F.sqrt(sum((s * s * s * s for s in spread), F.lit(0.0))))


def regress(df: DataFrame, column: str, target: str, **options) -> DataFrame:
    """df with the prediction of a random forest that learns ``target`` from the vectors."""
    data = vectors(df, column).withColumn("label", F.col(target).cast("double"))
    return RandomForestRegressor(featuresCol="features", labelCol="label", **options).fit(data).transform(data).drop("features", "label")


def perceptron(df: DataFrame, column: str, label: str, hidden: tuple[int, ...] = (), seed: int = 1) -> DataFrame:
    """df with the class that a perceptron (with ``hidden`` layers, if any) predicts; classes are 0, 1, 2, ..."""
    data = vectors(df, column).withColumn("_l", F.col(label).cast("double"))
    width, classes = data.agg(F.max(F.size(column)), F.max("_l")).first()
    layers = [width, *hidden, max(int(classes) + 1, 2)]
    model = MultilayerPerceptronClassifier(featuresCol="features", labelCol="_l", layers=layers, seed=seed, maxIter=50).fit(data)
    return model.transform(data).drop("features", "_l", "rawPrediction", "probability")


def matrix_times(matrix: list[list[float]], vector: Column) -> Column:
    """A constant matrix times an array column."""
    rows = [F.aggregate(F.zip_with(F.array(*[F.lit(float(w)) for w in row]), vector, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in matrix]
    return F.array(*rows)


def pseudo_inverse(matrix: list[list[float]]) -> list[list[float]]:
    return np.linalg.pinv(np.asarray(matrix, dtype=float)).tolist()
