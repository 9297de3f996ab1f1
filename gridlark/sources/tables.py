"""Scans and sinks, and the fixtures that read the driver's tables as images, collections and features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def export_table(df: DataFrame, path: str, fmt: str = "parquet", selectors: list[str] | None = None) -> None:
    df = df.select(*selectors) if selectors else df
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def export_images(df: DataFrame, path: str, name_column: str) -> None:
    """One folder for each image, in a single job."""
    df.write.mode("overwrite").partitionBy(name_column).parquet(path)


def grid(spark: SparkSession, sf_dir: str, positive: bool = False) -> DataFrame:
    """embeddings as one image: y, x, v."""
    e = scan(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    v = F.col("v").cast("double")
    return e.select("y", F.col("x").cast("long").alias("x"), (F.abs(v) + 1 if positive else v).alias("v"))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a collection: an image a day and event type, a pixel a user."""
    e = scan(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type", "user_id").agg(F.avg("value").alias("v"), F.min("ts").alias("ts"))


def collection_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a step function of v follows: a pixel's values are added one after another in the order of the events,
    so that the last bit of its mean does not hang on how rows are dealt to tasks."""
    e = scan(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    order = Window.partitionBy("day", "event_type", "user_id").orderBy("event_id", "ts", "value")
    e = e.withColumns({"_sum": F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_place": F.row_number().over(order)})
    mean = F.try_divide(F.max_by("_sum", "_place"), F.count("value"))
    return e.groupBy("day", "event_type", "user_id").agg(mean.alias("v"), F.min("ts").alias("ts"))


def bands(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """lineitem as pixels of four bands, with further columns."""
    li = scan(spark, sf_dir, "lineitem")
    names = {"l_quantity": "b1", "l_extendedprice": "b2", "l_discount": "b3", "l_tax": "b4"}
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *more, *[F.col(k).alias(v) for k, v in names.items()])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as scored points: score in 0..1, is_target."""
    d = scan(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / F.lit(3000.0), F.lit(1.0)).alias("score"))
    return d.join(scan(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("is_target")), "doc_id")


def export_kml(df: DataFrame, path: str, name: str, ring: str) -> None:
    """Polygons (a name and an array of x, y) as KML placemarks, a file a partition, each a whole document."""
    safe = F.replace(F.replace(F.col(name).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    corner = F.transform(F.concat(F.col(ring), F.slice(F.col(ring), 1, 1)), lambda p: F.concat_ws(",", p["x"], p["y"]))
    mark = F.concat(F.lit("<Placemark><name>"), F.coalesce(safe, F.lit("")), F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.concat_ws(" ", corner), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"

    def whole(batches):
        yield pd.DataFrame({"value": [head]})
        for b in batches:
            yield b
        yield pd.DataFrame({"value": [tail]})

    df.select(mark.alias("value")).mapInPandas(whole, "value string").write.mode("overwrite").text(path)
