"""A corpus from documents: toxic ones go, one of each near-duplicate group stays, benchmark leaks go, sources are mixed
to their weights, and what is left is put into shards.

Every stage takes the whole result of the one before, as Parquet.  Nulls, empty texts, repeated rows, empty tables and
extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from gridlark.llm.common import delete_path, fresh_path, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of ``sf_dir``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(docs, model)("text") < 0.5)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 % of five-word shingles connect."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark of ``sf_dir``."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.repeat(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.shard(docs, keep=("lang", "source"))


STAGES = [("toxicity", toxic_out), ("jaccard_join", near_copies_out), ("decontamination", leaks_out), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None  # the classifier is not SQL; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote goes once the next has read it; the last one's input stays, for the result
    is computed from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
