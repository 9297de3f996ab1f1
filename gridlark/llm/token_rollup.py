"""Token counts kept as delta-maintained rollups.

A change is an insert, a delete or a revision of a document's count under one tokenizer version (of ``times`` documents
alike, where that column is there).  ``deltas`` turns a batch of changes into signed additive totals by source, language
and version: a revision takes the old count away and adds the new one.  ``Rollup`` keeps the committed batches in a
shared folder.  A batch is written under a name of its own and becomes visible by one rename to ``batch=<id>``, which
fails where that name exists, so of two writers one commits; a batch id that is there already is not applied again, so a
batch can be replayed after any failure.  (Where a store's rename is a copy, one writer at a time is needed.)  Totals are
the sums over the batches, whatever their order.  ``compact`` folds batches into one base that lists which it holds; a
base becomes visible by one rename too, and only then are the batches deleted, so totals are whole at any moment.

Null texts count as empty (0 tokens); null source and language are keys of their own.  Repeated rows in a batch are
separate documents.  An empty batch commits and changes nothing; keys whose documents all went disappear from the
totals.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, words

KEYS = ("source", "lang", "version")
SIGNED = ("docs", "tokens", "bytes")
SCHEMA = "source string, lang string, version string, docs long, tokens long, bytes long"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BPE = "byte_bpe_50k"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_counter(path: str = TOKENIZER, pattern: str | None = None):
    """A column function: BPE tokens of a text under the vocabulary file ``path`` (which every executor has)."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path, pattern)
        for b in batches:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in b], dtype="int64")

    return count


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """``changes`` (change, source, lang, version, tokens, bytes, old_tokens, old_bytes, and times if there is such a column)
    to signed totals by key.

    change: insert adds a document with tokens and bytes, delete takes one away, revise replaces old_* by the new."""
    kind = F.col("change")
    times = F.col("times") if "times" in changes.columns else F.lit(1)
    sign = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
    amount = lambda c: times * F.when(kind == "revise", F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"old_{c}"), F.lit(0))).otherwise(sign * F.coalesce(F.col(c), F.lit(0)))
    return changes.groupBy(*KEYS).agg(F.sum(times * sign).cast("long").alias("docs"), F.sum(amount("tokens")).cast("long").alias("tokens"), F.sum(amount("bytes")).cast("long").alias("bytes"))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(conf)
        self._fs.mkdirs(self._path(path))
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _named(self, kind: str) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}="))

    def _rename(self, source: str, target: str) -> bool:
        """False where the target exists; a folder is never moved into another."""
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._files.rename(self._path(source), self._path(target), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches it holds."""
        bases = self._named("base")
        if not bases:
            return None, set()
        base = f"{self.path}/base={bases[-1]}"
        return base, {r[0] for r in self.spark.read.schema("id string").parquet(f"{base}/held").collect()}  # a row a batch

    def batches(self) -> set[str]:
        """The ids of all batches that were committed, folded ones too."""
        return self._base()[1] | set(self._named("batch"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """True if the batch was applied now, False if it had been before."""
        if batch_id in self.batches():
            return False
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(staged)
        done = self._rename(staged, f"{self.path}/batch={batch_id}")
        if not done:
            self._fs.delete(self._path(staged), True)
        return done

    def _rows(self) -> tuple[DataFrame, set[str]]:
        base, held = self._base()
        loose = [b for b in self._named("batch") if b not in held]
        files = ([f"{base}/totals"] if base else []) + [f"{self.path}/batch={b}" for b in loose]
        rows = self.spark.read.schema(SCHEMA).parquet(*files) if files else self.spark.createDataFrame([], SCHEMA)
        return rows, held | set(loose)

    def compact(self) -> bool:
        """Folds the batches committed so far into the base; False if another writer folded at the same time."""
        rows, held = self._rows()
        bases = self._named("base")
        staged, target = f"{self.path}/_staged-{uuid.uuid4().hex}", f"{len(bases) and int(bases[-1]) + 1:012d}"
        rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SIGNED]).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(held)], "id string").write.parquet(f"{staged}/held")
        if not self._rename(staged, f"{self.path}/base={target}"):
            self._fs.delete(self._path(staged), True)
            return False
        for name in [f"batch={b}" for b in self._named("batch") if b in held] + [f"base={b}" for b in bases]:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens, bytes; a key with no documents left is not listed."""
        sums = self._rows()[0].groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SIGNED])
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0) | (F.col("bytes") != 0))


def counted(docs: DataFrame, counters: dict) -> DataFrame:
    """doc_id, same (a digest of the text), source, lang, bytes, and version, tokens for each tokenizer version."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = F.array(*[F.struct(F.lit(v).alias("version"), f(text).alias("tokens")) for v, f in counters.items()])
    rows = docs.select("doc_id", F.md5(text.cast("binary")).alias("same"), "source", "lang", F.octet_length(text).cast("long").alias("bytes"), each.alias("each"))
    return rows.select("doc_id", "same", "source", "lang", "bytes", F.inline("each"))


def _changes(kind: str, rows: DataFrame, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("long")
    given = {"old_tokens": none, "old_bytes": none, "times": F.lit(1)} | columns
    return rows.select(F.lit(kind).alias("change"), *KEYS, *[given.get(c, F.col(c)).cast("long").alias(c) for c in ("tokens", "bytes", "old_tokens", "old_bytes", "times")])


def copies(rows: DataFrame) -> DataFrame:
    """Deletes of all copies of a text but that of the least id.  Copies are counted by key first, so no group of copies is
    ever gathered; a text has no more rows after that than there are keys."""
    alike = rows.groupBy("same", *KEYS, "tokens", "bytes").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    first = F.row_number().over(Window.partitionBy("same", "version").orderBy(F.col("least").asc_nulls_last(), "source", "lang"))
    times = F.col("n") - F.when(F.col("first") == 1, 1).otherwise(0)
    return _changes("delete", alike.withColumn("first", first).where(times > 0), times=times)


def rollup_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The totals of distinct texts under both tokenizer versions, by three batches, each of them replayed: all documents
    with BPE counts estimated from their bytes, revisions of the estimates to what the tokenizer counts, and deletes of
    copies; then the batches are folded."""
    spark = docs.sparkSession
    store = Rollup(spark, fresh_path(spark, "rollup"))
    rows = cut(counted(docs, {"words": word_count, BPE: bpe_counter(tokenizer)}))
    estimate = F.when(F.col("version") == BPE, F.ceil(F.col("bytes") / 4)).otherwise(F.col("tokens"))
    batches = {
        "load": _changes("insert", rows, tokens=estimate),
        "recount": _changes("revise", rows.where(F.col("version") == BPE), old_tokens=estimate, old_bytes=F.col("bytes")),
        "copies": copies(rows),
    }
    for name, changes in batches.items():
        store.commit(name, changes)
        store.commit(name, changes)
    store.compact()
    return store.totals()
