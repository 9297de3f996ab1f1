"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that parts words, as a regex class body and as the characters.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """The runs of non-space characters of ``c``, in order; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none it is a temporary one if all run in one
    process, else one of the warehouse, which a cluster shares."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = sc._jsc.sc().getCheckpointDir()
        at = got.get() if got.isDefined() else None
    if not at:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        at = "file://" + tempfile.mkdtemp(prefix="gridlark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Python workers are to get ``rows`` whole texts at a time at most, so that batches take a few MB on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Stands for a null id in Python, where whole numbers have no null; it is the largest, so it never names a group.
NO_ID = 2**63 - 1


def id_or_none(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(NO_ID)).alias(name)


def none_again(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of shuffle files that no plan in use needs: Spark removes them once the driver has collected what names them,
    which it would do some day anyway.  Nothing but disk depends on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- numpy hashing

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: One random odd word for each byte value: hashes of byte strings sum these times powers of BASE.
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2, ... (``n`` of them, modulo 2 ** 64); what was computed is kept."""
    got = _POWERS.get(int(base))
    if got is None or len(got) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        got = _POWERS[int(base)] = np.multiply.accumulate(out)
    return got[:n]


def joined(texts, gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (None: empty) in one array, ``gap`` spaces after each; starts and lengths."""
    raw = [b"" if t is None or t != t else (t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")) for t in texts]
    lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    starts = np.concatenate(([0], np.cumsum(lens + gap)))[:-1] if len(raw) else np.zeros(0, np.int64)
    return np.frombuffer((b" " * gap).join(raw) + b" " * gap, dtype=np.uint8), starts, lens


def word_places(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where in them each word begins and ends, and the index in the words where each text begins
    (one more entry at the end)."""
    data, starts, lens = joined(texts)
    if lower:
        data = _LOWER[data]
    edge = np.diff(np.concatenate(([True], _IS_SPACE[data])).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return data, begin, end, np.append(np.searchsorted(begin, starts), len(begin))


def hashes_at(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(begin) == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=total[1:])
    h = (total[end] - total[begin]) * powers(INV, len(data))[begin]
    return mix(h ^ (end - begin).astype(np.uint64))


def word_hashes(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, in order, and the index in them where each text begins (one more
    entry at the end)."""
    data, begin, end, at = word_places(texts, lower)
    return hashes_at(data, begin, end), at


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of hashes in their order, equal ones by place; the hashes in that order; and where in it each begins."""
    low = U((1 << len(h).bit_length()) - 1)
    mixed = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))  # quicker than to sort places by hashes
    order = (mixed & low).view(np.int64)
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))[: len(h)]
    mixed &= ~low
    if np.count_nonzero(new[1:]) != np.count_nonzero(mixed[1:] != mixed[:-1]):  # some differ in their last bits only
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
    return order, s, new


def distinct_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, the first place of each, and which of them each is."""
    order, s, new = grouped(h)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return s.compress(new), order.compress(new), which  # quicker than s[new]


def shingle_hashes(texts, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words; of the whole sequence where it is shorter;
    none where it has no words."""
    h, at = word_hashes(texts)
    out = []
    m = len(h) - k + 1
    mixed = np.zeros(max(m, 0), np.uint64)
    if m > 0:
        for j in range(k):
            mixed = mix(mixed * U(31) + h[j : j + m])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(mixed[a : b - k + 1]))
        elif b > a:
            x = U(0)
            with np.errstate(over="ignore"):
                for j in range(a, b):
                    x = mix(np.array([x * U(31) + h[j]], dtype=np.uint64))[0]
                out.append(mix(np.array([x + U(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def chunks(b, column: str = "text", limit: int = 1_000_000):
    """Row slices of a pandas frame whose texts have about ``limit`` characters together; a longer text stands alone."""
    size = np.fromiter((len(t) if isinstance(t, (str, bytes)) else 0 for t in b[column]), dtype=np.int64, count=len(b))
    part = np.cumsum(size) // limit
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(b)]))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j > i:
            yield b.iloc[i:j]


def fixed_order_bound(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``limit`` rows, else joined by a shuffle."""
    return F.broadcast(df) if rows <= limit else df
