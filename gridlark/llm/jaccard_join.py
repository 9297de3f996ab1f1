"""N-gram Jaccard self join with a token-group matrix.

A text's tokens are the hashes of its runs of ``k`` words.  Texts with equal token sets are one set.  Similar sets are
partitioned into groups: by a minimum hash first, then each is held against the leader of its hash, and those that link
with it are its group; those half as similar form groups of their own, and any other is a group alone.  In a common
order of all tokens (rare ones first) two sets that are similar enough must share one of the first
``n - ceil(t * n) + 1`` tokens of each; the matrix stores for each group the union of its sets' such tokens, with the
range of their sizes, so the overlap of a query with a group is bounded from above: by zero where it has none of the
union's tokens, and by the sizes.  Only pairs of groups whose
bound allows a link are opened, in blocks: a large group's sets against chunks of all sets that ask for it.  Links are
verified on whole token sets, so none is lost or invented, and connected components are built from them.  No links are
listed between sets that are known to be connected.

The order of tokens puts those of many documents last; it is counted over all documents, and only the most frequent
(``max_frequent`` at most, the bound of what is broadcast) take part in it.  It decides speed, not the result.

Null and blank texts have no tokens and link with nothing; with fewer than ``k`` words the whole sequence is the one
token.  Repeated rows are equal sets.  All null ids are one id.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, fixed_order_bound, free_name, id_or_none, mix, none_again, shingle_hashes, small_batches
from .graph import connected

U = np.uint64
LEVELS = [3 * 2**i for i in range(40)]


def _bits(n: int) -> int:
    return max(6, int(n // 4096).bit_length())


def _order_key(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` + 32 bits of a token: what frequencies are counted by."""
    return tokens >> U(32 - bits)


def _by_bucket(tokens: np.ndarray, bits: int):
    """(bucket, slice) of sorted tokens by their first bits."""
    edges = np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits))
    edges = np.concatenate(([0], edges, [len(tokens)]))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), slice(edges[b], edges[b + 1])


def frequent_tokens(docs: DataFrame, k: int, bits: int, max_frequent: int) -> np.ndarray:
    """Sorted order keys of the tokens in most documents, ``max_frequent`` at most."""
    import zlib

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush():
            tokens = np.sort(np.concatenate(held))
            rows = []
            for b, s in _by_bucket(tokens, bits):
                low = (_order_key(tokens[s], bits) & U(0xFFFFFFFF)).astype(np.uint32)
                gaps = np.diff(low, prepend=np.uint32(0)).astype(np.uint32)
                rows.append((b, zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)))
            held.clear()
            return pd.DataFrame(rows, columns=["bucket", "blob"])

        n = 0
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_hashes(part["text"], k)
                held += sets
                n += sum(map(len, sets))
                if n > 2_000_000:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def count(p: pd.DataFrame) -> pd.DataFrame:
        each = []
        for blob in p["blob"]:
            planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
            each.append(np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint32), dtype=np.uint32))
        low = np.sort(np.concatenate(each))
        first = np.flatnonzero(np.diff(low, prepend=low[0] + np.uint32(1)))
        df = np.diff(np.append(first, len(low)))
        kept = df >= LEVELS[0]
        hist = [int((df >= x).sum()) for x in LEVELS]
        return pd.DataFrame({"bucket": [p["bucket"].iloc[0]], "hist": [hist], "low": [low[first][kept].tobytes()], "df": [df[kept].astype(np.int64).tobytes()]})

    blobs = docs.select("text").mapInPandas(spread, "bucket int, blob binary")
    counted = cut(blobs.groupBy("bucket").applyInPandas(count, "bucket int, hist array<bigint>, low binary, df binary"))
    hist = counted.agg(*[F.sum(F.get("hist", F.lit(i))).alias(f"h{i}") for i in range(len(LEVELS))]).first()
    level = next((x for x, n in zip(LEVELS, hist, strict=True) if (n or 0) <= max_frequent), LEVELS[-1])

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = [((np.frombuffer(low, np.uint32)[np.frombuffer(df, np.int64) >= level].astype(np.uint64)) | (U(b) << U(32))).tobytes() for b, low, df in zip(p["bucket"], p["low"], p["df"], strict=True)]
            yield pd.DataFrame({"keys": out})

    rows = counted.select("bucket", "low", "df").mapInPandas(frequent, "keys binary").collect()  # 8 * max_frequent bytes at most
    out = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r[0], np.uint64) for r in rows]])
    out.sort()
    return out


def _features(k: int, percent: int, bits: int, shared):
    """For each document its size, the hash of its set, a minimum hash and the order keys of its first tokens."""
    width = _key_bytes(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare_last = shared.value
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_hashes(part["text"], k)
                lens = np.array([len(s) for s in sets])
                tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
                key = _order_key(tokens, bits)
                at = np.minimum(np.searchsorted(rare_last, key), max(len(rare_last) - 1, 0))
                often = rare_last[at] == key if len(rare_last) else np.zeros(len(tokens), bool)
                other = mix(tokens ^ U(0xD1B54A32D192ED03))
                begin = np.concatenate(([0], np.cumsum(lens)))
                sigs, gkeys, spare, prefixes = [], np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), []
                for i, s in enumerate(sets):
                    n = len(s)
                    sigs.append(hashlib.md5(s.tobytes()).hexdigest())
                    o = often[begin[i] : begin[i + 1]]
                    g = other[begin[i] : begin[i + 1]]
                    own = key[begin[i] : begin[i + 1]]
                    p = n - -(-n * percent // 100) + 1
                    first = own[~o][:p]
                    if len(first) < p:
                        first = np.sort(np.concatenate([first, own[o][: p - len(first)]]))
                    prefixes.append(first.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
                    if n:
                        common = int(o.sum())
                        gkeys[i] = (g[o] if 2 * common >= n else g).min().astype(np.int64)
                        spare[i] = n - 2 * common
                yield pd.DataFrame({"doc_id": part["doc_id"], "n": lens, "sig": sigs, "gkey": gkeys, "spare": spare, "prefix": prefixes})

    return run


_FEATURES = "doc_id bigint, n bigint, sig string, gkey bigint, spare bigint, prefix binary"


def _key_bytes(bits: int) -> int:
    return (bits + 39) // 8


def _matrix(bits: int):
    """Rows of sets (cluster, n, prefix) to rows of the matrix: for a bucket of tokens, which clusters have them."""
    width = _key_bytes(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunks(batch, "prefix", 2_000_000):
                raw = np.frombuffer(b"".join(part["prefix"]), np.uint8).reshape(-1, width)
                keys = np.zeros((len(raw), 8), np.uint8)
                keys[:, :width] = raw
                keys = keys.view(np.uint64).ravel()
                doc = np.repeat(np.arange(len(part)), part["prefix"].str.len().to_numpy() // width)
                order = np.argsort(keys, kind="stable")
                keys, doc = keys[order], doc[order]
                cluster, n = part["cluster"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
                rows = []
                for b, s in _by_bucket(keys << U(32 - bits), bits):
                    used, local = np.unique(doc[s], return_inverse=True)
                    rows.append((b, (keys[s] & U(0xFFFFFFFF)).astype(np.uint32).tobytes(), local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), cluster[used].tobytes(), n[used].tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "tokens", "places", "clusters", "sizes"])

    return run


_MATRIX = "bucket int, tokens binary, places binary, clusters binary, sizes binary"


def _group_pairs(percent: int):
    """The matrix's rows of one bucket of tokens to the pairs of groups that share a token and whose sizes allow a link."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        tokens, groups, sizes = [], [], []
        for t, i, g, n in zip(p["tokens"], p["places"], p["clusters"], p["sizes"], strict=True):
            t = np.frombuffer(t, np.uint32)
            i = np.frombuffer(i, np.uint16 if len(i) == 2 * len(t) else np.uint32)
            tokens.append(t)
            groups.append(np.frombuffer(g, np.int64)[i])
            sizes.append(np.frombuffer(n, np.int64)[i])
        t, g, n = np.concatenate(tokens), np.concatenate(groups), np.concatenate(sizes)
        _, t, c = np.unique(t, return_inverse=True, return_counts=True)
        many = c[t] > 1
        t, g, n = t[many], g[many], n[many]
        order = np.lexsort((g, t))
        t, g, n = t[order], g[order], n[order]
        if not len(t):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        # one entry for each token and group, with the range of sizes
        new = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.concatenate(([True], g[1:] != g[:-1]))))
        lo, hi, t, g = np.minimum.reduceat(n, new), np.maximum.reduceat(n, new), t[new], g[new]
        edges = np.append(np.flatnonzero(np.diff(t, prepend=-1)), len(t))
        out: set[tuple[int, int]] = set()
        arrays = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for i in range(a, b - 1):
                fits = (percent * lo[i + 1 : b] <= 100 * hi[i]) & (percent * lo[i] <= 100 * hi[i + 1 : b])
                j = g[i + 1 : b][fits]
                if len(j) <= 4:
                    out.update((int(g[i]), int(x)) for x in j)
                else:
                    arrays.append(np.stack([np.full(len(j), g[i]), j], axis=1))
        pairs = np.concatenate([np.array(sorted(out), dtype=np.int64).reshape(-1, 2), *arrays])
        pairs = np.unique(pairs, axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _linked(inter, n, m, percent: int):
    return 100 * inter >= percent * (n + m - inter)


def _star(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for s, t in zip(p["tokens"], p["leader_tokens"], strict=True):
                a, b = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                inter = int((b[at] == a).sum())
                ok.append(2 if _linked(inter, len(a), len(b), percent) else 1 if _linked(inter, len(a), len(b), percent // 2) else 0)
            yield p[["rep", "leader"]].assign(near=ok)

    return run


def _open_unit(sides: np.ndarray, reps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between side 0 and side 1 (or, where a set is in both, itself left out), as a spanning forest."""
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    lens = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lens)
    _, inv, count = np.unique(tokens, return_inverse=True, return_counts=True)
    several = count > 1
    col = np.cumsum(several) - 1
    keep = several[inv]
    width = int(several.sum())
    inter = np.zeros((len(left), len(right)), np.int64)
    row, c = owner[keep], col[inv[keep]]
    place = np.full(len(sets), -1)
    place[left] = np.arange(len(left))
    other = np.full(len(sets), -1)
    other[right] = np.arange(len(right))
    for a in range(0, width, 8192):
        z = min(8192, width - a)
        part = (c >= a) & (c < a + z)
        x, y = np.zeros((len(left), z), np.float32), np.zeros((len(right), z), np.float32)
        r, d = row[part], c[part] - a
        x[place[r[place[r] >= 0]], d[place[r] >= 0]] = 1
        y[other[r[other[r] >= 0]], d[other[r] >= 0]] = 1
        inter += (x @ y.T).astype(np.int64)
    ok = _linked(inter, lens[left][:, None], lens[right][None, :], percent) & (reps[left][:, None] != reps[right][None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        u, v = int(reps[left[i]]), int(reps[right[j]])
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((u, v))
    return edges


def _open(percent: int):
    """Rows sorted by unit to the links in each unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, []

        def done() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            return _open_unit(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], percent)

        for p in batches:
            out = []
            for unit, side, rep, s in zip(p["unit"], p["side"], p["rep"], p["tokens"], strict=True):
                if unit != name:
                    out += done()
                    name, held = unit, []
                held.append((side, rep, np.frombuffer(s, np.uint64)))
            yield pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)
        yield pd.DataFrame(done(), columns=["u", "v"], dtype=np.int64)

    return run


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, max_broadcast: int = 500_000, **options) -> DataFrame:
    """``docs`` with one document of each component, that of the least id; texts without words all stay."""
    found = components(docs, k, percent, **options)
    i = free_name(docs, "kept_id")
    kept = cut(found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).groupBy(F.col("doc_id").alias(i)).agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n")))
    n, repeated = kept.agg(F.count("*"), F.coalesce(F.max(F.when((F.col("n") > 0) & F.col(i).isNotNull(), F.col("rows"))), F.lit(0))).first()
    out = docs.join(fixed_order_bound(kept.select(i), n, max_broadcast), F.col("doc_id").eqNullSafe(F.col(i)), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if repeated > 1 else out


def components(docs: DataFrame, k: int = 4, percent: int = 85, block: int = 128, max_frequent: int = 4_000_000, max_broadcast: int = 500_000) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_shingles, component_id: the least id reachable by links of which each
    joins two sets with 100 * intersection >= ``percent`` * union."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(id_or_none("doc_id"), "text")
    n_docs = docs.count()
    bits = _bits(n_docs)
    shared = spark.sparkContext.broadcast(frequent_tokens(docs, k, bits, max_frequent))
    feats = cut(docs.mapInPandas(_features(k, percent, bits, shared), _FEATURES))
    shared.destroy()  # what it was for is written
    each = feats.select("doc_id", "n", "sig")
    least = F.min(F.struct("doc_id", "n", "gkey", "spare"))
    reps = cut(feats.where("n > 0").groupBy("sig").agg(least.alias("r")).select("sig", F.col("r.doc_id").alias("rep"), "r.gkey", "r.spare"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """``wanted`` (rep, ...) with each set's tokens, from the texts."""
        named = wanted.select(F.col("rep").alias("doc_id"), F.struct(*[c for c in wanted.columns]).alias("w"))
        found = docs.join(fixed_order_bound(named, wanted.count(), max_broadcast), "doc_id").select("text", "w.*")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for p in chunks(b):
                    yield p.drop(columns="text").assign(tokens=[s.tobytes() for s in shingle_hashes(p["text"], k)])

        return found.mapInPandas(run, f"{kinds}, tokens binary")  # an id that is repeated gives its set again, which is harmless

    # Every group's sets against its leader: what links with it is a cluster, any other set is one of its own.
    groups = reps.groupBy("gkey").agg(F.count("*").alias("members"), F.min(F.struct("spare", "rep")).alias("best"))
    groups = cut(groups.where("members > 1").select("gkey", F.col("best.rep").alias("leader")))
    grouped = cut(reps.select("rep", "gkey").join(fixed_order_bound(groups, groups.count(), max_broadcast), "gkey").select("rep", "leader"))
    leaders = sets_of(grouped.where("rep = leader")).select("leader", F.col("tokens").alias("leader_tokens"))
    held = sets_of(grouped.where("rep <> leader")).join(leaders, "leader").select("rep", "leader", "tokens", "leader_tokens")
    near = cut(held.mapInPandas(_star(percent), "rep bigint, leader bigint, near int").where("near > 0").distinct())
    core = near.where("near = 2").select("rep", "leader")
    # Sets of the leader's kind that do not link with it are groups of up to ``block``, so that many of them are few groups.
    loose = near.where("near = 1").select("rep", "leader")
    blocked = loose.join(loose.groupBy("leader").agg(F.count("*").alias("members")), "leader").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / block)))
    named = blocked.groupBy("leader", "block").agg(F.min("rep").alias("cluster"))
    kin = cut(core.withColumnRenamed("leader", "cluster").unionByName(blocked.join(named, ["leader", "block"]).where("rep <> cluster").select("rep", "cluster")))
    clusters = reps.select("rep").join(kin, "rep", "left").select(F.col("rep").alias("doc_id"), F.coalesce("cluster", "rep").alias("cluster"))
    clustered = feats.where("n > 0").select("doc_id", "n", "prefix").join(clusters, "doc_id").select("cluster", "n", "prefix")
    matrix = clustered.mapInPandas(_matrix(bits), _MATRIX)
    pairs = matrix.groupBy("bucket").applyInPandas(_group_pairs(percent), "a bigint, b bigint").distinct()
    # Each pair of clusters is opened as blocks of the larger one against chunks of all its partners' sets.
    sizes = kin.groupBy("cluster").agg((F.count("*") + 1).alias("members"))
    within = blocked.join(named, ["leader", "block"]).select(F.col("cluster").alias("a"), F.col("cluster").alias("b")).distinct()
    pairs = pairs.unionByName(within)
    sized = lambda g: sizes.select(F.col("cluster").alias(g), F.col("members").alias(f"{g}_members"))
    pairs = pairs.join(sized("a"), "a", "left").join(sized("b"), "b", "left").select("a", "b", F.coalesce("a_members", F.lit(1)).alias("m"), F.coalesce("b_members", F.lit(1)).alias("o"))
    larger = (F.col("m") > F.col("o")) | ((F.col("m") == F.col("o")) & (F.col("a") < F.col("b")))
    x, y = F.when(larger, F.col("a")).otherwise(F.col("b")), F.when(larger, F.col("b")).otherwise(F.col("a"))
    pairs = cut(pairs.select(x.alias("x"), y.alias("y"), F.greatest("m", "o").alias("x_members"), F.least("m", "o").alias("y_members")))
    used = pairs.select(F.col("x").alias("cluster")).union(pairs.select(F.col("y").alias("cluster"))).distinct()
    wanted = cut(kin.join(used, "cluster").select("rep", "cluster").unionByName(used.select(F.col("cluster").alias("rep"), "cluster")))
    opened = cut(sets_of(wanted))
    partners = pairs.groupBy("x", "x_members").agg(F.sum("y_members").alias("partners"))
    n_blocks, n_chunks = F.ceil(F.col("x_members") / block), F.ceil(F.col("partners") / block)
    blocks = partners.select("x", "partners", n_blocks.alias("blocks"), n_chunks.alias("chunks"))
    each_block = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    first = opened.join(each_block, F.col("cluster") == F.col("x")).select("x", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "chunk", F.lit(0).alias("side"), "rep", "tokens")
    asked = pairs.select("x", "y").join(blocks, "x").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    second = opened.join(asked, F.col("cluster") == F.col("y")).select("x", "block", F.pmod(F.xxhash64("rep"), "chunks").alias("chunk"), F.lit(1).alias("side"), "rep", "tokens")
    rows = first.unionByName(second).select(F.concat_ws(":", "x", "block", "chunk").alias("unit"), "side", "rep", "tokens")
    n_parts = max(spark.sparkContext.defaultParallelism * 2, n_docs // 8192)
    found = rows.repartition(n_parts, "unit").sortWithinPartitions("unit").mapInPandas(_open(percent), "u bigint, v bigint")
    ends = connected(core.select(F.col("rep").alias("u"), F.col("leader").alias("v")).unionByName(found))
    named = reps.select("sig", "rep").join(ends.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    out = each.join(named, "sig", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.select(none_again("doc_id"), "n_shingles", none_again("component_id"))
