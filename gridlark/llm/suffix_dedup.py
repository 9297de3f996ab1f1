"""Removal of repeated passages by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another.

Strings that are equal must meet in one suffix array.  So every window of ``length`` bytes gets an anchor: the place in
it where a hash of ``GRAM`` bytes is least.  Equal windows have equal anchors at equal offsets, and consecutive windows
share theirs, which makes a run of windows.  Runs whose anchor hash occurs once in the corpus cannot hold a repeated
window.  The segments of the other runs are dealt out by anchor hash, equal segments being counted and kept once; where
an anchor has very many runs, the run is cut into parts and dealt out by what all windows of the part share.  Where the
distinct segments of one key still have more bytes than an array may hold, each window goes by its own digest.  A task
concatenates its segments up to a bound and builds their suffix array by two-stage sorting: only suffixes smaller than
their successors are sorted directly, the others are induced by scanning the buckets of first bytes from the left.
The common prefixes of neighbours in the array are computed then; windows whose common prefix with a neighbour reaches
``length`` are repeated.

Null texts are empty; texts shorter than ``length`` keep everything.  Copies of one text (repeated rows included) are
handled once, and all of their windows are repeated.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_CODE, INV, cut, fixed_order_bound, id_or_none, mix, none_again, powers, small_batches

GRAM = 32
PLACE_BITS = 24  # of a window minimum; texts are read in pieces below 2 ** PLACE_BITS bytes
PIECE = 400_000
MAX_ARRAY = 1 << 21
U = np.uint64


# ---------------------------------------------------------------- suffix array


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is greater than its successor; the last one is."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # t[i] differs from t[i + 1]
    nxt = np.searchsorted(change, np.arange(n))
    greater = np.ones(n, dtype=bool)
    some = nxt < len(change)
    at = change[nxt[some]]
    greater[some] = t[at] > t[at + 1]
    return greater


def names(t: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the first 8, 24, 72, ... bytes of every suffix, up to the largest 8 * 3 ** i that is at most ``depth``."""
    padded = np.concatenate((t, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(len(t), np.uint64)
    for j in range(8):
        key = (key << U(8)) | padded[j : j + len(t)]
    d = 8
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    out = [rank.astype(np.uint32)]
    while 3 * d <= depth:
        ahead = np.concatenate((rank + U(1), np.zeros(2 * d, np.uint64)))
        key = (ahead[: len(t)] << U(42)) | (ahead[d : d + len(t)] << U(21)) | ahead[2 * d : 2 * d + len(t)]
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        out.append(rank.astype(np.uint32))
        d *= 3
    return out


def common_prefixes(t: np.ndarray, sa: np.ndarray, ranks: list[np.ndarray], depth: int) -> np.ndarray:
    """For each place in the array the length of the common prefix with the suffix before it, ``depth`` at most: steps of
    the sizes that have names, then the bytes in which the next eight agree."""
    out = np.zeros(len(sa), np.int32)
    if len(sa) < 2:
        return out
    begin = sa[1:].astype(np.int32)
    p, q = begin.copy(), sa[:-1].astype(np.int32)
    beyond = np.zeros(2 * depth + 64, np.uint32)  # no step leads further
    for i in range(len(ranks) - 1, -1, -1):
        d = 8 * 3**i
        rank = np.concatenate((ranks[i] + np.uint32(1), beyond))
        for _ in range(2 if i < len(ranks) - 1 else -(-depth // d)):
            step = (rank[p] == rank[q]) * np.int32(d)
            p += step
            q += step
    padded = np.concatenate((t, np.zeros(len(beyond) + 8, np.uint8))).astype(np.uint64)
    key = np.zeros(len(t) + len(beyond), np.uint64)
    for j in range(8):
        key = (key << U(8)) | padded[j : j + len(key)]
    differ = key[p] ^ key[q]
    for b in range(1, 8):
        p += differ < U(1 << 8 * b)
    out[1:] = np.minimum(p - begin, depth)
    return out


def suffix_array(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``t`` (under 2 ** 21 bytes) in the order of their first ``depth`` bytes, by two-stage sorting, and the
    length of the prefix that each shares with the one before, ``depth`` at most.  Beyond the end of ``t`` zero bytes are
    read."""
    n = len(t)
    assert n < MAX_ARRAY, n  # three ranks, and one more than the largest, fit a word
    greater = types(t)
    ranks = names(t, depth)
    rank, d = ranks[-1].astype(np.uint64), 8 * 3 ** (len(ranks) - 1)
    padded = np.concatenate((rank, np.zeros(depth, np.uint64)))
    # The name of the first ``depth`` bytes: the names of its first d and of its last d bytes (which overlap).
    whole = np.unique((rank << U(21)) | padded[depth - d : depth - d + n], return_inverse=True)[1] if d < depth <= 2 * d else rank
    if depth > 2 * d:
        parts = [padded[min(j, depth - d) :][:n] for j in range(0, depth, d)]
        whole = np.unique(np.stack(parts, axis=1), axis=0, return_inverse=True)[1].ravel()
    direct = np.flatnonzero(~greater)
    direct = direct[np.argsort(whole[direct], kind="stable")]
    ends = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        # Induced suffixes of this bucket come before the directly sorted ones; a run of one byte induces in waves.
        scan = [*waiting[c]]
        waiting[c] = []
        queue = [np.concatenate(scan)] if scan else []
        b = direct[ends[c] : ends[c + 1]]
        bucket = []
        while queue:
            wave = queue.pop()
            bucket.append(wave)
            before = wave[wave > 0] - 1
            before = before[greater[before] & (t[before] == c)]
            if len(before):
                queue.append(before)
        order = np.concatenate([*bucket, b]) if bucket or len(b) else b
        out.append(order)
        before = order[order > 0] - 1
        before = before[greater[before] & (t[before] > c)]
        if len(before):
            first = t[before]
            by = np.argsort(first, kind="stable")
            first, before = first[by], before[by]
            edges = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, edges):
                waiting[t[part[0]]].append(part)
    sa = np.concatenate(out) if out else np.zeros(0, np.int64)
    return sa, common_prefixes(t, sa, ranks, depth)


def repeated_windows(segments: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each segment which of its windows (len - length + 1) occur in another place, or in a segment that was kept
    for several (weight over 1)."""
    lens = np.array([len(s) for s in segments])
    starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
    t = np.frombuffer(b"".join(segments), np.uint8)
    sa, prefix = suffix_array(t, length)
    eligible = np.zeros(len(t) + 1, np.int8)
    np.add.at(eligible, starts, 1)
    np.add.at(eligible, starts + lens - length + 1, -1)
    eligible = np.cumsum(eligible[:-1]).astype(bool)
    # Equal windows are neighbours in the array with nothing but their equals between them.
    group = np.cumsum(prefix < length)
    ok = eligible[sa]
    sa, group = sa[ok], group[ok]
    count = np.bincount(group)
    hit = np.zeros(len(t), bool)
    hit[sa[count[group] > 1]] = True
    return [np.ones(n - length + 1, bool) if w > 1 else hit[s : s + n - length + 1] for s, n, w in zip(starts, lens, weights, strict=True)]


# ---------------------------------------------------------------- anchors


def runs_of(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, length: int):
    """For texts that lie in ``data``: text, first window, last window, anchor and anchor hash of every run of windows that
    share an anchor; places count from the text's start."""
    w = length - GRAM + 1
    m = len(data) - GRAM + 1
    if m < w:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)))))
    h = mix((total[GRAM:] - total[:-GRAM]) * powers(INV, m))
    low = U((1 << PLACE_BITS) - 1)
    key = (h & ~low) | np.arange(m, dtype=np.uint64)
    pad = -m % w
    blocks = np.concatenate((key, np.full(pad, ~U(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(lens)), np.maximum(lens - length + 1, 0))
    p = np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(starts, lens, strict=True) if n >= length] or [np.zeros(0, np.int64)])
    if not len(p):
        return text, p, p, p, np.zeros(0, np.uint64)
    a = anchor[p]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (a[1:] != a[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    text, s = text[first], starts[text[first]]
    return text, p[first] - s, p[last] - s, a[first] - s, h[a[first]]


def _pieces(texts: list[bytes], length: int):
    """(index, offset, bytes) of texts, long ones in overlapping pieces that hold every window once; in lists of bounded
    size."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            part = t[at : at + PIECE + length - 1]
            if held and size + len(part) > PIECE + length:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def _bytes(t) -> bytes:
    return t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""


def _anchors(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [_bytes(t) for t in b["text"]]
            ids, sigs = b["doc_id"].tolist(), b["sig"].tolist()
            for held in _pieces(texts, length):
                lens = np.array([len(x[2]) for x in held])
                starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
                text, p, q, a, h = runs_of(np.frombuffer(b"".join(x[2] for x in held), np.uint8), starts, lens, length)
                edges = np.searchsorted(text, np.arange(len(held) + 1))
                rows = []
                for k, (i, at, _) in enumerate(held):
                    s = slice(edges[k], edges[k + 1])
                    rows.append((ids[i], sigs[i], h[s].view(np.int64), (p[s] + at).astype(np.int32), (q[s] - p[s]).astype(np.int32), (a[s] - p[s]).astype(np.int32)))
                yield pd.DataFrame(rows, columns=["doc_id", "sig", "h", "p", "span", "a"])

    return run


def _segments(length: int, parts: int, content: bool):
    """Rows (doc_id, text and the runs' h, p, span, a, hot) to segments: with their bytes, or with the place they have in the document."""
    step = -(-(length - GRAM + 1) // parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for i, t, *runs in zip(b["doc_id"], b["text"], b["h"], b["p"], b["span"], b["a"], b["hot"], strict=True):
                t = _bytes(t)
                for h, p, span, a, hot in zip(*[r.tolist() for r in runs], strict=True):
                    if not hot:
                        cuts = [(p, p + span, None)]
                    else:  # windows by their anchor's offset; every window of a part holds the part's core
                        cuts, x, at = [], p, p + a
                        while x <= p + span:
                            near = (at - x) // step * step
                            far = min(near + step - 1, length - GRAM)
                            y = min(p + span, at - near)
                            cuts.append((x, y, hashlib.md5(t[at - near : at - far + length]).digest()))
                            x = y + 1
                    for x, y, core in cuts:
                        seg = t[x : y + length]
                        name = hashlib.md5(seg).digest()
                        key = h if core is None else int.from_bytes(core[:8], "little", signed=True) ^ h
                        out.append((name, key, seg) if content else (i, x, name))
                        size += len(seg)
                if size > 1_000_000:
                    yield pd.DataFrame(out, columns=["name", "key", "seg"] if content else ["doc_id", "p", "name"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["name", "key", "seg"] if content else ["doc_id", "p", "name"])

    return run


def _arrays(length: int, bound: int):
    """Rows sorted by key (name, key, n, seg) to (name, starts, ends): which windows of a segment are repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None

        def done() -> pd.DataFrame:
            rows = []
            for (name, _, _), hit in zip(held, repeated_windows([x[2] for x in held], [x[1] for x in held], length), strict=True):
                edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
                if hit.any():
                    rows.append((name, np.flatnonzero(edge == 1).astype(np.int32), (np.flatnonzero(edge == -1) - 1).astype(np.int32)))
            return pd.DataFrame(rows, columns=["name", "starts", "ends"])

        for b in batches:
            for name, key, n, seg in zip(b["name"], b["key"], b["n"], b["seg"], strict=True):
                if key != last and size > bound:
                    yield done()
                    held, size = [], 0
                last = key
                held.append((name, n, seg))
                size += len(seg)
        if held:
            yield done()

    return run


def _digests(length: int):
    """Segments (name, seg) to the digest of each of their windows: name, place, and the digest's halves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, size = [], 0
            for last, name, seg in zip(range(len(b) - 1, -1, -1), b["name"], b["seg"], strict=True):
                held.append((name, [hashlib.md5(seg[i : i + length]).digest() for i in range(len(seg) - length + 1)]))
                size += len(held[-1][1])
                if size > 20_000 or not last:
                    halves = np.frombuffer(b"".join(d for _, ds in held for d in ds), np.int64).reshape(-1, 2)
                    yield pd.DataFrame({"name": [n for n, ds in held for _ in ds], "at": np.concatenate([np.arange(len(ds), dtype=np.int32) for _, ds in held]), "a": halves[:, 0], "b": halves[:, 1]})
                    held, size = [], 0

    return run


def _by_window(segments: DataFrame, length: int) -> DataFrame:
    """Distinct segments (name, n, seg) to name, starts, ends, however many share a key: windows meet by digest."""
    digests = lambda rows: rows.select("name", "seg").mapInPandas(_digests(length), "name binary, at int, a bigint, b bigint")
    # A segment kept for several is repeated as a whole, and so is each of its windows in the others.
    kept, each = segments.where("n > 1"), digests(segments.where("n = 1"))
    again = each.select("a", "b").unionByName(digests(kept).select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b")
    hits = each.join(again, ["a", "b"]).groupBy("name").agg(F.sort_array(F.collect_list("at")).alias("w"))
    hits = hits.select("name", F.array_except("w", F.transform("w", lambda x: x + 1)).alias("starts"), F.array_except("w", F.transform("w", lambda x: x - 1)).alias("ends"))
    return hits.unionByName(kept.select("name", F.array(F.lit(0)).alias("starts"), F.array(F.octet_length("seg") - length).alias("ends")))


def _remove(length: int):
    """Rows (doc_id, text, sig, windows, everything) to the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, starts, ends, everything in zip(b["doc_id"], b["text"], b["starts"], b["ends"], b["everything"], strict=True):
                t = _bytes(t)
                spans = []
                if everything and len(t) >= length:
                    spans = [(0, len(t))]
                elif starts is not None:
                    for x, y in sorted((int(x), int(y) + length) for x, y in zip(starts, ends, strict=True)):
                        if spans and x <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], y))
                        else:
                            spans.append((x, y))
                digest, at = hashlib.sha256(), 0
                for x, y in spans:
                    digest.update(t[at:x])
                    at = y
                digest.update(t[at:])
                rows.append((i, len(t), sum(y - x for x, y in spans), len(spans), digest.hexdigest(), [x for x, _ in spans], [y for _, y in spans]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, hot_runs: int = 5000, parts: int = 8, array_bytes: int = 350_000, key_bytes: int = 1_500_000, max_broadcast: int = 200_000) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends (byte offsets)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(id_or_none("doc_id"), "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("sig"))
    copies = cut(docs.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    found = cut(docs.where(F.octet_length("text") >= length).mapInPandas(_anchors(length), "doc_id bigint, sig string, h array<bigint>, p array<int>, span array<int>, a array<int>"))
    reps = copies.select("sig", F.col("rep").alias("doc_id"))
    runs = found.join(reps, ["sig", "doc_id"]).select("doc_id", F.explode(F.arrays_zip("h", "p", "span", "a")).alias("r")).select("doc_id", "r.*")
    place = F.xxhash64("doc_id", "p")
    again = runs.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("n")).where("x <> y")
    # Only keys of anchors with many runs can exceed key_bytes: a run has fewer than 2 * length bytes.
    hot, many = F.col("n") > hot_runs, F.col("n") > key_bytes // (2 * length)
    again = cut(again.select("h", hot.alias("hot"), (hot | many).alias("many")))
    # Hot anchors are few (one for hot_runs runs at most) and are joined without a shuffle by anchor, which spares one task
    # all runs of an anchor; their rows are dealt by place in the join of the others.
    few = again.where("hot").select(F.col("h").alias("hot_h"))
    held = runs.join(fixed_order_bound(few, few.count(), max_broadcast), F.col("h") == F.col("hot_h"), "left")
    held = held.withColumn("by", F.when(F.col("hot_h").isNull(), F.col("h")).otherwise(F.xxhash64("h", "doc_id", "p")))
    usual = again.where("NOT hot").select(F.col("h").alias("by"), F.col("h").alias("cold_h"), "many")
    held = held.join(usual, "by", "left").where("hot_h IS NOT NULL OR cold_h = h")
    held = held.select("doc_id", "h", "p", "span", "a", F.col("hot_h").isNotNull().alias("hot"), (F.col("hot_h").isNotNull() | F.coalesce("many", F.lit(False))).alias("many"))
    chosen = cut(held.groupBy("doc_id").agg(F.collect_list(F.struct("h", "p", "span", "a", "hot", "many")).alias("r")).select("doc_id", "r.h", "r.p", "r.span", "r.a", "r.hot", "r.many"))
    chosen_rows, chosen_runs, any_many = chosen.agg(F.count("*"), F.coalesce(F.sum(F.size("h")), F.lit(0)), F.max(F.array_contains("many", True))).first()
    texts = docs.drop("sig").join(fixed_order_bound(chosen, chosen_runs, max_broadcast), "doc_id").select("doc_id", "text", "h", "p", "span", "a", "hot", "many")
    heavy = texts.where(F.array_contains("many", True)).withColumn("r", F.filter(F.arrays_zip("h", "p", "span", "a", "hot", "many"), lambda r: r["many"])).select("doc_id", "text", "r.h", "r.p", "r.span", "r.a", "r.hot")
    texts = texts.drop("many")
    cut_up = lambda rows: rows.mapInPandas(_segments(length, parts, True), "name binary, key bigint, seg binary")
    segments = cut_up(texts)
    segments = segments.groupBy("key", "name").agg(F.first("seg").alias("seg"), F.count("*").alias("n"))
    if array_bytes + 2 * length + key_bytes >= MAX_ARRAY:
        raise ValueError("array_bytes and key_bytes exceed what one array can hold")
    n_parts = max(2 * spark.sparkContext.defaultParallelism, chosen_rows // 2000)
    n_over = 0
    if any_many:
        sizes = cut_up(heavy).groupBy("key", "name").agg(F.max(F.octet_length("seg")).alias("size"))
        over = cut(sizes.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > key_bytes).select("key"))
        n_over = over.count()
    small = segments.join(fixed_order_bound(over, n_over, max_broadcast), "key", "left_anti") if n_over else segments
    arrays = small.repartition(n_parts, "key").sortWithinPartitions("key").mapInPandas(_arrays(length, array_bytes), "name binary, starts array<int>, ends array<int>")
    if n_over:
        large = cut_up(heavy).join(fixed_order_bound(over, n_over, max_broadcast), "key", "left_semi")
        arrays = arrays.unionByName(_by_window(cut(large.groupBy("key", "name").agg(F.first("seg").alias("seg"), F.count("*").alias("n"))), length))
    arrays = arrays.groupBy("name").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    places = texts.mapInPandas(_segments(length, parts, False), "doc_id bigint, p int, name binary")
    windows = places.join(arrays, "name").select("doc_id", "p", F.explode(F.arrays_zip("starts", "ends")).alias("w"))
    windows = windows.groupBy("doc_id").agg(F.collect_list(F.struct((F.col("p") + F.col("w.starts")).alias("s"), (F.col("p") + F.col("w.ends")).alias("e"))).alias("w"))
    marked = copies.withColumnRenamed("rep", "doc_id").join(windows, "doc_id", "left").where("copies > 1 OR w IS NOT NULL")
    marked = cut(marked.select("sig", F.col("w.s").alias("starts"), F.col("w.e").alias("ends"), (F.col("copies") > 1).alias("everything")))
    full = docs.join(fixed_order_bound(marked, marked.count(), max_broadcast), "sig", "left").select("doc_id", "text", "starts", "ends", "everything")
    out = full.mapInPandas(_remove(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, span_starts array<bigint>, span_ends array<bigint>")
    return out.withColumn("doc_id", none_again("doc_id"))
