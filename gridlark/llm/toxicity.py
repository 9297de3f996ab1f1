"""Toxicity by a convolutional text classifier, trained here in numpy.

Words (runs of ASCII letters, digits and non-ASCII characters, lower-cased) become vectors: the sum of hashed
embeddings of the word and of its first 4 and 6 bytes, so that unseen endings of a known stem are known.  Filters of
several widths run over the sequence, each keeps its largest value in the text, and a linear layer gives a logit.  The
threshold is calibrated for each language on training rows that the weights were not fitted to, and the logit is
shifted by it, so that a score of 0.5 is the threshold everywhere.  The language is told from the text's own function
words; the table's language, source, id and labels are no inputs of a score.

All labelled rows count: four of five (by a hash of their id) fit the weights, the fifth sets the thresholds.  Learners
on executors, as many as the rows ask for, read their rows in a hash order; after each pass their weights are merged, each
weight as the mean over the learners that moved it, and all go on from there.  The thresholds come from counts of the
fifth's logits in steps of 1/64, summed over all tasks.  Every whole text is scored, in batches of a bounded number of
bytes.

Null and empty texts have no words and get the score of an empty sequence.  Repeated rows each get their row; of
repeated labels of one id the larger counts; null labels are ignored.  Without labelled rows every score is the prior
0.0.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, BASE, BYTE_CODE, INV, chunks, cut, delete_path, fixed_order_bound, fresh_path, joined, mix, powers, small_batches

BITS, DIM, FILTERS, WIDTHS = 16, 12, 8, (1, 2, 3)
PAD = max(WIDTHS)
FOLDS = 5
#: Parts of the weights that are merged by themselves.
PIECES = 32
#: Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with are this from not have be by at which",
    "de": "der die das und ist nicht ein eine mit auf den von zu dem des sich für im auch",
    "fr": "le les des et est dans une pour que qui pas sur au du avec ce plus par sont",
    "es": "el los las que y del por con una para es en lo como más su al no se",
}
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (words, 3) of every word, of its first 4 and of its first 6 bytes; where each text begins."""
    data, starts, _ = joined(texts)
    data = _LOWER[data]
    edge = np.diff(np.concatenate(([False], _WORD[data])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)))))
    back = powers(INV, len(data))[begin] if len(begin) else np.zeros(0, np.uint64)
    cuts = (end, np.minimum(begin + 4, end), np.minimum(begin + 6, end))
    out = np.stack([mix((total[c] - total[begin]) * back + np.uint64(j)) for j, c in enumerate(cuts)], axis=1)
    return out, np.append(np.searchsorted(begin, starts), len(begin))


def features_in_parts(texts: list[str], limit: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The same for many texts, without arrays of all their bytes."""
    feats, at = [np.zeros((0, 3), np.uint64)], [np.zeros(1, np.int64)]
    for part in chunks(pd.DataFrame({"text": texts}), limit=limit):
        f, a = features(part["text"])
        feats.append(f)
        at.append(a[1:] + at[-1][-1])
    return np.concatenate(feats), np.concatenate(at)


_LANGUAGE = {int(features([w])[0][0, 0]): k for k, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split()}
_LANGUAGE_KEYS = np.array(sorted(_LANGUAGE), dtype=np.uint64)
_LANGUAGE_VALUES = np.array([_LANGUAGE[int(x)] for x in _LANGUAGE_KEYS])


def languages(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text the language whose function words are most frequent; the number of languages where none occur."""
    n, k = len(at) - 1, len(FUNCTION_WORDS)
    i = np.minimum(np.searchsorted(_LANGUAGE_KEYS, words), len(_LANGUAGE_KEYS) - 1)
    hit = np.flatnonzero(_LANGUAGE_KEYS[i] == words)
    doc = np.searchsorted(at, hit, "right") - 1
    counts = np.bincount(doc * k + _LANGUAGE_VALUES[i[hit]], minlength=n * k).reshape(n, k)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), k)


class Model:
    """Weights; ``shift`` has a threshold for each language and one for texts of none."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
        self.conv = [r.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.const = np.array([-0.5], np.float32)
        self.shift = np.zeros(len(FUNCTION_WORDS) + 1)
        self.fitted = False

    def vectors(self, feats: np.ndarray) -> np.ndarray:
        i = (feats & np.uint64((1 << BITS) - 1)).astype(np.int64)
        return self.emb[i[:, 0]] + self.emb[i[:, 1]] + self.emb[i[:, 2]]

    def pooled(self, feats: np.ndarray, at: np.ndarray, argmax: bool = False):
        """The largest value of every filter in every text, and if asked for its place in the padded sequence."""
        n = len(at) - 1
        # One vector for each distinct word; texts are parted by PAD words whose vector is zero (row 0).
        _, first, which = np.unique(feats[:, 0], return_index=True, return_inverse=True)
        x = np.vstack([np.zeros((1, DIM), np.float32), self.vectors(feats[first])])
        lens = np.diff(at) + PAD
        begin = np.concatenate(([0], np.cumsum(lens)))
        seq = np.zeros(begin[-1] + PAD, np.int32)
        seq[np.arange(len(feats)) + np.repeat(np.arange(n) * PAD, np.diff(at))] = which + 1
        tops, places = [], []
        for w, b in zip(self.conv, self.bias, strict=True):
            total = (x @ w[0])[seq[: begin[-1]]]
            for j in range(1, len(w)):
                total += (x @ w[j])[seq[j : j + begin[-1]]]
            for j in range(1, PAD):
                total[begin[1:] - j] = 0  # windows that would reach into the next text; those of padding alone are 0
            top = np.maximum.reduceat(total, begin[:-1], axis=0)
            if argmax:
                doc = np.repeat(np.arange(n), lens)
                places.append(np.stack([_first(total[:, f] == top[doc, f], begin) for f in range(FILTERS)], axis=1))
            tops.append(np.maximum(top + b, 0))
        return (np.hstack(tops), places, seq, x, first) if argmax else np.hstack(tops)

    def logits(self, texts) -> np.ndarray:
        """Logits less the threshold of each text's language."""
        if not self.fitted:
            return np.full(len(texts), -np.inf)
        feats, at = features(texts)
        return self.raw(feats, at) - self.shift[languages(feats[:, 0], at)]

    def raw(self, feats: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(feats, at).astype(np.float64) @ self.out + float(self.const[0])


def _first(hit: np.ndarray, begin: np.ndarray) -> np.ndarray:
    places = np.flatnonzero(hit)
    return places[np.searchsorted(places, begin[:-1])]


class Learner:
    """AdaGrad on a model's weights; ``flat`` and ``squares`` are all weights, and their summed squares, as one vector."""

    def __init__(self, flat: np.ndarray | None = None, squares: np.ndarray | None = None, seed: int = 0):
        self.model = m = Model(seed)
        parts = [m.emb, *m.conv, *m.bias, m.out, m.const]
        self.flat = np.concatenate([p.ravel() for p in parts]) if flat is None else flat.copy()
        self.squares = np.full_like(self.flat, 1e-6) if squares is None else squares.copy()
        cuts = np.cumsum([p.size for p in parts])[:-1]
        self.params, self.sums = ([x.reshape(p.shape) for x, p in zip(np.split(v, cuts), parts, strict=True)] for v in (self.flat, self.squares))
        n = len(WIDTHS)
        m.emb, m.conv, m.bias, m.out, m.const = self.params[0], self.params[1 : 1 + n], self.params[1 + n : 1 + 2 * n], self.params[-2], self.params[-1]
        m.fitted = True

    def step(self, sub: np.ndarray, begin: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step on the mean loss of a few texts."""
        m = self.model
        pooled, places, seq, x, first = m.pooled(sub, begin, argmax=True)
        g = (1 / (1 + np.exp(-(pooled @ m.out + m.const))) - y).astype(np.float32) / len(y)
        grad_out = pooled.T @ g
        grad_pool = np.outer(g, m.out) * (pooled > 0)
        gx = np.zeros_like(x)
        grads_conv, grads_bias = [], []
        for c, w in enumerate(m.conv):
            d = grad_pool[:, c * FILTERS : (c + 1) * FILTERS]
            gw = np.zeros_like(w)
            for j in range(len(w)):
                word = seq[places[c] + j]
                gw[j] = np.einsum("nfd,nf->df", x[word], d)
                np.add.at(gx, word, d[:, :, None] * w[j].T[None])
            grads_conv.append(gw)
            grads_bias.append(d.sum(axis=0))
        used = np.flatnonzero(np.any(gx[1:] != 0, axis=1))
        slots = (sub[first[used]] & np.uint64((1 << BITS) - 1)).astype(np.int64)
        rows_of, inverse = np.unique(slots, return_inverse=True)
        ge = np.zeros((len(rows_of), DIM), np.float32)
        np.add.at(ge, inverse.reshape(slots.shape), gx[1:][used][:, None, :])
        self.sums[0][rows_of] += ge**2
        m.emb[rows_of] -= rate * ge / np.sqrt(self.sums[0][rows_of])
        for p, s, gp in zip(self.params[1:], self.sums[1:], [*grads_conv, *grads_bias, grad_out, g.sum(keepdims=True)], strict=True):
            s += gp**2
            p -= rate * gp / np.sqrt(s)

    def go(self, feats: np.ndarray, at: np.ndarray, y: np.ndarray, order: np.ndarray, batch: int, rate: float) -> None:
        """Steps on the texts in an order."""
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            part = np.concatenate([np.arange(at[i], at[i + 1]) for i in rows])
            self.step(feats[part], np.concatenate(([0], np.cumsum([at[i + 1] - at[i] for i in rows]))), y[rows], rate)


def train(texts: list[str], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, seed: int = 0) -> Model:
    """The same for texts at hand, by one learner: fits the weights on four rows of five, and the thresholds on the fifth."""
    if len(set(y.tolist())) < 2:
        return Model(seed)
    learner = Learner(seed=seed)
    r = np.random.default_rng(seed)
    feats, at = features_in_parts(texts)
    order = r.permutation(len(y))
    fit, rest = order[len(order) // 5 :], order[: len(order) // 5]
    for _ in range(epochs):
        r.shuffle(fit)
        learner.go(feats, at, y, fit, batch, rate)
    part = np.concatenate([np.arange(at[i], at[i + 1]) for i in rest]) if len(rest) else np.zeros(0, np.int64)
    begin = np.concatenate(([0], np.cumsum([at[i + 1] - at[i] for i in rest]))).astype(np.int64)
    m = learner.model
    z, lang = m.raw(feats[part], begin), languages(feats[part][:, 0], begin)
    set_thresholds(m, lang, *steps(z), y[rest], 1 - y[rest])
    return m


def steps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the step of 1/64 that each logit lies in."""
    low = np.floor(z * 64)
    return low / 64, (low + 1) / 64


def set_thresholds(m: Model, lang: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
    """Each language's threshold, that of all where it has few rows of a label, from the numbers of rows by step of logit."""
    m.shift[:] = threshold(low, high, ones, zeros)
    for k in range(len(m.shift)):
        own = lang == k
        if min(ones[own].sum(), zeros[own].sum()) >= 20:
            m.shift[k] = threshold(low[own], high[own], ones[own], zeros[own])


def threshold(low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The middle of the widest gap between steps among those that make the fewest errors."""
    if len(low) == 0:
        return 0.0
    _, first, which = np.unique(low, return_index=True, return_inverse=True)
    ones, zeros = np.bincount(which, ones), np.bincount(which, zeros)
    errors = np.concatenate(([0], np.cumsum(ones))) + np.concatenate((np.cumsum(zeros[::-1])[::-1], [0]))
    below, above = np.append(low[first[0]] - 1, high[first]), np.append(low[first], high[first[-1]] + 1)
    best = np.flatnonzero(errors == errors.min())
    i = best[np.argmax((above - below)[best])]
    return float((below[i] + above[i]) / 2)


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """h, text, y and rest (a fifth, for the thresholds) of all documents with a label whose remainder is not 0."""
    seen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0))
    seen = seen.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    joined_ = docs.select("doc_id", "text").join(fixed_order_bound(seen, seen.count(), 2_000_000), F.col("doc_id") == F.col("_id"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    return joined_.select(h.alias("h"), F.coalesce("text", F.lit("")).alias("text"), "y", (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0).alias("rest"))


def _one_pass(shared, number: int, batch: int, rate: float):
    """Rows (learner, text, y), those of a learner together, to each learner's weights after them, in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, squares = shared.value
        learner, last, r = None, None, None

        def done() -> pd.DataFrame:
            both = [np.array_split(v, PIECES) for v in (learner.flat, learner.squares)]
            return pd.DataFrame({"piece": np.arange(PIECES), "learner": last, "w": [x.tobytes() for x in both[0]], "q": [x.tobytes() for x in both[1]]})

        for b in batches:
            for name, rows in b.groupby("learner", sort=True):
                if name != last:
                    if learner is not None:
                        yield done()
                    learner, last, r = Learner(flat, squares), name, np.random.default_rng([number, name])
                for p in chunks(rows):
                    learner.go(*features(p["text"]), p["y"].to_numpy(), r.permutation(len(p)), batch, rate)
        if learner is not None:
            yield done()

    return run


def _merged(shared):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        piece = int(p["piece"].iloc[0])
        w0, q0 = (np.array_split(v, PIECES)[piece] for v in shared.value)
        dw, dq, n = np.zeros(len(w0)), np.zeros(len(w0)), np.zeros(len(w0))
        p = p.sort_values("learner")
        for w, q in zip(p["w"], p["q"], strict=True):
            more = np.frombuffer(q, np.float32) - q0
            dw += np.frombuffer(w, np.float32) - w0
            dq += more
            n += more > 0
        n = np.maximum(n, 1)
        return pd.DataFrame({"piece": [piece], "w": [(w0 + dw / n).astype(np.float32).tobytes()], "q": [(q0 + dq / n).astype(np.float32).tobytes()]})

    return run


def _by_step(shared):
    """The numbers of rows (text, y) of each label by language and step of logit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Learner(*shared.value).model
        for b in batches:
            for p in chunks(b, limit=250_000):
                feats, at = features(p["text"])
                low, _ = steps(m.raw(feats, at))
                yield pd.DataFrame({"lang": languages(feats[:, 0], at), "low": low, "y": p["y"].to_numpy()}).groupby(["lang", "low"], as_index=False).agg(ones=("y", "sum"), n=("y", "size"))

    return run


def fit(docs: DataFrame, labels: DataFrame, rows_each: int = 8000, batch: int = 32, rate: float = 0.05, seed: int = 0) -> Model:
    """Trains on all labelled documents whose remainder is not 0, by a learner for each ``rows_each`` of them: eight passes
    by one learner, four by several."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    sc = spark.sparkContext
    rows = labelled(docs, labels, seed)
    per_label = rows.groupBy("y").count().collect()
    if len(per_label) < 2:
        return Model(seed)
    learners = -(-sum(r["count"] for r in per_label) // rows_each)
    learner = F.when(F.col("rest"), F.lit(-1)).otherwise(F.pmod("h", F.lit(learners)))
    path = fresh_path(spark, "labelled")
    rows.withColumn("learner", learner.cast("int")).write.partitionBy("rest").parquet(path)
    stored = spark.read.schema("h bigint, text string, y int, learner int, rest boolean").parquet(path)
    own = cut(stored.where("NOT rest").drop("rest").repartition(learners, "learner").sortWithinPartitions("learner", "h", "text"))
    start = Learner(seed=seed)
    state = [start.flat, start.squares]
    for number in range(8 if learners == 1 else 4):
        shared = sc.broadcast(state)
        moved = own.mapInPandas(_one_pass(shared, number, batch, rate), "piece int, learner int, w binary, q binary")
        got = sorted((r["piece"], bytes(r["w"]), bytes(r["q"])) for r in moved.groupBy("piece").applyInPandas(_merged(shared), "piece int, w binary, q binary").collect())  # one model
        shared.destroy()
        if got:
            state = [np.concatenate([np.frombuffer(r[k], np.float32) for r in got]) for k in (1, 2)]
    shared = sc.broadcast(state)
    counts = stored.where("rest").select("text", "y").mapInPandas(_by_step(shared), "lang int, low double, ones bigint, n bigint")
    got = counts.groupBy("lang", "low").agg(F.sum("ones"), F.sum("n")).collect()  # a row a step
    shared.destroy()
    delete_path(spark, path)
    model = Learner(*state).model
    lang, low, ones, n = np.array([tuple(r) for r in got], float).reshape(-1, 4).T
    set_thresholds(model, lang, low, low + 1 / 64, ones, n - ones)
    return model


def scorer(docs: DataFrame, model: Model, batch_chars: int = 250_000):
    """A column function: the score of a text."""
    small_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            parts = [shared.value.logits([t if isinstance(t, str) else "" for t in p["text"]]) for p in chunks(b.to_frame("text"), limit=batch_chars)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate([*parts, np.zeros(0)]), -500, 500))))

    return run


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and ``keep`` for all ``docs``."""
    scored = docs.select("doc_id", *keep, scorer(docs, fit(docs, labels))("text").alias("score"))
    return scored.select("doc_id", *keep, (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
