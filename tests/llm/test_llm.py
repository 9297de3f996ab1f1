"""The operators on small tables against brute force, and on nulls, empty and long texts, ties, repeated rows and
clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlark.llm import context_mixing, decontamination, jaccard_join, line_quality, mixing, pii, sharding, suffix_dedup, token_rollup, toxicity
from gridlark.llm.common import distinct_of, grouped
from gridlark.llm.graph import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string"
SF = "/root/testdata/sf0.001"


def words(n, seed, vocabulary=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, vocabulary, n))


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", f"s{i % 3}", len(t or ""), 1, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, repeated rows, one word, ties; extra columns."""
    long = words(3000, 1)
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "a", 0, 1, "x"), (3, " \n\t", None, "a", 3, 1, "x"), (4, long, "en", None, 1, 1, "x"), (5, long, "de", "b", 1, 1, "x"), (6, "one", "en", "b", 3, 1, "x"), (6, "one", "en", "b", 3, 1, "x"), (7, "a b c", "en", "b", 5, 1, "x"), (None, "no id " + words(60, 9), "en", "b", 5, 1, "x"), (8, "é ñ 漢字 😀 mail me a.b@c.de", "en", "b", 5, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, "what is two plus two in this plain little question of ours"), (2, None), (None, "too short"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


ALL = {
    "op1": lambda s, d: suffix_dedup.remove_repeats(d),
    "op2": lambda s, d: decontamination.leaks(d, bench(s)),
    "op3": lambda s, d: pii.digest(pii.find(d)),
    "op4": lambda s, d: mixing.mix(d),
    "op5": lambda s, d: toxicity.classify(d, labels_of(s, [(1, 1, 0), (4, 1, 1), (None, 1, 1), (6, 0, None)])),
    "op6": lambda s, d: context_mixing.score(d),
    "op7": lambda s, d: jaccard_join.components(d),
    "op8": lambda s, d: sharding.shard(d),
    "op9": lambda s, d: line_quality.score_lines(d),
}


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_and_empty_tables(spark, odd, empty, name):
    got = ALL[name](spark, odd).collect()
    assert name == "op2" or sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert ALL[name](spark, empty).collect() == []


def test_rollup_odd_and_idempotent(spark, odd, empty, tmp_path):
    got = token_rollup.rollup_documents(odd).collect()
    assert sum(r["docs"] for r in got if r["version"] == "words") == 7  # a null and an empty text, the long one and one row are twice there
    assert token_rollup.rollup_documents(empty).collect() == []
    store = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    schema = "change string, source string, lang string, version string, tokens long, bytes long, old_tokens long, old_bytes long"
    a = spark.createDataFrame([("insert", "s", "en", "v", 5, 9, None, None), ("insert", "s", "en", "v", 2, 3, None, None)], schema)
    b = spark.createDataFrame([("revise", "s", "en", "v", 7, 9, 5, 9), ("delete", "s", "en", "v", 2, 3, None, None)], schema)
    assert store.commit("1", a) and not store.commit("1", a) and store.commit("2", b) and not store.commit("2", b)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 1, 7, 9)]
    assert store.compact() and store.batches() == {"1", "2"} and not store.commit("1", a)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 1, 7, 9)]
    store.commit("3", spark.createDataFrame([("delete", "s", "en", "v", 7, 9, None, None)], schema))
    assert store.totals().collect() == [] and store.compact() and store.compact() and store.totals().collect() == []
    assert store.batches() == {"1", "2", "3"} and not store.commit("3", a) and store._named("batch") == [] and len(store._named("base")) == 1


CLASH = ("id", "n", "rows", "kept_id", "taken_id", "times", "again", "bad_id", "h", "w", "t", "base", "uid", "sig", "k", "d", "key", "bucket", "run", "score", "lines", "host", "shard", "Times")


def test_clashing_columns(spark, odd):
    """Columns with the operators' own names pass through what keeps rows, and change nothing elsewhere."""
    docs = odd.select("doc_id", "text", "lang", "source", *[F.lit("x").alias(c) for c in CLASH if c != "Times"])
    plain = odd.select("doc_id", "text", "lang", "source")
    for stage in (lambda d: mixing.repeat(d), lambda d: jaccard_join.one_of_each(d), lambda d: decontamination.clean(d, bench(spark)), lambda d: d.where(toxicity.scorer(d, toxicity.Model())("text") < 0.5)):
        got = stage(docs)
        assert got.columns == docs.columns
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, stage(plain).collect()))
    for name in ALL:
        assert sorted(map(str, ALL[name](spark, docs).collect())) == sorted(map(str, ALL[name](spark, plain).collect())), name


def test_of_two_writers_one_commits(spark, tmp_path):
    store = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    schema = "change string, source string, lang string, version string, tokens long, bytes long, old_tokens long, old_bytes long"
    store.commit("1", spark.createDataFrame([("insert", "s", "en", "v", 5, 9, None, None)], schema))
    staged = f"{store.path}/_late"
    token_rollup.deltas(spark.createDataFrame([("insert", "s", "en", "v", 6, 9, None, None)], schema)).write.parquet(staged)
    assert not store._rename(staged, f"{store.path}/batch=1")
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 1, 5, 9)]


def test_rollup_equals_plain_counts(spark):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    texts = [words(5 + i % 9, i % 40) for i in range(120)] + [None, "", "é 漢字 😀", words(9000, 7)]
    with open(token_rollup.TOKENIZER, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}, special_tokens={})
    want, seen = {}, set()
    for i, t in enumerate(t or "" for t in texts):
        if t not in seen:
            seen.add(t)
            for version, n in (("words", len(t.split())), ("byte_bpe_50k", len(enc.encode_ordinary(t)))):
                k = (f"s{i % 3}", "en", version)
                want[k] = tuple(a + b for a, b in zip(want.get(k, (0, 0, 0)), (1, n, len(t.encode()))))
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"], r["bytes"]) for r in token_rollup.rollup_documents(docs_of(spark, texts)).collect()}
    assert got == want


def test_suffix_array_is_sorted():
    r = np.random.default_rng(0)
    for _ in range(100):
        t = r.integers(97, 100, int(r.integers(1, 60))).astype(np.uint8)
        depth = int(r.choice([8, 30, 400]))
        sa, prefix = suffix_dedup.suffix_array(t, depth)
        keys = [(t.tobytes() + bytes(depth))[i : i + depth] for i in sa]
        # The prefix ends with the shorter suffix; zero bytes beyond both ends are alike.
        want = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), depth) for a, b in zip(keys, keys[1:])]
        assert keys == sorted(keys) and prefix.tolist() == want


@pytest.mark.parametrize("hot", [5000, 2])
def test_repeats_are_removed(spark, hot):
    passage = words(120, 5)
    texts = [words(200, i) for i in range(6)] + [words(100, 20 + i) + " " + passage + " " + words(80, 40 + i) for i in range(5)] + ["ab" * 400, passage + passage[:50], passage]
    raw = [t.encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    for r in suffix_dedup.remove_repeats(docs_of(spark, texts), hot_runs=hot).collect():
        t = raw[r["doc_id"]]
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_bytes_decide_what_is_repeated_not_words(spark):
    """A passage of over 50 words stays if it has 399 bytes, and goes if it has 400."""
    texts = []
    for n in (399, 400):
        passage = words(90, n, 1000)[:n]
        assert len(passage) == n and len(passage.split()) > 50
        texts += [f"{a * 50}({passage}){b * 50}".replace("(", x).replace(")", y) for a, b, x, y in (("a", "b", "<", ">"), ("c", "d", "[", "]"))]
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 0, 400, 400]


@pytest.mark.parametrize("hot", [5000, 2])
def test_keys_beyond_an_array_are_split(spark, monkeypatch, hot):
    """Many texts share a passage in different surroundings, more than an array may hold of one key."""
    passage = words(150, 5)
    texts = [words(60, 100 + i) + " " + passage + " " + words(60, 300 + i) for i in range(30)] + [passage, words(200, 1)]
    raw = [t.encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    split, by_window = [], suffix_dedup._by_window
    monkeypatch.setattr(suffix_dedup, "_by_window", lambda segments, length: split.append(segments.count()) or by_window(segments, length))
    rows = suffix_dedup.remove_repeats(docs_of(spark, texts), hot_runs=hot, array_bytes=2000, key_bytes=4000).collect()
    assert split and split[0] > 1
    for r in rows:
        t = raw[r["doc_id"]]
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert (r["n_removed"], r["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())


def test_arrays_refuse_what_ranks_cannot_hold():
    with pytest.raises(AssertionError):
        suffix_dedup.suffix_array(np.zeros(1 << 21, np.uint8), 400)


def test_leaks(spark):
    b = bench(spark, [(1, "The train leaves Paris at 9 and needs 12 hours to reach the far coast of this large country"), (2, words(30, 3))])
    texts = [words(50, 1) + " " + words(30, 3) + " " + words(50, 2), words(40, 4) + ". The train leaves London at 4 and needs 17 hours to reach the far coast of this large country. " + words(40, 6), words(100, 7)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs_of(spark, texts), b).collect()}
    assert set(got) == {(0, 2), (1, 1)} and not got[(1, 1)]["exact"] and got[(1, 1)]["n_slots"] >= 2
    assert [r["doc_id"] for r in decontamination.clean(docs_of(spark, texts), b).collect()] == [2]


def test_leaks_with_words_put_in(spark):
    frame = "a shop sells {} apples and then {} pears on the first day while its owner counts {}every coin at night and the next morning {} carts come down the long road and {} more wait at the old gate"
    b = bench(spark, [(1, frame.format(3, 3, "", 3, 3))])
    texts = [frame.format(8, 8, "quietly ", 8, 8), frame.format(8, 5, "quietly ", 7, 9), frame.format(8, 8, "", 8, 8), frame.format(3, 3, "quietly ", 3, 3) + " " + frame.format(1, 2, "", 4, 6)[:60]]
    got = {r["doc_id"]: r for r in decontamination.leaks(docs_of(spark, texts), b).collect()}
    assert set(got) == {0, 2, 3} and all(r["consistency"] == 1 and r["n_slots"] == 4 for r in got.values())
    assert got[0]["n_found"] == got[0]["n_windows"] - 4 and got[2]["n_found"] == got[2]["n_windows"]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def plain_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                yield kind, m.start(), m.end()


def test_base_spans(spark):
    texts = [
        "é a.b@c.de x_y@q.org.uk 10.0.0.256 10.0.0.25.7 4111 1111 1111 1111, 4111111111111112 +49 (30) 123-4567 +1 2 a@b 1.2.3.4.5.6.7.8",
        "😀 card 4111 1111 1111 1111. or 4111-1111-1111-1111 x, 41111111111111111111 a@b.c_x@d.e y@z@w.org +1 (2) 3.4-5 67 8 90 +12345678901234567890 001.002.003.0255",
        "1" * 3000 + " " + "a." * 500 + "@" + "b." * 500 + "c" + " 4111 1111 1111 1111 " * 40,
    ]
    r = np.random.default_rng(4)
    texts += ["".join(r.choice(list("0123456789.-+@ab ()\n"), 400)) for _ in range(60)]
    for row in pii.digest(pii.find(docs_of(spark, texts))).collect():
        want = list(plain_spans(texts[row["doc_id"]]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and row["spans"].startswith(joined)


def test_terms_that_reveal(spark):
    texts = [words(8, i) + f" secretword call +49 30 1234567 now {words(8, 50 + i)}" for i in range(4)] + [words(30, 90 + i) for i in range(60)]
    got = pii.find(docs_of(spark, texts))
    assert {t["value"] for r in got.collect() for t in r["terms"]} >= {"secretword"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(spark, texts)).collect()}
    assert "+49" not in clean[0] and "secretword" not in clean[0] and clean[10] == texts[10]


def test_terms_near_entities_of_one_text(spark):
    """An entity that one text names loses its rare terms and keeps the common ones; copies do not hide them."""
    texts = [f"plainword {words(8, i)}" for i in range(60)] + ["plainword zanzibarish call +49 30 1234567 İstanbulite now"] * 40
    rows = pii.find(docs_of(spark, texts)).collect()
    for r in rows:
        want = {("zanzibarish", "remove"), ("İstanbulite".lower(), "remove")} if r["doc_id"] >= 60 else set()
        got = {(t["value"], t["action"]) for t in r["terms"]}
        assert got - {("call", "remove")} == want


def test_mix_meets_targets(spark):
    texts = [words(10 + i % 7, i) for i in range(300)]
    rows = mixing.mix(docs_of(spark, texts)).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["target"], r["source_size"]), []).append(r["taken"])
    assert abs(sum(t for t, _ in by) - 1.5 * total) < 1e-6 and all(abs(sum(v) - t) <= 1 for (t, _), v in by.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs_of(spark, texts)).collect()))


def test_toxicity_learns():
    bad = ["vile", "awful", "nasty"]
    texts = [words(40, i) + (f" {bad[i % 3]} {bad[(i + 1) % 3]}" if i % 2 else "") for i in range(600)]
    m = toxicity.train(texts[:500], np.array([i % 2 for i in range(500)]))
    assert ((m.logits(texts[500:]) > 0) == np.arange(500, 600) % 2).mean() > 0.95


def test_language_model(spark):
    texts = [words(60, i, 50) for i in range(60)] + [None]
    low = [(t or "").lower().split() + [None] for t in texts]
    c = Counter(w for i, ws in enumerate(low) if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in context_mixing.score(docs_of(spark, texts)).collect():
        ws = low[r["doc_id"]]
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0


def test_jaccard_components(spark):
    base = [words(100, i) for i in range(8)]
    texts = list(base)
    r = np.random.default_rng(3)
    for i, t in enumerate(base * 6):
        w = t.split()
        for _ in range(int(r.integers(0, 5))):
            w[int(r.integers(0, 100))] = f"n{i}{int(r.integers(0, 9))}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((min(k for k in range(len(texts)) if parent[k] == parent[i]), min(k for k in range(len(texts)) if parent[k] == parent[j])))
                old = parent[b]
                parent = [parent[a] if p == old else p for p in parent]
    want = {i: min(k for k in range(len(texts)) if parent[k] == parent[i]) for i in range(len(texts))}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(docs_of(spark, texts), block=4).collect()}
    assert got == want


def test_connected_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 40)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected(e).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 40, 40: 40}


def test_shards_are_even_and_gapless(spark):
    texts = [words(30 + i % 5, i) for i in range(2000)] + ["same text"] * 700
    rows = sharding.shard(docs_of(spark, texts), n_shards=8, ranges_per_shard=4).collect()
    size = Counter()
    slots = {}
    for r in rows:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert len(rows) == 2700 and max(size.values()) < 1.1 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_frequent_lines_go(spark):
    texts = [f"cookie notice of this site for all\n{words(5 if i % 10 == 0 else 40, i)}" for i in range(120)]
    rows = line_quality.score_lines(docs_of(spark, texts), max_docs=10).collect()
    assert all(r["n_lines_removed"] == 1 for r in rows)
    assert {r["doc_id"] for r in rows if not r["kept"]} <= set(range(0, 120, 10)) | {r["doc_id"] for r in rows if r["base_failed"]}


def test_repeated_words(spark):
    cases = ["a b c d e f a b c d e", "x " * 30, "a b c d e a b c d", words(50, 1)]
    for r in line_quality.score_lines(docs_of(spark, cases)).collect():
        w = cases[r["doc_id"]].split()
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert r["n_repeat_words"] == len(hit)


def test_pipeline_keeps_its_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        if name in ("toxicity", "decontamination", "jaccard_join"):
            assert 0.5 * docs.count() < out.count() <= docs.count()
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert rows.count() == docs.count() and rows.agg(F.max("shard")).first()[0] <= 23


def plain_terms(texts, reach=60, generalise=0.7, remove=0.95):
    """The terms that reveal an entity, by counting over distinct texts."""
    pattern = re.compile(r"[^\W\d_]{4,}")
    distinct = set(texts)
    n = len(distinct)
    entities, pairs, near = Counter(), Counter(), {}
    in_texts = Counter(w for t in distinct for w in {m.group().lower() for m in pattern.finditer(t)})
    for t in distinct:
        spans = list(plain_spans(t))
        here = near.setdefault(t, set())
        for kind, s, e in spans:
            entity = f"{kind}:{t[s:e].lower()}"
            low = max(0, s - reach)
            found = [(m.start() + low, m.end() + low, m.group()) for m in pattern.finditer(t[low:s]) if m.start() > 0 or low == 0]
            found += [(m.start() + e, m.end() + e, m.group()) for m in pattern.finditer(t[e : e + reach + 1]) if m.end() <= reach]
            here |= {(entity, a, b, w) for a, b, w in found if not any(a < y and x < b for _, x, y in spans)}
        entities.update({f"{k}:{t[s:e].lower()}" for k, s, e in spans})
        pairs.update({(x[0], x[3].lower()) for x in here})
    out = {}
    for t, here in near.items():
        out[t] = set()
        for entity, a, b, w in here:
            seen = max(in_texts[w.lower()], pairs[(entity, w.lower())])
            information = np.log(n / entities[entity])
            part = np.log(n * pairs[(entity, w.lower())] / (entities[entity] * seen)) / information if information > 0 else 0
            if part >= generalise - 1e-12:
                out[t].add((a, b, "remove" if part >= remove - 1e-12 else "generalise"))
    return out


def test_terms_equal_plain_counts(spark):
    r = np.random.default_rng(8)
    people = [f"person{'abcdefgh'[i]}@mail.org" for i in range(8)] + ["+49 30 1234567", "10.1.2.3"]
    names = [f"name{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(3)]
    texts = []
    for i in range(150):
        w = [f"common{chr(97 + int(x))}" for x in r.integers(0, 12, 30)]
        for _ in range(int(r.integers(0, 3))):
            k = int(r.integers(0, 10))
            w[int(r.integers(0, 29))] = f"{names[3 * k + int(r.integers(0, 3))]} {people[k]} {names[int(r.integers(0, 30))]}"
        texts.append(" ".join(w))
    texts += texts[:20]
    want, n = plain_terms(texts), 0
    for row in pii.find(docs_of(spark, texts)).collect():
        actions = {}
        for a, b, action in want[texts[row["doc_id"]]]:
            actions[(a, b)] = max(action, actions.get((a, b), ""))
        assert {(t["s"], t["e"]): t["action"] for t in row["terms"]} == actions
        n += len(actions)
    assert n > 50 and {t["action"] for r in pii.find(docs_of(spark, texts)).collect() for t in r["terms"]} == {"remove", "generalise"}


def test_depleted_documents_are_rejected(spark):
    """A host's notice goes from all its documents at any size of the host; one that is little else goes as a whole."""
    notice = "all rights reserved by the owners of this site and its many friends"
    texts = [f"{notice}\n{words(3, i) if i == 33 else words(60, i)}" for i in range(90)] + [f"{words(30, 500 + i)}" for i in range(400)]
    got = {r["doc_id"]: r for r in line_quality.score_lines(docs_of(spark, texts)).collect()}
    assert [got[i]["n_lines_removed"] for i in range(490)] == [1] * 90 + [0] * 400
    assert not got[33]["base_failed"] and not got[33]["kept"]
    assert all(got[i]["kept"] for i in range(490) if i != 33 and not got[i]["base_failed"]) and sum(r["kept"] for r in got.values()) > 450
    few = [f"{notice}\n{words(3, i)}" for i in range(60)]  # 20 documents a host are within the limit
    assert all(r["n_lines_removed"] == 0 for r in line_quality.score_lines(docs_of(spark, few)).collect())


def test_scores_depend_on_order_and_copies(spark):
    r = np.random.default_rng(5)
    bigrams = [[f"v{int(x)}" for x in r.integers(0, 300, 2)] for _ in range(60)]
    texts = [" ".join(w for k in r.integers(0, 60, 40) for w in bigrams[int(k)]) for _ in range(300)]
    texts += texts[:40]  # copies
    shuffled = [" ".join(r.permutation(t.split())) for t in texts[100:140]]
    both = docs_of(spark, texts + shuffled)
    rows = {x["doc_id"]: x for x in context_mixing.score(both).collect()}
    held = [i for i in range(100, 140) if rows[i]["held_out"]]
    alone = [i for i in range(40, 300)]
    per = lambda i, c="score": rows[i][c] / rows[i]["n_tokens"]
    assert held and all(rows[i]["score"] > rows[i]["base_score"] for i in alone)
    assert np.mean([per(i) for i in range(100, 140)]) > np.mean([per(i) for i in range(340, 380)]) + 0.3
    taught = [i for i in range(40) if not rows[i]["held_out"] and not rows[300 + i]["held_out"]]
    assert max(per(i) for i in alone) < min(per(i) for i in taught)
    assert all(np.isclose(x["bits_per_byte"] * len((texts + shuffled)[i].encode()), -x["score"] / np.log10(2)) for i, x in rows.items())
    again = {x["doc_id"]: x["score"] for x in context_mixing.score(both.repartition(7)).collect()}
    assert all(abs(again[i] - x["score"]) < 1e-3 * abs(x["score"]) for i, x in rows.items())


def test_probabilities_leave_the_token_out(spark):
    """Counts that come back to a chunk, against plain ones."""
    texts = ["a b a b c", "a b c", "b c a", "x y z a b"]
    h, at = context_mixing.word_hashes([t.encode() + b" " + context_mixing.END for t in texts])
    keys, begin, of = context_mixing.context_keys(h, at)
    n, m = len(h), len(begin)
    assert len(keys) == n + 2 * m and of.tolist() == [int(np.searchsorted(begin, i)) for i in at]
    tokens = [w for t in texts for w in [None, *t.split(), "END"]]
    pairs = [(a, b) for a, b in zip(tokens, tokens[1:]) if b is not None]
    same = Counter(pairs)
    assert len(set(keys[:n].tolist())) == len(same)
    assert sorted(Counter(keys[:n].tolist()).values()) == sorted(same.values())
    raw = np.array([Counter(h.tolist())[x] for x in h.tolist()], float)
    two = np.array([same[p] for p in pairs], float)
    seen, after = context_mixing.after(raw, two, np.ones(n), at[:-1], 4)
    assert after[1] == (same[("a", "b")] - 1) / (raw[0] - 1) and after[0] == (same[(None, "a")] - 1) / 3 and after[-1] == (same[("b", "END")] - 1) / (raw[-2] - 1)


def test_counters_along_a_text_equal_plain_ones():
    r = np.random.default_rng(2)
    hashes, text, data = r.integers(0, 6, 500).astype(np.uint64), r.integers(0, 3, 500), r.integers(0, 4, 500).astype(np.uint8) * 65
    along, seen = context_mixing.Along(hashes, text), Counter()
    got = []
    for bit in range(8):
        zero, one = np.zeros(500, np.float32), np.zeros(500, np.float32)
        along.add(zero, one, (data >> (7 - bit)) & 1)
        got.append((zero, one))
    for i in range(500):
        for bit in range(8):
            key = (hashes[i], text[i], bit, data[i] >> (8 - bit))
            assert (got[bit][0][i], got[bit][1][i]) == (seen[key, 0], seen[key, 1])
            seen[key, data[i] >> (7 - bit) & 1] += 1


def test_texts_share_no_counters():
    """A text's spelling costs the same whichever texts stand beside it, also where their numbers are bytes of each other."""
    texts, numbers = [b"ab ac ad " * 5, b"eb ef eg " * 5, b"eb eb ef " * 5], [101, 97, 5]
    cost = lambda w, text: context_mixing.Speller().log2(*context_mixing.contexts(w), context_mixing.Counters(), np.zeros(len(w), bool), text)
    alone = [cost(w, np.full(len(w), i)) for w, i in zip(texts, numbers, strict=True)]
    assert np.allclose(cost(b"".join(texts), np.repeat(numbers, [len(w) for w in texts])), np.concatenate(alone), rtol=0, atol=1e-9)


def test_counters_belong_to_one_context():
    c = context_mixing.Counters()
    at = np.arange(context_mixing.K)[:, None]

    def count(check, bits):
        for y in bits:
            zero, one, mine = c.read(at, check := np.full_like(at, check, np.uint16))
            c.update(at, check, np.array([y]), zero + one, mine)
        zero, one, mine = c.read(at, check)
        return (zero[0, 0], one[0, 0]) if mine.all() else None

    assert count(7, [0]) == (1, 0) and count(8, [1, 1, 0]) == (1, 2)  # seen once, it gives way
    assert count(7, [0, 0]) is None and count(8, []) == (1, 2)
    zero, one = count(8, [1] * 3000)
    assert zero + one < context_mixing.LIMIT + 2 and zero < 0.2  # what is old fades


def test_spelling_goes_on_along_a_text(spark):
    """New words like the ones before them in their text cost less, and a training text's own words count as new."""
    r = np.random.default_rng(4)
    letters = lambda n: "".join(r.choice(list("abcdefghijklmnop"), n))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = [" ".join(letters(8) for _ in range(12)) for _ in range(400)]
    for i in held[:10]:
        stem = letters(7)
        texts[i] = " ".join(stem + x for x in "abcdefghijkl")
    per = {x["doc_id"]: x["score"] / x["n_tokens"] for x in context_mixing.score(docs_of(spark, texts)).collect()}
    new = np.mean([per[i] for i in held[10:]])
    assert np.mean([per[i] for i in held[:10]]) > new + 1
    assert abs(np.mean([per[i] for i in range(400) if i not in held]) - new) < 0.2
    untaught = docs_of(spark, texts).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    got = {x["doc_id"]: x for x in context_mixing.score(untaught).collect()}
    assert sorted(got) == held and all(x["train_tokens"] == 0 for x in got.values())
    assert min(got[i]["score"] for i in held[:10]) > max(got[i]["score"] for i in held[10:])


def test_long_texts(spark):
    """Texts beyond a piece, a chunk and a batch: what repeats across a piece's edge goes, and counts are those of whole texts."""
    big = words(90_000, 1, 30_000)
    assert len(big) > suffix_dedup.PIECE + 1000
    edge = suffix_dedup.PIECE
    texts = [big, words(50, 2) + " " + big[edge - 300 : edge + 300] + " " + words(50, 3), words(300, 4)]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[0]["n_removed"] >= 600 and got[1]["n_removed"] >= 600 and got[2]["n_removed"] == 0
    assert any(a <= edge - 300 and b >= edge + 300 for a, b in zip(got[0]["span_starts"], got[0]["span_ends"]))
    sets = {r["doc_id"]: r["n_shingles"] for r in jaccard_join.components(docs).collect()}
    w = big.split()
    assert sets[0] == len({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    assert {r["doc_id"]: r["n_tokens"] for r in context_mixing.score(docs).collect()}[0] == len(w) + 1
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}[0] == len(w)
    assert {r["doc_id"]: r["n_words"] for r in line_quality.score_lines(docs).collect()}[0] == len(w)


def test_item_beginnings_in_either_form(spark):
    """A word that begins an item becomes a name where other words stand before it."""
    item = "Rivers carry seven kinds of stone to sea"
    docs = docs_of(spark, [f"we read that {item} and more of it", f"{item}.", "rivers of other kinds"])
    got = {r["doc_id"]: r["n_found"] == r["n_windows"] for r in decontamination.leaks(docs, bench(spark, [(1, item)])).collect()}
    assert got == {0: True, 1: True}


def test_shards_follow_the_splitters(spark):
    texts = [words(30 + i % 5, i) for i in range(1500)] + ["same text"] * 500
    rows = sharding.shard(docs_of(spark, texts), n_shards=6, ranges_per_shard=8, whole_group=0.3).collect()
    ranges = {}
    for r in rows:
        ranges.setdefault(r["range_id"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in ranges.values()) <= 1 and len(ranges) > 30


def test_toxicity_learns_from_all_labelled_rows(spark):
    """2,000 rows of each label were the most that counted; results do not depend on how rows are dealt."""
    texts = [words(6, i, 50) + (" vile" if i % 2 else "") for i in range(5200)]
    docs = docs_of(spark, texts)
    labels = labels_of(spark, [(i, 1, i % 2) for i in range(5200)])
    kept = [i for i in range(5200) if zlib.crc32(str(i).encode()) % toxicity.FOLDS]
    assert all(sum(i % 2 == v for i in kept) > 2000 for v in (0, 1))
    assert toxicity.labelled(docs, labels).count() == len(kept)
    a, b = (toxicity.fit(d, labels, rows_each=1500) for d in (docs, docs.repartition(7)))
    assert np.allclose(a.logits(texts[:50]), b.logits(texts[:50]), atol=1e-3)
    held = [i for i in range(5200) if i not in set(kept)]
    assert ((a.logits([texts[i] for i in held]) > 0) == np.array(held) % 2).mean() > 0.95


def test_toxicity_scores_a_text_alone():
    """The windows at a text's end once reached into the text after it in its batch."""
    m = toxicity.train([words(8, i, 30) + (" vile" if i % 2 else "") for i in range(200)], np.arange(200) % 2)
    texts = [words(5, i, 30) + " vile" * (i % 3) for i in range(30)] + ["", "vile"]
    assert np.allclose(m.logits(texts), [m.logits([t])[0] for t in texts], atol=1e-4)


def test_cells_of_the_speller_are_whole_logarithms():
    one = np.concatenate([np.arange(1024), np.float32(1023) * (1 + np.arange(-3, 4) * np.float32(2**-23))]).astype(np.float32)
    zero = np.zeros_like(one)
    stretch, conf = context_mixing.Speller().inputs(np.tile(zero, (context_mixing.K, 1)), np.tile(one, (context_mixing.K, 1)))
    assert (conf[0] // context_mixing.CONF == np.minimum(np.log2(one + 1), context_mixing.CONF - 1).astype(int)).all()
    assert (conf[0] % context_mixing.CONF == conf[0] // context_mixing.CONF).all() and np.allclose(stretch[0], np.log((one + 0.05) / 0.05))


def test_spelling_is_scored_as_it_is_learned():
    """The predictors that are added one after another give what learning adds at once."""
    speller, counters = context_mixing.Speller(), context_mixing.Counters()
    for i in range(3):
        speller.learn(*context_mixing.contexts((words(400, i, 300) + " ").encode()), counters)
    data, hashes = context_mixing.contexts((words(60, 9, 300) + " new ").encode())
    got = speller.log2(data, hashes, counters, np.zeros(len(data), bool), np.arange(len(data)))  # no byte has any before it
    grid, want = np.linspace(-context_mixing.STRETCH_MAX, context_mixing.STRETCH_MAX, context_mixing.MAP), np.zeros(len(data))
    for bit in range(8):
        zero, one, mine = counters.read(*context_mixing.slots(hashes, data, bit))
        z = speller.mixed(*speller.inputs(zero * mine, one * mine), bit)
        refined = (speller.hits[1, bit] + 8 / (1 + np.exp(-grid))) / (speller.hits.sum(axis=0)[bit] + 8)
        p = (1 / (1 + np.exp(-z)) + np.interp(z, grid, refined)) / 2
        want += np.log2(np.where(data >> (7 - bit) & 1, p, 1 - p))
    assert np.allclose(got, want, rtol=0, atol=1e-9) and want.sum() > -4 * len(data)


def test_hashes_that_differ_in_their_last_bits():
    h = np.array([5, 4, 5, 2**63, 4, 2**63 + 1, 2**63], np.uint64)
    order, ordered, new = grouped(h)
    assert order.tolist() == [1, 4, 0, 2, 3, 6, 5] and (ordered == h[order]).all()
    assert np.flatnonzero(new).tolist() == [0, 2, 4, 6]


def test_distinct_hashes():
    h = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    keys, place, which = distinct_of(h)
    assert (keys == np.unique(h)).all() and (h[place] == keys).all() and (keys[which] == h).all()
    assert [len(x) for x in distinct_of(h[:0])] == [0, 0, 0]
