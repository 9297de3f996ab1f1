"""Personal data and the terms that give it away.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers.  Each value found is a protected
entity.  The words near an entity are terms; over all documents their co-occurrence estimates how strongly a term
reveals the entity: with p from document frequencies, the pointwise mutual information log(p(e, t) / (p(e) p(t))) as a
part of the entity's information content -log p(e).  It is 1 where the term occurs with the entity only.  A term whose
part reaches ``generalise`` for an entity is a span wherever it stands near that entity; from ``remove`` on it is
removed, below it is generalised to a placeholder.

All four frequencies count distinct texts, so copies change nothing.  Every entity is scored, also one that a single text
names: there each term near it that few other texts have reveals it.  Null texts are empty.  Repeated rows each get a row of the result.  An empty table gives
no rows.  Extra columns are ignored.  Positions count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .line_quality import let

#: The kinds in their order.  The patterns find the leftmost matches of the plain ones, without trying each start in a
#: run of characters again: a match can begin only where the run does, or where the match before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"\p{L}{4,}"
SPAN = "array<struct<kind:string,s:int,e:int,value:string>>"


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches of ``pattern`` with their places, found from the lengths of matches and of what lies between."""
    empty = F.lit(None).cast(SPAN)

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        both = F.zip_with(F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.char_length(g)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["g"]
            e = s + F.char_length(x["m"])
            span = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("value"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(both, start, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(F.coalesce(empty, F.array().cast(SPAN))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda x: x != "")
    doubled = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    spans = F.filter(located(text, PATTERNS[kind], kind), lambda x: _valid(kind, x["value"]))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(SPAN))


def near_terms(text: Column, spans: Column, reach: int) -> Column:
    """For each base span the whole terms within ``reach`` characters of it: struct(entity, term)."""

    def around(x: Column) -> Column:
        low = F.greatest(F.lit(0), x["s"] - reach)
        left = F.substring(text, low + 1, x["s"] - low)
        right = F.substring(text, x["e"] + 1, F.lit(reach + 1))
        before = F.filter(F.transform(located(left, TERM, "term"), lambda t: F.struct(F.lit("term").alias("kind"), (t["s"] + low).alias("s"), (t["e"] + low).alias("e"), F.lower(t["value"]).alias("value"))), lambda t: (t["s"] > low) | (low == 0))
        after = F.filter(F.transform(located(right, TERM, "term"), lambda t: F.struct(F.lit("term").alias("kind"), (t["s"] + x["e"]).alias("s"), (t["e"] + x["e"]).alias("e"), F.lower(t["value"]).alias("value"))), lambda t: t["e"] <= x["e"] + reach)
        whole = F.filter(F.concat(before, after), lambda t: ~F.exists(spans, lambda b: (t["s"] < b["e"]) & (b["s"] < t["e"])))
        return F.transform(whole, lambda t: F.struct(F.concat_ws(":", x["kind"], F.lower(x["value"])).alias("entity"), t.alias("term")))

    return F.flatten(F.transform(spans, around))


def find(docs: DataFrame, generalise: float = 0.7, remove: float = 0.95, reach: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, ``keep``, base (array of kind, s, e, value) and terms (array of action, s, e,
    value); a term's action is remove or generalise."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", *keep, text.alias("t"))
    d = d.withColumn("base", F.concat(*[base_spans(F.col("t"), k) for k in PATTERNS]))
    d = d.withColumn("near", F.when(F.size("base") > 0, near_terms(F.col("t"), F.col("base"), reach)))
    d = d.withColumn("same", F.md5(F.col("t").cast("binary")))
    d = cut(d.drop("t").withColumn("uid", F.monotonically_increasing_id()))
    n = d.agg(F.count_distinct("same")).first()[0]
    entities = d.select("same", F.explode(F.array_distinct(F.transform("base", lambda x: F.concat_ws(":", x["kind"], F.lower(x["value"]))))).alias("entity"))
    df_entity = entities.distinct().groupBy("entity").agg(F.count("*").alias("df_e"))
    near = d.select("uid", "same", F.explode("near").alias("x")).select("uid", "same", "x.entity", "x.term")
    pairs = near.select("same", "entity", F.col("term.value").alias("word")).distinct().groupBy("entity", "word").agg(F.count("*").alias("df_et"))
    # Only terms that occur near some entity need their frequency in the corpus.
    candidates = cut(pairs.join(df_entity, "entity"))
    once = docs.select(text.alias("t")).withColumn("same", F.md5(F.col("t").cast("binary"))).dropDuplicates(["same"])
    words = once.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), F.lower))).alias("word"))
    wanted = candidates.select("word").distinct()
    df_word = words.groupBy("word").agg(F.count("*").alias("df_t"))
    # A term that the entity cuts off from a longer run of letters is no word of the corpus but for there.
    scored = candidates.join(df_word.join(wanted, "word"), "word", "left").withColumn("df_t", F.greatest("df_t", "df_et"))
    information = F.log(F.lit(float(max(n, 1))) / F.col("df_e"))
    mutual = F.log(F.lit(float(max(n, 1))) * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    part = F.when(information > 0, mutual / information).otherwise(0.0)
    shown = scored.withColumn("part", part).where(F.col("part") >= generalise).select("entity", "word", F.when(F.col("part") >= remove, "remove").otherwise("generalise").alias("action"))
    hits = near.withColumn("word", F.col("term.value")).join(shown, ["entity", "word"]).groupBy("uid", "term").agg(F.max("action").alias("action"))
    hits = hits.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.col("term.s").alias("s"), F.col("term.e").alias("e"), F.col("term.value").alias("value"), "action"))).alias("terms"))
    none = F.array().cast("array<struct<s:int,e:int,value:string,action:string>>")
    return d.join(hits, "uid", "left").select("doc_id", *keep, "base", F.coalesce("terms", none).alias("terms"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, text with base values and generalised terms as placeholders, removed terms gone."""
    found = find(docs, keep=("text",), **options)
    marks = F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("<"), x["kind"], F.lit(">")).alias("by"))), F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["action"] == "remove", "").otherwise("<term>").alias("by"))))
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        late = m["s"] < acc["at"]  # overlaps what was replaced: only its rest goes
        piece = F.when(late, "").otherwise(F.concat(F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), m["s"] - acc["at"])), m["by"]))
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = F.aggregate(F.sort_array(marks), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    return found.select("doc_id", F.when(F.col("text").isNotNull(), done).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """What ``find`` returns, as counts, the hash of the base spans and the list of all spans."""
    named = lambda a, kind: F.transform(a, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string")))
    base, terms = named("base", lambda x: x["kind"]), named("terms", lambda x: F.lit("term"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"))
