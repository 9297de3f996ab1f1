"""Benchmark decontamination by templates.

Texts become token sequences in which numbers, units behind numbers and names (capitalised words within a sentence) are
typed placeholders, and all words are lower-cased.  Windows of ``width`` tokens of the documents meet those of
the benchmark in a hash join.  A document leaks an item if it holds at least ``share`` of the item's windows, and if
the values in its placeholders follow the item's: one value of the item must stand for one value of the document (the
same, or a new one throughout) in ``consistent`` of the places.  A place is looked for where the windows over it were
met, of several such where most windows of the item were, and where none was met as in the best alignment of all.  So
questions are found with their numbers and names changed and words put in, but not texts that merely have the same frame.

Windows with fewer than ``min_words`` plain words are no evidence and count on neither side; an item with no other
window is never found.  Null texts are empty.  Repeated rows of documents are one document by id and text; of items too.
Null ids are kept apart from no other null.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fixed_order_bound, free_name
from .line_quality import let

# Words for units that can follow a number.
UNITS = "kg g mg t lb oz km m cm mm mi mile miles ft feet inch inches l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent euro euros dollar dollars cent cents degree degrees mph kmh mb gb".split()
MARK = "\x02"  # begins a placeholder
NAME = r"(?<=[\p{Ll}\p{N},;:] )[A-Z][a-z]\p{L}*"
NUMBER = r"(?<![\p{L}\p{N}])\p{N}++(?!\p{L})"


def templates(text: Column, values: bool = False) -> Column:
    """The runs of letters and digits of a text, lower-cased, with typed placeholders; these carry what they stand for if
    ``values``.  The whole text is rewritten before it is split, so no token is handled on its own."""
    kept = "$0" if values else ""
    x = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
    x = F.regexp_replace(x, NAME, f"{MARK}name{kept}")
    x = F.lower(F.regexp_replace(x, NUMBER, f"{MARK}num{kept}"))
    unit = rf"(?<={MARK}num\p{{N}}{{0,20}} )(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
    x = F.regexp_replace(x, unit, f"{MARK}unit{kept}")
    return F.array_remove(F.split(x, rf"[^\p{{L}}\p{{N}}{MARK}]+"), "")


def window_hashes(temps: Column, width: int) -> Column:
    """A hash of the window that begins at each token; the last ones are short."""
    return let(temps, lambda t: F.transform(t, lambda x, i: F.xxhash64(x, *[F.get(t, i + j) for j in range(1, width)])))


def whole_windows(temps: Column, width: int, min_words: int) -> Column:
    """struct(h, i) of each whole window that has ``min_words`` plain words."""

    def chosen(t: Column) -> Column:
        plain = F.transform(t, lambda w: F.when(F.startswith(w, F.lit(MARK)), 0).otherwise(1))
        each = F.transform(window_hashes(t, width), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.filter(each, lambda x: (x["i"] <= F.size(t) - width) & (F.aggregate(F.slice(plain, x["i"] + 1, width), F.lit(0), lambda s, v: s + v) >= min_words))

    return let(temps, chosen)


def _slots(rows: DataFrame, *ids: str) -> DataFrame:
    """Rows (ids, text) to ids, at, value of each placeholder."""
    each = rows.select(*ids, F.posexplode(templates(F.col("text"), values=True)).alias("at", "x"))
    return each.where(F.startswith("x", F.lit(MARK))).select(*ids, "at", F.col("x").alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, consistent: float = 0.8, min_words: int = 2, max_broadcast: int = 500_000) -> DataFrame:
    """``docs`` (doc_id, text) and ``benchmark`` (item_id, text) to doc_id, item_id, n_windows, n_found, n_slots,
    consistency, exact for each document and item that it leaks."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    # What stands before an item can make a name of its first word, so its first window is asked for in both forms.
    behind = F.filter(whole_windows(templates(F.concat(F.lit("a "), "text")), width, min_words), lambda x: x["i"] == 1)
    items = cut(items.select("item_id", "text", whole_windows(templates(F.col("text")), width, min_words).alias("w"), behind.alias("behind")))
    first = F.transform(F.when(F.exists("w", lambda x: x["i"] == 0), F.col("behind")).otherwise(F.slice("behind", 1, 0)), lambda x: F.struct(x["h"].alias("h"), F.lit(0).alias("i")))
    asked = items.select("item_id", F.size("w").alias("n_windows"), F.explode(F.array_union("w", first)).alias("x")).select("item_id", "n_windows", F.col("x.h").alias("h"), F.col("x.i").alias("b"))
    n_asked = asked.count()
    held = docs.select("doc_id", F.posexplode(window_hashes(templates(F.col("text")), width)).alias("d", "h"))
    met = cut(held.join(fixed_order_bound(asked, n_asked, max_broadcast), "h").select("doc_id", "item_id", "n_windows", "b", (F.col("d") - F.col("b")).alias("shift")))
    found = met.select("doc_id", "item_id", "n_windows", "b").distinct().groupBy("doc_id", "item_id", "n_windows").agg(F.count("*").alias("n_found"))
    found = found.where(F.col("n_found") >= share * F.col("n_windows"))
    aligned = met.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("n"))
    best = aligned.groupBy("doc_id", "item_id").agg(F.max(F.struct("n", (-F.col("shift")).alias("shift"))).alias("best"))
    found = cut(found.join(best, ["doc_id", "item_id"]).select("doc_id", "item_id", "n_windows", "n_found", (-F.col("best.shift")).alias("shift")))
    # Values in placeholders, for the documents found and the items with any.
    item_slots = _slots(items, "item_id").withColumnRenamed("value", "item_value")
    # Each is looked for where the windows over it were met, so words put in or left out move only what is behind them.
    pair = ["doc_id", "item_id"]
    by_window = met.join(found.select(*pair), pair).join(aligned, [*pair, "shift"]).groupBy(*pair, "b").agg(F.max(F.struct("n", (-F.col("shift")).alias("back"))).alias("own"))
    own = by_window.select(*pair, F.explode(F.sequence("b", F.col("b") + (width - 1))).alias("at"), "own").groupBy(*pair, "at").agg((-F.max("own")["back"]).alias("own"))
    at = F.col("at") + F.coalesce("own", "shift")
    to_check = cut(found.join(item_slots, "item_id").join(own, [*pair, "at"], "left").select(*pair, "item_value", at.alias("at")))
    ids = to_check.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(fixed_order_bound(ids, ids.count(), max_broadcast), "doc_id")
    doc_slots = _slots(texts, "doc_id")
    pairs = to_check.join(doc_slots, ["doc_id", "at"], "left").groupBy("doc_id", "item_id", "item_value", "value").agg(F.count("*").alias("n"))
    usual = pairs.groupBy("doc_id", "item_id", "item_value").agg(F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("most"), F.sum("n").alias("n"), F.sum(F.when(F.col("value") == F.col("item_value"), F.col("n"))).alias("equal"))
    checked = usual.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_slots"), (F.sum(F.coalesce("most", F.lit(0))) / F.sum("n")).alias("consistency"), (F.sum(F.coalesce("equal", F.lit(0))) == F.sum("n")).alias("same_values"))
    out = found.join(checked, ["doc_id", "item_id"], "left")
    out = out.where(F.coalesce(F.col("consistency"), F.lit(1.0)) >= consistent)
    return out.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "n_found", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("consistency", F.lit(1.0)).alias("consistency"), ((F.col("n_found") == F.col("n_windows")) & F.coalesce("same_values", F.lit(True))).alias("exact"))


def clean(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 500_000, **options) -> DataFrame:
    """``docs`` without those that leak an item; a document whose id is null stays."""
    i = free_name(docs, "bad_id")
    bad = cut(leaks(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias(i)).distinct())
    return docs.join(fixed_order_bound(bad, bad.count(), max_broadcast), F.col("doc_id") == F.col(i), "left_anti")
