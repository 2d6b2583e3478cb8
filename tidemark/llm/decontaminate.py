"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become word lists; numbers, units behind numbers and capitalised names
become typed slots. Each window of ``window`` tokens of a benchmark item is a
template. A template's anchor is its longest plain word: the words of all
documents are looked up among the anchors, and only windows that stand around an
anchor as in some template are canonicalised, and their hash must equal the
template's. Then the slots must be consistent: two slots of a window hold the same value in the document exactly
if they do in the item. So a question that comes back with other numbers and
names is still found. Windows with fewer than ``literals`` plain words are no
evidence. An item shorter than ``window`` is looked for as a whole.

Names are told by their capitals, so a copy in other casing has other slots.
With ``any_case`` each window is a second template, of its words in lower case
with names as words, and documents are looked up in it in lower case too: a copy
in any casing is found, with other numbers, and in the item's casing with other
names.

Null and empty texts and items match nothing. Rows that repeat a document id
are one document. A window that two items share counts for both; a template that
one item has twice, with the same words, counts once. Whole texts are searched,
however long. Templates are
broadcast ``broadcast_rows`` at a time (a few hundred bytes each), with one scan
of the documents a time, so memory is bounded for any benchmark. Extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import parted, written

WINDOW, LITERALS, BROADCAST_ROWS = 12, 6, 50_000
WORD = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+"

# Units of measure that are slots behind a number.
UNITS = [
    "a", "amp", "bar", "cents", "cm", "c", "days", "dollars", "eur", "euros", "f", "feet", "ft", "g", "gb", "grams", "h", "hours", "hz", "in", "inches",
    "j", "k", "kb", "kg", "km", "kmh", "kw", "l", "lbs", "liters", "litres", "m", "mb", "meters", "metres", "mg", "miles", "min", "minutes", "ml", "mm",
    "months", "mph", "ms", "n", "oz", "pa", "percent", "pounds", "s", "seconds", "t", "tons", "usd", "v", "w", "weeks", "years",
]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _is_number(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def canonical(tokens: Column) -> Column:
    """Typed placeholders for numbers, for units behind them, and for words with a capital."""

    def one(t: Column, i: Column) -> Column:
        behind = (i > 0) & _is_number(F.get(tokens, i - 1)) & F.lower(t).isin(UNITS)
        return F.when(_is_number(t), "<num>").when(behind, "<unit>").when(F.lower(t) != t, "<name>").otherwise(t)

    return F.transform(tokens, one)


def consistent(ours: Column, theirs: Column) -> Column:
    """Equal slots here are equal slots there and the other way round: the pairs are one to one."""
    pairs = F.size(F.array_distinct(F.arrays_zip(ours, theirs)))
    return (pairs == F.size(F.array_distinct(ours))) & (pairs == F.size(F.array_distinct(theirs)))


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def templates(items: DataFrame, item: str, text: str, window: int, literals: int, any_case: bool = False) -> DataFrame:
    """item, its tokens, template, anchor and the anchor's place, of each benchmark window that is evidence; ``folded`` ones are in lower case."""
    base = items.select(F.col(item).alias("item"), words(F.col(text)).alias("all")).withColumn("size", F.least(F.size("all"), F.lit(window))).filter("size > 0")
    starts = F.explode(F.sequence(F.lit(1), F.size("all") - F.col("size") + 1))
    cased = base.withColumn("canon", canonical(F.col("all"))).withColumn("folded", F.lit(False))
    if any_case:
        cased = cased.unionByName(base.withColumn("canon", canonical(lowered(F.col("all")))).withColumn("folded", F.lit(True)))
    cut = cased.select("item", "folded", "size", "all", "canon", starts.alias("at"))
    cut = cut.select("item", "folded", F.slice("all", F.col("at"), F.col("size")).alias("item_tokens"), F.slice("canon", F.col("at"), F.col("size")).alias("template"))
    plain = F.filter("template", lambda t: ~t.startswith("<"))
    enough = (F.size(plain) >= F.least(F.lit(literals), F.size("template"))) & (F.size(plain) > 0)
    longest = F.array_max(F.transform(plain, lambda t: F.struct(F.length(t), t.alias("word"))))["word"]
    return cut.distinct().filter(enough).withColumn("anchor", longest).withColumn("offset", F.array_position("template", F.col("anchor")).cast("int") - 1)


def _places(tokens: Column, wanted: list[str]) -> Column:
    """Where the wanted words stand."""
    return F.array_compact(F.transform(tokens, lambda t, i: F.when(t.isin(wanted), i)))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, literals: int = LITERALS, broadcast_rows: int = BROADCAST_ROWS, any_case: bool = False) -> DataFrame:
    """One row a document and item: matched windows, the first one's word, and whether all its slots hold the item's own values."""
    known = templates(items, item, item_text, window, literals, any_case)
    turns = max(1, -(-known.count() // broadcast_rows))
    tokens = docs.select(F.col(key).alias("doc"), words(F.col(text)).alias("tokens"))
    found = []
    for turn in range(turns):
        part = known.filter(F.pmod(F.xxhash64("anchor"), F.lit(turns)) == turn) if turns > 1 else known
        anchors = [r["anchor"] for r in part.select("anchor").distinct().collect()]  # at most broadcast_rows words of the benchmark
        few = tokens.withColumn("places", _places(lowered(F.col("tokens")) if any_case else F.col("tokens"), anchors)).filter(F.size("places") > 0)
        # only the words around an anchor leave the row, so a long text is not copied for each of its places
        low = lambda p: F.greatest(p - window, F.lit(0))
        cut = lambda p: F.struct(p.alias("place"), F.slice("tokens", low(p) + 1, p + window - low(p)).alias("near"))
        met = few.select("doc", F.explode(F.transform("places", cut)).alias("cut")).select("doc", "cut.*").withColumn("low", low(F.col("place")))
        own = F.get("near", F.col("place") - F.col("low"))
        met = met.withColumn("anchor", F.lower(own) if any_case else own).join(F.broadcast(part), "anchor")
        start, size = F.col("place") - F.col("offset") - F.col("low"), F.size("template")
        # slices may be evaluated before the filter, so their bounds are legal for any start
        met = met.filter((F.col("place") >= F.col("offset")) & (start + size <= F.size("near"))).withColumn("from", F.greatest(start, F.lit(0)))
        met = met.withColumn("at", F.col("low") + F.col("from")).withColumn("own", F.slice("near", F.col("from") + 1, size))
        before = F.greatest(F.col("from"), F.lit(1))  # the word before tells whether the first one is a unit
        context = F.slice("near", before, size + F.col("from") + 1 - before)
        if any_case:
            context = F.when(F.col("folded"), lowered(context)).otherwise(context)
        same = F.xxhash64(F.slice(canonical(context), -size, size)) == F.xxhash64("template")
        slots = lambda side: F.filter(F.transform(side, lambda t, i: F.when(F.get("template", i).startswith("<"), F.lower(t))), lambda t: t.isNotNull())
        met = met.filter(same).filter(consistent(slots(F.col("own")), slots(F.col("item_tokens"))))
        found.append(met.select("doc", "item", "at", (lowered("own") == lowered("item_tokens")).alias("same")))
    out = reduce(DataFrame.unionByName, found).groupBy("doc", "item")
    out = out.agg(F.countDistinct("at").alias("n_windows"), F.min("at").cast("long").alias("first_word"), F.bool_and("same").alias("verbatim"))
    return out.withColumnsRenamed({"doc": key, "item": item})


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The documents in which no item is found; a document without a key is kept."""
    found = written(matches(docs, items, key, **how).select(key).distinct(), "decontaminate-found")
    some, others = parted(docs, key, found)
    return others.unionByName(some.join(found, key, "left_anti").select(docs.columns))
