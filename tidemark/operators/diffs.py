"""Structural comparison of nested values: two JSON texts a row, walked level by level, and each difference named by its path.

A round compares one level of all rows at once. Pairs of objects are opened by key,
pairs of lists by place or by the ``url`` of their elements, pairs of the same text
not at all; what is in one side
only is ``missing`` or ``extra``, lists of unequal length are a ``length`` besides,
and two other values that are not equal are a ``value``. The pairs that were opened
are the next round's rows, so there are as many rounds as the values are deep, and
no schema is needed.

Lists whose elements all have a ``url``, or all hold one under the same single
name, are matched by it, in any order; of elements with the same url the last one
counts. Other lists are matched by place. Keys in ``extra_allowed`` may be there on
the second side only, at any depth; keys in ``tolerated`` must be on both, but
their values are not compared. Numbers are equal as JSON numbers: 1 and 1.0 are.

A text that is no JSON, and a null, compare as themselves: equal if both are the
same text or both are null. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_value
from ..sources.scratch import dropped, written

#: Rounds after which values are compared whole; deeper ones than this are told apart, but not taken apart.
DEPTH = 64

_OBJECT = "map<string, variant>"


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", _OBJECT)


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _url(v: Column) -> Column:
    return F.try_variant_get(v, "$.url", "string")


def _holder(items: Column) -> Column:
    """The first key by which an element holds an object with a url, in order of elements and keys."""
    names = F.transform(items, lambda x: F.get(F.array_sort(F.map_keys(F.map_filter(F.coalesce(_fields(x), F.create_map().cast(_OBJECT)), lambda k, v: _url(v).isNotNull()))), 0))
    return F.get(F.array_compact(names), 0)


def _same(a: Column, b: Column) -> Column:
    """Equal plain values; numbers by value, strings by themselves."""
    x, y = F.to_json(a), F.to_json(b)
    numbers = F.try_variant_get(a, "$", "double") == F.try_variant_get(b, "$", "double")
    both = ~x.startswith('"') & ~y.startswith('"') & x.rlike("^[-0-9]") & y.rlike("^[-0-9]")
    return x.eqNullSafe(y) | F.coalesce(both & numbers, F.lit(False))


def _opened(todo: DataFrame, extra_allowed: list[str], tolerated: list[str]) -> DataFrame:
    """Steps (key, path, kind, a, b) of pairs of JSON texts: differences, and pairs for the next round. Each kind of values is opened on its own."""
    step = lambda path, kind, a, b: F.struct(path.alias("path"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("variant")

    def matched(left: Column, right: Column, name, allowed: bool) -> Column:
        keys = F.array_union(F.map_keys(left), F.map_keys(right))

        def one(k: Column) -> Column:
            path, a, b = F.concat("path", name(k)), F.try_element_at(left, k), F.try_element_at(right, k)
            there, here = F.map_contains_key(left, k), F.map_contains_key(right, k)
            extra = step(path, "extra", none, b)
            if allowed and extra_allowed:
                extra = F.when(~k.isin(extra_allowed), extra)
            both = step(path, "pair", a, b)
            if allowed and tolerated:
                both = F.when(~k.isin(tolerated), both)
            return F.when(~there, extra).when(~here, step(path, "missing", a, none)).otherwise(both)

        return F.filter(F.transform(keys, one), lambda s: s.isNotNull())

    objects = matched(F.col("fa"), F.col("fb"), lambda k: F.concat(F.lit("."), k), True)
    by = lambda items, key: F.map_from_entries(F.transform(items, lambda x: F.struct(key(x).alias("key"), x.alias("value"))))
    later = lambda items, key: F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: key(y) == key(x)))
    last = lambda items, key: F.when(F.size(F.array_distinct(F.transform(items, key))) == F.size(items), items).otherwise(later(items, key))
    direct, held = _url, lambda x: F.try_variant_get(F.try_element_at(_fields(x), F.col("holder")), "$.url", "string")
    placed = lambda items: F.map_from_entries(F.transform(items, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))))
    all_ = lambda key: F.forall("ia", lambda x: key(x).isNotNull()) & F.forall("ib", lambda x: key(x).isNotNull())
    keyed = lambda items: F.when(F.col("by_url"), by(last(items, direct), direct)).when(F.col("by_held"), by(last(items, held), held)).otherwise(placed(items))
    mark = F.when(F.col("by_url") | F.col("by_held"), "[url=").otherwise("[")
    lists = matched(F.col("ma"), F.col("mb"), lambda k: F.concat("mark", k, F.lit("]")), False)
    length = F.when(F.size("ia") != F.size("ib"), F.array(step(F.col("path"), "length", F.col("a"), F.col("b")))).otherwise(F.array().cast("array<struct<path: string, kind: string, a: variant, b: variant>>"))

    pairs = lambda rows: rows.select("key", "path", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    both = lambda mark: F.coalesce(F.col("a").startswith(mark) & F.col("b").startswith(mark), F.lit(False))
    maps = pairs(todo.filter(both("{"))).withColumns({"fa": _fields(F.col("a")), "fb": _fields(F.col("b"))}).select("key", F.inline(objects))
    items = pairs(todo.filter(both("["))).withColumns({"ia": _items(F.col("a")), "ib": _items(F.col("b"))})
    items = items.withColumn("holder", F.coalesce(_holder(F.col("ia")), _holder(F.col("ib")))).withColumn("by_url", all_(direct)).withColumn("by_held", ~F.col("by_url") & F.col("holder").isNotNull() & F.coalesce(all_(held), F.lit(False)))
    items = items.withColumns({"ma": keyed(F.col("ia")), "mb": keyed(F.col("ib")), "mark": mark}).select("key", F.inline(F.concat(length, lists)))  # a map is made once, not once a key
    rest = pairs(todo.filter(~both("{") & ~both("["))).filter(~_same(F.col("a"), F.col("b"))).select("key", "path", F.lit("value").alias("kind"), "a", "b")
    return maps.unionByName(items).unionByName(rest).select("key", "path", "kind", F.to_json("a").alias("a"), F.to_json("b").alias("b"))


def differences(rows: DataFrame, key: str, left: str, right: str, extra_allowed: list[str] | None = None, tolerated: list[str] | None = None) -> DataFrame:
    """(key, path, kind, left, right) of all differences between two columns of JSON texts; values are JSON texts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.col(key).alias("key"), F.col(left).alias("left"), F.col(right).alias("right")).repartition(parts, "key")  # a small file is one task else, in all rounds
    a, b = json_value(F.col("left")), json_value(F.col("right"))
    known = own.withColumns({"a": a, "b": b})
    whole = known.filter("a IS NULL OR b IS NULL").filter("NOT left <=> right").select("key", F.lit("$").alias("path"), F.lit("value").alias("kind"), F.col("left").alias("left"), F.col("right").alias("right"))
    found, todo = [whole], written(known.filter("a IS NOT NULL AND b IS NOT NULL").select("key", F.lit("$").alias("path"), F.to_json("a").alias("a"), F.to_json("b").alias("b")), "diff-pairs")
    for _ in range(DEPTH):
        if todo.isEmpty():
            break
        steps = _opened(todo, extra_allowed or [], tolerated or [])
        steps = written(steps, "diff-steps")
        dropped(todo)
        found.append(steps.filter("kind <> 'pair'").select("key", "path", "kind", F.col("a").alias("left"), F.col("b").alias("right")))
        todo = written(steps.filter("kind = 'pair' AND NOT a <=> b").select("key", "path", "a", "b"), "diff-pairs")
    found.append(todo.filter("NOT a <=> b").select("key", "path", F.lit("value").alias("kind"), F.col("a").alias("left"), F.col("b").alias("right")))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("key", key)
