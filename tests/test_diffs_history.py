"""Nested comparison and score history against plain Python over random values."""

import json
import random
from collections import Counter

from tidemark.operators import diffs, history
from tidemark.operators.ingest import entity_id

KEY = tuple(history.KEY)


def walk(a, b, extra_allowed, tolerated, path="$"):
    """(path, kind) of the differences of two values."""
    out = []
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted({*a, *b}):
            if k not in a:
                out += [] if k in extra_allowed else [(f"{path}.{k}", "extra")]
            elif k not in b:
                out.append((f"{path}.{k}", "missing"))
            elif k not in tolerated:
                out += walk(a[k], b[k], extra_allowed, tolerated, f"{path}.{k}")
        return out
    if isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            out.append((path, "length"))
        url = lambda x: x.get("url") if isinstance(x, dict) else None
        holder = lambda x: next((k for k in sorted(x) if url(x[k]) is not None), None) if isinstance(x, dict) else None
        names = [h for h in map(holder, a) if h] + [h for h in map(holder, b) if h]
        key = None
        if all(url(x) is not None for x in a + b):
            key = url
        elif names and all(isinstance(x, dict) and url(x.get(names[0])) is not None for x in a + b):
            key = lambda x: url(x[names[0]])
        if key:
            x, y, name = {key(v): v for v in a}, {key(v): v for v in b}, "[url={}]"
        else:
            x, y, name = dict(enumerate(a)), dict(enumerate(b)), "[{}]"
        for k in [*x, *(k for k in y if k not in x)]:
            at = path + name.format(k)
            if k not in x:
                out.append((at, "extra"))
            elif k not in y:
                out.append((at, "missing"))
            else:
                out += walk(x[k], y[k], extra_allowed, tolerated, at)
        return out
    return [] if a == b and isinstance(a, bool) == isinstance(b, bool) else [(path, "value")]


def value(r, depth):
    kind = r.choice(["object", "object", "list", "urls", "held", "plain"]) if depth else "plain"
    if kind == "object":
        return {k: value(r, depth - 1) for k in r.sample("abcdxy", r.randint(0, 4))}
    if kind == "list":
        return [value(r, depth - 1) for _ in range(r.randint(0, 3))]
    if kind == "urls":
        return [{"url": f"u{r.randint(0, 3)}", "v": value(r, depth - 1)} for _ in range(r.randint(0, 3))]
    if kind == "held":
        return [{"job": {"url": f"u{r.randint(0, 3)}"}, "v": r.randint(0, 1)} for _ in range(r.randint(0, 3))]
    return r.choice([1, 2, 2.5, "text", "1", "", True, False, None])


def changed(r, v):
    """A value like v, with some parts of it changed."""
    if r.random() < 0.1:
        return value(r, 2)
    if isinstance(v, dict):
        out = {k: x if k == "url" else changed(r, x) for k, x in v.items() if r.random() > 0.08}
        return out | ({r.choice("xyz"): 5} if r.random() < 0.1 else {})
    if isinstance(v, list):
        out = [changed(r, x) for x in v if r.random() > 0.08]
        r.shuffle(out)
        return out
    return v


def test_differences_equal_a_recursive_walk(spark):
    r, rows, want = random.Random(8), [], Counter()
    for k in range(300):
        a = value(r, 5)
        b = changed(r, a)
        rows.append((k, json.dumps(a), json.dumps(b)))
        want.update((k, *d) for d in walk(a, b, {"x"}, {"y"}))
    got = diffs.differences(spark.createDataFrame(rows, "k long, one string, two string"), "k", "one", "two", ["x"], ["y"])
    assert got.columns == ["k", "path", "kind", "left", "right"]
    assert Counter((x["k"], x["path"], x["kind"]) for x in got.collect()) == want
    assert {kind for _, _, kind in want} == {"missing", "extra", "length", "value"} and max(p.count(".") + p.count("[") for _, p, _ in want) >= 4


def test_odd_texts(spark):
    rows = [(1, None, None), (2, None, "1"), (3, "{", "{"), (4, "{", "[]"), (5, "1", "1.0"), (6, '"1"', "1"), (7, "null", "null"), (8, "[]", "{}"), (9, "true", "false"), (10, '[{"url": "a", "n": 1}, {"url": "a", "n": 2}]', '[{"url": "a", "n": 2}]')]
    got = diffs.differences(spark.createDataFrame(rows, "k long, a string, b string"), "k", "a", "b").collect()
    assert sorted((x["k"], x["path"], x["kind"]) for x in got) == [(2, "$", "value"), (4, "$", "value"), (6, "$", "value"), (8, "$", "value"), (9, "$", "value"), (10, "$", "length")]
    assert diffs.differences(spark.createDataFrame([], "k long, a string, b string"), "k", "a", "b").count() == 0


def test_history_equals_a_sequential_one(spark):
    r, table, current = random.Random(2), {}, {}
    frame = spark.createDataFrame([], history.HISTORY)
    keys = [(f"e{k}", f"p{k % 2}", s) for k in range(40) for s in ("s1", "s2")]
    ids = {}
    for x in spark.createDataFrame([(*k, i) for k in keys for i in "ABC"], "entity string, profile string, scorer string, input string").withColumn("id", entity_id(*KEY, "input")).collect():
        ids[(x["entity"], x["profile"], x["scorer"]), x["input"]] = x["id"]
    for step in range(4):
        plan = {k: r.choice("ABC") for k in keys if r.random() < 0.7}
        buckets = {}
        for k in {*plan, *current}:
            new, old = plan.get(k), current.get(k)
            if new is None:
                buckets[k] = "untouched"
            elif new == old:
                buckets[k] = "reused"
            else:
                buckets[k] = "reverted" if (k, new) in table else "fresh" if old is None else "replaced"
                if old is not None:
                    table[k, old][1:] = [str(step), ids[k, new]]
                table.setdefault((k, new), [str(step), None, None])[1:] = [None, None]
                current[k] = new
        one = history.merged(frame, spark.createDataFrame([(*k, i) for k, i in plan.items()], "entity string, profile string, scorer string, input string"), str(step))
        assert {tuple(x[c] for c in KEY): x["bucket"] for x in one.buckets.collect()} == buckets
        assert one.to_score().count() == sum(b in ("fresh", "replaced") for b in buckets.values())
        frame = one.history
        got = {((x["entity"], x["profile"], x["scorer"]), x["input"]): [x["scored_at"], x["superseded_at"], x["superseded_by"]] for x in frame.collect()}
        assert got == table
    assert sum(v[1] is None for v in table.values()) == len(current)
