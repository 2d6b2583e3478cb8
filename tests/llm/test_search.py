"""Ranked search against brute force, the bisection's use, and edges of rows and items."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import search
from tidemark.llm.kernels import U64

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=search.TOP):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    count, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, c in wanted.items():
        scores = []
        for i, d in own:
            m = 75 + 25 * sum(d.values()) * count // total
            s = sum(n * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * d[t] // (1000 * d[t] + 12 * m)) for t, n in c.items() if d[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).withColumns({"key": F.lit("x"), "item": F.lit(1), "score": F.lit(2), "shard": F.lit(3)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("x"), "rank": F.lit(1), "item": F.lit(1)})
    out = search.Index(d).top(i, **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(r) for r in out.collect())


def corpus(r, n):
    """Texts of several vocabularies, with common words in all, and groups of equal ones."""
    topics = [[f"{c}{k}" for k in range(60)] for c in "abcdeé"]
    texts = []
    for k in range(n):
        topic = topics[k % len(topics)]
        texts.append(" ".join(r.choice(topic) if r.random() < 0.7 else r.choice(["The", "of", "and", "7"]) for _ in range(r.randint(1, 60))))
    return texts + [texts[0]] * 100 + [texts[1] + " extra"] * 50


def test_equals_brute_force_in_several_waves(spark, monkeypatch):
    monkeypatch.setattr(search, "FIRST", 1)
    monkeypatch.setattr(search, "GROWTH", 2)
    monkeypatch.setattr(search, "PIECE", 8000)
    r = random.Random(11)
    docs = list(enumerate(corpus(r, 700)))
    r.shuffle(docs)
    items = [(k, " ".join(t.split()[:12])) for k, t in docs[:25]] + [(100, "the THE the of"), (101, "unknown words"), (102, "")]
    assert found(spark, docs, items) == brute(docs, items)


def test_turns_and_another_k(spark, monkeypatch):
    monkeypatch.setattr(search, "TERMS", 20)
    r = random.Random(12)
    docs = list(enumerate(corpus(r, 200)))
    items = [(k, t) for k, t in docs[:12]]
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "... !!"), (4, "Straße ÄÖ ä"), (5, "straße äö ä"), (5, "straße äö ä"), (6, "a_b-c d\x00e"), (None, "a b c straße"), (7, "long " * 200_000 + "tail"), (-8, "A B"), (9, "a b")]
    items = [(1, "STRAße"), (2, "ÄÖ"), (3, None), (None, "a"), (4, "a"), (4, "b b"), (5, "tail long"), (6, "c d e")]
    assert found(spark, docs, items) == brute(docs, [i for i in items if i[0] is not None])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a"), (2, "b")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []
    assert found(spark, [(1, "one")], [(1, "one")]) == brute([(1, "one")], [(1, "one")])


def test_order_brings_common_terms_together():
    """Documents of two vocabularies, mixed, lie apart in the bisection's order, and the tree tells new ones apart."""
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 2, 800)
    doc = np.repeat(np.arange(800), 20)
    term = rng.integers(0, 100, 16_000) + 100 * kind[doc]
    both = np.unique(doc * 200 + term)
    doc, term = np.divmod(both, 200)
    order = search.bisection_order(doc, term, 800)
    assert sorted(order.tolist()) == list(range(800))
    assert np.abs(np.diff(kind[order])).sum() <= search.LEAF  # the halves are equal, so one leaf may hold both
    tree = search.Tree(doc, term.astype(U64), 800, depth=1)
    side = tree.cluster(np.arange(200).astype(U64), doc, term, 800)
    assert max((side == kind).mean(), (side != kind).mean()) > 0.9


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**7], np.int64)
    assert search.lengths(n, 10**14, 3 * 10**15).tolist() == [75 + 25 * int(x) * 10**14 // (3 * 10**15) for x in n]
