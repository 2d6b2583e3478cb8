import itertools
import random

import numpy as np
import pytest

from tidemark.llm import bands
from tidemark.llm.kernels import collecting, forget, parted, written


def test_overlaps_are_exact(monkeypatch):
    monkeypatch.setattr(bands, "WIDTH", 7)
    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(60), r.randint(0, 30))), np.int64) for _ in range(20)]
    got = bands.overlaps(sets[:8], sets[8:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[8:]] for a in sets[:8]]
    assert bands.overlaps([sets[0][:0]], [sets[1]]).tolist() == [[0]]


@pytest.mark.parametrize("block", [5, 256])
def test_linked_equals_brute_force_over_pairs_that_share_a_band(spark, monkeypatch, block):
    monkeypatch.setattr(bands, "BLOCK", block)
    r = random.Random(block)
    sets = {}
    for g in range(4):  # groups of near copies of one base, some of them beyond the similarity to it
        base = list(range(1000 * g, 1000 * g + 30))
        for k in range(25):
            own = set(base)
            for _ in range(r.randint(0, 6)):
                own.discard(r.choice(base))
                own.add(1000 * g + 100 + r.randint(0, 12))
            sets[100 * g + k + 7] = own
    met = [(rep, band) for rep in sets for band in {rep // 100 * 10, rep // 100 * 10 + r.randint(1, 3), 77 if r.random() < 0.3 else 78}]
    df = {}
    for s in sets.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    rows = [(rep, len(s), sum(df[x] > 1 for x in s), sorted(s)) for rep, s in sets.items()]
    share = {}
    for rep, band in met:
        share.setdefault(rep, set()).add(band)
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if share[a] & share[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    groups = {}
    for x in sets:
        groups.setdefault(find(x), []).append(x)
    want = {x: c for c, own in groups.items() if len(own) > 1 for x in own}
    assert len(set(want.values())) > 2
    classes = spark.createDataFrame(rows, "rep long, n long, m long, shingles array<long>")
    got = bands.linked(classes, spark.createDataFrame(met, "rep long, band long"), 75)
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_parts_by_a_bloom_filter_lose_nothing(spark):
    docs = spark.range(1000).selectExpr("nullif(id, 5) as key", "id as at")
    keys = spark.range(0, 1000, 10).toDF("key")
    some, others = parted(docs, "key", keys)
    assert some.join(keys, "key").count() == 100 and others.join(keys, "key").count() == 0
    assert some.count() + others.count() == 1000 and some.count() < 200
    nothing, all_ = parted(docs, "key", keys.filter("key < 0"))
    assert nothing.count() == 0 and all_.count() == 1000


def test_tables_written_within_are_collected_and_can_go(spark):
    with collecting([]) as tables:
        one = written(spark.range(3).toDF("x"), "test")
    two = written(spark.range(3).toDF("x"), "test")
    assert [t.written_to for t in tables] == [one.written_to]
    forget(one)
    assert two.count() == 3
