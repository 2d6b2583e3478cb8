import itertools
import random
import re

import pytest

from tidemark.llm import jaccard
from tidemark.llm.components import components


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [(i, shingled(t)) for i, t in docs]
    links = {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and 100 * len(a & b) >= 75 * len(a | b)}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return sets, links, {i: find(i) for i, _ in docs}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3)))
    texts = []
    shared = " ".join(word() for _ in range(25))
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 5, 8, 40, 90]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            near = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                near[r.randrange(len(near))] = word()
            texts.append(" ".join(near) + (" " + shared if r.random() < 0.2 else ""))
    texts += [shared] * 5 + [shared + " " + " ".join(word() for _ in range(40)) for _ in range(20)]
    texts += [None, "", "  \n", "A b C", "a B c", "x " * 3000, "x " * 10]
    r.shuffle(texts)
    return [(k * 3, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    docs = corpus(seed)
    sets, links, comp = brute(docs)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string").repartition(3)
    join = jaccard.Join(frame)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.documents().collect()}
    assert got == {i: (len(s), comp[i]) for i, s in sets}
    rep = {}
    for i, s in sets:
        rep.setdefault(frozenset(s), i)
    of = dict(sets)
    want = {tuple(sorted((rep[frozenset(of[i])], rep[frozenset(of[j])]))) for i, j in links if of[i] != of[j]}
    assert {tuple(sorted((r["x"], r["y"]))) for r in join.links().collect()} == want
    kept = jaccard.kept(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in comp.values()})


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.Join(empty).documents().collect() == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, jaccard.Join(docs).documents().collect()))
    assert got == sorted(f"Row(doc_id={d}, n_shingles={n}, component_id={c})" for d, n, c in [(None, 2, None), (4, 2, 2), (4, 2, 2), (2, 2, 2), (7, 0, 7)])
    assert sorted(map(str, jaccard.kept(docs).collect())) == sorted(["Row(doc_id=None, text='a b c d e f')", "Row(doc_id=2, text='a b c d e f')", "Row(doc_id=7, text=None)"])


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 130)} | {k: 200 for k in range(200, 203)}
    assert got == want
