"""The import of redirects against a sequential twin over many small graphs."""

import random
from collections import Counter

from tidemark.operators import redirects
from tidemark.operators.resolve import rings

RECORDS = "at long, src long, dst long, content string"


def end(graph, node):
    """Where a node ends, or None in a cycle."""
    seen = set()
    while node in graph:
        if node in seen:
            return None
        seen.add(node)
        node = graph[node]
    return node


def sequential(records, known):
    graph, evidence, out, added = dict(known), {}, {}, {}
    for at, src, dst, content in sorted(records):
        if src is None or dst is None:
            out[at] = ("unresolved", None)
            continue
        a, d = end(graph, src), end(graph, dst)
        if a is None or d is None:
            out[at] = ("cyclic", None)
        elif d == src and src != dst:
            out[at] = ("closing", d)
        elif src != d and src in graph and a != d:
            out[at] = ("conflicting", d)
        elif evidence.get(content, d) != d:
            out[at] = ("disputed", d)
        else:
            adds = src != d and src not in graph
            out[at] = ("mapped" if adds or content not in evidence else "repeated", d)
            evidence.setdefault(content, d)
            if adds:
                graph[src] = added[src] = d
    return out, added


def world(r, base):
    nodes = [base + k for k in range(r.randint(2, 8))]
    known = {n: r.choice([m for m in nodes if m != n]) for n in nodes if r.random() < 0.25}
    records = []
    for k in range(r.randint(0, 14)):
        src, dst = r.choice(nodes), r.choice(nodes)
        if r.random() < 0.05:
            src = None
        records.append((base * 100 + k, src, dst, f"{src}>{dst}>{r.randint(0, 1)}"))
    return records, known


def test_equals_a_sequential_import(spark):
    r, records, known, want, added = random.Random(7), [], {}, {}, {}
    for w in range(400):
        some, graph = world(r, 100 * (w + 1))
        out, new = sequential(some, graph)
        records += some
        known |= graph
        want |= out
        added |= new
    r.shuffle(records)
    got, pairs = redirects.imported(spark.createDataFrame(records, RECORDS).repartition(5), spark.createDataFrame(list(known.items()), "src long, dst long"))
    assert {x["at"]: (x["outcome"], x["end"]) for x in got.collect()} == want
    counts = Counter(o for o, _ in want.values())
    assert min(counts[o] for o in ("mapped", "repeated", "closing", "conflicting", "disputed", "cyclic", "unresolved")) > 5, counts
    assert {x["src"]: x["dst"] for x in pairs.collect()} == added


def test_long_cycles_are_closed_once(spark):
    n = 40
    records = [(k, k, (k + 1) % n, str(k)) for k in range(n)]
    got, pairs = redirects.imported(spark.createDataFrame(records, RECORDS), spark.createDataFrame([], "src long, dst long"))
    assert {x["at"]: x["outcome"] for x in got.collect()} == {k: "mapped" for k in range(n - 1)} | {n - 1: "closing"}
    assert pairs.count() == n - 1


def test_rings_without_what_leads_into_them(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 7), (8, 8), (9, 8), (10, 11), (11, 10)]
    assert sorted(map(tuple, rings(spark.createDataFrame(edges, "src long, dst long")).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (10, 10), (11, 10)]


def test_no_records(spark):
    got, pairs = redirects.imported(spark.createDataFrame([], RECORDS), spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert got.count() == 0 and pairs.count() == 0


def test_refusals_in_a_row_are_few_rounds(spark, monkeypatch):
    """Sources that are refused again and again, as all nodes have been joined."""
    rounds, r = [], random.Random(3)
    monkeypatch.setattr(redirects, "rings", lambda edges: rounds.append(1) or rings(edges))
    nodes = list(range(12))
    records = [(k, *r.sample(nodes, 2), str(k)) for k in range(300)]
    want, added = sequential(records, {})
    got, pairs = redirects.imported(spark.createDataFrame(records, RECORDS), spark.createDataFrame([], "src long, dst long"))
    assert {x["at"]: (x["outcome"], x["end"]) for x in got.collect()} == want
    assert {x["src"]: x["dst"] for x in pairs.collect()} == added
    assert len(rounds) <= 6
