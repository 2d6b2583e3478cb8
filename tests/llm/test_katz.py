import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import katz


def brute(texts, train):
    """Scores, and the model as p(w, h) with its vocabulary."""
    tok = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) + [1] for t in texts]
    uni, bi, hist = Counter(), Counter(), Counter()
    for t, on in zip(tok, train, strict=True):
        if on:
            uni.update(t)
            pairs = list(zip([0, *t[:-1]], t, strict=True))
            bi.update(pairs)
            hist.update(h for h, _ in pairs)
    of = lambda c: np.array([sum(v == r for v in c.values()) for r in range(7)], float)
    total, d1, d2 = sum(uni.values()), katz.discounts(of(uni)), katz.discounts(of(bi))
    cut = lambda c, d: c * (d[c] if c <= 5 else 1.0)
    freed = 1 - sum(cut(c, d1) for c in uni.values()) / total if total else 1.0
    over = total if freed > 1e-12 else total + 1
    p1 = lambda w: cut(uni[w], d1) / over if uni[w] else (freed if freed > 1e-12 else 1 / over)
    after = defaultdict(list)
    for h, w in bi:
        after[h].append(w)

    def p(w, h):
        if not hist[h]:
            return p1(w)
        plus = 0 if any(bi[h, x] <= 5 for x in after[h]) else 1
        under = hist[h] + plus
        if bi[h, w]:
            return cut(bi[h, w], d2) / under
        return (1 - sum(cut(bi[h, x], d2) for x in after[h]) / under) / (1 - sum(map(p1, after[h]))) * p1(w)

    scores = [sum(math.log10(p(w, h)) for h, w in zip([0, *t[:-1]], t, strict=True)) for t in tok]
    base = [sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t) for t in tok]
    known = [sum(uni[w] > 0 for w in t) for t in tok]
    return scores, base, known, [len(t) for t in tok], total, p, uni


def corpus():
    rng = np.random.default_rng(5)
    words = [f"W{k}" for k in range(40)]
    share = 1 / np.arange(1, 41)
    texts = [" ".join(rng.choice(words, rng.integers(0, 30), p=share / share.sum())) for _ in range(150)]
    return [*texts, None, "", "x " * 500, "often seen pair " * 20, "often seen pair " * 20, "unknown words only"]


@pytest.mark.parametrize("buckets", [1, 5])
def test_scores_equal_the_brute_force_model(spark, monkeypatch, buckets):
    monkeypatch.setattr(katz, "BLOCK", 2000)
    texts = corpus()
    rows = [(k, t, k) for k, t in enumerate(texts)]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    held[-1] = True
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long").repartition(3)
    model = katz.Model(docs, ~F.col("doc_id").isin([k for k, h in enumerate(held) if h]), buckets=buckets)
    got = {r["doc_id"]: r for r in model.scores().collect()}
    scores, base, known, n, total, p, uni = brute(texts, [not h for h in held])
    assert len(got) == len(texts)
    for k in range(len(texts)):
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], n[k], known[k], total)
        assert r["base_score"] == pytest.approx(base[k], abs=1e-9)
        assert r["score"] == pytest.approx(scores[k], abs=1e-6)
    for h in (0, "w0", "w7", "often", "seen", "never"):
        assert sum(p(w, h) for w in [*uni, "some unknown word"]) == pytest.approx(1)


def test_heavy_histories_are_split_without_change(spark, monkeypatch):
    texts = ["a b " * 600, "a c a d", "a zz", "b a q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in katz.Model(docs, F.col("doc_id") < 2, buckets=7).scores().collect()}
    want = brute(texts, [True, True, False, False])[0]
    assert [got[k] for k in range(4)] == pytest.approx(want)


def test_pairs_of_words_seen_once_are_known_in_held_out_texts(spark):
    unique = " ".join(f"u{k}" for k in range(30))
    texts = ["a b", "a b", unique, unique, "u3 u4 new u7 u8 u20", "a a u5 u6 " * 3, "only here", "u1 u2 b"]
    train = [k in (0, 2, 5, 6) for k in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in katz.Model(docs, F.col("doc_id").isin([k for k, on in enumerate(train) if on]), buckets=3).scores().collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(brute(texts, train)[0])
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    got = [r["score"] for r in katz.Model(docs, F.col("doc_id") == 1).scores().collect()]
    assert got[0] == pytest.approx(got[1]) == pytest.approx(brute(["a b", "a b"], [True, False])[0][0])


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.Model(empty, F.lit(True)).scores().collect() == []
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = katz.Model(docs, F.lit(False)).scores().collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["score"]) for r in got) == [("1", 3, 0, 0.0), ("1", 3, 0, 0.0), ("None", 1, 0, 0.0)]
    assert len(katz.Model(docs, F.col("doc_id") == 1).bigrams().collect()) == 3
