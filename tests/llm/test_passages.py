import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import passages
from tidemark.llm.kernels import Hasher, text_bytes


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(n)]


def corpus(seed=3):
    """Documents by id, the planted passages by the ids that hold them, and the ids of clean documents."""
    r = random.Random(seed)
    docs, planted = {}, []
    for k in range(60):
        docs[k] = [words(r, r.randint(20, 120)) for _ in range(r.randint(1, 4))]
    boiler = words(r, 13)
    for k in range(0, 60, 2):
        docs[k].append(list(boiler))
    holders = list(range(40))
    r.shuffle(holders)
    for p in range(10):
        passage, own = words(r, r.randint(51, 90)), holders[4 * p : 4 * p + r.choice([2, 3, 4])]
        for d in own:
            line = r.choice(docs[d])
            at = r.randint(0, len(line))
            line[at:at] = passage
        planted.append((passage, own))
    base = words(r, 100)
    near = list(base)
    near[50] = "changed"
    docs[100], docs[101] = [base], [words(r, 30), near]
    return {k: "\n".join(" ".join(line) for line in d) for k, d in docs.items()}, planted, set(range(60)) - {d for _, own in planted for d in own}


def frame(spark, docs):
    return spark.createDataFrame([(k, t, len(t)) for k, t in docs.items()], "doc_id long, text string, n_chars int").repartition(3)


def test_every_planted_passage_is_found_and_clean_documents_are_not(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 5000)
    docs, planted, clean = corpus()
    got = passages.repeats(frame(spark, docs)).collect()
    assert not {r["doc_id"] for r in got} & clean
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append(r)
    for passage, own in planted:
        for d in own:
            if d == min(own):
                continue
            at = docs[d].split().index(passage[0])
            while docs[d].split()[at : at + len(passage)] != passage:
                at = docs[d].split().index(passage[0], at + 1)
            hit = sum(max(0, min(s["first_word"] + s["n_words"], at + len(passage)) - max(s["first_word"], at)) for s in spans[d])
            assert hit >= len(passage) - 2 * passages.NEAR
            assert min(own) in {s["kept_in"] for s in spans[d]}
    assert [(r["first_word"], r["n_words"], r["kept_in"]) for r in spans[101]] == [(30, 100, 100)]
    assert 100 not in spans


def test_repeated_passages_are_found_to_their_first_and_last_word(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 3000)
    for seed in (5, 6):
        docs = {k: t for k, t in corpus(seed)[0].items() if k < 100}
        # three documents that share runs of other lengths with one another
        r = random.Random(seed + 100)
        run = words(r, 90)
        docs |= {k: " ".join([*words(r, 40), *run[a:z], *words(r, 40)]) for k, a, z in ((70, 0, 60), (71, 5, 75), (72, 2, 90))}
        held, want = {}, {}
        for k in sorted(docs):
            t = docs[k].split()
            for a in range(len(t) - passages.LEAST + 1):
                first = held.setdefault(tuple(t[a : a + passages.LEAST]), k)
                if first != k:
                    want.setdefault(k, set()).update(range(a, a + passages.LEAST))
        got = {}
        for row in passages.repeats(frame(spark, docs)).collect():
            got.setdefault(row["doc_id"], set()).update(range(row["first_word"], row["first_word"] + row["n_words"]))
        assert got.keys() == want.keys() and all(want[k] <= got[k] for k in want)  # near paragraphs go whole
        assert all(got[k] == want[k] for k in (71, 72))


def test_removal_leaves_each_passage_once(spark):
    docs, planted, clean = corpus(4)
    docs[200], docs[201] = None, docs[100]
    source = frame(spark, {k: t or "" for k, t in docs.items()}).withColumn("hash", F.lit("kept"))
    out = passages.removed(source)
    assert out.columns == source.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(rows[k]["text"] == docs[k] for k in clean)
    assert all(r["n_chars"] == len(r["text"]) and r["hash"] == "kept" for r in rows.values())
    for passage, own in planted:
        assert [k for k, r in rows.items() if " ".join(passage) in r["text"]] == [min(own)]
    assert 201 not in rows and 200 in rows


def test_band_recall_is_high(spark):
    r = random.Random(8)
    met = tried = 0
    for _ in range(300):
        a = words(r, 80)
        b = list(a)
        for _ in range(r.randint(1, 3)):
            b[r.randrange(80)] = "zz" + str(r.random())
        t = passages.Texts(Hasher(), *text_bytes(pa.array([" ".join(a), " ".join(b)])))
        sets = [set(t.s[t.w[k] : t.w[k + 1] - 4].tolist()) for k in (0, 1)]
        if len(sets[0] & sets[1]) >= 0.75 * len(sets[0] | sets[1]):
            _, bands = t.bands(*t.lines())
            tried += 1
            met += bool((bands[:, 0] == bands[:, 1]).any())
    assert tried > 50 and met >= 0.97 * tried


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert passages.repeats(empty).collect() == []
    text = " ".join(words(random.Random(1), 60))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text), (3, None), (4, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["first_word"], r["n_words"]) for r in passages.repeats(docs).collect()] == [(2, 0, 60)]
    assert sorted(str(r["doc_id"]) for r in passages.removed(docs).collect()) == ["1", "1", "3", "4", "None"]
    assert np.array_equal(passages.Texts(Hasher(), *text_bytes(pa.array(["a b"]))).windows()[0], [])
