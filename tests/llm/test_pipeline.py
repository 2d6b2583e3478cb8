"""The pipeline against plain Python on a small corpus, stage by stage."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import queries
from tests.llm.test_jaccard import brute


def words(r, n):
    return ["".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(2)
    path = str(tmp_path_factory.mktemp("tables"))
    texts, good, planted = {}, {}, {}
    for k in range(160):
        w = words(r, r.randint(60, 160))
        good[k] = int(k % 4 != 3)
        texts[k] = " ".join(w) if good[k] else " ".join(x.upper() + "!!" for x in w)
    for k in range(0, 20, 4):  # near copies
        w = texts[k].split()
        w[5] = "other"
        texts[k + 200], good[k + 200] = " ".join(w), 1
    passage = " ".join(words(r, 60))
    for k in (21, 25, 29):
        texts[k] = texts[k] + " " + passage
    item = "The Committee counted " + " ".join(words(r, 20)) + " and 17 km by Berlin"
    texts[33] += " " + item
    texts[37] += " " + item.replace("17", "2.5").replace("Berlin", "Paris")
    planted = {"near": [k + 200 for k in range(0, 20, 4)], "passage": (passage, [21, 25, 29]), "leaks": [33, 37]}
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, g, 0) for k, g in good.items() if k % 10 < 9], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, " ".join(words(r, 30)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, good, planted


def test_stages(spark, folder, tmp_path):
    path, texts, good, planted = folder
    docs, seen = queries.table(spark, path, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    kept = {k for k in texts if good[k]}
    assert set(seen[0]) == kept
    comp = brute([(k, texts[k]) for k in sorted(kept)])[2]
    assert set(seen[1]) == set(comp.values()) and not set(planted["near"]) & set(seen[1])
    passage, own = planted["passage"]
    assert set(seen[2]) == set(seen[1])
    assert [k for k, r in seen[2].items() if passage in r["text"]] == own[:1]
    assert all(r["text"] == texts[k] for k, r in seen[2].items() if k not in own)
    assert set(seen[2]) - set(seen[3]) == set(planted["leaks"])
    assert set(seen[4]) == set(seen[3])
    assert sorted(map(str, docs.drop("sequence_id", "offset").collect())) == sorted(map(str, corpus_pipeline.run(spark, path).drop("sequence_id", "offset").collect()))
