"""URL filters, license scans, quality classifier, shards, media, decontamination and packing on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, licenses, media, packing, quality, queries, shards, urlfilter


# url filters


def test_host_path_rules_and_lists(spark):
    urls = [
        "https://A.Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://x.org", "http://x.com/fr/", "http://y.com/de/1?x=/fr/", "http://www.bad.com/de", "http://bad.com", "http://notbad.com",
        "nothing", None, "http://org/x", "http://a.b.bad.com?q#h", "http://Bad.com#top/x", "x://h://p/q",
    ]
    pages = spark.createDataFrame([(k, u, "keep") for k, u in enumerate(urls)], "page_id int, url string, note string")
    listed = spark.createDataFrame([("bad.com",), ("BAD.com",), (None,), ("",)], "host string")
    got = {r["page_id"]: r for r in urlfilter.judged(pages, listed, queries.RULES).collect()}
    want = [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("x.org", "", None, "allow"), ("x.com", "/fr/", "com/fr/", "allow"),
        ("y.com", "/de/1", "com/de/", "block"), ("www.bad.com", "/de", None, "block"), ("bad.com", "", None, "block"), ("notbad.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("org", "/x", "org/", "allow"), ("a.b.bad.com", "", None, "block"), ("bad.com", "", None, "block"), ("h:", "//p/q", None, "allow"),
    ]
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(len(urls))] == want
    assert all(r["note"] == "keep" for r in got.values())


def test_cascade_is_exact_with_tiny_filters_and_shards(spark):
    r = random.Random(1)
    hosts = [f"h{k}.example.net" for k in range(3000)]
    listed = set(r.sample(hosts, 400)) | {"elsewhere.example"}
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate(hosts)], "page_id int, url string")
    names = spark.createDataFrame([(h,) for h in listed], "host string")
    cascade = urlfilter.Cascade(spark.createDataFrame([(h,) for h in hosts], "key string"), names.withColumnRenamed("host", "key"), bits=3)
    assert len(cascade.levels) > 2
    held = spark.createDataFrame([(h,) for h in hosts], "key string").filter(cascade.holds(F.col("key")))
    assert {x["key"] for x in held.collect()} == listed & set(hosts)
    out = urlfilter.judged(pages, names, [], max_bytes=256)
    assert {hosts[x["page_id"]] for x in out.filter("verdict = 'block'").collect()} == listed & set(hosts)
    assert urlfilter.judged(pages, names.limit(0), []).filter("listed").count() == 0
    assert urlfilter.judged(pages.limit(0), names, []).count() == 0


# license scans


def test_licenses_are_found_anywhere_and_only_there(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    rows, want = [], set()
    for k in range(120):
        w = [word() for _ in range(r.randint(0, 300))]
        if k % 2:
            name = r.choice(sorted(licenses.TEMPLATES))
            at = r.randint(0, len(w))
            w[at:at] = licenses.TEMPLATES[name].upper().split() if k % 4 == 1 else licenses.TEMPLATES[name].split()
            want.add((k, name))
        rows.append((k, " ".join(w), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "MIT License is mentioned", "x"), (903, "all rights", "x")]
    got = {(x["doc_id"], x["license"]): x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert want <= set(got)
    extra = {(k, n) for k, n in set(got) - want}
    assert all((k, n + "-notice") in want for k, n in extra)  # a notice holds the short form
    assert all(x["containment"] >= licenses.CONTAINMENT for x in got.values())
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string"), {"empty": " ... "})


# quality classifier


def prose(r, good):
    w = ["".join(r.choice(["an", "er", "th", "ou", "st"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 80))]
    return " ".join(w) if good else " ".join(x.upper() + "!!" for x in w) if r.random() < 0.5 else " ".join(x for x in w[:9] for _ in range(8))


def test_classifier_reaches_high_held_out_accuracy(spark):
    r = random.Random(4)
    rows = [(k, prose(r, k % 5 > 0), k % 5 > 0) for k in range(600)]
    docs = spark.createDataFrame([(k, t, "en") for k, t, _ in rows] + [(9001, None, "en"), (9002, "", "en"), (9003, "long " * 60000, "en"), (None, "x", "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(g)) for k, _, g in rows] + [(5000, 1), (7, 2), (None, 1)], "doc_id long, quality int")
    model = queries.quality_model(docs, labels)
    got = {x["doc_id"]: x["score"] for x in quality.scored(docs, model).collect()}
    assert len(got) == 604 and got[9001] == got[9002] == pytest.approx(1 / (1 + np.exp(-model[1])))
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(got[k] >= 0.3) == rows[k][2] for k in held]) >= 0.97
    assert quality.scored(docs, quality.train(docs, labels.limit(0))).filter("score <> 0.5").count() == 0


# shards


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    store = shards.Store(spark, f"file://{tmp_path}/s")
    assert store.read().count() == 0
    for k in range(9):
        store.append(spark.createDataFrame([(k * 100 + j, None if j == 3 else "t" * j) for j in range(50)], "doc_id long, text string").coalesce(1))
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    before = sorted(map(tuple, store.read().fillna("-").collect()))
    size = max(s["bytes"] for s in store.manifest()["shards"])
    last = store.compact_all(target=4 * size, smallest=size)
    assert sorted(map(tuple, store.read().fillna("-").collect())) == before
    sizes = [s["bytes"] for s in store.manifest()["shards"]]
    assert len(sizes) < 9 and store.version() == last
    with pytest.raises(RuntimeError):
        store.commit(last - 1, [], "{}")
    assert sorted(map(tuple, store.read(last).fillna("-").collect())) == before
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1,)], "other long"))


# media


def test_media_round_trip_and_boxes(spark):
    texts = ["", None, "a", "x" * 576, "y" * 577, "é" * 20000]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in media.media_columns(docs, keep_media=True).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = bytes(r["media"])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        (track,) = media.tracks(stored)
        assert media.samples(stored, track) == payload and track["codec"] == "raw " and track["duration"] == len(payload) // 576
        assert len(track["size"]) == len(payload) // 576 and track["key"].sum() == -(-len(track["size"]) // 25)
        assert payload.startswith(stored[track["place"][0] : track["place"][0] + 576])
    stored = bytes(got[5]["media"])
    assert [p[-1] for p, _, _ in media.boxes(stored)][:3] == [b"ftyp", b"mdat", b"moov"]
    for broken in (stored[:-20], stored[:10], stored.replace(b"stco", b"stxx")):
        with pytest.raises(ValueError):
            media.tracks(broken)
    with pytest.raises(ValueError):
        media.mux(b"123")


# decontamination

ITEM = "When the Committee met in Berlin it counted 40 km of roads and Committee members noted that these roads were longer than all of the others nearby"


def find(spark, texts, items, **how):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string"), **how).collect()}


def test_leaks_are_found_verbatim_and_with_other_values(spark):
    r = random.Random(6)
    noise = lambda n: " ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(n))
    other = ITEM.replace("Berlin", "Paris").replace("40 km", "7.5 miles").replace("Committee", "Council")
    mixed = ITEM.replace("Committee members", "Delegation members")  # one slot's two places no longer agree
    texts = [noise(50) + " " + ITEM + " " + noise(50), noise(9) + "\n" + other, mixed, noise(300), None, "", ITEM[:40], ITEM.upper()]
    got = find(spark, texts, [(1, ITEM), (2, None), (3, noise(40)), (4, "Short plain item here now")])
    assert {k for k in got} == {(0, 1), (1, 1), (2, 1)}
    assert got[0, 1]["verbatim"] and not got[1, 1]["verbatim"]
    assert got[0, 1]["n_windows"] == got[1, 1]["n_windows"] > got[2, 1]["n_windows"]
    assert got[0, 1]["first_word"] == 50
    assert find(spark, ["x short plain item here now y"], [(4, "short plain item here now")]).keys() == {(0, 4)}
    assert find(spark, texts, [(1, ITEM), (3, noise(40))], broadcast_rows=5).keys() == {(0, 1), (1, 1), (2, 1)}
    assert find(spark, texts, []) == {}


def test_copies_in_other_casing_are_found(spark):
    title = "The Quick Brown Fox Jumps Over The Lazy Dog And Runs 30 km Away"
    texts = [ITEM.upper(), "x " + ITEM.lower().replace("40", "7.5"), ITEM.title(), ITEM.replace("Berlin", "Paris"), ITEM, title.lower(), title.upper().replace("FOX", "CAT"), "nothing of it " * 9]
    items = [(1, ITEM), (2, title)]
    got = find(spark, texts, items, any_case=True)
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2)}
    assert got[0, 1]["verbatim"] and got[2, 1]["verbatim"] and not got[1, 1]["verbatim"] and not got[3, 1]["verbatim"]
    assert got[0, 1]["n_windows"] == got[1, 1]["n_windows"] == got[4, 1]["n_windows"] and got[1, 1]["first_word"] == 1
    assert find(spark, texts, items, any_case=True, broadcast_rows=5).keys() == got.keys()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"), any_case=True).collect()] == [6, 7]


def test_clean_keeps_documents_and_columns(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "fine"), (None, ITEM), (2, "fine")], "doc_id long, text string")
    out = decontaminate.clean(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "2", "None"]


# packing


def test_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(queries.byte_bpe())
    reference.encode_special_tokens = True
    ids = packing.encoder(queries.byte_bpe())
    r = random.Random(9)
    texts = ["", " ", "  ", "a  b", " x", "x ", "a\n\n b\t c", "it's 'll", "x <|endoftext|> y", "über 12,5% 漢字 🙂", "a \u00a0 b", "\u2003x y"]
    texts += ["".join(r.choice(["a", "B", " ", "  ", "\n", "\t", "1", "'s", ".", "é", "\u00a0", "🙂", " the"]) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(ids(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("per_partition", [40, 50_000])
def test_packing_is_gapless_tight_and_complete(spark, per_partition):
    r = random.Random(3)
    texts = ["a b " * r.randint(0, 400) for _ in range(150)] + [None, "", "word " * 5000, "a", "a"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, piece int")
    out = packing.pack(packing.pieces(docs, queries.byte_bpe()), per_partition=per_partition)
    rows, ids, seqs, of = out.collect(), packing.encoder(queries.byte_bpe()), {}, {}
    for x in rows:
        seqs.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        of.setdefault(x["doc_id"], []).append(x)
    for places in seqs.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024
    for k, t in enumerate(texts):
        body = np.append(np.frombuffer(ids(t or ""), "<u4"), 2).astype("<u4")
        parts = sorted(of[k], key=lambda x: x["piece"])
        assert [x["piece"] for x in parts] == list(range(len(parts))) and all(x["length"] == 1024 for x in parts[1:])
        assert sum(x["length"] for x in parts) == len(body)
        assert all(zlib.crc32(body[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] for x in parts)
    total = sum(x["length"] for x in rows)
    assert len(seqs) <= -(-total // 1024) + 2


def test_bounds_and_best_fit():
    r = np.random.default_rng(1)
    for _ in range(60):
        sizes = r.integers(1, 101, r.integers(0, 60))
        bins, offs, room = packing.best_fit(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= len(room)
        assert all(sizes[bins == b].sum() + room[b] == 100 for b in range(len(room)))
    assert packing.lower_bound(np.full(7, 51), 100) == 7 and packing.lower_bound(np.full(6, 34), 100) == 3
    assert re.fullmatch(r"\d+", str(packing.lower_bound(np.zeros(0, np.int64), 100)))
