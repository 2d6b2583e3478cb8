"""Streams that die and go on, changed fingerprints, the repost filter over several files, and the tail of a ledger."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import streams
from tidemark.sources.ledger import Ledger
from tidemark.streaming import reposts, resume
from tidemark.streaming.events import drained

ROWS = "order long, url string, company string, title string"


def files(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")


def rows_of(r, n, first=0):
    urls = [f"https://x.example/{k}" for k in range(40)]
    return [(first + k, r.choice(urls) + r.choice(["", "/", "?gclid=1", "#top"]), r.choice(["A", "a", "B", None]), r.choice(["Job", "job", "Other"])) for k in range(n)]


def brute(rows, cap):
    seen, count, out = set(), {}, []
    for order, url, company, title in sorted(rows):
        key = url.split("?")[0].split("#")[0].rstrip("/")
        if key in seen:
            continue
        seen.add(key)
        who = ((company or "").lower(), title.lower())
        count[who] = count.get(who, 0) + 1
        if cap <= 0 or count[who] <= cap:
            out.append(order)
    return out


@pytest.mark.parametrize("cap", [0, 1, 3])
def test_reposts_in_a_batch(spark, cap):
    rows = rows_of(random.Random(cap), 200)
    got = reposts.filtered(spark.createDataFrame(rows, ROWS).repartition(5), cap)
    assert sorted(r["order"] for r in got.collect()) == brute(rows, cap)


def test_reposts_over_several_files(spark, tmp_path):
    r = random.Random(9)
    parts = [rows_of(r, 60, 100 * k) for k in range(4)]
    parts[2].append((250, "", "A", "no url"))
    with reposts.state_store(spark):
        got = drained(reposts.filtered(files(spark, tmp_path, parts), 3))
    rows = [x for p in parts for x in p if x[1]]
    assert sorted(x["order"] for x in got.collect()) == brute(rows, 3)
    assert len(brute(rows, 3)) < len(brute(rows, 0))


@pytest.mark.parametrize("cap", [0, 1, 3])
def test_reposts_into_a_ledger_equal_the_batch_form_also_when_a_batch_comes_again(spark, tmp_path, cap):
    r = random.Random(10 + cap)
    parts = [rows_of(r, 60, 100 * k) for k in range(4)] + [[]]
    parts[2].append((250, "", "A", "no url"))
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    sink = reposts.into(ledger, cap)
    for k, rows in enumerate(parts):
        for _ in range(1 + (k == 1)):
            sink(spark.createDataFrame(rows, ROWS).repartition(3), f"b{k}")
    rows = [x for p in parts for x in p if x[1]]
    assert sorted(x["order"] for x in ledger.read("kept", ROWS).collect()) == brute(rows, cap)
    assert ledger.version() == 5 and ledger.read("seen", reposts.SEEN).count() == len(brute(rows, 0))


def test_the_repost_query_asks_python_for_no_key(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("once a key")

    monkeypatch.setattr(reposts, "filtered", refused)
    assert streams.stream_reposts(spark, "/root/testdata/sf0.001").count() > 0


def test_a_killed_stream_goes_on_without_loss_or_repetition(spark, tmp_path):
    df = files(spark, tmp_path, [rows_of(random.Random(k), 10, 100 * k) for k in range(4)])
    ledger, root, calls = Ledger(spark, f"file://{tmp_path}/ledger"), f"file://{tmp_path}/streams", []

    def dies(when):
        def sink(rows, batch):
            calls.append(batch)
            if len(calls) == 2 and when == "before":
                raise RuntimeError("killed")
            resume.into(ledger, "rows")(rows, batch)
            if len(calls) == 4 and when == "after":
                raise RuntimeError("killed")

        return sink

    mark = resume.fingerprint(source="in", cap=3)
    for when in ("before", "after"):
        with pytest.raises(Exception, match="killed"):
            resume.run(df, root, "s", mark, dies(when))
    now = resume.run(df, root, "s", resume.fingerprint(cap=3, source="in"), dies("never"))
    assert (now.number, now.resumed) == (1, True)
    assert [c.rpartition("-")[2] for c in calls] == ["0", "1", "1", "2", "2", "3"]
    assert sorted(r["order"] for r in ledger.read("rows", ROWS).collect()) == sorted(100 * k + j for k in range(4) for j in range(10))
    assert ledger.version() == 4


def test_another_fingerprint_starts_anew(spark, tmp_path):
    df = files(spark, tmp_path, [rows_of(random.Random(k), 5, 100 * k) for k in range(2)])
    root, seen = f"file://{tmp_path}/streams", []
    for cap in (1, 1, 2, 1):
        resume.run(df, root, "s", resume.fingerprint(cap=cap), lambda rows, batch: seen.append((batch, rows.count())))
    assert seen == [(f"s-{g}-{k}", 5) for g in (1, 2, 3) for k in (0, 1)]


def test_the_tail_replays_past_a_cursor_and_follows(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    one = spark.range(4).select(F.col("id").cast("long"))
    for k in range(3):
        ledger.commit(f"b{k}", {"x": {"a": one, "b": one.limit(k)}})
    got, checkpoint = [], f"file://{tmp_path}/checkpoint"

    def follow():
        query = ledger.tail(after=1).writeStream.foreachBatch(lambda rows, k: got.extend(tuple(r) for r in rows.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    follow()
    assert sorted(got) == [(2, "b1", "x", "a", 4), (2, "b1", "x", "b", 1), (3, "b2", "x", "a", 4), (3, "b2", "x", "b", 2)]
    ledger.commit("b3", {"y": {"a": one}})
    follow()
    assert got[4:] == [(4, "b3", "y", "a", 4)]
