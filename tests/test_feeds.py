"""Feeds of pushed pages: whole pages only, in order, resumed where the checkpoint stopped."""

import os

from tidemark.sources.source import FolderFeed, PagedFeed, push


class Numbers(PagedFeed):
    @classmethod
    def name(cls):
        return "numbers"

    def fetch(self, instance, page):
        yield from (f"{instance}{page}{k}" for k in range(2))


def test_a_batch_reads_all_pages(spark):
    spark.dataSource.register(Numbers)
    got = spark.read.format("numbers").option("instances", "a,b").option("pages", "2").load()
    assert sorted(x["payload"] for x in got.collect()) == sorted(f"{i}{p}{k}" for i in "ab" for p in range(2) for k in range(2))


def test_pushed_pages_are_streamed_in_order_and_resumed(spark, tmp_path):
    spark.dataSource.register(FolderFeed)
    path, batches = f"file://{tmp_path}/inbox", []

    def pushed(instance, page, *payloads):
        push(spark.createDataFrame([(p,) for p in payloads], "payload string").coalesce(1), path, instance, page)

    def follow():
        df = spark.readStream.format("folder_feed").option("path", path).option("instances", "a,b").load()
        sink = lambda rows, k: batches.append(sorted((x["instance"], x["page"], x["payload"]) for x in rows.collect()))
        query = df.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/checkpoint").start()
        query.processAllAvailable()
        query.stop()

    pushed("a", 0, "p0", "é")
    pushed("b", 0, "q0")
    follow()
    pushed("a", 1, "p1")
    pushed("b", 1)
    pushed("a", 2, "waits for its twin")
    follow()
    assert [b for b in batches if b] == [[("a", 0, "p0"), ("a", 0, "é"), ("b", 0, "q0")], [("a", 1, "p1")]]
    pushed("b", 2, "q2")
    os.makedirs(f"{tmp_path}/inbox/a/3")
    pushed("b", 3, "not yet")
    follow()
    assert [b for b in batches if b][2:] == [[("a", 2, "waits for its twin"), ("b", 2, "q2")]]
