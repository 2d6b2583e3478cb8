"""Streams over several parts: stopped and resumed, filtered with state, written by claims, and the tail of what they commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources.ledger import Ledger
from ..sources.parsers import parsed
from ..sources.scratch import fresh
from ..sources.source import FolderFeed, push
from ..sources.tables import table
from ..streaming import reposts, resume
from ..streaming.events import drained
from .ingest import RESOLVED, orders_as_records


def _fed(spark: SparkSession, rows: DataFrame, parts: list[str], drain: Callable[[DataFrame], object]) -> None:
    """Drains a stream of rows after each part that comes in, so that a part is a batch, in as many files as it is written by tasks."""
    path = fresh(spark, "stream-in")
    for part in parts:
        rows.filter(part).write.mode("append").parquet(path)
        drain(spark.readStream.schema(rows.schema).parquet(path))


_QUARTERS = [f"event_id % 4 = {k}" for k in range(4)]


def stream_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Events in four parts go into a ledger by a stream that dies after its second commit, before that is noted, and is started again."""
    rows = table(spark, folder, "events").select("event_id", "event_type", "value")
    ledger, root, mark, seen, ends = Ledger(spark, fresh(spark, "ledger")), fresh(spark, "streams"), resume.fingerprint(source="events", files=4), [], []

    def dies(rows: DataFrame, batch: str) -> None:
        resume.into(ledger, "events")(rows, batch)
        seen.append(batch)
        if len(seen) == 2:
            raise RuntimeError("stopped half-way")

    def drain(df: DataFrame) -> None:
        try:
            ends.append(resume.run(df, root, "events", mark, dies))
        except StreamingQueryException as e:
            if "stopped half-way" not in str(e):
                raise

    _fed(spark, rows, _QUARTERS, drain)
    now = ends[-1]
    out = ledger.read("events", "event_id long, event_type string, value double").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return out.select("event_type", "n", "ids", F.lit(ledger.version()).cast("long").alias("commits"), F.lit(now.resumed).alias("resumed"))


def stream_reposts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as postings in four runs of their order: a url once, three a company and title."""
    e = table(spark, folder, "events")
    last = e.agg(F.max("event_id")).first()[0] or 0
    key = F.col("user_id").cast("string")
    rows = e.select(F.col("event_id").alias("order"), F.concat(F.lit("https://"), "event_type", F.lit(".example/"), key, F.when(F.col("event_id") % 2 == 0, "?gclid=1").otherwise("/")).alias("url"), F.upper("event_type").alias("company"), F.concat(F.lit("Title "), (F.col("user_id") % 7).cast("string")).alias("title"))
    cuts = [(last * k // 4, last * (k + 1) // 4) for k in range(4)]
    ledger, root, mark = Ledger(spark, fresh(spark, "ledger")), fresh(spark, "streams"), resume.fingerprint(source="events", cap=3)
    _fed(spark, rows, [f"`order` >= {a} AND (`order` < {b} OR {b} = {last})" for a, b in cuts], lambda df: resume.run(df, root, "reposts", mark, reposts.into(ledger, 3)))
    return ledger.read("kept", rows.schema).select("order", "company", "title")


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Records by identity claims in three parts, written by a stream: the entity of each alias, as if they came in one batch."""
    writer, root, mark = ingest.Writer(spark, fresh(spark, "ledger")), fresh(spark, "streams"), resume.fingerprint(source="orders")
    sink = lambda rows, batch: writer.write(batch, rows, "run", "orders", batch, "2024-01-01")
    _fed(spark, orders_as_records(table(spark, folder, "orders")), ["record < 3000", "record >= 3000 AND record < 9000", "record >= 9000"], lambda df: resume.run(df, root, "orders", mark, sink))
    return writer.ledger.read("aliases", ingest.ALIASES).select("claim", F.col("posting").alias("entity"), "rank")


def ledger_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Three commits of events by type; the tail replays what is past the first one."""
    e, ledger = table(spark, folder, "events"), Ledger(spark, fresh(spark, "ledger"))
    for kind in ("view", "click", "purchase"):
        rows = e.filter(F.col("event_type") == kind).select("event_id", "user_id")
        ledger.commit(kind, {"events": {"events": rows}, "users": {"users": rows.select("user_id").distinct()}})
    return drained(ledger.tail(after=1))


def pushed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as board payloads, pushed in three pages for two instances while a stream reads them: the postings of each batch."""
    o, path, ledger = table(spark, folder, "orders"), fresh(spark, "inbox"), Ledger(spark, fresh(spark, "ledger"))
    key = F.col("o_orderkey")
    job = F.struct(key.alias("id"), F.concat(F.lit("Order  "), key.cast("string")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("first_published"), F.struct(F.col("o_orderpriority").alias("name")).alias("location"), F.concat(F.lit("https://B.example/"), key.cast("string"), F.lit("?gh_src=x")).alias("absolute_url"))
    spark.dataSource.register(FolderFeed)
    bronze = spark.readStream.format("folder_feed").option("path", path).option("instances", "even,odd").load()
    sink = lambda rows, batch: ledger.commit(str(batch), {"append": {"bronze": rows.withColumn("batch", F.lit(batch).cast("long"))}})
    query = bronze.writeStream.foreachBatch(sink).option("checkpointLocation", fresh(spark, "checkpoint")).start()
    try:
        for page in range(3):
            for instance in ("even", "odd"):
                own = o.filter((key % 3 == page) & (key % 2 == (1 if instance == "odd" else 0)))
                push(own.groupBy((key % 50).alias("g")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(job)).alias("jobs"))).alias("payload")), path, instance, page)
            query.processAllAvailable()
    finally:
        query.stop()
    rows = ledger.read("bronze", "source string, instance string, page int, payload string, batch long")
    good, _ = parsed(rows.select(F.lit("greenhouse").alias("source"), F.concat_ws(":", "instance", "page").alias("instance"), "payload"), "greenhouse")
    return good.select("instance", "native_id", "title", "location", "url", "posted")


QUERIES = {f.__name__: f for f in (stream_resumed, stream_reposts, stream_ingest, ledger_tail, pushed_payloads)}
SQL = {
    "stream_resumed": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, 4::BIGINT AS commits, true AS resumed FROM events GROUP BY 1",
    "stream_reposts": """
        WITH u AS (SELECT event_id AS "order", event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events),
        c AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY "order") AS n FROM u WHERE k = 1)
        SELECT "order", upper(event_type) AS company, 'Title ' || (user_id % 7) AS title FROM c WHERE n <= 3""",
    "stream_ingest": f"""
        WITH RECURSIVE {RESOLVED}
        SELECT f.claim, left(sha256(h.head), 32) AS entity, CASE WHEN starts_with(f.claim, 'id:') THEN 0 ELSE 1 END::INTEGER AS rank FROM f JOIN r ON r.record = f.first JOIN p h ON h.record = r.root""",
    "pushed_payloads": """
        SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'odd' ELSE 'even' END || ':' || (o_orderkey % 3) AS instance, CAST(o_orderkey AS VARCHAR) AS native_id, 'Order ' || o_orderkey AS title, o_orderpriority AS location,
        'https://b.example/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders""",
    "ledger_tail": """
        WITH k AS (SELECT * FROM (VALUES (2, 'click'), (3, 'purchase')) v(version, batch)), e AS (SELECT version, batch, count(*) AS n, count(DISTINCT user_id) AS u FROM k LEFT JOIN events ON event_type = batch GROUP BY 1, 2)
        SELECT version::BIGINT AS version, batch, 'events,users' AS operations, 'events' AS "table", n AS rows FROM e UNION ALL SELECT version::BIGINT, batch, 'events,users', 'users', u FROM e""",
}
