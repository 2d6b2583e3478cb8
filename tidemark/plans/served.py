"""Served queues and scoring passes: snapshots with what was known, the claims that they make, and full or incremental passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import passes, snapshots
from ..sources.ledger import Ledger
from ..sources.scratch import fresh
from ..sources.tables import table

CATEGORIES = {"n0": "direct", "n1": "direct", "n2": "aggregator"}
FAMILIES = {"urgent": ["urgent", "high"], "low": ["low"], "french": [" des "]}


def _known(spark: SparkSession, folder: str) -> snapshots.Known:
    """Customers are postings, their orders versions, every second order has a score, every tenth score is superseded, documents describe orders."""
    o, c, d = (table(spark, folder, n) for n in ("orders", "customer", "documents"))
    text, key, none = (lambda x: F.col(x).cast("string")), F.col("o_orderkey"), F.lit(None)
    at = F.date_format("o_orderdate", "yyyy-MM-dd")
    versions = o.select(
        text("o_orderkey").alias("version"), text("o_custkey").alias("posting"), at.alias("observed_at"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("c"), (key % 9).cast("string")).alias("company"),
        F.concat(F.lit("n"), (key % 4).cast("string"), F.lit(":x")).alias("source"), (key % 5).cast("int").alias("tier"), F.lit("Likely").alias("odds"), none.cast("int").alias("odds_score"),
    )
    scores = o.filter(key % 2 == 0).select(
        F.concat(F.lit("s"), text("o_orderkey")).alias("score"), text("o_orderkey").alias("version"), F.when(key % 3 > 0, text("o_custkey")).alias("posting"), at.alias("created_at"), F.when(key % 10 == 0, "2000").alias("superseded_at"),
        F.when(key % 7 > 0, (key % 7).cast("int")).alias("tier"), F.lit("Good / High").alias("odds"), (key % 100).cast("int").alias("odds_score"), F.concat(F.lit("h"), F.floor(F.col("o_custkey") / 75).cast("string")).alias("scorer"),
    )
    descriptions = d.select(text("doc_id").alias("description"), text("doc_id").alias("version"), F.lit("1").alias("fetched_at"), F.col("text").alias("body"))
    return snapshots.Known(c.filter("c_custkey % 997 > 0").select(text("c_custkey").alias("posting")), versions, scores, descriptions)


def _captured(spark: SparkSession, folder: str) -> Ledger:
    """Twenty queues a day of the customers seen on it, written in two batches and the second one twice; the queues of every thirteenth day rank all of them first."""
    e, o = table(spark, folder, "events"), table(spark, folder, "orders")
    day = F.date_format("ts", "yyyy-MM-dd")
    seen = e.filter("user_id IS NOT NULL").groupBy(day.alias("day"), F.pmod("user_id", F.lit(20)).alias("block"), "user_id").agg(F.min("event_id").alias("first"))
    name = F.concat_ws("/", "day", F.col("block").cast("string"))
    last = o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderkey").alias("k"))
    rows = seen.join(last, "user_id", "left").withColumn("snapshot", name)
    none = F.lit(None)
    items = rows.select(
        "snapshot", F.when(F.dayofmonth(F.to_date("day")) % 13 == 0, 1).otherwise((F.col("first") + 1).cast("int")).alias("rank"), F.col("user_id").cast("string").alias("posting"), F.when(F.col("user_id") % 3 == 0, F.col("k").cast("string")).alias("version"),
        none.cast("string").alias("score"), F.when(F.col("user_id") % 11 == 0, "own title").alias("title"), none.cast("string").alias("company"), none.cast("string").alias("source"), none.cast("int").alias("tier"), none.cast("string").alias("odds"), none.cast("int").alias("odds_score"),
    )
    headers = rows.select("snapshot", F.lit("queue").alias("surface"), F.col("day").alias("at"), F.lit("p1").alias("profile"), none.cast("string").alias("scorer"), F.when(F.col("block") == 1, 300).cast("long").alias("queue_size")).distinct()
    known, ledger = _known(spark, folder), Ledger(spark, fresh(spark, "snapshots"))
    for batch, blocks in (("even", "[02468]$"), ("odd", "[13579]$"), ("odd", "[13579]$")):
        part = F.col("snapshot").rlike(blocks)
        snapshots.stored(ledger, batch, headers.filter(part), items.filter(part), known, CATEGORIES, FAMILIES)
    return ledger


def snapshot_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the snapshots, with what each was enriched to."""
    out = _captured(spark, folder).read("items", snapshots.STORED)
    return out.withColumn("claim", F.col("claim").isNotNull())


def snapshot_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of the snapshots, with the scorer that all scored items share and the number of claims that each made first."""
    ledger = _captured(spark, folder)
    heads, claims = ledger.read("snapshots", snapshots.HEADERS), ledger.read("claims", snapshots.CLAIMS)
    own = ledger.read("items", snapshots.STORED).groupBy("snapshot").agg(F.countDistinct("claim").alias("n_claims"))
    total = claims.agg(F.count("*").alias("all_claims"), F.countDistinct("claim").alias("distinct_claims"))
    return heads.join(own, "snapshot", "left").crossJoin(F.broadcast(total))  # a row


def pass_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as runs of their customers, line items as scoring passes: what each run must score, and why."""
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    runs = o.select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("requested_at"), (F.col("o_orderstatus") != "O").alias("succeeded"))
    done = li.select(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("pass"), F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("profile"), F.col("l_linestatus").alias("scorer"),
        (F.col("l_quantity") < 40).alias("completed"), F.col("l_shipdate").alias("started_at"),
    )
    mine = o.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("N").alias("profile"), F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise("O").alias("scorer"))
    return passes.modes(runs, done, mine).withColumn("reasons", F.array_join("reasons", ","))


_SEEN = """
    WITH k AS (SELECT o_custkey AS u, max(o_orderkey) AS k FROM orders GROUP BY 1),
    x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 20 AS block, user_id AS u, min(event_id) AS first FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2, 3),
    i AS (SELECT day || '/' || block AS snapshot, day, block, first, x.u, CASE WHEN x.u % 3 = 0 THEN k END AS named FROM x LEFT JOIN k ON k.u = x.u),
    bad AS (SELECT snapshot FROM i WHERE u NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 997 > 0) UNION SELECT snapshot FROM i WHERE CAST(right(day, 2) AS INTEGER) % 13 = 0 GROUP BY 1 HAVING count(*) > 1),
    s AS (SELECT *, floor(o_custkey / 75)::BIGINT AS h FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0),
    sp AS (SELECT o_custkey AS u, arg_max(o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), 's' || o_orderkey)) AS sk FROM s GROUP BY 1),
    lv AS (SELECT o_custkey AS u, arg_max(o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), CAST(o_orderkey AS VARCHAR))) AS lk FROM orders GROUP BY 1),
    r AS (SELECT i.*, CASE WHEN named IS NOT NULL THEN (SELECT o_orderkey FROM s WHERE o_orderkey = named) ELSE sk END AS sk, lk FROM i LEFT JOIN sp ON sp.u = i.u LEFT JOIN lv ON lv.u = i.u WHERE snapshot NOT IN (SELECT snapshot FROM bad)),
    f AS (SELECT *, coalesce(named, sk, lk) AS vk FROM r)"""

QUERIES = {f.__name__: f for f in (snapshot_items, snapshot_headers, pass_modes)}
SQL = {
    "snapshot_items": f"""{_SEEN},
        g AS (SELECT f.*, CASE WHEN f.u % 11 = 0 THEN 'own title' ELSE o_orderpriority END AS title, lower(substr(replace(coalesce(text, ''), '\\', ''), 1, 1500)) AS body FROM f LEFT JOIN orders ON o_orderkey = lk LEFT JOIN documents ON doc_id = vk)
        SELECT snapshot, CASE WHEN CAST(right(day, 2) AS INTEGER) % 13 = 0 THEN 1 ELSE first + 1 END::INTEGER AS rank, vk IS NOT NULL AS claim, CAST(u AS VARCHAR) AS posting, CAST(vk AS VARCHAR) AS version, 's' || sk AS score,
        coalesce(CASE WHEN sk % 7 > 0 THEN sk % 7 END, lk % 5)::INTEGER AS tier, CASE WHEN sk IS NOT NULL THEN 'Good / High' WHEN lk IS NOT NULL THEN 'Likely' END AS odds, (sk % 100)::INTEGER AS odds_score, 'n' || (lk % 4) || ':x' AS source,
        CASE WHEN lk % 4 < 2 THEN 'direct' WHEN lk % 4 = 2 THEN 'aggregator' END AS category, CASE WHEN sk IS NOT NULL THEN 'Good' END AS match_label, CASE WHEN sk IS NOT NULL THEN 'High' END AS competition_label,
        CASE WHEN lower(title) LIKE '%urgent%' OR lower(title) LIKE '%high%' THEN 'urgent' WHEN lower(title) LIKE '%low%' THEN 'low' WHEN lower(title) LIKE '% des %' THEN 'french'
            WHEN body LIKE '%urgent%' OR body LIKE '%high%' THEN 'urgent' WHEN body LIKE '%low%' THEN 'low' WHEN body LIKE '% des %' THEN 'french' END AS role_family, title, 'c' || (lk % 9) AS company FROM g""",
    "snapshot_headers": f"""{_SEEN},
        t AS (SELECT count(DISTINCT (u, vk, sk)) AS n FROM f WHERE vk IS NOT NULL)
        SELECT snapshot, 'queue' AS surface, min(day) AS at, 'p1' AS profile, CASE WHEN min(h) = max(h) THEN 'h' || min(h) END AS scorer, CASE WHEN min(block) = 1 THEN 300 ELSE count(*) END::BIGINT AS queue_size, count(vk) AS n_claims,
        min(t.n) AS all_claims, min(t.n) AS distinct_claims FROM f LEFT JOIN s ON o_orderkey = sk, t GROUP BY 1""",
    "pass_modes": """
        WITH r AS (SELECT o_custkey AS series, o_orderkey AS run, last_value(CASE WHEN o_orderstatus <> 'O' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM orders),
        p AS (SELECT l_orderkey, arg_max({'f': l_returnflag, 's': l_linestatus}, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)) AS p FROM lineitem WHERE l_quantity < 40 GROUP BY 1),
        w AS (SELECT r.*, CASE WHEN p IS NULL THEN 'no_baseline_pass' ELSE array_to_string([x FOR x IN [CASE WHEN p.f <> CASE WHEN run % 2 = 0 THEN 'A' ELSE 'N' END THEN 'profile_changed' END, CASE WHEN p.s <> CASE WHEN run % 3 = 0 THEN 'F' ELSE 'O' END THEN 'scorer_changed' END] IF x IS NOT NULL], ',') END AS reasons FROM r LEFT JOIN p ON l_orderkey = baseline)
        SELECT series, run, baseline, CASE WHEN reasons = '' THEN 'incremental' ELSE 'full' END AS mode, reasons FROM w""",
}
