"""Ledgers and bookkeeping: positional matches, survivors, bridges, backfills, accounting and readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_date
from ..operators.latest import first_rows
from ..operators.resolve import survivors
from ..sources.tables import table


def nearest_preceding(spark: SparkSession, folder: str) -> DataFrame:
    """Each click with the user's nearest preceding view in the stream's order, wherever it stands."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, folder, "events").withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return rows.filter("event_type = 'click'").select("event_id", "view_id")


def merge_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Of parts with one name and brand: one with a size above 40 survives, else the cheapest, else the smallest key."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_brand").alias("g"), "p_size", "p_retailprice")
    return survivors(p, "g", [(F.col("p_size") <= 40).asc(), F.col("p_retailprice"), F.col("id")]).select("id", "survivor", "survives")


def alias_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Keys by how many owners they have: none to bridge, an alias, or ambiguous evidence."""
    o = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("key")).agg(F.countDistinct("o_custkey").alias("owners"), F.min("o_custkey").alias("owner"), F.count("*").alias("n"))
    return o.select("key", F.when(F.col("n") == 1, "no-op").when(F.col("owners") == 1, "alias").otherwise("ambiguous").alias("outcome"), F.when(F.col("owners") == 1, F.col("owner")).alias("owner"))


def epoch_days(spark: SparkSession, folder: str) -> DataFrame:
    """Epoch milliseconds and seconds back to UTC days."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select("event_id", F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd").alias("day_ms"), F.date_format(F.timestamp_seconds(F.floor(ms / 1000)), "yyyy-MM-dd").alias("day_s"), normalize_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day_text"))


def missing_aware(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts in which NaN, empty and absent are all missing, and truth in many spellings."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 != 0, F.col("value"))
    amount = F.when(~F.isnan(v), v)
    flag = F.get(F.array(*map(F.lit, ("true", "1", "Yes", "no", "", "0"))), (F.col("event_id") % 6).cast("int"))
    return table(spark, folder, "events").select("event_id", F.round(amount, 2).alias("amount"), F.lower(flag).isin("true", "1", "yes").alias("truth"))


def first_seen_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' first order dates kept from an earlier ledger (never moved later), and whether the newest order is another one."""
    o = table(spark, folder, "orders")
    old = o.filter("o_orderkey < 5000").groupBy("o_custkey").agg(F.min("o_orderdate").alias("old_first"), F.max("o_orderkey").alias("old_key"))
    new = o.filter("o_orderkey >= 5000").groupBy("o_custkey").agg(F.min("o_orderdate").alias("new_first"), F.max("o_orderkey").alias("new_key"))
    rows = old.join(new, "o_custkey", "full_outer")
    return rows.select("o_custkey", F.date_format(F.least("old_first", "new_first"), "yyyy-MM-dd").alias("first_seen"), F.coalesce(F.col("old_key") != F.col("new_key"), F.lit(False)).alias("reposted"))


def health_pruning(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger of sources without entries of 45 days and more, but for the one being written."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"), F.count("*").alias("n"))
    return o.filter((F.datediff(F.lit("1998-12-01").cast("date"), F.to_date("at")) < 45) | (F.col("o_custkey") == 7)).select("o_custkey", "n")


def resume_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Users as sources: any success, the last checkpoint, and the number of attempts."""
    e = table(spark, folder, "events")
    return e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("done"), F.max_by("event_id", F.struct("ts", "event_id")).alias("checkpoint"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("attempts"))


def verdict_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of a batch: known key, the first one a key, a castable tier of 1 to 5; the rest is counted by reason."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").try_cast("int").alias("tier"))
    known = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")).filter("user_id % 4 <> 0").withColumn("known", F.lit(True))
    rows = e.join(known, "user_id", "left").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    why = F.when(F.col("known").isNull(), "unknown").when(F.col("rn") > 1, "repeated").when(F.col("tier").isNull() | ~F.col("tier").between(1, 5), "tier").otherwise("accepted")
    return rows.groupBy(why.alias("outcome")).agg(F.count("*").alias("n"))


def overdue_then_upcoming(spark: SparkSession, folder: str) -> DataFrame:
    """Overdue orders before upcoming ones, the first eight of both, and how many are hidden."""
    day = F.to_date("o_orderdate")
    o = table(spark, folder, "orders").withColumn("part", F.when((day >= "1998-05-20") & (day < "1998-06-01"), 0).when((day >= "1998-06-01") & (day <= "1998-06-10"), 1)).filter("part IS NOT NULL")
    total = o.agg(F.count("*").alias("n"))
    return o.orderBy("part", "o_orderdate", "o_orderkey").limit(8).join(F.broadcast(total)).select("o_orderkey", "part", (F.col("n") - 8).alias("hidden"))


def state_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """One synthetic event a filled state field of each customer."""
    c = table(spark, folder, "customer")
    fields = F.array(F.struct(F.lit("segment").alias("field"), F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("value")), F.struct(F.lit("rich").alias("field"), F.when(F.col("c_acctbal") > 9000, "1").alias("value")))
    return c.select("c_custkey", F.inline(fields)).filter("value IS NOT NULL")


def import_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Every line lands in exactly one outcome, and the outcomes add up to the lines."""
    e = table(spark, folder, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    outcome = F.when(F.col("event_type") == "error", "malformed").when(F.col("rn") > 1, "duplicate").when(F.col("value") < 5, "archived").otherwise("mapped")
    counts = e.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return counts.unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("all").alias("outcome"), "n"))


def readiness_blockers(spark: SparkSession, folder: str) -> DataFrame:
    """What stands against a cut-over, as a list of codes from many scalar checks."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    facts = [
        o.join(c, o.o_custkey == c.c_custkey, "left_anti").agg(F.count("*").alias("orphan_orders")),
        o.groupBy("o_orderkey").count().filter("count > 1").agg(F.count("*").alias("duplicate_keys")),
        c.join(o, o.o_custkey == c.c_custkey, "left_anti").agg(F.count("*").alias("idle_customers")),
        o.agg(F.count_if(F.col("o_totalprice") < 0).alias("negative_prices")),
    ]
    row = reduce(lambda a, b: a.join(F.broadcast(b)), facts)  # one row each
    codes = F.array_compact(F.array(*[F.when(F.col(x) > 0, x) for x in ("orphan_orders", "duplicate_keys", "idle_customers", "negative_prices")]))
    return row.select("*", F.array_join(codes, ",").alias("blockers"), (F.size(codes) == 0).alias("ready"))


def overlapping_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Price buckets of 10,000 that overlap a band from 95,000 to 151,000, with their counts."""
    b = (F.floor(F.col("o_totalprice") / 10000) * 10000).cast("long").alias("lo")
    return table(spark, folder, "orders").groupBy(b).agg(F.count("*").alias("n")).filter("lo + 10000 > 95000 AND lo < 151000")


def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Dense vectors in a fixed order of names from sparse maps; what is absent is 0."""
    e = table(spark, folder, "events")
    sums = F.map_from_entries(F.collect_list(F.struct("event_type", "n")))
    maps = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(sums.alias("m"))
    names = ["click", "error", "never", "purchase", "signup", "view"]
    return maps.select("user_id", F.array_join(F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0)).cast("string")), ",").alias("vector"))


def newest_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """Minimum tier, presence, and each brand's two newest accepted parts."""
    p = table(spark, folder, "part").filter("p_size >= 20 AND p_type <> 'SMALL'")
    return first_rows(p, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 2).select("p_partkey", "p_brand", "rn")


QUERIES = {
    f.__name__: f
    for f in (
        nearest_preceding, merge_survivors, alias_bridge, epoch_days, missing_aware, first_seen_ledger, health_pruning, resume_plan, verdict_cleaning, overdue_then_upcoming, state_backfill, import_accounting,
        readiness_blockers, overlapping_bands, feature_vectors, newest_accepted,
    )
}

SQL = {
    "nearest_preceding": """
        WITH r AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events)
        SELECT event_id, view_id FROM r WHERE event_type = 'click'""",
    "merge_survivors": """
        SELECT p_partkey AS id, first_value(p_partkey) OVER w AS survivor, row_number() OVER w = 1 AS survives FROM part WINDOW w AS (PARTITION BY p_name, p_brand ORDER BY p_size <= 40, p_retailprice, p_partkey)""",
    "alias_bridge": """
        SELECT strftime(o_orderdate, '%Y-%m-%d') AS key, CASE WHEN count(*) = 1 THEN 'no-op' WHEN count(DISTINCT o_custkey) = 1 THEN 'alias' ELSE 'ambiguous' END AS outcome, CASE WHEN count(DISTINCT o_custkey) = 1 THEN min(o_custkey) END AS owner FROM orders GROUP BY 1""",
    "epoch_days": "SELECT event_id, strftime(make_timestamp(epoch_ms(ts) * 1000), '%Y-%m-%d') AS day_ms, strftime(to_timestamp(epoch_ms(ts) // 1000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day_s, strftime(ts, '%Y-%m-%d') AS day_text FROM events",
    "missing_aware": "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN round(value, 2) END AS amount, event_id % 6 < 3 AS truth FROM events",
    "first_seen_ledger": """
        SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, count(*) FILTER (o_orderkey < 5000) > 0 AND count(*) FILTER (o_orderkey >= 5000) > 0 AS reposted FROM orders GROUP BY 1""",
    "health_pruning": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-12-01') < 45 OR o_custkey = 7",
    "resume_plan": "SELECT user_id, bool_or(event_type = 'purchase') AS done, arg_max(event_id, (ts, event_id)) AS checkpoint, count(*) FILTER (event_type = 'error') AS failed, count(*) AS attempts FROM events GROUP BY 1",
    "verdict_cleaning": """
        WITH r AS (SELECT c_custkey IS NOT NULL AND user_id % 4 <> 0 AS known, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, CAST(json_extract_string(props, '$.k') AS INTEGER) AS tier FROM events LEFT JOIN customer ON c_custkey = user_id)
        SELECT CASE WHEN NOT known THEN 'unknown' WHEN rn > 1 THEN 'repeated' WHEN tier IS NULL OR tier NOT BETWEEN 1 AND 5 THEN 'tier' ELSE 'accepted' END AS outcome, count(*) AS n FROM r GROUP BY 1""",
    "overdue_then_upcoming": """
        WITH p AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN 0 ELSE 1 END AS part FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-05-20' AND DATE '1998-06-10')
        SELECT o_orderkey, part, (SELECT count(*) FROM p) - 8 AS hidden FROM p ORDER BY part, o_orderdate, o_orderkey LIMIT 8""",
    "state_backfill": "SELECT c_custkey, 'segment' AS field, c_mktsegment AS value FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' UNION ALL SELECT c_custkey, 'rich', '1' FROM customer WHERE c_acctbal > 9000",
    "import_accounting": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events), o AS (SELECT CASE WHEN event_type = 'error' THEN 'malformed' WHEN rn > 1 THEN 'duplicate' WHEN value < 5 THEN 'archived' ELSE 'mapped' END AS outcome FROM r)
        SELECT outcome, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events""",
    "readiness_blockers": """
        WITH f AS (SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphan_orders, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys,
                   (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS idle_customers, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS negative_prices),
        c AS (SELECT *, concat_ws(',', CASE WHEN orphan_orders > 0 THEN 'orphan_orders' END, CASE WHEN duplicate_keys > 0 THEN 'duplicate_keys' END, CASE WHEN idle_customers > 0 THEN 'idle_customers' END, CASE WHEN negative_prices > 0 THEN 'negative_prices' END) AS blockers FROM f)
        SELECT *, blockers = '' AS ready FROM c""",
    "overlapping_bands": "WITH b AS (SELECT CAST(floor(o_totalprice / 10000) * 10000 AS BIGINT) AS lo, count(*) AS n FROM orders GROUP BY 1) SELECT * FROM b WHERE lo + 10000 > 95000 AND lo < 151000",
    "feature_vectors": "SELECT user_id, concat_ws(',', " + ", ".join(f"count(*) FILTER (event_type = '{n}')" for n in ("click", "error", "never", "purchase", "signup", "view")) + ") AS vector FROM events GROUP BY 1",
    "newest_accepted": "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part WHERE p_size >= 20 AND p_type <> 'SMALL' QUALIFY rn <= 2",
}
