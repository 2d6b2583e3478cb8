"""Versions of entities: latest, previous and as-of states, changes between runs, presence, supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.changes import changes_as_events, compared, content_hash, presence, superseded
from ..operators.latest import as_of, first_rows, latest_by, trailing, validity
from ..operators.numbering import numbered
from ..sources.tables import table

CUT = "1998-01-01"


def _orders(spark, folder):
    return table(spark, folder, "orders")


def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return latest_by(_orders(spark, folder), ["o_custkey"], ["o_orderdate", "o_totalprice", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


def latest_with_fallback_chain(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's newest filled order, else the newest open one, else the newest of any kind."""
    level = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = _orders(spark, folder).withColumn("level", level)
    return first_rows(rows, ["o_custkey"], [F.col("level"), F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "level")


def as_of_join_validity(spark: SparkSession, folder: str) -> DataFrame:
    """The order that was a customer's current one at each other customer event: an order is valid until the next one."""
    o = validity(_orders(spark, folder).select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    asked = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(F.lit("1995-06-01"), F.lit("1998-03-15"))).alias("day")).withColumn("at", F.col("day").cast("timestamp_ntz"))
    return as_of(asked, o, "o_custkey", "at", "o_orderdate", "valid_to", ["o_orderkey"], ["o_orderkey"]).select("o_custkey", "day", "o_orderkey")


def alias_validity(spark: SparkSession, folder: str) -> DataFrame:
    o = validity(_orders(spark, folder), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return o.select("o_orderkey", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), F.col("valid_to").isNull().alias("active"))


def previous_consumed_state(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose state differs from the user's last consumed one (value of 20 or more), nulls being states."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, folder, "events").withColumn("previous", F.last(F.when(F.col("value") >= 20, F.col("event_type")), ignorenulls=True).over(w))
    return rows.filter("NOT (event_type <=> previous)").select("event_id", "event_type", "previous")


def content_hash_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as versions of their customers: dirty is the first one, and one whose content is not that of the version before it."""
    o = table(spark, folder, "orders").withColumn("hash", content_hash("o_orderstatus", "o_orderpriority"))
    before = F.lag("hash").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_orderkey", "hash", (~before.eqNullSafe(F.col("hash"))).alias("dirty"))


def set_new_gone_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of two periods: new, gone, changed or same in their latest order's status and priority."""
    o = _orders(spark, folder)
    halves = [latest_by(o.filter(c), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]) for c in (F.col("o_orderdate") < CUT, F.col("o_orderdate") >= CUT)]
    return compared(*halves, ["o_custkey"], ["o_orderstatus", "o_orderpriority"]).select("o_custkey", "change", F.array_join("fields", ",").alias("fields"))


def change_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = set_new_gone_changed(spark, folder)
    return rows.agg(F.count("*").alias("observed"), *[F.count_if(F.col("change") == c).alias(c) for c in ("new", "gone", "changed", "same")])


def change_events(spark: SparkSession, folder: str) -> DataFrame:
    """One event a field that changed between a customer's first and latest order."""
    o = _orders(spark, folder)
    old, new = (latest_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"], newest=n) for n in (False, True))
    return changes_as_events(old, new, ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


def licensed_absence(spark: SparkSession, folder: str) -> DataFrame:
    """Customers after a run over a period: absent only where their segment was enumerated completely."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("source"))
    seen = _orders(spark, folder).filter(F.col("o_orderdate") >= CUT).select(F.col("o_custkey").alias("key"))
    complete = c.sparkSession.createDataFrame([("BUILDING",), ("MACHINERY",)], "source string")
    return presence(c, seen, complete, "key", "source").select("key", "source", "presence")


def supersession(spark: SparkSession, folder: str) -> DataFrame:
    """Planned scores against current ones, by hash: fresh, reused, replaced or kept."""
    p = table(spark, folder, "part")
    current = p.filter("p_partkey % 3 <> 0").select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256).alias("hash"))
    planned = p.filter("p_partkey % 5 <> 0").select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", F.when(F.col("p_size") > 25, "X").otherwise(F.col("p_type"))), 256).alias("hash"))
    return superseded(current, planned, ["p_partkey"], "hash")


def first_observation(spark: SparkSession, folder: str) -> DataFrame:
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    return _orders(spark, folder).select("o_orderkey", (F.col("o_orderdate") == first).alias("is_first"))


def collision_winner(spark: SparkSession, folder: str) -> DataFrame:
    """Of a customer's orders of one day, the furthest status wins; the others are archived."""
    place = F.array_position(F.array(*map(F.lit, "OPF")), F.col("o_orderstatus"))
    rn = F.row_number().over(Window.partitionBy("o_custkey", F.to_date("o_orderdate")).orderBy(place.desc(), F.col("o_totalprice").desc(), F.col("o_orderkey")))
    return _orders(spark, folder).select("o_orderkey", F.when(rn == 1, "kept").otherwise("archived").alias("outcome"))


def sequence_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Appended events numbered on from what each user already has (the first 3000 events)."""
    e = table(spark, folder, "events")
    have = e.filter("event_id < 3000").groupBy("user_id").agg(F.count("*").alias("base"))
    new = numbered(e.filter("event_id >= 3000").select("user_id", "event_id"), ["user_id"], ["event_id"], "rn")
    return new.join(have, "user_id", "left").select("event_id", (F.coalesce("base", F.lit(0)) + F.col("rn")).alias("sequence"))


def time_ordered_split(spark: SparkSession, folder: str) -> DataFrame:
    """Each priority's orders by date: the first 70 % train."""
    rows = numbered(_orders(spark, folder).select("o_orderpriority", "o_orderdate", "o_orderkey"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "rn", "n")
    return rows.groupBy("o_orderpriority").agg(F.count_if(F.col("rn") <= F.floor(F.col("n") * 7 / 10)).alias("train"), F.count("*").alias("n"))


def baseline_run(spark: SparkSession, folder: str) -> DataFrame:
    """For each month's run, the latest earlier complete one (500 lines or more)."""
    runs = table(spark, folder, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("run")).agg(F.count("*").alias("n"))
    w = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row a month
    return runs.select("run", "n", F.last(F.when(F.col("n") >= 500, F.col("run")), ignorenulls=True).over(w).alias("baseline"))


def consecutive_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of each user from the newest event back to the first purchase or signup; views neither count nor stop."""
    return trailing(table(spark, folder, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], F.col("event_type") == "error", F.col("event_type").isin("purchase", "signup"))


def source_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Per user: last success, last attempt and whether the last success is older than three days."""
    e = table(spark, folder, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("ok"), F.max("ts").alias("last"))
    stale = F.col("ok").isNull() | (F.col("ok") < F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL '3' DAY"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("user_id", text("ok").alias("last_success"), text("last").alias("last_attempt"), stale.alias("stale"))


def row_anomaly_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Months with fewer than half or more than twice the median number of orders."""
    days = _orders(spark, folder).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    mid = days.agg(F.median("n").alias("mid"))
    rows = days.join(F.broadcast(mid)).withColumn("ratio", F.round(F.col("n") / F.col("mid"), 6))
    return rows.select("month", "n", "ratio", F.when(F.col("ratio") < 0.5, "low").when(F.col("ratio") > 2.0, "high").otherwise("normal").alias("flag"))


def due_split(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that are due: no order yet, or the last one at least 90 days before the date."""
    last = _orders(spark, folder).groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    c = table(spark, folder, "customer")
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("last"))
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", (F.col("last").isNull() | (age >= 90)).alias("due"), age.cast("long").alias("age_days"))


def first_of_day_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each day and type stands for it, however often it is served."""
    e = table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return latest_by(e, ["day", "event_type"], ["ts", "event_id"], ["event_id"], newest=False)


def click_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks that follow a view of the same user on the same day go to the day's first view; others are dropped."""
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    shown = e.filter("event_type = 'view'").groupBy("user_id", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("view_id"), F.min("ts").alias("shown"))
    return e.filter("event_type = 'click'").join(shown, ["user_id", "day"]).filter(F.col("ts") >= F.col("shown")).select("event_id", "view_id")


QUERIES = {
    f.__name__: f
    for f in (
        latest_per_key, latest_with_fallback_chain, as_of_join_validity, alias_validity, previous_consumed_state, content_hash_dirty, set_new_gone_changed, change_summary, change_events, licensed_absence,
        supersession, first_observation, collision_winner, sequence_numbers, time_ordered_split, baseline_run, consecutive_failures, source_freshness, row_anomaly_ratio, due_split, first_of_day_snapshot, click_attribution,
    )
}

_LATEST = "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders WHERE o_orderdate {} TIMESTAMP '1998-01-01' GROUP BY 1"
_CHANGED = f"""
    WITH a AS ({_LATEST.format('<')}), b AS ({_LATEST.format('>=')}),
    c AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_custkey IS NULL AS n, b.o_custkey IS NULL AS g, a.s IS DISTINCT FROM b.s AS ds, a.p IS DISTINCT FROM b.p AS dp FROM a FULL JOIN b ON a.o_custkey = b.o_custkey),
    r AS (SELECT o_custkey, CASE WHEN n THEN 'new' WHEN g THEN 'gone' WHEN ds OR dp THEN 'changed' ELSE 'same' END AS change,
          CASE WHEN n OR g THEN '' ELSE concat_ws(',', CASE WHEN ds THEN 'o_orderstatus' END, CASE WHEN dp THEN 'o_orderpriority' END) END AS fields FROM c)"""

SQL = {
    "latest_per_key": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_totalprice, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_totalprice, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1",
    "latest_with_fallback_chain": """
        SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS level FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY level, o_orderdate DESC, o_orderkey DESC) = 1""",
    "as_of_join_validity": """
        WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders),
        q AS (SELECT c_custkey, unnest(['1995-06-01', '1998-03-15']) AS day FROM customer)
        SELECT c_custkey AS o_custkey, day, o_orderkey FROM q LEFT JOIN o ON o_custkey = c_custkey AND o_orderdate <= CAST(day AS TIMESTAMP) AND (valid_to IS NULL OR valid_to > CAST(day AS TIMESTAMP))
        QUALIFY row_number() OVER (PARTITION BY c_custkey, day ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1""",
    "alias_validity": """
        WITH v AS (SELECT o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders)
        SELECT o_orderkey, strftime(t, '%Y-%m-%d') AS valid_to, t IS NULL AS active FROM v""",
    "previous_consumed_state": """
        WITH r AS (SELECT event_id, event_type, last_value(CASE WHEN value >= 20 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events)
        SELECT * FROM r WHERE event_type IS DISTINCT FROM previous""",
    "content_hash_dirty": """
        WITH d AS (SELECT *, 'sha256:' || sha256(o_orderstatus || chr(31) || o_orderpriority) AS hash FROM orders)
        SELECT o_orderkey, hash, hash IS DISTINCT FROM lag(hash) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dirty FROM d""",
    "set_new_gone_changed": f"{_CHANGED} SELECT * FROM r",
    "change_summary": f"{_CHANGED} SELECT count(*) AS observed, {', '.join(f'count(*) FILTER (change = {c!r}) AS {chr(34)}{c}{chr(34)}' for c in ('new', 'gone', 'changed', 'same'))} FROM r",
    "change_events": """
        WITH k AS (SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS s0, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s1,
                   arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS p0, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p1 FROM orders GROUP BY 1)
        SELECT o_custkey, 'o_orderstatus' AS field, s0 AS old_value, s1 AS new_value FROM k WHERE s0 IS DISTINCT FROM s1
        UNION ALL SELECT o_custkey, 'o_orderpriority', p0, p1 FROM k WHERE p0 IS DISTINCT FROM p1""",
    "licensed_absence": """
        SELECT c_custkey AS key, c_mktsegment AS source, CASE WHEN s.o_custkey IS NOT NULL THEN 'present' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'absent' ELSE 'unknown' END AS presence
        FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') s ON o_custkey = c_custkey""",
    "supersession": """
        WITH c AS (SELECT p_partkey, sha256(p_brand || '|' || p_type) AS h FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, sha256(p_brand || '|' || CASE WHEN p_size > 25 THEN 'X' ELSE p_type END) AS h FROM part WHERE p_partkey % 5 <> 0)
        SELECT coalesce(c.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.h IS NULL THEN 'kept' WHEN c.h IS NULL THEN 'fresh' WHEN c.h = n.h THEN 'reused' ELSE 'replaced' END AS outcome FROM c FULL JOIN n ON c.p_partkey = n.p_partkey""",
    "first_observation": "SELECT o_orderkey, o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) AS is_first FROM orders",
    "collision_winner": """
        SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY instr('OPF', o_orderstatus) DESC, o_totalprice DESC, o_orderkey) = 1 THEN 'kept' ELSE 'archived' END AS outcome FROM orders""",
    "sequence_numbers": """
        WITH b AS (SELECT user_id, count(*) AS base FROM events WHERE event_id < 3000 GROUP BY 1)
        SELECT event_id, coalesce(base, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events LEFT JOIN b USING (user_id) WHERE event_id >= 3000""",
    "time_ordered_split": """
        WITH r AS (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
        SELECT o_orderpriority, count(*) FILTER (rn <= floor(n * 7 / 10.0)) AS train, count(*) AS n FROM r GROUP BY 1""",
    "baseline_run": """
        WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS run, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT run, n, last_value(CASE WHEN n >= 500 THEN run END IGNORE NULLS) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM r""",
    "consecutive_failures": """
        WITH r AS (SELECT user_id, event_type, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS stopped FROM events)
        SELECT user_id, count(*) FILTER (stopped = 0 AND event_type = 'error') AS n_trailing FROM r GROUP BY 1""",
    "source_freshness": """
        WITH t AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok, max(ts) AS l FROM events GROUP BY 1)
        SELECT user_id, strftime(ok, '%Y-%m-%d %H:%M:%S') AS last_success, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_attempt, ok IS NULL OR ok < TIMESTAMP '2024-01-30' - INTERVAL 3 DAY AS stale FROM t""",
    "row_anomaly_ratio": """
        WITH d AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT median(n) AS mid FROM d), r AS (SELECT month, n, round(n / mid, 6) AS ratio FROM d, m)
        SELECT *, CASE WHEN ratio < 0.5 THEN 'low' WHEN ratio > 2.0 THEN 'high' ELSE 'normal' END AS flag FROM r""",
    "due_split": """
        WITH l AS (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY 1), a AS (SELECT c_custkey, date_diff('day', CAST(t AS DATE), DATE '1998-12-31') AS age_days FROM customer LEFT JOIN l ON o_custkey = c_custkey)
        SELECT c_custkey, age_days IS NULL OR age_days >= 90 AS due, age_days FROM a""",
    "first_of_day_snapshot": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "click_attribution": """
        WITH v AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_min(event_id, (ts, event_id)) AS view_id, min(ts) AS shown FROM events WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT event_id, view_id FROM events e JOIN v ON e.user_id = v.user_id AND CAST(e.ts AS DATE) = v.d AND e.ts >= v.shown WHERE event_type = 'click'""",
}
