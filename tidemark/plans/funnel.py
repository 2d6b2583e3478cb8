"""Event funnels: stages reached, transitions, time in stage, activity and ageing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.cells import rate
from ..operators.latest import first_rows, latest_by, streaks
from ..sources.tables import table

STAGES = ["view", "click", "signup", "purchase"]
AS_OF = "2024-02-01"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def funnel_stage_conversion(spark: SparkSession, folder: str) -> DataFrame:
    """Users at each stage and at the next one, whatever the order; null rate where nobody is."""
    flags = _events(spark, folder).groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == s).alias(s) for s in STAGES])
    pairs = [(a, b) for a, b in zip(STAGES, STAGES[1:], strict=False)]
    totals = flags.agg(*[F.count_if(F.col(a)).alias(f"n_{a}") for a in STAGES], *[F.count_if(F.col(a) & F.col(b)).alias(f"b_{a}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage"), F.col(f"n_{a}").alias("reached"), F.col(f"b_{a}").alias("advanced")) for a, b in pairs])
    return totals.select(F.inline(rows)).withColumn("conversion", rate(F.col("advanced"), F.col("reached")))


def _steps(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", "event_type", "ts", F.lag("event_type").over(w).alias("before"), F.lead("ts").over(w).alias("next_ts"))


def transition_response_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Users with a click directly followed by a signup or purchase, against all that clicked."""
    hit = (F.col("before") == "click") & F.col("event_type").isin("signup", "purchase")
    out = _steps(_events(spark, folder)).agg(F.countDistinct(F.when(hit, F.col("user_id"))).alias("responded"), F.countDistinct(F.when(F.col("event_type") == "click", F.col("user_id"))).alias("asked"))
    return out.withColumn("response_rate", rate(F.col("responded"), F.col("asked")))


def time_in_stage_median(spark: SparkSession, folder: str) -> DataFrame:
    """Median and count of the seconds until the next event; the open last one is left out."""
    seconds = (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    spans = _steps(_events(spark, folder)).filter("next_ts IS NOT NULL").select("event_type", seconds.alias("s")).filter("s >= 0")
    return spans.groupBy("event_type").agg(F.round(F.median("s"), 3).alias("median_s"), F.count("*").alias("n"))


def apps_per_week(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases and distinct buyers per week from Monday."""
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")
    return _events(spark, folder).filter("event_type = 'purchase'").groupBy(week).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def daily_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's longest run of active days, and the one that ends on the last day or the day before."""
    days = _events(spark, folder).select("user_id", F.to_date("ts").alias("day"))
    last = days.agg(F.max("day").alias("today"))
    runs = streaks(days, "user_id", "day").join(F.broadcast(last))
    current = F.when(F.col("last_day") >= F.date_sub("today", 1), F.col("n_days")).otherwise(0)
    return runs.groupBy("user_id").agg(F.max("n_days").alias("longest"), F.max(current).alias("current"))


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Of the last day and its week: distinct users by action, and by any of them."""
    events = _events(spark, folder).withColumn("day", F.to_date("ts"))
    today = events.agg(F.max("day").alias("today"))
    rows = events.join(F.broadcast(today))
    on = F.col("day") == F.col("today")
    week = F.date_trunc("week", "day") == F.date_trunc("week", "today")
    return rows.agg(
        *[F.countDistinct(F.when(on & (F.col("event_type") == s), F.col("user_id"))).alias(f"today_{s}") for s in STAGES],
        F.countDistinct(F.when(on & (F.col("event_type") != "error"), F.col("user_id"))).alias("today_any"),
        F.countDistinct(F.when(week & (F.col("event_type") != "error"), F.col("user_id"))).alias("week_any"),
    )


def ghost_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose first signup is 21 days old or more and who never bought afterwards."""
    events = _events(spark, folder)
    first = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("since"))
    bought = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("bought"))
    rows = first.join(bought, "user_id", "left").filter(F.col("since") <= F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '21' DAY"))
    ghost = F.col("bought").isNull() | (F.col("bought") < F.col("since"))
    out = rows.agg(F.count("*").alias("mature"), F.count_if(ghost).alias("ghosts"))
    return out.withColumn("ghost_rate", rate(F.col("ghosts"), F.col("mature")))


def first_response_days(spark: SparkSession, folder: str) -> DataFrame:
    """Entity fold: first signup, stages reached, and days to the first purchase after it."""
    events = _events(spark, folder)
    first = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("since"))
    rows = events.join(first, "user_id").filter("event_type = 'purchase' AND ts >= since").groupBy("user_id", "since").agg(F.min("ts").alias("bought"))
    days = F.round((F.unix_micros(F.col("bought").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 86400e6, 4)
    reached = events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("reached"))
    return first.join(reached, "user_id").join(rows.select("user_id", days.alias("days")), "user_id", "left").select("user_id", "reached", "days")


def queue_completion_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each day's first 10 viewed users that click the same day; null where the queue is empty of viewers."""
    events = _events(spark, folder).withColumn("day", F.to_date("ts"))
    firsts = events.filter("event_type = 'view'").groupBy("day", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    queue = first_rows(firsts, ["day"], [F.col("at"), F.col("user_id")], 10)
    acted = events.filter("event_type = 'click'").select("day", "user_id").distinct().withColumn("acted", F.lit(True))
    out = queue.join(acted, ["day", "user_id"], "left").groupBy("day").agg(F.count("*").alias("queue_size"), F.count_if("acted").alias("completed"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "queue_size", "completed", rate(F.col("completed"), F.col("queue_size")).alias("completion"))


def top10_application_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Of the users served in a day's ten highest values, the share that purchase at any later time."""
    events = _events(spark, folder).withColumn("day", F.to_date("ts"))
    served = first_rows(events.filter("event_type = 'view'"), ["day"], [F.col("value").desc(), F.col("event_id")], 10).groupBy("user_id").agg(F.min("ts").alias("served"))
    later = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("bought"))
    out = served.join(later, "user_id", "left").agg(F.count("*").alias("served"), F.count_if(F.col("bought") >= F.col("served")).alias("applied"))
    return out.withColumn("application_rate", rate(F.col("applied"), F.col("served")))


def served_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Per user: first event, first event of value 50 and more, and the latest type."""
    events = _events(spark, folder)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    facts = events.groupBy("user_id").agg(text(F.min("ts")).alias("first_at"), text(F.min(F.when(F.col("value") >= 50, F.col("ts")))).alias("first_high_at"))
    return facts.join(latest_by(events, ["user_id"], ["ts", "event_id"], ["event_type"]), "user_id")


def status_since(spark: SparkSession, folder: str) -> DataFrame:
    """When each user's current type began: the last event whose type differs from the one before."""
    changed = _steps(_events(spark, folder)).filter("NOT (event_type <=> before)")
    return changed.groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("since"), F.count("*").alias("n_changes"))


def active_days(spark: SparkSession, folder: str) -> DataFrame:
    days = F.array_sort(F.collect_set(F.date_format("ts", "MM-dd")))
    return _events(spark, folder).groupBy("user_id").agg(F.array_join(days, ",").alias("days"), F.countDistinct(F.to_date("ts")).alias("n_days"))


def event_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the stream after a cursor, with their sequence numbers per type."""
    seq = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).cast("long")
    return _events(spark, folder).select("event_id", "event_type", seq.alias("sequence")).filter("sequence > 100")


QUERIES = {
    f.__name__: f
    for f in (
        funnel_stage_conversion, transition_response_rate, time_in_stage_median, apps_per_week, daily_streaks, activity, ghost_rate, first_response_days,
        queue_completion_by_day, top10_application_rate, served_fold, status_since, active_days, event_replay,
    )
}

_STEPS = "SELECT *, lag(event_type) OVER w AS before, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"

SQL = {
    "funnel_stage_conversion": """
        WITH f AS (SELECT user_id, bool_or(event_type = 'view') v, bool_or(event_type = 'click') c, bool_or(event_type = 'signup') s, bool_or(event_type = 'purchase') p FROM events GROUP BY 1),
        t AS (SELECT 'view' AS from_stage, 'click' AS to_stage, count(*) FILTER (v) AS reached, count(*) FILTER (v AND c) AS advanced FROM f
              UNION ALL SELECT 'click', 'signup', count(*) FILTER (c), count(*) FILTER (c AND s) FROM f
              UNION ALL SELECT 'signup', 'purchase', count(*) FILTER (s), count(*) FILTER (s AND p) FROM f)
        SELECT *, round(CAST(advanced AS DOUBLE) / nullif(reached, 0), 6) AS conversion FROM t""",
    "transition_response_rate": f"""
        WITH s AS ({_STEPS}), t AS (SELECT count(DISTINCT user_id) FILTER (before = 'click' AND event_type IN ('signup', 'purchase')) AS responded, count(DISTINCT user_id) FILTER (event_type = 'click') AS asked FROM s)
        SELECT *, round(CAST(responded AS DOUBLE) / nullif(asked, 0), 6) AS response_rate FROM t""",
    "time_in_stage_median": f"""
        WITH s AS ({_STEPS}), d AS (SELECT event_type, (epoch_us(next_ts) - epoch_us(ts)) / 1e6 AS s FROM s WHERE next_ts IS NOT NULL)
        SELECT event_type, round(median(s), 3) AS median_s, count(*) AS n FROM d WHERE s >= 0 GROUP BY 1""",
    "apps_per_week": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "daily_streaks": """
        WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
        r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d),
        g AS (SELECT user_id, max(day) AS last_day, count(*) AS n FROM r GROUP BY user_id, run)
        SELECT user_id, max(n) AS longest, max(CASE WHEN last_day >= (SELECT max(day) FROM d) - 1 THEN n ELSE 0 END) AS current FROM g GROUP BY 1""",
    "activity": """
        WITH e AS (SELECT *, CAST(ts AS DATE) AS day, (SELECT max(CAST(ts AS DATE)) FROM events) AS today FROM events)
        SELECT count(DISTINCT user_id) FILTER (day = today AND event_type = 'view') AS today_view, count(DISTINCT user_id) FILTER (day = today AND event_type = 'click') AS today_click,
               count(DISTINCT user_id) FILTER (day = today AND event_type = 'signup') AS today_signup, count(DISTINCT user_id) FILTER (day = today AND event_type = 'purchase') AS today_purchase,
               count(DISTINCT user_id) FILTER (day = today AND event_type <> 'error') AS today_any,
               count(DISTINCT user_id) FILTER (date_trunc('week', day) = date_trunc('week', today) AND event_type <> 'error') AS week_any FROM e""",
    "ghost_rate": f"""
        WITH f AS (SELECT user_id, min(ts) AS since FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id, max(ts) AS bought FROM events WHERE event_type = 'purchase' GROUP BY 1),
        t AS (SELECT count(*) AS mature, count(*) FILTER (bought IS NULL OR bought < since) AS ghosts FROM f LEFT JOIN b USING (user_id) WHERE since <= TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY)
        SELECT *, round(CAST(ghosts AS DOUBLE) / nullif(mature, 0), 6) AS ghost_rate FROM t""",
    "first_response_days": """
        WITH f AS (SELECT user_id, min(ts) AS since FROM events WHERE event_type = 'signup' GROUP BY 1),
        b AS (SELECT e.user_id, min(ts) AS bought FROM events e JOIN f ON e.user_id = f.user_id AND ts >= since WHERE event_type = 'purchase' GROUP BY 1),
        r AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS reached FROM events GROUP BY 1)
        SELECT user_id, reached, round((epoch_us(bought) - epoch_us(since)) / 86400e6, 4) AS days FROM f JOIN r USING (user_id) LEFT JOIN b USING (user_id)""",
    "queue_completion_by_day": """
        WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM events), v AS (SELECT d, user_id, min((ts, event_id)) AS first_at FROM e WHERE event_type = 'view' GROUP BY 1, 2),
        q AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY d ORDER BY first_at, user_id) <= 10), c AS (SELECT DISTINCT d, user_id FROM e WHERE event_type = 'click')
        SELECT strftime(q.d, '%Y-%m-%d') AS day, count(*) AS queue_size, count(c.user_id) AS completed, round(CAST(count(c.user_id) AS DOUBLE) / count(*), 6) AS completion
        FROM q LEFT JOIN c ON q.d = c.d AND q.user_id = c.user_id GROUP BY 1""",
    "top10_application_rate": """
        WITH s AS (SELECT user_id, ts FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) <= 10),
        f AS (SELECT user_id, min(ts) AS served_at FROM s GROUP BY 1), b AS (SELECT user_id, max(ts) AS bought FROM events WHERE event_type = 'purchase' GROUP BY 1),
        t AS (SELECT count(*) AS served, count(*) FILTER (bought >= served_at) AS applied FROM f LEFT JOIN b USING (user_id))
        SELECT *, round(CAST(applied AS DOUBLE) / nullif(served, 0), 6) AS application_rate FROM t""",
    "served_fold": """
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(min(ts) FILTER (value >= 50), '%Y-%m-%d %H:%M:%S') AS first_high_at, arg_max(event_type, (ts, event_id)) AS event_type
        FROM events GROUP BY 1""",
    "status_since": f"WITH s AS ({_STEPS}) SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS n_changes FROM s WHERE event_type IS DISTINCT FROM before GROUP BY 1",
    "active_days": "SELECT user_id, string_agg(DISTINCT strftime(ts, '%m-%d'), ',' ORDER BY strftime(ts, '%m-%d')) AS days, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1",
    "event_replay": "WITH s AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sequence FROM events) SELECT * FROM s WHERE sequence > 100",
}
