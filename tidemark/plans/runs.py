"""Runs: exports of orders ingested one after another, and the backfill of postings from what they left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backfill, runs
from ..sources import scans
from ..sources.scratch import fresh, written
from ..sources.tables import table

DAYS = ["2024-01-01", "2024-01-02", "2024-01-03"]


def _url(key: Column) -> Column:
    return F.concat(F.lit("https://o.example/"), F.pmod(key, F.lit(4001)).cast("string"))


def _exported(spark: SparkSession, folder: str) -> str:
    """Orders as CSV exports of three days, a third each, named by day and part."""
    o, base = table(spark, folder, "orders"), fresh(spark, "exports")
    key = F.col("o_orderkey")
    rows = o.select(
        key.alias("k"), F.pmod(key, F.lit(3)).cast("int").alias("day"),
        F.when(key % 17 > 0, _url(key)).otherwise("no address").alias("url"), F.concat((key % 5).cast("string"), F.lit(".0")).alias("tier"), F.when(key % 4 == 0, "True").otherwise("").alias("remote"), F.when(key % 6 < 3, "NEW").otherwise("").alias("new"),
        *[{"title": F.col("o_orderpriority"), "company": F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(50)).cast("string")), "location": F.col("o_orderstatus"), "desc_snippet": F.concat(F.lit('two\nlines, "'), key.cast("string"), F.lit('"'))}.get(c, F.lit("")).alias(c) for c in runs.TEXTS],
        *[F.when(key % 2 == 0, key.cast("string")).otherwise("n/a").alias(c) for c in runs.NUMBERS],
    )
    # sorted by the day first: a writer of partitions would sort by them itself, and not keep the order of keys
    rows.repartitionByRange("day", "k").sortWithinPartitions("day", "k").drop("k").write.partitionBy("day").option("header", True).option("escape", '"').csv(f"{base}/by-day")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(f"{base}/named"))
    named = {str(n): day for n, day in enumerate(DAYS)}  # rows without a key have no day
    for found in fs.globStatus(jvm.Path(f"{base}/by-day/day=*/part-*")):
        path = found.getPath()
        day = path.getParent().getName().removeprefix("day=")
        fs.rename(path, jvm.Path(f"{base}/named/exported_{named.get(day, day)}_{path.getName()}"))
    return f"{base}/named"


def _book(spark: SparkSession, folder: str) -> runs.Book:
    """The first two days' exports into empty tables, then the third one's with states, picks and texts, and that one once more."""
    path, o, d = _exported(spark, folder), table(spark, folder, "orders"), table(spark, folder, "documents")
    key = F.col("o_orderkey")
    role = F.concat_ws("|", F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(50)).cast("string")), F.lower(F.regexp_replace("o_orderpriority", "-", "")), F.lower("o_orderstatus"))
    exports = written(scans.dated_csv(spark, path, runs.COLUMNS, placed=True), "exports")  # parsed once for all ingests
    before = runs.ingested(runs.Book.empty(spark), exports.filter(F.col("run_date") < DAYS[2]), "t1")
    none = F.lit(None).cast("string")
    states = o.filter(key % 11 == 0).groupBy(role.alias("seen_key")).agg(F.min(_url(key)).alias("url")).select("seen_key", "url", F.lit("Applied").alias("status"), none.alias("notes"), F.lit(False).alias("starred"), F.lit("t0").alias("updated_at"))
    picks = o.filter(key % 31 == 0).select(_url(key).alias("url"), F.when(key % 2 == 0, "good").alias("reason"), key.alias("place"))
    texts = lambda wanted: d.groupBy(_url(F.col("doc_id")).alias("url")).agg(F.min(F.md5("text")).alias("desc")).join(wanted, "url")
    before.states = states
    book = before.written()
    for at in ("t2", "t3"):
        book = runs.ingested(book, exports, at, picks, texts, (DAYS[2], "{}"), "[]").written()
    return book


def run_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The current table: what the last run has, what only earlier ones had as absent, and texts where there are any."""
    return _book(spark, folder).jobs.select("url", "seen_key", "tier", "remote", "is_new", "salary_min", "desc_snippet", "latest_run", "present", "full_desc")


def run_history(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with what was kept in them and what their history holds."""
    b = _book(spark, folder)
    lines = b.history.groupBy("run_date").agg(F.count("*").alias("lines"), F.sum("tier").alias("tiers"), F.countDistinct("seen_key").alias("roles"))
    return b.runs.join(lines, "run_date")


def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """States after the last run: where they are shown, those that picks seeded, and how many events that made."""
    b = _book(spark, folder)
    made = b.events.groupBy("seen_key").agg(F.count("*").alias("n_events"))
    return b.states.join(made, "seen_key", "left").select("seen_key", "url", "status", "notes", "starred", "updated_at", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def _old_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    """Orders as jobs and history that know urls and keys only, customers as states, events as theirs."""
    o, c, e = (table(spark, folder, n) for n in ("orders", "customer", "events"))
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    role = F.when(key % 101 > 0, F.concat(F.lit("r"), F.pmod("o_custkey", F.lit(900)).cast("string")))
    history = o.filter(key % 3 > 0).select(_url(F.pmod(key, F.lit(2000))).alias("url"), role.alias("seen_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date"), (key % 5).alias("tier"), F.lit("x").alias("odds"), (key % 2 == 0).alias("present"), key.alias("k"))
    history = history.groupBy("url", "run_date").agg(F.max_by(F.struct("seen_key", "tier", "odds", "present"), "k").alias("h")).select("url", "h.seen_key", "run_date", "h.tier", "h.odds", "h.present")
    jobs = o.filter(key % 3 == 0).groupBy(_url(F.pmod(key, F.lit(2500))).alias("url")).agg(F.max_by(F.struct(role.alias("seen_key"), key.alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at")), "o_orderkey").alias("j"))
    k = F.col("j.k")
    jobs = jobs.select("url", "j.seen_key", (k % 5).alias("tier"), F.lit("y").alias("odds"), F.when(k % 7 > 0, F.col("j.at")).alias("first_seen"), F.when(k % 2 == 0, F.col("j.at")).otherwise(none).alias("latest_run"), (k % 4 > 0).alias("present"))
    states = c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("seen_key"), F.col("c_mktsegment").alias("status"))
    return jobs, history, states, e.select(F.col("event_id").alias("id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("seen_key"))


def backfill_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each old table were mapped and archived."""
    tables = _old_tables(spark, folder)
    return backfill.accounted(backfill.backfilled(*tables), *tables)


def backfill_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The urls' lineages with the times they hold for, and the memberships of their postings."""
    done = backfill.backfilled(*_old_tables(spark, folder))
    member = done.memberships.groupBy("posting").agg(F.count("*").alias("n_runs"), F.count_if("present").alias("n_present"), F.min(F.when(F.col("first_seen"), F.col("run"))).alias("first_run"))
    return done.aliases.join(done.postings.select("posting", "seen_key", "first_seen", "last_seen"), "posting").join(member, "posting").drop("posting")


_RUNS = """
    WITH e AS (SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS day, 'c' || (o_custkey % 50) || '|' || lower(replace(o_orderpriority, '-', '')) || '|' || lower(o_orderstatus) AS role, 'https://o.example/' || (o_orderkey % 4001) AS seen FROM orders),
    x AS (SELECT *, CASE WHEN k % 17 > 0 THEN seen ELSE 'withheld:' || role END AS url, '2024-01-0' || day AS run FROM e),
    l AS (SELECT run, url, max(k) AS k FROM x GROUP BY 1, 2), h AS (SELECT l.run, l.url, l.k, role FROM l JOIN x ON x.k = l.k), p AS (SELECT * FROM h WHERE run = '2024-01-03')"""
_OLD = """
    WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 > 0 THEN 'r' || (o_custkey % 900) END AS role, strftime(o_orderdate, '%Y-%m-%d') AS seen FROM orders),
    h AS (SELECT 'https://o.example/' || (k % 2000) AS url, seen AS run, max(k) AS k FROM o WHERE k % 3 > 0 GROUP BY 1, 2), hh AS (SELECT url, run, o.role, k % 2 = 0 AS present FROM h JOIN o USING (k)),
    j AS (SELECT 'https://o.example/' || (k % 2500) AS url, max(k) AS k FROM o WHERE k % 3 = 0 GROUP BY 1), jj AS (SELECT url, o.role, k, CASE WHEN k % 7 > 0 THEN seen END AS first, CASE WHEN k % 2 = 0 THEN seen END AS latest, k % 4 > 0 AS present FROM j JOIN o USING (k)),
    s AS (SELECT url, role, run AS seen FROM hh UNION ALL SELECT url, role, first FROM jj UNION ALL SELECT url, role, latest FROM jj),
    b AS (SELECT url, role, coalesce(min(seen), '1970-01-01') AS first_seen, coalesce(max(seen), '1970-01-01') AS last_seen FROM s WHERE role IS NOT NULL GROUP BY 1, 2)"""

QUERIES = {f.__name__: f for f in (run_jobs, run_history, run_states, backfill_accounts, backfill_aliases)}
SQL = {
    "run_jobs": f"""{_RUNS}, q AS (SELECT *, false AS present FROM h WHERE run = '2024-01-02' AND url NOT IN (SELECT url FROM p) UNION ALL SELECT *, true FROM p),
        d AS (SELECT 'https://o.example/' || (doc_id % 4001) AS url, min(md5(text)) AS full_desc FROM documents GROUP BY 1)
        SELECT q.url, role AS seen_key, k % 5 AS tier, k % 4 = 0 AS remote, k % 6 < 3 AS is_new, CASE WHEN k % 2 = 0 THEN k END AS salary_min, 'two' || chr(10) || 'lines, "' || k || '"' AS desc_snippet, run AS latest_run, present, CASE WHEN present THEN full_desc END AS full_desc FROM q LEFT JOIN d ON d.url = q.url""",
    "run_history": f"""{_RUNS}, c AS (SELECT run, count(*) AS kept, count(*) FILTER (k % 6 < 3) AS new_this_run FROM x GROUP BY 1)
        SELECT run AS run_date, any_value(kept) AS kept, any_value(new_this_run) AS new_this_run, CASE WHEN run = '2024-01-03' THEN '{{}}' END AS report, CASE WHEN run = '2024-01-03' THEN '[]' END AS source_health, count(*) AS lines, sum(k % 5)::BIGINT AS tiers, count(DISTINCT role) AS roles FROM h JOIN c USING (run) GROUP BY 1""",
    "run_states": f"""{_RUNS}, own AS (SELECT role, min(url) AS own FROM p GROUP BY 1), s AS (SELECT role, min(seen) AS url FROM e WHERE k % 11 = 0 GROUP BY 1),
        kept AS (SELECT s.role AS seen_key, CASE WHEN own IS NOT NULL THEN own WHEN s.url NOT IN (SELECT url FROM p) THEN s.url END AS url, 'Applied' AS status, NULL AS notes, false AS starred, 't0' AS updated_at, 0::BIGINT AS n_events FROM s LEFT JOIN own ON own.role = s.role),
        pick AS (SELECT p.role, arg_min(e.seen, e.k) AS url, min(e.k) AS k FROM e JOIN p ON p.url = e.seen WHERE e.k % 31 = 0 AND p.role NOT IN (SELECT role FROM s) GROUP BY 1)
        SELECT * FROM kept UNION ALL SELECT pick.role, own, 'Interested', CASE WHEN k % 2 = 0 THEN '[pick] good' ELSE '[pick]' END, true, 't2', 3 FROM pick JOIN own ON own.role = pick.role""",
    "backfill_accounts": f"""{_OLD}, n AS (SELECT role, count(*) AS n FROM b GROUP BY 1)
        SELECT 'jobs' AS kind, count(*) AS received, count(role) AS mapped, count(*) - count(role) AS archived FROM jj UNION ALL SELECT 'history', count(*), count(role), count(*) - count(role) FROM hh
        UNION ALL SELECT 'state', count(*), count(*) FILTER (n = 1), count(*) FILTER (n IS DISTINCT FROM 1) FROM customer LEFT JOIN n ON role = 'r' || c_custkey UNION ALL SELECT 'event', count(*), count(*) FILTER (n = 1), count(*) FILTER (n IS DISTINCT FROM 1) FROM events LEFT JOIN n ON role = 'r' || user_id""",
    "backfill_aliases": f"""{_OLD}, m AS (SELECT url, role, run, present FROM hh WHERE role IS NOT NULL), f AS (SELECT url, role, min(run) AS first FROM m GROUP BY 1, 2),
        now AS (SELECT jj.url, jj.role, coalesce(latest, jj.first, last_seen) AS run, present FROM jj JOIN b ON b.url = jj.url AND b.role = jj.role),
        a AS (SELECT m.*, run = first AS is_first FROM m JOIN f USING (url, role) UNION ALL SELECT n.url, n.role, n.run, n.present, f.first IS NULL FROM now n LEFT JOIN f ON f.url = n.url AND f.role = n.role WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.url = n.url AND m.role = n.role AND m.run = n.run)),
        g AS (SELECT url, role, count(*) AS n_runs, count(*) FILTER (present) AS n_present, min(run) FILTER (is_first) AS first_run FROM a GROUP BY 1, 2)
        SELECT b.url, b.role AS seen_key, first_seen AS valid_from, lead(first_seen) OVER (PARTITION BY b.url ORDER BY first_seen, last_seen, b.role) AS valid_to, first_seen, last_seen, n_runs, n_present, first_run FROM b JOIN g ON g.url = b.url AND g.role = b.role""",
}
