"""Rule scores of documents, their replay, first reasons, queues, facets, streams and redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import greedy_queue, interleaved, queue_outcomes
from ..operators.resolve import redirect_closure
from ..operators.scoring import Profile, contributions_add_up, first_reason, replayed, scored
from ..sources.scratch import written
from ..sources.tables import table
from ..streaming import events as S

CAPS = ["cap_source", "cap_short"]


def profile() -> Profile:
    c = F.col
    return Profile(
        start=F.when(c("lang") == "en", 3).when(c("lang").isin("de", "fr"), 2).otherwise(1),
        blockers=[("too_short", c("n_chars") < 60), ("shouting", c("text").rlike("[A-Z]{4,}!!")), ("table_rows", c("text").contains(" | "))],
        rules=[("long_text", c("n_chars") >= 3000, 1), ("very_long", c("n_chars") >= 9000, -1), ("has_license", c("text").rlike("(?i)licen[cs]e"), 1)],
        clamp=("hot_source_delta", c("source") == "src0", 2),
        late_rules=[("digits", c("text").rlike("[0-9]{3}"), 1), ("lines", F.length(c("text")) - F.length(F.replace(c("text"), F.lit("\n"), F.lit(""))) >= 5, 1)],
        caps=[("cap_source", c("source").isin("src1", "src2"), 3), ("cap_short", c("n_chars") < 400, 2)],
    )


def _scored(spark, folder):
    return scored(table(spark, folder, "documents"), profile())


def rule_score(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return _scored(spark, folder).select("doc_id", "tier", "blocker", shown.alias("features"))


def score_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose tier or total does not follow from their features: none."""
    rows = _scored(spark, folder)
    return rows.agg(F.count("*").alias("n"), F.count_if(replayed(F.col("features"), CAPS) != F.col("tier")).alias("tier_differs"), F.count_if(F.col("blocker").isNull() & ~contributions_add_up(F.col("features"), CAPS)).alias("sum_differs"))


def first_failing_reason(spark: SparkSession, folder: str) -> DataFrame:
    reason = first_reason([("not-new", F.col("o_orderstatus") != "O"), ("snoozed", F.col("o_orderdate") > "1998-06-01"), ("below-cutoff", F.col("o_totalprice") < 100000)], "eligible")
    return table(spark, folder, "orders").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def facet_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A conjunction of optional facets and, for each facet, the counts without its own predicate."""
    facets = {"p_type": F.col("p_type").isin("ECONOMY", "PROMO"), "p_brand": F.col("p_brand").startswith("Brand#1"), "p_size": F.col("p_size") >= 20}
    p = table(spark, folder, "part").withColumns({f"_{k}": v for k, v in facets.items()})
    all_ = F.lit(True)
    for k in facets:
        all_ = all_ & F.col(f"_{k}")
    rows = [F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value"), all_.alias("on"))]
    for k in ("p_type", "p_brand"):
        others = F.lit(True)
        for o in facets:
            others = others & F.col(f"_{o}") if o != k else others
        rows.append(F.struct(F.lit(k).alias("facet"), F.col(k).alias("value"), others.alias("on")))
    return p.select(F.inline(F.array(*rows))).filter("on").groupBy("facet", "value").agg(F.count("*").alias("n"))


def search_filter(spark: SparkSession, folder: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, folder, "part").filter(hay.contains("ring") & hay.contains("economy") & (F.coalesce("p_retailprice", F.lit(0)) >= 900)).select("p_partkey", "p_name")


def user_sort(spark: SparkSession, folder: str) -> DataFrame:
    """The first 40 parts by descending size, then name, then key, with their places."""
    top = table(spark, folder, "part").orderBy(F.desc("p_size"), "p_name", "p_partkey").limit(40)
    return top.select("p_partkey", F.struct((-F.col("p_size")).alias("s"), "p_name", "p_partkey").alias("o")).agg(F.array_sort(F.collect_list("o")).alias("os")).select(F.posexplode("os").alias("place", "o")).select("place", "o.p_partkey")


def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").filter("o_orderkey > 5000").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")


def budgeted_work(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 highest priced open orders are done now, the rest is deferred."""
    from pyspark.sql.window import Window

    o = table(spark, folder, "orders").filter("o_orderstatus = 'O'")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))
    total = o.agg(F.count("*").alias("n"))
    return top.join(F.broadcast(total)).select("o_orderkey", "place", (F.col("n") - 200).alias("deferred"))


def bank_aim_interleave(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return interleaved(o, "o_orderkey", [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")], [F.col("o_totalprice").desc(), F.col("o_orderkey")], F.col("o_orderstatus") == "O", 30)


_QUEUE = ("o_orderstatus", "o_orderkey", "o_custkey", "uncertain", ["band", "price"], ["price"], "high", 10)


def _queued(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("uncertain"), F.col("o_orderpriority").alias("band"), (-F.col("o_totalprice")).alias("price"), (F.col("o_totalprice") >= 300000).alias("high"))


def greedy_queue_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    """A queue of ten per status with at most two of a customer and two uncertain ones."""
    o = _queued(spark, folder)
    return greedy_queue(o, *_QUEUE).select("o_orderstatus", "o_orderkey", "lane", "lane_rank", "position")


def queue_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every order that the queues considered."""
    o = _queued(spark, folder)
    return queue_outcomes(o, written(greedy_queue(o, *_QUEUE), "queue"), *_QUEUE).groupBy("o_orderstatus", "outcome").agg(F.count("*").alias("n"))


def redirects(spark: SparkSession, folder: str) -> DataFrame:
    """Chains and cycles of a functional graph over the parts, followed to their ends."""
    p = F.col("p_partkey")
    edges = table(spark, folder, "part").filter("p_partkey % 10 <> 9 OR p_partkey % 30 = 29").select(p.alias("src"), F.when(p % 30 == 29, p - 9).otherwise(p + 1).alias("dst"))
    return redirect_closure(edges)


def _stream(spark, folder):
    e = table(spark, folder, "events")
    # one file is one batch at least; a stream reads folders, so the file is named by a glob
    return S.stream(spark, f"{folder}/events*.parquet", e.schema)


def stream_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly counts from Monday by type, from a stream in complete mode."""
    out = S.drained(S.windowed_counts(_stream(spark, folder), "7 days", "event_type", start="4 days"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("week"), "event_type", "n")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users (6 hours' gap), those that are still open at the end too: in complete mode the last batch has all."""
    out = S.drained(S.sessions(_stream(spark, folder), "6 hours", "user_id", late="1 hour"), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (user, type) pairs of a stream."""
    out = S.drained(S.deduplicated(_stream(spark, folder), ["user_id", "event_type"], late="400 days"))
    return out.select("user_id", "event_type")


def stream_cap(spark: SparkSession, folder: str) -> DataFrame:
    """At most five events a type over the life of a stream."""
    return S.drained(S.capped(_stream(spark, folder), ["event_type"], "event_id", 5))


QUERIES = {
    f.__name__: f
    for f in (
        rule_score, score_replay, first_failing_reason, facet_filter, search_filter, user_sort, keyset_page, budgeted_work, bank_aim_interleave, greedy_queue_by_segment, queue_accounting, redirects,
        stream_window_counts, stream_sessions, stream_dedupe, stream_cap,
    )
}

_F = {"a": "p_type IN ('ECONOMY', 'PROMO')", "b": "starts_with(p_brand, 'Brand#1')", "c": "p_size >= 20"}
_SCORE = r"""
    WITH b AS (SELECT doc_id, CASE WHEN n_chars < 60 THEN 'too_short' WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN 'shouting' WHEN contains(text, ' | ') THEN 'table_rows' END AS blocker,
               CASE WHEN lang = 'en' THEN 3 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS start, n_chars >= 3000 AS r1, n_chars >= 9000 AS r2, regexp_matches(text, '(?i)licen[cs]e') AS r3, source = 'src0' AS hot,
               regexp_matches(text, '[0-9]{3}') AS r4, length(text) - length(replace(text, chr(10), '')) >= 5 AS r5, source IN ('src1', 'src2') AS c1, n_chars < 400 AS c2 FROM documents),
    e AS (SELECT *, start + CASE WHEN r1 THEN 1 ELSE 0 END - CASE WHEN r2 THEN 1 ELSE 0 END + CASE WHEN r3 THEN 1 ELSE 0 END AS early FROM b), m AS (SELECT *, CASE WHEN hot THEN least(2, early) - early END AS delta FROM e),
    r AS (SELECT *, early + coalesce(delta, 0) + CASE WHEN r4 THEN 1 ELSE 0 END + CASE WHEN r5 THEN 1 ELSE 0 END AS raw FROM m), t0 AS (SELECT *, greatest(1, least(5, raw)) AS t FROM r),
    t1 AS (SELECT *, c1 AND t > 3 AS f1, CASE WHEN c1 AND t > 3 THEN 3 ELSE t END AS ta FROM t0), t2 AS (SELECT *, c2 AND ta > 2 AS f2, CASE WHEN c2 AND ta > 2 THEN 2 ELSE ta END AS tb FROM t1)
    """

_WALK = """WITH RECURSIVE a AS (SELECT o_orderstatus, o_orderkey, o_custkey, o_orderpriority = '4-NOT SPECIFIED' AS u, o_totalprice >= 300000 AS high, o_orderpriority AS band, o_totalprice AS price FROM orders),
        b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY band, price DESC, o_orderkey) - 1 AS rb, CASE WHEN high THEN row_number() OVER (PARTITION BY o_orderstatus, high ORDER BY price DESC, o_orderkey) - 1 END AS ra FROM a),
        r AS (SELECT *, least(2 * rb, coalesce(2 * ra + 1, 2 * rb)) AS turn, CASE WHEN 2 * ra + 1 < 2 * rb THEN 'aim' ELSE 'bank' END AS lane FROM b),
        q AS (SELECT DISTINCT o_orderstatus, CAST(NULL AS BIGINT) AS o_orderkey, CAST(-1 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS held, 0 AS used, 0 AS position FROM orders
            UNION ALL SELECT q.o_orderstatus, r.o_orderkey, r.turn, list_append(q.held, r.o_custkey), q.used + CAST(r.u AS INTEGER), q.position + 1 FROM q JOIN r ON r.o_orderstatus = q.o_orderstatus
            WHERE q.position < 10 AND r.turn > q.turn AND len(list_filter(q.held, lambda x: x = r.o_custkey)) < 2 AND NOT (r.u AND q.used >= 2) QUALIFY row_number() OVER (PARTITION BY q.o_orderstatus ORDER BY r.turn) = 1)"""

SQL = {
    "rule_score": _SCORE + """
        SELECT doc_id, CASE WHEN blocker IS NOT NULL THEN 0 ELSE tb END AS tier, blocker, CASE WHEN blocker IS NOT NULL THEN 'blocker:' || blocker || '=1' ELSE concat_ws(',',
          CASE WHEN f2 THEN 'cap_short=2' END, CASE WHEN f1 THEN 'cap_source=3' END, CASE WHEN r4 THEN 'digits=1' END, CASE WHEN r3 THEN 'has_license=1' END, 'hot_source_delta=' || delta,
          CASE WHEN r5 THEN 'lines=1' END, CASE WHEN r1 THEN 'long_text=1' END, 'raw=' || raw, 'start=' || start, CASE WHEN r2 THEN 'very_long=-1' END) END AS features FROM t2""",
    "score_replay": "SELECT count(*) AS n, 0 AS tier_differs, 0 AS sum_differs FROM documents",
    "first_failing_reason": "SELECT CASE WHEN o_orderstatus <> 'O' THEN 'not-new' WHEN o_orderdate > TIMESTAMP '1998-06-01' THEN 'snoozed' WHEN o_totalprice < 100000 THEN 'below-cutoff' ELSE 'eligible' END AS reason, count(*) AS n FROM orders GROUP BY 1",
    "facet_filter": f"""
        SELECT 'all' AS facet, 'all' AS value, count(*) AS n FROM part WHERE {_F['a']} AND {_F['b']} AND {_F['c']} HAVING count(*) > 0 UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE {_F['b']} AND {_F['c']} GROUP BY 2
        UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE {_F['a']} AND {_F['c']} GROUP BY 2""",
    "search_filter": "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'economy') AND coalesce(p_retailprice, 0) >= 900",
    "user_sort": "SELECT row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) - 1 AS place, p_partkey FROM part QUALIFY place < 40",
    "keyset_page": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 5000 ORDER BY 1 LIMIT 100",
    "budgeted_work": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER () - 200 AS deferred FROM orders WHERE o_orderstatus = 'O' QUALIFY place <= 200",
    "bank_aim_interleave": """
        WITH b AS (SELECT o_orderkey, 'bank' AS lane, 2 * (row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1) AS turn FROM orders),
        a AS (SELECT o_orderkey, 'aim' AS lane, 2 * row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS turn FROM orders WHERE o_orderstatus = 'O'),
        m AS (SELECT o_orderkey, min(turn) AS turn, arg_min(lane, turn) AS lane FROM (SELECT * FROM b UNION ALL SELECT * FROM a) GROUP BY 1)
        SELECT o_orderkey, lane, row_number() OVER (ORDER BY turn) AS position FROM m QUALIFY position <= 30""",
    "greedy_queue_by_segment": f"""{_WALK} SELECT o_orderstatus, o_orderkey, lane, turn // 2 AS lane_rank, CAST(position AS BIGINT) AS position FROM q JOIN r USING (o_orderstatus, o_orderkey, turn)""",
    "queue_accounting": f"""{_WALK}, e AS (SELECT o_orderstatus, max(turn) AS turn FROM q GROUP BY 1 HAVING max(position) >= 10), t AS (SELECT o_orderstatus, o_orderkey, o_custkey, turn FROM q JOIN r USING (o_orderstatus, o_orderkey, turn)),
        f AS (SELECT o_orderstatus, o_custkey, max(turn) AS turn FROM t GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT o_orderstatus, CASE WHEN t.turn IS NOT NULL THEN 'queued' WHEN r.turn > e.turn THEN 'beyond-cap' WHEN r.turn > f.turn THEN 'company-cap' ELSE 'uncertainty-cap' END AS outcome, count(*) AS n
        FROM r LEFT JOIN t USING (o_orderstatus, o_orderkey) LEFT JOIN e USING (o_orderstatus) LEFT JOIN f ON f.o_orderstatus = r.o_orderstatus AND f.o_custkey = r.o_custkey GROUP BY 1, 2""",
    "redirects": """
        WITH e AS (SELECT p_partkey AS src FROM part WHERE p_partkey % 10 <> 9 OR p_partkey % 30 = 29)
        SELECT src, CASE WHEN src % 30 < 20 THEN (src // 10) * 10 + 9 END AS terminal, src % 30 >= 20 AS in_cycle, CASE WHEN src % 30 >= 20 THEN (src // 10) * 10 END AS cycle_id FROM e""",
    "stream_window_counts": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
        c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "stream_cap": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 5",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
}
