"""Joins by kind, keyed merges, accounting between two tables, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.latest import first_rows
from ..operators.resolve import best_matches, jaccard, priority_merge, unique_matches
from ..sources.tables import table

JOIN_FLOOR = 0.3


def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders").filter("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def full_outer_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected against actual rows by key: missing, unexpected, and differing fields."""
    o = table(spark, folder, "orders")
    expected = o.filter("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    actual = o.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status2"), F.col("o_totalprice").alias("price2"))
    rows = expected.withColumn("in_e", F.lit(True)).join(actual.withColumn("in_a", F.lit(True)), "o_orderkey", "full_outer")
    both = F.col("in_e") & F.col("in_a")
    return rows.agg(F.count_if(F.col("in_a").isNull()).alias("missing"), F.count_if(F.col("in_e").isNull()).alias("unexpected"), F.count_if(both & ~F.col("o_orderstatus").eqNullSafe(F.col("status2"))).alias("status_differs"), F.count_if(both & ~F.col("o_totalprice").eqNullSafe(F.col("price2"))).alias("price_differs"))


def two_level_key_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A nation by its key, else the one of the same number as the segment's length."""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    first = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("name1"))
    second = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("name2"))
    rows = c.join(first, c.c_nationkey == F.col("k1"), "left").join(second, F.length("c_mktsegment") == F.col("k2"), "left")
    return rows.select("c_custkey", F.coalesce("name1", "name2").alias("name"), F.col("name1").isNotNull().alias("direct"))


def bridged_events(spark: SparkSession, folder: str) -> DataFrame:
    """Four ways to a customer, the first that leads to one: order key, customer key, part key, none."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    o = table(spark, folder, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("user_id"), F.col("o_custkey").alias("by_order"))
    c = table(spark, folder, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("by_customer"))
    p = table(spark, folder, "part").filter("p_size < 10").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("by_part"))
    rows = e.join(o, "user_id", "left").join(c, "user_id", "left").join(p, "k", "left")
    return rows.select("event_id", F.coalesce("by_order", "by_customer", "by_part", F.lit(-1)).alias("bridged"))


def jaccard_block_join(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of one type against those of another inside a brand and size class: the only similar name, or ambiguous."""
    p = table(spark, folder, "part").withColumn("tokens", F.split("p_name", " "))
    left = p.filter("p_type = 'ECONOMY'").select("p_brand", F.col("p_partkey").alias("left_id"), F.col("tokens").alias("lt"), F.col("p_size").alias("ls"))
    right = p.filter("p_type <> 'ECONOMY'").select("p_brand", F.col("p_partkey").alias("right_id"), F.col("tokens").alias("rt"), F.col("p_size").alias("rs"))
    near = right.withColumn("size", F.explode(F.sequence(F.col("rs") - 2, F.col("rs") + 2))).drop("rs")
    return unique_matches(left.withColumnRenamed("ls", "size"), near, ["p_brand", "size"], "left_id", "right_id", jaccard(F.col("lt"), F.col("rt")) >= JOIN_FLOOR)


def best_match_argmax(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar other part name within a brand and size, at least 0.3, smaller key first."""
    p = table(spark, folder, "part").select("p_brand", "p_size", "p_partkey", F.split("p_name", " ").alias("tokens"))
    return best_matches(p, ["p_brand", "p_size"], "p_partkey", "tokens", JOIN_FLOOR).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


def multiset_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of two periods as bags of (part, quantity): how many are accounted for, each at most once."""
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", (F.col("l_shipdate") < "1999-01-01").alias("early"))
    bags = rows.groupBy("l_partkey", "l_quantity").agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b"))
    return bags.agg(F.sum(F.least("a", "b")).alias("accounted"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("only_early"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("only_late"))


def keyed_union(spark: SparkSession, folder: str) -> DataFrame:
    """Nations that are configured, have customers, or have suppliers, side by side."""
    n = table(spark, folder, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("k"), F.lit(True).alias("configured"))
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.count("*").alias("suppliers"))
    rows = n.join(c, "k", "full_outer").join(s, "k", "full_outer")
    return rows.select("k", F.coalesce("configured", F.lit(False)).alias("configured"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def term_search_cross(spark: SparkSession, folder: str) -> DataFrame:
    """Every region with every priority and page of a search: a product of two small vocabularies."""
    r = table(spark, folder, "region").select("r_name")
    terms = spark.createDataFrame([("URGENT",), ("HIGH",), ("LOW",)], "term string")
    return r.join(F.broadcast(terms)).select(F.concat_ws(" ", "term", "r_name").alias("query"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))


def array_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first description found among an order's candidate keys, in their order."""
    o = table(spark, folder, "orders").select("o_orderkey", F.posexplode(F.array(F.col("o_orderkey") + 100000, F.col("o_custkey") * 3, F.col("o_custkey"))).alias("pos", "key"))
    p = table(spark, folder, "part").filter("p_size > 20").select(F.col("p_partkey").alias("key"), "p_name")
    return o.join(p, "key").groupBy("o_orderkey").agg(F.min_by("p_name", "pos").alias("description"), F.min("pos").alias("place"))


def overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Live rows before the persisted ones they are not among, at most 20."""
    o = table(spark, folder, "orders")
    live = o.orderBy(F.desc("o_orderkey")).limit(10).select("o_orderkey", F.lit("live").alias("state"))
    stored = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("stored").alias("state")).join(F.broadcast(live.select("o_orderkey")), "o_orderkey", "left_anti")
    return live.unionByName(stored).orderBy("state", F.desc("o_orderkey")).limit(20)


def cached_results(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without a good result for the same part and quantity on an earlier day: what has to be done anew, by month."""
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_shipdate", "l_returnflag")
    good = rows.filter("l_returnflag = 'A'").groupBy("l_partkey", "l_quantity").agg(F.min("l_shipdate").alias("since"))
    left = rows.join(good, ["l_partkey", "l_quantity"], "left").filter("since IS NULL OR since >= l_shipdate")
    return left.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def healed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """States whose order is not filled move to their customer's smallest filled order; without one they are detached."""
    o = table(spark, folder, "orders")
    filled = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("filled"))
    state = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).join(o.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    rows = state.join(filled, "o_custkey", "left")
    return rows.select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(F.col("filled")).alias("healed"))


def union_top1(spark: SparkSession, folder: str) -> DataFrame:
    """Two ways to a customer's score, the explicit one first, then the higher."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    a = c.filter("c_acctbal > 8000").select("c_custkey", F.col("c_acctbal").alias("score"), F.lit(0).alias("way"))
    b = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("score"), F.lit(1).alias("way"))
    return first_rows(a.unionByName(b), ["c_custkey"], [F.col("way"), F.col("score").desc()]).select("c_custkey", "score", "way")


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Union, intersection, both differences and bag difference of two key sets, as counts."""
    o = table(spark, folder, "orders")
    a, b = (o.filter(c).select("o_custkey") for c in ("o_orderstatus = 'F'", "o_totalprice > 300000"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "a_minus_b": a.subtract(b), "b_minus_a": b.subtract(a), "bag_a_minus_b": a.exceptAll(b)}
    from functools import reduce

    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("operation"), "n") for k, d in parts.items()])


def work_list(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty or invalidated keys after a cursor, in order, one page of 50."""
    o = table(spark, folder, "orders")
    dirty, invalid = o.filter("o_totalprice > 480000").select("o_orderkey"), o.filter("o_orderkey % 97 = 0").select("o_orderkey")
    return dirty.union(invalid).distinct().filter("o_orderkey > 1000").orderBy("o_orderkey").limit(50)


def priority_merge_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one normalised text become one record: fields by priority, other sources as alternates. A text of which the normal form keeps nothing merges with none."""
    d = table(spark, folder, "documents")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9 ]", ""))
    key = F.when(plain == "", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).otherwise(F.md5(plain))
    rows = d.select(key.alias("key"), "doc_id", "source", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise("").alias("lang"), F.when(F.col("source") == "src0", 9).otherwise(0).alias("level"))
    out = priority_merge(rows, ["key"], ["level", "doc_id"], ["doc_id", "lang", "source"], "source")
    return out.select("key", "doc_id", "lang", "source", F.array_join("alternates", ",").alias("alternates"), "n_merged")


def cap_n_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return first_rows(table(spark, folder, "events"), ["user_id", "event_type"], [F.col("event_id")], 5).select("event_id", "rn")


def membership_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Expected and actual membership by nation: in both, only expected, only actual."""
    c, s = table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")).distinct(), table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    rows = c.withColumn("c", F.lit(True)).join(s.withColumn("s", F.lit(True)), "k", "full_outer")
    return rows.agg(F.count_if(F.col("c") & F.col("s")).alias("both"), F.count_if(F.col("s").isNull()).alias("only_expected"), F.count_if(F.col("c").isNull()).alias("only_actual"))


def identity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases with several owners, orphans, and owners whose first date moved later."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    alias = o.groupBy(F.concat_ws("-", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("alias")).agg(F.countDistinct("o_custkey").alias("owners"))
    orphans = c.join(o, c.c_custkey == o.o_custkey, "left_anti")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    moved = o.select("o_custkey", (F.col("o_orderdate") < F.first("o_orderdate").over(w)).alias("moved")).groupBy("o_custkey").agg(F.bool_or("moved").alias("moved"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
    return one(alias.filter("owners > 1"), "shared_alias").unionByName(one(orphans, "orphan")).unionByName(one(moved.filter("moved"), "first_seen_moved"))


QUERIES = {
    f.__name__: f
    for f in (
        semi_join, anti_join, full_outer_parity, two_level_key_fallback, bridged_events, jaccard_block_join, best_match_argmax, multiset_accounting, keyed_union, term_search_cross, array_lookup, overlay,
        cached_results, healed_keys, union_top1, set_operations, work_list, priority_merge_dedupe, cap_n_per_key, membership_difference, identity_audit,
    )
}

_TOKENS = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"

SQL = {
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "full_outer_parity": """
        WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 0)
        SELECT count(*) FILTER (a.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS unexpected, count(*) FILTER (a.k = e.k AND a.s IS DISTINCT FROM e.s) AS status_differs, count(*) FILTER (a.k = e.k AND a.p IS DISTINCT FROM e.p) AS price_differs FROM e FULL JOIN a ON e.k = a.k""",
    "two_level_key_fallback": """
        SELECT c_custkey, coalesce(a.n_name, b.n_name) AS name, a.n_name IS NOT NULL AS direct FROM customer LEFT JOIN nation a ON a.n_nationkey = c_nationkey AND a.n_nationkey % 2 = 0 LEFT JOIN nation b ON b.n_nationkey = length(c_mktsegment)""",
    "bridged_events": """
        SELECT event_id, coalesce(o_custkey, c_custkey, p_partkey, -1) AS bridged FROM events LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_orderkey = user_id
        LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_custkey = user_id LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT)""",
    "jaccard_block_join": f"""
        WITH p AS (SELECT *, string_split(p_name, ' ') AS t FROM part), l AS (SELECT * FROM p WHERE p_type = 'ECONOMY'), r AS (SELECT * FROM p WHERE p_type <> 'ECONOMY'),
        m AS (SELECT l.p_partkey AS left_id, count(*) AS n, min(r.p_partkey) AS x FROM l JOIN r ON l.p_brand = r.p_brand AND abs(l.p_size - r.p_size) <= 2 AND {_TOKENS.format('l.t', 'r.t')} >= {JOIN_FLOOR} GROUP BY 1)
        SELECT p_partkey AS left_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 1 THEN x END AS match_id FROM l LEFT JOIN m ON left_id = p_partkey""",
    "best_match_argmax": f"""
        WITH p AS (SELECT *, string_split(p_name, ' ') AS t FROM part), m AS (SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, {_TOKENS.format('a.t', 'b.t')} AS s FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey)
        SELECT left_id, right_id, round(s, 6) AS similarity FROM m WHERE s >= {JOIN_FLOOR} QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id) = 1""",
    "multiset_accounting": """
        WITH b AS (SELECT count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01') AS a, count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS b FROM lineitem GROUP BY l_partkey, l_quantity)
        SELECT CAST(sum(least(a, b)) AS BIGINT) AS accounted, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS only_early, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS only_late FROM b""",
    "keyed_union": """
        WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), x AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 20),
        a AS (SELECT k FROM c UNION SELECT k FROM s UNION SELECT k FROM x)
        SELECT CAST(a.k AS BIGINT) AS k, x.k IS NOT NULL AS configured, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM a LEFT JOIN x USING (k) LEFT JOIN c USING (k) LEFT JOIN s USING (k)""",
    "term_search_cross": "SELECT t || ' ' || r_name AS query, unnest([1, 2, 3]) AS page FROM region, (VALUES ('URGENT'), ('HIGH'), ('LOW')) x(t)",
    "array_lookup": """
        WITH o AS (SELECT o_orderkey, unnest([o_orderkey + 100000, o_custkey * 3, o_custkey]) AS key, unnest([0, 1, 2]) AS pos FROM orders)
        SELECT o_orderkey, arg_min(p_name, pos) AS description, min(pos) AS place FROM o JOIN part ON p_partkey = key AND p_size > 20 GROUP BY 1""",
    "overlay": """
        WITH l AS (SELECT o_orderkey, 'live' AS state FROM orders ORDER BY o_orderkey DESC LIMIT 10), s AS (SELECT o_orderkey, 'stored' AS state FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM l))
        SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM s) ORDER BY state, o_orderkey DESC LIMIT 20""",
    "cached_results": """
        WITH g AS (SELECT l_partkey, l_quantity, min(l_shipdate) AS since FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
        SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem LEFT JOIN g USING (l_partkey, l_quantity) WHERE since IS NULL OR since >= l_shipdate GROUP BY 1""",
    "healed_keys": """
        WITH f AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS filled, max(o_orderkey) AS k FROM orders GROUP BY 1)
        SELECT f.o_custkey, CASE WHEN o_orderstatus = 'F' THEN k ELSE filled END AS healed FROM f JOIN orders ON o_orderkey = k""",
    "union_top1": """
        WITH u AS (SELECT c_custkey, c_acctbal AS score, 0 AS way FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT o_custkey, o_totalprice, 1 FROM orders)
        SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY way, score DESC) = 1""",
    "set_operations": """
        WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
        SELECT 'union' AS operation, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
        UNION ALL SELECT 'a_minus_b', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b_minus_a', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
        UNION ALL SELECT 'bag_a_minus_b', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
    "work_list": "SELECT DISTINCT o_orderkey FROM orders WHERE (o_totalprice > 480000 OR o_orderkey % 97 = 0) AND o_orderkey > 1000 ORDER BY 1 LIMIT 50",
    "priority_merge_dedupe": """
        WITH n AS (SELECT *, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g'), ' ') AS plain FROM documents), d AS (SELECT CASE WHEN plain = '' THEN 'doc:' || doc_id ELSE md5(plain) END AS key, doc_id, source, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE '' END AS lang, CASE WHEN source = 'src0' THEN 9 ELSE 0 END AS level FROM n),
        g AS (SELECT key, arg_min(doc_id, (level, doc_id)) AS doc_id, arg_min(lang, (level, doc_id)) FILTER (lang <> '') AS lang, arg_min(source, (level, doc_id)) AS source, list_sort(list(DISTINCT source)) AS s, count(*) AS n_merged FROM d GROUP BY 1)
        SELECT key, doc_id, lang, source, coalesce(array_to_string(list_filter(s, lambda x: x <> source), ','), '') AS alternates, n_merged FROM g""",
    "cap_n_per_key": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events QUALIFY rn <= 5",
    "membership_difference": """
        WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
        SELECT count(*) FILTER (c.k = s.k) AS both, count(*) FILTER (s.k IS NULL) AS only_expected, count(*) FILTER (c.k IS NULL) AS only_actual FROM c FULL JOIN s ON c.k = s.k""",
    "identity_audit": """
        WITH a AS (SELECT o_orderpriority || '-' || strftime(o_orderdate, '%Y-%m-%d') AS alias FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1),
        m AS (SELECT DISTINCT o_custkey FROM (SELECT o_custkey, o_orderdate < first_value(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS moved FROM orders) WHERE moved)
        SELECT 'shared_alias' AS finding, count(*) AS n FROM a UNION ALL SELECT 'orphan', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'first_seen_moved', count(*) FROM m""",
}
