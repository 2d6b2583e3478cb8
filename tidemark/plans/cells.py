"""Counts, matrices, histograms, rollups and rate cells with explicit denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import histogram, matrix, rate, sliced, zero_filled
from ..operators.latest import first_rows
from ..operators.numbering import numbered
from ..sources.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
TODAY = "1998-06-01"


def status_funnel_default_new(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by the status of their orders; those without one are New."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left")
    return rows.groupBy(F.coalesce("o_orderstatus", F.lit("New")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("customers"))


def count_by_tier(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").groupBy(F.floor(F.col("p_size") / 10).cast("long").alias("tier")).agg(F.count("*").alias("n"))


def labels_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by priority over a closed vocabulary, of which one value never occurs."""
    return zero_filled(table(spark, folder, "orders"), "o_orderpriority", [*PRIORITIES, "6-NEVER"])


def matrix_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    return matrix(table(spark, folder, "orders").filter("o_totalprice > 450000"), "o_orderpriority", "o_orderstatus", [*PRIORITIES, "6-NEVER"], STATUSES)


def kept_with_text_by_source(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 400).alias("kept"), F.count_if(F.col("lang") == "en").alias("english"))


def salary_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Order prices in buckets of 10,000; the middle of price and its rounded-up thousand."""
    o = table(spark, folder, "orders")
    mid = (F.col("o_totalprice") + F.ceil(F.col("o_totalprice") / 1000) * 1000) / 2
    return histogram(o, mid, 10_000)


def followup_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Overdue and upcoming (14 days) orders, in one aggregate."""
    day, today = F.to_date("o_orderdate"), F.to_date(F.lit(TODAY))
    soon = day.between(today, F.date_add(today, 14))
    live = F.col("o_orderstatus").isin("O", "P")
    return table(spark, folder, "orders").agg(F.count_if((day < today) & live).alias("overdue"), F.count_if(soon & live).alias("upcoming"), F.count_if(soon).alias("upcoming_any"))


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """Several groupings of one table in one report: by source prefix, language and size class."""
    docs = table(spark, folder, "documents").select(
        F.regexp_replace("source", "[0-9]+$", "").alias("prefix"), "lang", F.when(F.col("n_chars") < 400, "short").when(F.col("n_chars") < 4000, "middle").otherwise("long").alias("size")
    )
    return sliced(docs, ["prefix", "lang", "size"], [F.count("*").alias("n")])


def coverage_pct(spark: SparkSession, folder: str) -> DataFrame:
    d, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = d.join(labels.select("doc_id", F.lit(True).alias("has")).distinct(), "doc_id", "left")
    out = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if("has").alias("covered"))
    return out.withColumn("pct", F.round(100 * F.col("covered") / F.col("total"), 2))


def outcome_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Quality outcomes by language and source in one pass, with rates, a median and a flag for small samples."""
    d, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = d.join(labels, "doc_id")
    n = F.count("*")
    out = sliced(rows, ["lang", "source"], [n.alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.median("n_chars"), 2).alias("median_chars")])
    return out.withColumns({"good_rate": rate(F.col("good"), F.col("n")), "toxic_rate": rate(F.col("toxic"), F.col("n")), "low_sample": F.col("n") < 20})


def source_yield_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, filled orders and customers by segment and priority, each with its own denominator."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    out = sliced(rows, ["c_mktsegment", "o_orderpriority"], [F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.countDistinct("c_custkey").alias("customers")])
    return out.withColumn("filled_rate", rate(F.col("filled"), F.col("orders"))).withColumn("low_sample", F.col("orders") < 100)


def feature_map_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes by the features that are present in a JSON map."""
    e = table(spark, folder, "events").withColumn("features", F.from_json("props", "map<string,int>"))
    rows = e.select("event_type", "value", F.explode(F.col("features")).alias("feature", "weight"))
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.sum(F.col("weight").cast("long")).alias("weight"))


def calibration_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Empirical response rate by band and by band and language; small cells are counted but not rated."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").withColumn("band", F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "middle").otherwise("long"))
    cells = rows.groupingSets([[F.col("band")], [F.col("band"), F.col("lang")], []], F.col("band"), F.col("lang")).agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("good"))
    rated = F.when(F.col("n") >= 10, rate(F.col("good"), F.col("n")))
    return cells.select(F.coalesce("band", F.lit("*")).alias("band"), F.coalesce("lang", F.lit("*")).alias("lang"), "n", "good", rated.alias("rate"))


def calibration_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether there are 50 cases and 10 responses; else how many are missing."""
    out = table(spark, folder, "labels").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("responses"))
    return out.select("n", "responses", ((F.col("n") >= 50) & (F.col("responses") >= 10)).alias("ready"), F.greatest(F.lit(0), 50 - F.col("n")).alias("missing_n"), F.greatest(F.lit(0), 10 - F.col("responses")).alias("missing_responses"))


def brier_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Brier scores, on the later 30 % of labelled documents, of the earlier cells' rates and of their base rate."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select("doc_id", "lang", "quality")
    split = numbered(rows, [], ["doc_id"], "rn", "total").withColumn("train", F.col("rn") <= F.floor(F.col("total") * 7 / 10))
    train = split.filter("train")
    cells, base = train.groupBy("lang").agg(F.avg("quality").alias("cell")), train.agg(F.avg("quality").alias("base"))
    test = split.filter("NOT train").join(F.broadcast(cells), "lang", "left").join(F.broadcast(base))
    out = test.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.coalesce("cell", "base") - F.col("quality"), 2)), 6).alias("brier_cells"), F.round(F.avg(F.pow(F.col("base") - F.col("quality"), 2)), 6).alias("brier_base"))
    return out.withColumn("admitted", F.col("brier_cells") < F.col("brier_base"))


def standardized_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and population deviation of features; a constant one has scale 1."""
    p = table(spark, folder, "part").withColumn("constant", F.lit(3.0))
    names = ["p_size", "p_retailprice", "constant"]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(f"m_{c}"), 6).alias("mean"), F.round(F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")), 6).alias("scale")) for c in names])
    return p.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).select(F.inline(rows))


def company_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their highest price, the key of their cheapest order, open orders, and their orders in sorted text."""
    o = table(spark, folder, "orders")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderkey"))), lambda r: F.concat(r["o_orderpriority"], F.lit("#"), r["o_orderkey"])), "|")
    return o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top_price"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), roles.alias("roles"))


def kanban(spark: SparkSession, folder: str) -> DataFrame:
    """The board of every day: its orders by status, each column sorted by price, highest first."""
    o = table(spark, folder, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    cards = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")))
    return o.groupBy("day", "o_orderstatus").agg(F.array_join(F.transform(cards, lambda c: c["o_orderkey"].cast("string")), ",").alias("cards"), F.count("*").alias("n"))


def duration_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Interpolated p50 and p95 of each type's last 200 values."""
    last = first_rows(table(spark, folder, "events"), ["event_type"], [F.col("event_id").desc()], 200)
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return last.groupBy("event_type").agg(p.alias("p")).select("event_type", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))


def nearest_rank_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """The value at rank ceil(0.95 n) of each group."""
    rows = numbered(table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], ["l_extendedprice"], "rn", "n")
    return rows.filter(F.col("rn") == F.ceil(F.col("n") * 95 / 100)).select("l_returnflag", F.col("l_extendedprice").alias("p95"), "n")


def duration_spread(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.round(F.median("value"), 6).alias("mid"), F.max("value").alias("hi"))


def distinct_or_null(spark: SparkSession, folder: str) -> DataFrame:
    """A group's value if all its rows agree on it."""
    one = F.when(F.min("o_orderstatus") == F.max("o_orderstatus"), F.max("o_orderstatus"))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(one.alias("status"), F.count("*").alias("n"))


def largest_group(spark: SparkSession, folder: str) -> DataFrame:
    """The segment with most customers, ties to the first name."""
    found = table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "c_mktsegment").limit(1)


def table_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table, as a backup's manifest holds them."""
    from functools import reduce

    names = ["customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]
    return reduce(DataFrame.unionByName, [table(spark, folder, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names])


def run_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of a run (month): lines, kept ones, quantity."""
    rows = table(spark, folder, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("run"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("kept"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


QUERIES = {
    f.__name__: f
    for f in (
        status_funnel_default_new, count_by_tier, labels_zero_filled, matrix_zero_filled, kept_with_text_by_source, salary_histogram, followup_counts, run_report, coverage_pct, outcome_cells,
        source_yield_cells, feature_map_presence, calibration_cells, calibration_gate, brier_baselines, standardized_columns, company_rollup, kanban, duration_percentiles,
        nearest_rank_percentile, duration_spread, distinct_or_null, largest_group, table_row_counts, run_rollup,
    )
}

_BAND = "CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'middle' ELSE 'long' END"

SQL = {
    "status_funnel_default_new": "SELECT coalesce(o_orderstatus, 'New') AS status, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "count_by_tier": "SELECT CAST(floor(p_size / 10.0) AS BIGINT) AS tier, count(*) AS n FROM part GROUP BY 1",
    "labels_zero_filled": "SELECT v AS o_orderpriority, count(o_orderkey) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')) t(v) LEFT JOIN orders ON o_orderpriority = v GROUP BY 1",
    "matrix_zero_filled": """
        SELECT v AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_0, count(*) FILTER (o_orderstatus = 'O') AS n_1, count(*) FILTER (o_orderstatus = 'P') AS n_2
        FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')) t(v) LEFT JOIN orders ON o_orderpriority = v AND o_totalprice > 450000 GROUP BY 1""",
    "kept_with_text_by_source": "SELECT source, count(*) AS n, count(*) FILTER (n_chars >= 400) AS kept, count(*) FILTER (lang = 'en') AS english FROM documents GROUP BY 1",
    "salary_histogram": "SELECT CAST(floor((o_totalprice + ceil(o_totalprice / 1000) * 1000) / 2 / 10000) * 10000 AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "followup_counts": f"""
        SELECT count(*) FILTER (o_orderdate < DATE '{TODAY}' AND o_orderstatus IN ('O', 'P')) AS overdue,
               count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 14 AND o_orderstatus IN ('O', 'P')) AS upcoming,
               count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 14) AS upcoming_any FROM orders""",
    "run_report": """
        WITH d AS (SELECT regexp_replace(source, '[0-9]+$', '') AS p, lang, CASE WHEN n_chars < 400 THEN 'short' WHEN n_chars < 4000 THEN 'middle' ELSE 'long' END AS size FROM documents)
        SELECT 'prefix' AS dimension, p AS key, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'size', size, count(*) FROM d GROUP BY 2
        UNION ALL SELECT 'all', 'all', count(*) FROM d""",
    "coverage_pct": "SELECT source, count(*) AS total, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*), 2) AS pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1",
    "outcome_cells": """
        WITH r AS (SELECT * FROM documents JOIN labels USING (doc_id)), g AS (
          SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, coalesce(lang, source, 'all') AS key,
                 count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, round(median(n_chars), 2) AS median_chars FROM r GROUP BY GROUPING SETS ((lang), (source), ()))
        SELECT *, round(CAST(good AS DOUBLE) / n, 6) AS good_rate, round(CAST(toxic AS DOUBLE) / n, 6) AS toxic_rate, n < 20 AS low_sample FROM g""",
    "source_yield_cells": """
        WITH r AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), g AS (
          SELECT CASE WHEN grouping(c_mktsegment) = 0 THEN 'c_mktsegment' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'all' END AS dimension, coalesce(c_mktsegment, o_orderpriority, 'all') AS key,
                 count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS filled, count(DISTINCT c_custkey) AS customers FROM r GROUP BY GROUPING SETS ((c_mktsegment), (o_orderpriority), ()))
        SELECT *, round(CAST(filled AS DOUBLE) / orders, 6) AS filled_rate, orders < 100 AS low_sample FROM g""",
    "feature_map_presence": """
        WITH r AS (SELECT event_type, unnest(json_keys(props)) AS feature, props FROM events)
        SELECT feature, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS bought, CAST(sum(CAST(json_extract_string(props, '$.' || feature) AS BIGINT)) AS BIGINT) AS weight FROM r GROUP BY 1""",
    "calibration_cells": f"""
        WITH r AS (SELECT *, {_BAND} AS b FROM documents JOIN labels USING (doc_id)),
        g AS (SELECT coalesce(b, '*') AS band, coalesce(lang, '*') AS lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM r GROUP BY GROUPING SETS ((b), (b, lang), ()))
        SELECT *, CASE WHEN n >= 10 THEN round(CAST(good AS DOUBLE) / n, 6) END AS rate FROM g""",
    "calibration_gate": """
        WITH t AS (SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS responses FROM labels)
        SELECT *, n >= 50 AND responses >= 10 AS ready, greatest(0, 50 - n) AS missing_n, greatest(0, 10 - responses) AS missing_responses FROM t""",
    "brier_baselines": """
        WITH r AS (SELECT doc_id, lang, quality, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS total FROM documents JOIN labels USING (doc_id)),
        s AS (SELECT *, rn <= floor(total * 7 / 10.0) AS train FROM r), c AS (SELECT lang, avg(quality) AS cell FROM s WHERE train GROUP BY 1), b AS (SELECT avg(quality) AS base FROM s WHERE train),
        t AS (SELECT count(*) AS n, round(avg(pow(coalesce(cell, base) - quality, 2)), 6) AS brier_cells, round(avg(pow(base - quality, 2)), 6) AS brier_base FROM s LEFT JOIN c USING (lang), b WHERE NOT train)
        SELECT *, brier_cells < brier_base AS admitted FROM t""",
    "standardized_columns": """
        SELECT 'p_size' AS feature, round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS scale FROM part
        UNION ALL SELECT 'p_retailprice', round(avg(p_retailprice), 6), round(stddev_pop(p_retailprice), 6) FROM part UNION ALL SELECT 'constant', 3.0, 1.0""",
    "company_rollup": """
        SELECT o_custkey, max(o_totalprice) AS top_price, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, count(*) FILTER (o_orderstatus = 'O') AS "open",
               string_agg(o_orderpriority || '#' || o_orderkey, '|' ORDER BY o_orderpriority, o_orderkey) AS roles FROM orders GROUP BY 1""",
    "kanban": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS cards, count(*) AS n FROM orders GROUP BY 1, 2",
    "duration_percentiles": """
        WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 200)
        SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM l GROUP BY 1""",
    "nearest_rank_percentile": """
        WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
        SELECT l_returnflag, l_extendedprice AS p95, n FROM r WHERE rn = ceil(n * 95 / 100.0)""",
    "duration_spread": "SELECT event_type, min(value) AS lo, round(median(value), 6) AS mid, max(value) AS hi FROM events GROUP BY 1",
    "distinct_or_null": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS status, count(*) AS n FROM orders GROUP BY 1",
    "largest_group": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 1",
    "table_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")),
    "run_rollup": "SELECT strftime(l_shipdate, '%Y-%m') AS run, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS kept, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
}
