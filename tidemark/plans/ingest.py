"""Ingest and maintenance: claims to entities, upserts, revivals, one-hop merges, stratified picks and small scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import ingest, redirects
from ..sources.scratch import fresh as scratch
from ..sources.scratch import written
from ..sources.tables import table


def ingest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The current table after a run: known keys that the run lacks are absent, the others are replaced, new ones added."""
    e = table(spark, folder, "events")
    latest = lambda rows, name: rows.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias(name))
    old, new = latest(e.filter("ts < TIMESTAMP_NTZ '2024-01-20'"), "old"), latest(e.filter("ts >= TIMESTAMP_NTZ '2024-01-29'"), "new")
    out = old.join(new, "user_id", "full")
    outcome = F.when(F.col("new").isNull(), "absent").when(F.col("old").isNull(), "inserted").when(F.col("old.event_type") == F.col("new.event_type"), "same").otherwise("updated")
    row = F.coalesce("new", "old")
    return out.select("user_id", F.col("new").isNotNull().alias("present"), outcome.alias("outcome"), row["event_type"].alias("event_type"), row["value"].alias("value"))


def orders_as_records(o: DataFrame) -> DataFrame:
    """Orders as records: two in three have an id of their own, all have an address that several share, and one in two a second one."""
    claim = lambda rank, kind, value: F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(kind), value.cast("string")).alias("claim"))
    key = F.col("o_orderkey")
    own = F.when(key % 3 != 0, claim(0, "id:", key % 4000))
    second = F.when(key % 2 == 0, claim(1, "url:", key % 5000 + 1_000_000))
    claims = F.array_compact(F.array(own, claim(1, "url:", F.col("o_custkey")), second))
    return o.select(key.alias("record"), F.concat(F.lit("source"), (F.col("o_custkey") % 3).cast("string")).alias("namespace"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("content"), claims.alias("claims"))


def claims_to_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entity of each record and how it came to it, in two batches, with the claims that belong to another entity."""
    records = orders_as_records(table(spark, folder, "orders"))
    one, two = records.filter("record < 3000"), records.filter("record >= 3000")
    first = ingest.resolved(ingest.claimed(one), spark.createDataFrame([], "claim string, posting string"))
    second = ingest.resolved(ingest.claimed(two), written(first.minted(), "aliases"))
    basis = F.when(F.col("basis") == "minted", "minted").otherwise("shared")
    return first.places.unionByName(second.places).select("record", F.col("posting").alias("entity"), "via", basis.alias("basis"), "conflicts")


def ingest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches of records written by the ingest writer, the second one twice: what each did that had records."""
    writer = ingest.Writer(spark, scratch(spark, "ledger"))
    records = orders_as_records(table(spark, folder, "orders"))
    for batch, part in (("b0", "record < 2000"), ("b1", "record >= 2000 AND record < 6000"), ("b1", "record >= 2000 AND record < 6000"), ("b2", "record >= 6000")):
        writer.write(batch, records.filter(part), batch, "orders", f"attempt-{batch}", "2024-01-01")
    return writer.ledger.read("outcomes", ingest.OUTCOMES).filter("received > 0")


def ingest_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The contents that the same batches leave of each posting, with the claim that evidenced the posting."""
    writer = ingest.Writer(spark, scratch(spark, "ledger"))
    records = orders_as_records(table(spark, folder, "orders"))
    for batch, part in (("b0", "record < 4000"), ("b1", "record >= 4000")):
        writer.write(batch, records.filter(part), batch, "orders", f"attempt-{batch}", "2024-01-01")
    return writer.ledger.read("versions", ingest.VERSIONS).select("posting", "content", "alias", "run")


def supersession_revival(spark: SparkSession, folder: str) -> DataFrame:
    """What each scoring does to its entity's versions: a fresh one, the current one reused, an earlier one revived (A, B, A), or a replacement."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("hash"))
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    earlier = F.row_number().over(Window.partitionBy("o_custkey", "hash").orderBy("o_orderdate", "o_orderkey")) > 1
    seen = o.withColumns({"current": F.lag("hash").over(by), "earlier": earlier})
    outcome = F.when(F.col("current").isNull(), "fresh").when(F.col("current") == F.col("hash"), "reused").when(F.col("earlier"), "reverted").otherwise("replaced")
    return seen.select("o_orderkey", outcome.alias("outcome"))


def one_hop_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Feature maps with those of what redirects to a row directly, its own first; a chain is not walked. Namespaces are united."""
    p = table(spark, folder, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey") - 1).alias("to"), F.create_map(F.concat(F.lit("k"), (F.col("p_partkey") % 3).cast("string")), "p_size").alias("own"))
    own, incoming = p.drop("to"), p.filter("to is not null").select(F.col("to").alias("p_partkey"), F.col("own").alias("more"), F.col("p_brand").alias("their"))
    out = own.join(incoming, "p_partkey", "left")
    merged = F.map_concat("own", F.coalesce(F.map_filter("more", lambda k, v: ~F.map_contains_key("own", k)), F.create_map().cast("map<string,int>")))
    spaces = F.array_sort(F.array_union(F.array("p_brand"), F.coalesce(F.array("their"), F.array().cast("array<string>"))))
    return out.select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("features"), F.array_join(F.filter(spaces, lambda s: s.isNotNull()), ",").alias("namespaces"))


def stream_id_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Per key, an id that some event of its stream names explicitly, the first one; else the dimension's."""
    e = table(spark, folder, "events").withColumn("named", F.when(F.col("event_id") % 97 == 0, F.col("event_id") % 1000))
    first = e.groupBy("user_id").agg(F.min_by("named", F.when(F.col("named").isNotNull(), F.struct("ts", "event_id"))).alias("named"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + 100000).alias("known"))
    return first.join(c, "user_id", "left").select("user_id", F.coalesce("named", "known").alias("id"), F.when(F.col("named").isNotNull(), "stream").when(F.col("known").isNotNull(), "dimension").otherwise("none").alias("basis"))


def prioritized_match(spark: SparkSession, folder: str) -> DataFrame:
    """Picks pinned to a row, or else its smallest match by the brand's last letter inside the brand and the name's beginning."""
    p = table(spark, folder, "part")
    picks = p.filter("p_partkey % 40 = 7").select(F.col("p_partkey").alias("pick"), F.when(F.col("p_partkey") % 80 == 7, F.col("p_partkey")).alias("pin"), "p_brand", F.substring_index("p_name", " ", 1).alias("begin"))
    pinned = picks.filter("pin is not null").join(p.select(F.col("p_partkey").alias("hit")), F.col("pin") == F.col("hit")).select("pick", "hit", F.lit("pinned").alias("basis"))
    # the join's key is the brand and the first word; the pair is reduced to one row before it is dealt out
    first = p.groupBy("p_brand", F.substring_index("p_name", " ", 1).alias("begin")).agg(F.min("p_partkey").alias("hit"))
    loose = picks.filter("pin is null").join(first, ["p_brand", "begin"]).select("pick", "hit", F.lit("name").alias("basis"))
    return pinned.unionByName(loose)


def resolution_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose key a resolution names take its key and keep the old one as an alternate."""
    o = table(spark, folder, "orders")
    known = o.filter("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_orderkey") * 10).alias("target"))
    out = o.join(known, "o_orderkey", "left")
    return out.select("o_orderkey", F.coalesce("target", "o_orderkey").alias("key"), F.when(F.col("target").isNotNull(), F.col("o_orderkey").cast("string")).otherwise("").alias("alternates"))


def resolution_import(spark: SparkSession, folder: str) -> DataFrame:
    """Resolutions in order, imported into a graph of redirects that has cycles already: what becomes of each, and where its target ended then."""
    p = table(spark, folder, "part")
    known = p.filter("p_partkey <= 150").select((F.col("p_partkey") % 900).alias("src"), ((F.col("p_partkey") * 31 + 7) % 900).alias("dst"))
    src, dst = F.col("p_partkey") * 11 % 900, F.when(F.col("p_size") % 10 != 0, (F.col("p_partkey") * 7 + F.col("p_size")) % 900)
    records = p.select(F.col("p_partkey").alias("at"), src.alias("src"), dst.alias("dst"), F.concat_ws(">", src.cast("string"), dst.cast("string")).alias("content"))
    return redirects.imported(records, known)[0]


def state_not_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Entities with a state whose listing is missing or absent, by state."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    present = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.join(present, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def versions_created(spark: SparkSession, folder: str) -> DataFrame:
    """Versions made while a run lasted, per run: each version is matched by its run's key and its time."""
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    runs = o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.col("o_orderdate").alias("began"))
    hit = li.select("l_orderkey", "l_shipdate").join(runs, "l_orderkey").filter("l_shipdate >= began AND l_shipdate < began + INTERVAL 60 DAYS")
    return hit.groupBy("o_orderpriority").agg(F.count("*").alias("versions"), F.countDistinct("l_orderkey").alias("runs"))


def stale_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Of what was served and never engaged with, the share whose last serving is stale."""
    e = table(spark, folder, "events")
    served = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("last"))
    engaged = e.filter("event_type IN ('click', 'purchase') AND value > 30").select("user_id").distinct()
    rest = served.join(engaged, "user_id", "left_anti")
    out = rest.agg(F.count("*").alias("ignored"), F.count_if(F.col("last") < F.lit("2024-01-29").cast("timestamp_ntz")).alias("stale"))
    return out.withColumn("stale_rate", F.when(F.col("ignored") > 0, F.round(F.col("stale") / F.col("ignored"), 6)))


def pace_cards(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.agg(F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1998-06-01").cast("timestamp_ntz"))).alias("actionable"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > F.lit("1998-06-01").cast("timestamp_ntz"))).alias("snoozed"))


def cells_unknown_last(spark: SparkSession, folder: str) -> DataFrame:
    """Cells by falling count, then key, with the unknown one last; their number is that of the dimension's values."""
    c = table(spark, folder, "customer").groupBy(F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")).otherwise("unknown").alias("cell")).agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.col("cell") == "unknown", F.desc("n"), "cell")))


def canonical_namespace(spark: SparkSession, folder: str) -> DataFrame:
    """Each entity's namespace: that of the best category, then the first by name."""
    li = table(spark, folder, "lineitem").select("l_orderkey", F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("namespace"), (F.col("l_suppkey") % 3).alias("rank"))
    return li.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("rank")).alias("r"), "namespace"))["namespace"].alias("namespace"))


def review_targets(spark: SparkSession, folder: str) -> DataFrame:
    """What is reviewed next: three strata in order, the dearest of each first, at most 50."""
    o = table(spark, folder, "orders").filter("o_orderstatus = 'O'")
    stratum = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_totalprice") > 400000, 1).otherwise(2)
    return o.select("o_orderkey", stratum.alias("stratum"), "o_totalprice").orderBy("stratum", F.desc("o_totalprice"), "o_orderkey").limit(50)


def flagged_groups_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of which no member's flags hold the word, with their size."""
    o = table(spark, folder, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority").contains("URGENT")).alias("flagged")).filter("not flagged").select("o_custkey", "n")


def completed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Completed runs with the date to show, newest first; a kind that is no snapshot is left out."""
    o = table(spark, folder, "orders").filter("o_orderpriority <> '5-LOW'")
    shown = F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.date_format("o_orderdate", "yyyy-MM"))
    return o.filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", shown.alias("shown"), "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(25)


def guarded_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions after an upsert that adds new keys and overwrites only those marked unavailable."""
    d = table(spark, folder, "documents")
    old = d.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "unavailable").otherwise("ok").alias("state"), F.lit("old").alias("by"))
    new = d.filter("doc_id % 2 = 0").select("doc_id", F.lit("ok").alias("new_state"), F.lit("new").alias("new_by"))
    out, take = old.join(new, "doc_id", "full"), F.col("state").isNull() | ((F.col("state") == "unavailable") & F.col("new_state").isNotNull())
    return out.select("doc_id", F.when(take, F.col("new_state")).otherwise(F.col("state")).alias("state"), F.when(take, F.col("new_by")).otherwise(F.col("by")).alias("by"))


def orphans_and_retries(spark: SparkSession, folder: str) -> DataFrame:
    """Runs after a restart: an unfinished one is interrupted, and its members belong to the next attempt of the same source, if there is one."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    out = o.withColumn("next", following).withColumn("status", F.when(F.col("o_orderstatus") == "P", "interrupted").otherwise(F.col("o_orderstatus")))
    return out.select("o_orderkey", "status", F.when(F.col("status") == "interrupted", F.coalesce("next", "o_orderkey")).otherwise(F.col("o_orderkey")).alias("owner"))


FAMILIES = {"billing": ["credit", "refund"], "support": ["support", "help"], "licensing": ["license", "copyright"], "french": [" les ", " aux "], "german": [" und ", " der "]}


def role_families(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", T.role_family(F.substring_index("text", "\n", 1), F.col("text"), FAMILIES).alias("family"))


def scalar_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Company keys, compatible places, surrogate urls, state values, numbers and the earlier of two times, of each customer."""
    c = table(spark, folder, "customer")
    n = F.col("c_custkey")
    name = F.concat(F.lit("The "), F.replace("c_name", F.lit("#"), F.lit(" ")), F.element_at(F.array(F.lit(" Holdings, Inc."), F.lit(" GmbH"), F.lit("")), (n % 3 + 1).cast("int")))
    url = F.when(n % 4 == 0, "").otherwise(F.concat(F.when(n % 4 == 1, "ftp").otherwise(" https"), F.lit("://x.example/"), n.cast("string")))
    early = F.when(n % 2 == 0, "2024-03-01").otherwise("2024-02-29T23:30:00Z")
    late = F.when(n % 3 == 0, "2024-03-01T00:30:00+01:00").when(n % 3 == 1, "2024-02-29 23:00:00").otherwise("soon")
    return c.select(
        "c_custkey", T.company_key(name).alias("company"), T.locations_compatible(F.col("c_mktsegment"), F.when(n % 2 == 0, "auto mobile household").otherwise("a b")).alias("compatible"),
        T.surrogate_url(url, n).alias("url"), T.state_value(n % 2 == 0, flag=True).alias("starred"), T.state_value(F.when(n % 4 == 0, "").otherwise("note")).alias("notes"),
        T.as_float(F.when(n % 3 == 0, "true").when(n % 3 == 1, F.col("c_acctbal").cast("string")).otherwise("n/a")).alias("number"), T.earliest(early, late).alias("earliest"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        ingest_upsert, claims_to_entities, ingest_outcomes, ingest_versions, supersession_revival, one_hop_merge, stream_id_resolution, prioritized_match, resolution_rewrite, resolution_import, state_not_listed, versions_created, stale_rate,
        pace_cards, cells_unknown_last, canonical_namespace, review_targets, flagged_groups_excluded, completed_runs, guarded_upsert, orphans_and_retries, role_families, scalar_rules,
    )
}

_FAMILY = " ".join(f"WHEN {' OR '.join(f'contains({t}, {chr(39)}{k}{chr(39)})' for k in words)} THEN '{name}'" for t in ("t", "d") for name, words in FAMILIES.items())
_NOISE = ", ".join(f"'{w}'" for w in T.COMPANY_NOISE)

# A claim belongs to the first record that has it; a record with an id follows that claim only, another one its first known claim.
RESOLVED = """
    c AS (SELECT o_orderkey AS record, unnest([{'k': 0, 'claim': CASE WHEN o_orderkey % 3 <> 0 THEN 'id:' || (o_orderkey % 4000) END}, {'k': 1, 'claim': 'url:' || o_custkey}, {'k': 2, 'claim': CASE WHEN o_orderkey % 2 = 0 THEN 'url:' || (o_orderkey % 5000 + 1000000) END}], recursive := true) FROM orders),
    d AS (SELECT * FROM c WHERE claim IS NOT NULL), f AS (SELECT claim, min(record) AS first FROM d GROUP BY 1),
    u AS (SELECT record, arg_min(claim, k) AS head, min(k) AS best, arg_min(claim, k) FILTER (first < record) AS hit, arg_min(first, k) FILTER (first < record) AS hit_first FROM d JOIN f USING (claim) GROUP BY 1),
    p AS (SELECT record, head, hit AS via, CASE WHEN best > 0 OR hit = head THEN hit_first END AS parent FROM u),
    r(record, root) AS (SELECT record, record FROM p WHERE parent IS NULL UNION ALL SELECT p.record, r.root FROM p JOIN r ON p.parent = r.record)"""

SQL = {
    "ingest_upsert": """
        WITH o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
        SELECT user_id, n.t IS NOT NULL AS present, CASE WHEN n.t IS NULL THEN 'absent' WHEN o.t IS NULL THEN 'inserted' WHEN o.t = n.t THEN 'same' ELSE 'updated' END AS outcome, coalesce(n.t, o.t) AS event_type, CASE WHEN n.t IS NULL THEN o.v ELSE n.v END AS value FROM o FULL JOIN n USING (user_id)""",
    "claims_to_entities": f"""
        WITH RECURSIVE {RESOLVED}
        SELECT r.record, left(sha256(h.head), 32) AS entity, CASE WHEN p.parent IS NULL THEN p.head ELSE p.via END AS via, CASE WHEN p.parent IS NULL THEN 'minted' ELSE 'shared' END AS basis,
        (SELECT count(*) FROM c JOIN f USING (claim) JOIN r q ON q.record = f.first WHERE c.record = r.record AND q.root <> r.root) AS conflicts
        FROM r JOIN p ON p.record = r.record JOIN p h ON h.record = r.root""",
    "ingest_outcomes": f"""
        WITH RECURSIVE {RESOLVED}, b AS (SELECT r.record, root, p.parent IS NULL AS minted, CASE WHEN r.record < 2000 THEN 'b0' WHEN r.record < 6000 THEN 'b1' ELSE 'b2' END AS batch, 'source' || (o_custkey % 3) AS namespace, o_orderstatus || ' ' || o_orderpriority AS content FROM r JOIN p USING (record) JOIN orders ON o_orderkey = r.record),
        m AS (SELECT *, content IS DISTINCT FROM lag(content) OVER (PARTITION BY root, namespace ORDER BY record) AS moved FROM b),
        k AS (SELECT CASE WHEN c.record < 2000 THEN 'b0' WHEN c.record < 6000 THEN 'b1' ELSE 'b2' END AS batch, count(*) AS conflicts FROM c JOIN f USING (claim) JOIN r q ON q.record = f.first JOIN r o ON o.record = c.record WHERE q.root <> o.root GROUP BY 1)
        SELECT batch, count(*) AS received, count(DISTINCT root) AS accepted, count(*) FILTER (minted) AS created, count(*) - count(DISTINCT root) AS duplicates, 0::BIGINT AS skipped, coalesce(any_value(conflicts), 0) AS conflicts, count(DISTINCT CASE WHEN moved THEN root END) AS changed
        FROM m LEFT JOIN k USING (batch) GROUP BY 1""",
    "ingest_versions": f"""
        WITH RECURSIVE {RESOLVED}, m AS (SELECT r.record, root, CASE WHEN parent IS NULL THEN head ELSE via END AS alias, 'source' || (o_custkey % 3) AS namespace, o_orderstatus || ' ' || o_orderpriority AS content FROM r JOIN p USING (record) JOIN orders ON o_orderkey = r.record),
        v AS (SELECT *, content IS DISTINCT FROM lag(content) OVER (PARTITION BY root, namespace ORDER BY record) AS moved FROM m)
        SELECT left(sha256(any_value(h.head)), 32) AS posting, content, arg_min(alias, v.record) AS alias, CASE WHEN min(v.record) < 4000 THEN 'b0' ELSE 'b1' END AS run FROM v JOIN p h ON h.record = root WHERE moved GROUP BY root, content""",
    "supersession_revival": """
        WITH s AS (SELECT o_orderkey, o_orderstatus AS h, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS c, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
        SELECT o_orderkey, CASE WHEN c IS NULL THEN 'fresh' WHEN c = h THEN 'reused' WHEN r > 1 THEN 'reverted' ELSE 'replaced' END AS outcome FROM s""",
    "one_hop_merge": """
        WITH p AS (SELECT p_partkey AS k, p_brand AS b, 'k' || (p_partkey % 3) || '=' || p_size AS f, 'k' || (p_partkey % 3) AS n FROM part), i AS (SELECT k - 1 AS k, b, f, n FROM p WHERE k % 10 <> 0)
        SELECT p.k AS p_partkey, array_to_string(list_sort(CASE WHEN i.f IS NULL OR i.n = p.n THEN [p.f] ELSE [p.f, i.f] END), ',') AS features, array_to_string(list_sort(list_distinct(list_filter([p.b, i.b], lambda x: x IS NOT NULL))), ',') AS namespaces FROM p LEFT JOIN i ON i.k = p.k""",
    "stream_id_resolution": """
        WITH f AS (SELECT user_id, arg_min(event_id % 1000, (ts, event_id)) FILTER (event_id % 97 = 0) AS named FROM events GROUP BY 1)
        SELECT user_id, coalesce(named, c_custkey + 100000) AS id, CASE WHEN named IS NOT NULL THEN 'stream' WHEN c_custkey IS NOT NULL THEN 'dimension' ELSE 'none' END AS basis FROM f LEFT JOIN customer ON c_custkey = user_id""",
    "prioritized_match": """
        WITH f AS (SELECT p_brand, split_part(p_name, ' ', 1) AS s, min(p_partkey) AS hit FROM part GROUP BY 1, 2)
        SELECT p_partkey AS pick, CASE WHEN p_partkey % 80 = 7 THEN p_partkey ELSE hit END AS hit, CASE WHEN p_partkey % 80 = 7 THEN 'pinned' ELSE 'name' END AS basis FROM part p JOIN f ON f.p_brand = p.p_brand AND s = split_part(p_name, ' ', 1) WHERE p_partkey % 40 = 7""",
    "resolution_rewrite": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey * 10 ELSE o_orderkey END AS key, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS alternates FROM orders",
    "resolution_import": """
        WITH RECURSIVE known AS (SELECT p_partkey % 900 AS src, (p_partkey * 31 + 7) % 900 AS dst FROM part WHERE p_partkey <= 150),
        walk(node, now, k) AS (SELECT i, i, 0 FROM range(900) t(i) UNION ALL SELECT node, dst, k + 1 FROM walk JOIN known ON src = now WHERE k < 200),
        ends AS (SELECT node, arg_max(now, k) AS terminal, max(k) >= 200 AS cyclic FROM walk GROUP BY 1), start AS (SELECT list(terminal ORDER BY node) AS g, list(cyclic ORDER BY node) AS bad FROM ends),
        asked AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM (SELECT p_partkey AS k, p_partkey * 11 % 900 AS src, CASE WHEN p_size % 10 <> 0 THEN (p_partkey * 7 + p_size) % 900 END AS dst FROM part)),
        judged(i, k, src, dst, found, fin, g, bad) AS (
            SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, g, bad FROM start
            UNION ALL
            SELECT n.i, n.k, n.src, n.dst, n.found, n.fin, CASE WHEN n.found = 'adds' THEN list_transform(n.g, lambda x: CASE WHEN x = n.src THEN n.fin ELSE x END) ELSE n.g END, n.bad
            FROM (SELECT a.i, a.k, a.src, a.dst, j.g, j.bad, j.g[a.dst + 1] AS fin,
                CASE WHEN a.dst IS NULL THEN 'unresolved' WHEN j.bad[a.src + 1] OR j.bad[a.dst + 1] THEN 'cyclic' WHEN j.g[a.dst + 1] = a.src AND a.src <> a.dst THEN 'closing' WHEN j.g[a.dst + 1] = a.src THEN 'same'
                     WHEN j.g[a.src + 1] = a.src THEN 'adds' WHEN j.g[a.src + 1] <> j.g[a.dst + 1] THEN 'conflicting' ELSE 'same' END AS found
                FROM judged j JOIN asked a ON a.i = j.i + 1) n),
        seen AS (SELECT *, first_value(fin) OVER w AS owner, row_number() OVER w AS nth FROM judged WHERE found IN ('adds', 'same') WINDOW w AS (PARTITION BY src, dst ORDER BY k))
        SELECT k AS "at", CASE WHEN nth = 1 THEN 'mapped' WHEN fin <> owner THEN 'disputed' WHEN found = 'adds' THEN 'mapped' ELSE 'repeated' END AS outcome, fin AS "end" FROM seen
        UNION ALL SELECT k, found, CASE WHEN found IN ('closing', 'conflicting') THEN fin END FROM judged WHERE found NOT IN ('adds', 'same') AND i > 0""",
    "state_not_listed": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY 1",
    "versions_created": "SELECT o_orderpriority, count(*) AS versions, count(DISTINCT o_orderkey) AS runs FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY GROUP BY 1",
    "stale_rate": """
        WITH r AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type IN ('click', 'purchase') AND value > 30) GROUP BY 1)
        SELECT count(*) AS ignored, count(*) FILTER (last < TIMESTAMP '2024-01-29') AS stale, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (last < TIMESTAMP '2024-01-29') / count(*), 6) END AS stale_rate FROM r""",
    "pace_cards": "SELECT count(*) FILTER (o_orderdate <= TIMESTAMP '1998-06-01') AS actionable, count(*) FILTER (o_orderdate > TIMESTAMP '1998-06-01') AS snoozed FROM orders WHERE o_orderstatus = 'O'",
    "cells_unknown_last": "SELECT cell, n, row_number() OVER (ORDER BY cell = 'unknown', n DESC, cell) AS place FROM (SELECT CASE WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'unknown' END AS cell, count(*) AS n FROM customer GROUP BY 1)",
    "canonical_namespace": "SELECT l_orderkey, arg_min('s' || (l_suppkey % 20), (-(l_suppkey % 3), 's' || (l_suppkey % 20))) AS namespace FROM lineitem GROUP BY 1",
    "review_targets": "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_totalprice > 400000 THEN 1 ELSE 2 END AS stratum, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY stratum, o_totalprice DESC, o_orderkey LIMIT 50",
    "flagged_groups_excluded": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderpriority LIKE '%URGENT%') = 0",
    "completed_runs": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS shown, o_orderdate FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25",
    "guarded_upsert": """
        WITH d AS (SELECT doc_id, doc_id % 3 <> 0 AS old, doc_id % 5 = 0 AS gap, doc_id % 2 = 0 AS new FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0)
        SELECT doc_id, CASE WHEN NOT old OR NOT gap OR new THEN 'ok' ELSE 'unavailable' END AS state, CASE WHEN NOT old OR (gap AND new) THEN 'new' ELSE 'old' END AS by FROM d""",
    "orphans_and_retries": """
        WITH o AS (SELECT o_orderkey, o_orderstatus = 'P' AS cut, o_orderstatus, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)
        SELECT o_orderkey, CASE WHEN cut THEN 'interrupted' ELSE o_orderstatus END AS status, CASE WHEN cut THEN coalesce(nxt, o_orderkey) ELSE o_orderkey END AS owner FROM o""",
    "role_families": f"WITH d AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS t, left(replace(lower(text), chr(92), ''), 1500) AS d FROM documents) SELECT doc_id, CASE {_FAMILY} END AS family FROM d",
    "scalar_rules": f"""
        SELECT c_custkey, array_to_string(list_filter(regexp_extract_all(lower('The ' || replace(c_name, '#', ' ') || CASE c_custkey % 3 WHEN 0 THEN ' Holdings, Inc.' WHEN 1 THEN ' GmbH' ELSE '' END), '[a-z0-9]+'), lambda w: w NOT IN ({_NOISE})), ' ') AS company,
        c_custkey % 2 = 1 OR c_mktsegment = 'HOUSEHOLD' AS compatible, CASE WHEN c_custkey % 4 < 2 THEN 'withheld:' || c_custkey ELSE 'https://x.example/' || c_custkey END AS url, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END AS starred, CASE WHEN c_custkey % 4 <> 0 THEN 'note' END AS notes,
        CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN c_acctbal ELSE 0.0 END AS number,
        CASE WHEN c_custkey % 3 = 2 THEN CASE WHEN c_custkey % 2 = 0 THEN '2024-03-01' ELSE '2024-02-29T23:30:00Z' END WHEN c_custkey % 3 = 1 THEN '2024-02-29 23:00:00' WHEN c_custkey % 2 = 0 THEN '2024-03-01T00:30:00+01:00' ELSE '2024-02-29T23:30:00Z' END AS earliest FROM customer""",
}
