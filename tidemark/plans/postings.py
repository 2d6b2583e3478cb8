"""Postings: scored in full from documents, scanned from files, parsed by position, compared, and kept as a score history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate, diffs, history, projections, rubric
from ..functions.text import sigmoid
from ..sources import markup, scans
from ..sources.scratch import fresh
from ..sources.tables import table

RUBRIC = rubric.Rubric(
    abroad=[r"\buk\b", r"germany", r"\bindia\b"],
    local=[r"san francisco", r"oakland", r"\bfremont\b"],
    local_mark=r",\s*ca\b|bay area",
    remote_mark=r"\bremote\b|work from home|\banywhere\b",
    families={"support": ["support", "help desk"], "validation": ["validation", "verification"], "techops": ["technical operations", "it operations"], "tpm": ["tpm", "program manager"], "solutions": ["solutions engineer"]},
    family_points={"support": 3, "validation": 3, "techops": 2, "tpm": 2, "solutions": 1},
    focus=["support", "validation", "techops"],
    clearance=(r"clearance", r"\b(active|current|hold)\b", r"able to obtain|eligible"),
    barred_words=["verilog", "salesforce apex"],
    barred_titles=[r"\bintern\b", r"\bdirector\b"],
    managers=r"\b(manager|supervisor)\b",
    single_contributors=r"\b(program|project|product|account) manager\b",
    senior=r"\b(senior|sr|staff|principal)\b",
    second_level=r"\bii\b",
    staff=r"\b(staff|principal)\b",
    design_words=["design", "architect"],
    large_support=["bigcloud", "meta"],
    domains=([r"\blinux\b", r"\bsql\b"], [r"\bazure\b", r"active directory", r"\bokta\b"]),
    targets=[r"^acme", r"bigcloud"],
    contract_words=["corp-to-corp", "c2c"],
    agencies=["staffing", "contoso"],
    degree=(r"(bachelor|degree)[^.]*required", "or equivalent"),
    points={"tpm_senior": -2, "tpm_ii_stretch": -1, "stretch_level": -1, "years_penalty": -1, "years_bonus": 1, "years_pref_penalty": -1, "domain_tier2": 2, "domain_tier1": 1, "target_co": 1, "stale_30d": -1, "comp_in_band": 1, "low_comp": -1, "c2c": -2, "staffing_w2": -1, "degree_gated": -1},
    odds_points={"staff_principal": -4, "senior": -2, "junior": 2, "years_low": 2, "years_high": -2, "high_competition": -2, "staffing_w2": 1, "skills_strong": 3, "skills_moderate": 1, "skills_thin": -1, "exact_stack": 2, "comp_high_bar": -2, "comp_near_level": 1, "degree_gated": -2},
    odds_levels=(r"\b(staff|principal)\b", r"\bsenior\b", r"\b(junior|associate)\b"),
    crowded=[r"\bmeta\b", r"bigcloud"],
    skills=[r"\bokta\b", r"\bjamf\b", r"\bslack\b", r"\bpython\b", r"\bsql\b", r"\blinux\b", r"\bjira\b", r"\bintune\b"],
    stack=[r"\bokta\b", r"\bjamf\b", r"\bslack\b"],
)


def _postings(docs: DataFrame) -> DataFrame:
    """Documents as postings: a title and sentences that postings have, by their ids, around the whole text."""
    pick = lambda of, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("doc_id"), F.lit(of)).cast("int") % len(values)) + 1)
    said = pick(11, ["We need 3+ years of experience. ", "Requires 6 years of experience. ", "Works with azure and okta. ", "Must hold an active clearance. ", "Able to obtain a clearance; ", "Pay is $95,000 - $130,000. ", "", "Equal opportunity for azure users. ", "corp-to-corp ", "A degree is required. ", "At least 9 years required. "])
    return docs.select(
        "doc_id", pick(7, ["Support Engineer", "Senior Validation Engineer", "Staff Support Engineer", "Program Manager", "Technical Operations Lead", "Support Manager", "Account Manager, help desk"]).alias("title"),
        pick(5, ["Acme", "Meta", "Contoso Staffing", "Bigcloud", "Other"]).alias("company"), pick(6, ["San Francisco, CA", "Remote", "Austin, TX", "Oakland, CA", "London, UK", "Remote (US)"]).alias("location"), F.lit("false").alias("remote"), "source",
        pick(4, ["$100k - $140k", "", "$30/hr", ""]).alias("salary"), F.lit("").alias("salary_min"), F.lit("").alias("salary_max"), pick(3, ["2024-06-20", "2024-01-01", ""]).alias("posted"),
        F.when(F.pmod("doc_id", F.lit(13)) > 0, F.concat(said, F.coalesce("text", F.lit("")))).alias("description"), (F.pmod("doc_id", F.lit(2)) == 0).alias("aggregator"),
    )


def posting_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Tier, blocker, flags and odds of every document as a posting."""
    out = rubric.odds(rubric.fit(_postings(table(spark, folder, "documents")), RUBRIC, "2024-06-30"), RUBRIC)
    return out.select("doc_id", "tier", "blocker", F.array_join("flags", ",").alias("flags"), "why", F.col("odds.score").alias("odds_score"), F.col("odds.label").alias("odds"))


def posting_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vectors whose tier does not follow from them alone, or in which something is wrong: none."""
    out = rubric.fit(_postings(table(spark, folder, "documents")), RUBRIC, "2024-06-30")
    vector = out.select("tier", rubric.stored(F.col("features"), F.col("blocker")).alias("vector"))
    return vector.agg(F.count("*").alias("n"), F.count_if(~rubric.replayed(F.col("vector")).eqNullSafe(F.col("tier"))).alias("tier_differs"), F.count_if(F.size(rubric.problems(F.col("vector"))) > 0).alias("wrong"))


def wanted_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as JSON lines, every third one twice and with broken lines between, asked for the urls of two documents in three; the first line wins."""
    d, path = table(spark, folder, "documents"), fresh(spark, "lines")
    url = F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string"))
    good = d.select("doc_id", F.lit(0).alias("k"), F.to_json(F.struct(url.alias("url"), F.col("text").alias("desc"))).alias("value"))
    again = d.filter("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("k"), F.to_json(F.struct(url.alias("url"), F.lit("again").alias("desc"))).alias("value"))
    broken = d.filter("doc_id % 5 = 0").select("doc_id", F.lit(-1).alias("k"), F.concat(F.lit('{"url": "'), url, F.lit('", "desc": ')).alias("value"))
    good.unionByName(again).unionByName(broken).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "k").select("value").write.text(path)
    wanted = d.filter("doc_id % 3 <> 1").select(url.alias("url"))
    return scans.wanted_lines(spark, path, wanted, "url", "desc", 2000).select("url", F.length("desc").alias("n_chars"), F.md5("desc").alias("hash"))


def board_cards(spark: SparkSession, folder: str) -> DataFrame:
    """The links of pages as cards of a board, each behind a link of its company: titles, companies, pay and remoteness by what is around them."""
    card = '<a href="/company/$1-works">$2</a><h2 class="t"><a id="c" href="/job/$1">$2 &amp; more</a></h2><span>\\$90K - \\$120K Remote</span>'
    pages = table(spark, folder, "pages").select(F.lit("board").alias("instance"), F.col("page_id").alias("page"), F.regexp_replace("html", r'<li><a href="/(\w+)">([^<]*)</a></li>', card).alias("payload"))
    good, _ = markup.carded(pages)
    return good.select("page", F.col("n").cast("int").alias("n"), "title", F.lower("company").alias("company"), "url", "salary", "remote")


def structural_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Two nested responses of each event, walked to their leaves: each differing path with its kind, counted; a key that may be added is no difference."""
    e = table(spark, folder, "events")
    k, v = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    items = lambda shift, note: F.array(*[F.struct(F.concat(F.lit(f"u{j}"), F.lit("")).alias("url"), F.struct(F.struct((k + j * shift).alias("leaf"), note.alias("note")).alias("deep")).alias("body")) for j in (1, 2)])
    left = F.to_json(F.struct("event_type", v.alias("value"), F.struct(items(0, F.lit("x")).alias("items")).alias("box")))
    note = F.when(F.col("event_id") % 11 == 0, "y").otherwise("x")
    shift = F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    swapped = F.when(F.col("event_id") % 2 == 0, F.reverse(items(shift, note))).otherwise(items(shift, note))
    cut = F.when(F.col("event_id") % 13 == 0, F.slice(swapped, 1, 1)).otherwise(swapped)
    right = F.to_json(F.struct("event_type", F.when(F.col("event_id") % 7 == 0, v + 1).otherwise(v).alias("value"), F.struct(cut.alias("items")).alias("box"), F.lit(1).alias("added")))
    found = diffs.differences(e.select("event_id", left.alias("a"), right.alias("b")), "event_id", "a", "b", ["added"])
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"))


def score_history(spark: SparkSession, folder: str) -> DataFrame:
    """Score rows of customers after three passes, a pass a third of the orders, the input being the last order's status; inputs that come back revive their rows."""
    o = table(spark, folder, "orders")
    frame = spark.createDataFrame([], history.HISTORY)
    for step in range(3):
        planned = o.filter(F.col("o_orderkey") % 3 == step).groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("input"))
        key = F.col("o_custkey").cast("string")
        frame = history.merged(frame, planned.select(key.alias("entity"), F.lit("p").alias("profile"), F.lit("s").alias("scorer"), "input"), str(step)).history
    by = frame.select(F.col("row_id").alias("superseded_by"), F.col("input").alias("superseded_input"))
    return frame.join(by, "superseded_by", "left").select("entity", "input", "scored_at", "superseded_at", "superseded_input")


def light_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as postings: their last order is the version, scored or not; states by posting or by url; descriptions, other sources and new ones beside."""
    o, c, e, d = (table(spark, folder, n) for n in ("orders", "customer", "events", "documents"))
    text = lambda x: F.col(x).cast("string")
    none, key, user = F.lit(None), F.col("o_orderkey"), F.col("c_custkey")
    url = F.concat(F.lit("https://c.example/"), text("c_custkey"))
    versions = o.select(
        text("o_custkey").alias("posting"), text("o_orderkey").alias("version"), text("o_orderdate").alias("observed_at"), F.col("o_orderpriority").alias("title"), none.cast("string").alias("company"), none.cast("string").alias("location"),
        F.when(key % 3 == 0, "$100k - $120k").alias("salary"), none.cast("long").alias("salary_min"), none.cast("long").alias("salary_max"), none.cast("string").alias("posted"), none.cast("boolean").alias("remote"), F.concat(F.lit("n"), (key % 5).cast("string")).alias("source"),
        none.cast("string").alias("req_id"), none.cast("string").alias("first_seen"), none.cast("string").alias("also_seen_on"), F.when(key % 4 == 0, 4).alias("tier"), F.lit("own").alias("odds"), none.cast("int").alias("odds_score"), none.cast("string").alias("odds_why"),
        none.cast("string").alias("why"), F.lit("f").alias("flags"), none.cast("string").alias("desc_snippet"), F.to_json(F.struct(F.struct(F.lit("2024-02-02").alias("posted_date"), (key % 2).cast("string").alias("remote")).alias("canonical"))).alias("payload"),
    )
    scores = o.filter(key % 2 == 0).select(text("o_orderkey").alias("version"), (key % 5 + 1).cast("int").alias("tier"), F.lit("scored").alias("odds"), F.lit(1).alias("odds_score"), F.lit('{"why": "w", "flags": ["a", "b"]}').alias("rationale"), none.cast("string").alias("superseded_at"))
    states = c.filter(user % 3 == 0).select(F.concat(F.lit("k"), text("c_custkey")).alias("seen_key"), F.when(user % 2 == 0, text("c_custkey")).alias("posting"), url.alias("url"), F.col("c_mktsegment").alias("status"), *[none.cast("boolean" if n in ("starred", "hidden") else "string").alias(n) for n in projections.STATE[1:]])
    tables = projections.Tables(
        versions=versions, scores=scores, urls=c.select(text("c_custkey").alias("posting"), url.alias("url"), F.lit("1").alias("at")), states=states, new=c.filter(user % 7 == 0).select(text("c_custkey").alias("posting")),
        descriptions=d.select(text("doc_id").alias("posting"), F.col("text").alias("body"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("available").alias("fetch_status"), F.lit("1").alias("at")),
        postings=c.select(text("c_custkey").alias("posting"), F.lit("2024-01-01").alias("first_seen_at")), aliases=o.select(text("o_custkey").alias("posting"), F.concat(F.lit("n"), (key % 5).cast("string")).alias("namespace")),
        events=e.select(F.concat(F.lit("k"), text("user_id")).alias("seen_key"), F.when(F.col("event_type") == "view", "status").otherwise("notes").alias("field"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")),
    )
    out = projections.detail(tables, ["the", "zz", "der"])
    return out.select("posting", "url", "tier", "odds", "flags", "is_new", "title", "salary_min", "salary_max", "posted", "first_seen", "remote", "source", "also_seen_on", "has_desc", F.col("state.status").alias("status"), F.col("state.status_since").alias("status_since"), F.array_join("skill_hits", ",").alias("skill_hits"))


def verdict_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A review verdict a document, seven in eight of them spoiled in some way: why it is refused, and the tier after it."""
    d, i = table(spark, folder, "documents"), F.col("doc_id")
    why = F.when(i % 8 == 5, F.concat(F.lit("said: "), F.coalesce("text", F.lit("")))).otherwise("fits")
    tier = F.when(i % 8 == 1, i % 5 + 6).otherwise(i % 5 + 1)
    confidence = F.when(i % 8 == 7, "very").when(i % 3 == 0, "high").otherwise("low")
    parts = [tier.alias("tier"), confidence.alias("confidence"), why.alias("why")]
    whole = F.to_json(F.struct(*parts))
    raw = F.when(i % 8 == 2, F.concat(whole, F.lit(" thanks"))).when(i % 8 == 3, F.to_json(F.struct(*parts, F.lit(1).alias("note")))).when(i % 8 == 4, F.to_json(F.struct(*parts[1:]))).when(i % 8 != 6, whole)
    out = calibrate.verdicts(d.select("doc_id", raw.alias("raw")), "raw")
    before = (i % 4 + 1).cast("int")
    after = calibrate.applied(before, F.col("verdict"))
    return out.select("doc_id", "refused", before.alias("before"), after.alias("after"), calibrate.gated(after, i % 9 == 0).alias("shown"))


def calibrated_model(spark: SparkSession, folder: str) -> DataFrame:
    """A logistic model of orders that are closed on their first three features, and how much better than the base rate it is."""
    o, k = table(spark, folder, "orders"), F.col("o_orderkey")
    rows = o.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.pmod("o_custkey", F.lit(7)).alias("region"), F.when(k % 5 > 0, k % 3).alias("kind"), ((F.col("o_orderstatus") == "F") | (k % 3 == 1)).cast("int").alias("closed"))
    scales, weights, bias = calibrate.fit_logistic(rows, ["priority", "region", "kind"], "closed")
    p = sigmoid(calibrate.linear(scales, weights, bias))
    out = rows.dropna().agg(calibrate.brier(rows, p, "closed").alias("brier"), F.avg("closed").alias("base"))
    return out.select(F.round("brier", 6).alias("brier"), F.round(F.col("base") * (1 - F.col("base")), 6).alias("base_brier"), *[F.round(F.lit(weights[f]), 6).alias(f"w_{f}") for f in weights], F.round(F.lit(bias), 6).alias("bias"))


QUERIES = {f.__name__: f for f in (verdict_outcomes, calibrated_model, posting_scores, posting_replay, wanted_descriptions, board_cards, structural_diff, score_history, light_rows)}
SQL = {
    "verdict_outcomes": """
        WITH v AS (SELECT doc_id, doc_id % 4 + 1 AS b, doc_id % 5 + 1 AS t, doc_id % 3 = 0 AS high, CASE doc_id % 8 WHEN 1 THEN 'tier_range' WHEN 2 THEN 'not_json' WHEN 3 THEN 'unknown_keys' WHEN 4 THEN 'missing_keys' WHEN 6 THEN 'not_text' WHEN 7 THEN 'confidence_value'
            WHEN 5 THEN CASE WHEN length('said: ' || coalesce(text, '')) > 400 THEN 'why_length' END END AS refused FROM documents),
        a AS (SELECT *, CASE WHEN refused IS NOT NULL THEN b WHEN t < b OR high OR (b = 3 AND t = 4) THEN t ELSE b END AS a FROM v)
        SELECT doc_id, refused, b::INTEGER AS before, a::INTEGER AS after, CASE WHEN doc_id % 9 = 0 THEN 5 WHEN a = 5 THEN 4 ELSE a END::INTEGER AS shown FROM a""",
    "calibrated_model": """
        WITH RECURSIVE r AS (SELECT left(o_orderpriority, 1)::DOUBLE AS f, (o_custkey % 7)::DOUBLE AS g, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 END::DOUBLE AS h, (o_orderstatus = 'F' OR o_orderkey % 3 = 1)::INTEGER AS y FROM orders),
        m AS (SELECT avg(f) AS mf, stddev_pop(f) AS sf, avg(g) AS mg, stddev_pop(g) AS sg, avg(h) AS mh, stddev_pop(h) AS sh FROM r),
        x AS MATERIALIZED (SELECT (f - mf) / sf AS f, (g - mg) / sg AS g, (h - mh) / sh AS h, count(*) AS n, sum(y)::DOUBLE AS y FROM r, m WHERE f IS NOT NULL AND g IS NOT NULL AND h IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT sum(n)::DOUBLE AS n FROM x),
        w AS (SELECT 0 AS step, 0.0::DOUBLE AS b, 0.0::DOUBLE AS wf, 0.0::DOUBLE AS wg, 0.0::DOUBLE AS wh UNION ALL
            SELECT step + 1, any_value(b) - 0.5 * sum(e) / any_value(t.n), any_value(wf) - 0.5 * sum(e * f) / any_value(t.n), any_value(wg) - 0.5 * sum(e * g) / any_value(t.n), any_value(wh) - 0.5 * sum(e * h) / any_value(t.n)
            FROM (SELECT step, b, wf, wg, wh, f, g, h, x.n / (1 + exp(-(b + wf * f + wg * g + wh * h))) - x.y AS e FROM w, x WHERE step < 400), t GROUP BY step),
        l AS (SELECT * FROM w WHERE step = 400), p AS (SELECT x.n, x.y, 1 / (1 + exp(-(b + wf * f + wg * g + wh * h))) AS p FROM x, l), s AS (SELECT sum(y * (p - 1) ** 2 + (n - y) * p ** 2) / sum(n) AS brier, sum(y) / sum(n) AS base FROM p)
        SELECT round(brier, 6) AS brier, round(base * (1 - base), 6) AS base_brier, round(wf, 6) AS w_priority, round(wg, 6) AS w_region, round(wh, 6) AS w_kind, round(b, 6) AS bias FROM s, l""",
    "posting_replay": "SELECT count(*) AS n, 0::BIGINT AS tier_differs, 0::BIGINT AS wrong FROM documents",
    "wanted_descriptions": "SELECT 'https://d.example/' || doc_id AS url, length(left(coalesce(text, ''), 2000))::INTEGER AS n_chars, md5(left(coalesce(text, ''), 2000)) AS hash FROM documents WHERE doc_id % 3 <> 1",
    "board_cards": r"""
        WITH m AS (SELECT page_id AS page, regexp_extract_all(html, '<li><a href="/(\w+)">([^<]*)</a></li>', 1) AS s, regexp_extract_all(html, '<li><a href="/(\w+)">([^<]*)</a></li>', 2) AS t FROM pages),
        r AS (SELECT page, unnest(range(len(s)))::INTEGER AS n, s, t FROM m)
        SELECT page, n, t[n + 1] || ' & more' AS title, lower(s[n + 1]) || ' works' AS company, 'https://builtin.com/job/' || s[n + 1] AS url, '$90K - $120K' AS salary, true AS remote FROM r""",
    "light_rows": """
        WITH v AS (SELECT o_custkey AS c, arg_max(o_orderkey, (o_orderdate, CAST(o_orderkey AS VARCHAR))) AS k FROM orders GROUP BY 1), a AS (SELECT o_custkey AS c, list_sort(list_distinct(list('n' || (o_orderkey % 5)))) AS ns FROM orders GROUP BY 1),
        s AS (SELECT user_id AS c, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS since FROM events WHERE event_type = 'view' GROUP BY 1)
        SELECT CAST(v.c AS VARCHAR) AS posting, CASE WHEN c_custkey IS NOT NULL THEN 'https://c.example/' || v.c ELSE '' END AS url, CASE WHEN k % 2 = 0 THEN k % 5 + 1 WHEN k % 4 = 0 THEN 4 ELSE 0 END::INTEGER AS tier, CASE WHEN k % 2 = 0 THEN 'scored' ELSE 'own' END AS odds,
        CASE WHEN k % 2 = 0 THEN 'a, b' ELSE 'f' END AS flags, coalesce(c_custkey % 7 = 0, false) AS is_new, o_orderpriority AS title, CASE WHEN k % 3 = 0 THEN 100000 END::BIGINT AS salary_min, CASE WHEN k % 3 = 0 THEN 120000 END::BIGINT AS salary_max, '2024-02-02' AS posted,
        CASE WHEN c_custkey IS NOT NULL THEN '2024-01-01' END AS first_seen, k % 2 = 1 AS remote, 'n' || (k % 5) AS source, nullif(array_to_string(list_filter(ns, lambda n: n <> 'n' || (k % 5)), ', '), '') AS also_seen_on,
        coalesce(text <> '' AND doc_id % 4 <> 0, false) AS has_desc, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS status, CASE WHEN c_custkey % 3 = 0 THEN since END AS status_since,
        array_to_string(list_filter(['the', 'zz', 'der'], lambda w: contains(lower(coalesce(text, '')), w)), ',') AS skill_hits
        FROM v JOIN orders ON o_orderkey = k JOIN a ON a.c = v.c LEFT JOIN customer ON c_custkey = v.c LEFT JOIN documents ON doc_id = v.c LEFT JOIN s ON s.c = v.c""",
    "structural_diff": """
        WITH e AS (SELECT event_id AS i, event_id % 2 = 0 AS swapped, event_id % 13 = 0 AS cut FROM events), x AS (SELECT i, swapped, cut, unnest([1, 2]) AS j FROM e), y AS (SELECT *, NOT cut OR (j = CASE WHEN swapped THEN 2 ELSE 1 END) AS there FROM x),
        d AS (SELECT '$.value' AS path, 'value' AS kind FROM events WHERE event_id % 7 = 0 AND value IS NOT NULL UNION ALL SELECT '$.box.items', 'length' FROM e WHERE cut UNION ALL SELECT '$.box.items[url=u' || j || ']', 'missing' FROM y WHERE NOT there
            UNION ALL SELECT '$.box.items[url=u' || j || '].body.deep.leaf', 'value' FROM y WHERE there AND i % 5 = 0 UNION ALL SELECT '$.box.items[url=u' || j || '].body.deep.note', 'value' FROM y WHERE there AND i % 11 = 0)
        SELECT path, kind, count(*) AS n FROM d GROUP BY 1, 2""",
    "score_history": """
        WITH p AS (SELECT o_orderkey % 3 AS step, o_custkey, arg_max(o_orderstatus, o_orderkey) AS input FROM orders GROUP BY 1, 2), c AS (SELECT *, input IS DISTINCT FROM lag(input) OVER (PARTITION BY o_custkey ORDER BY step) AS moved FROM p),
        m AS (SELECT *, lead(step) OVER w AS next_step, lead(input) OVER w AS next_input FROM c WHERE moved WINDOW w AS (PARTITION BY o_custkey ORDER BY step))
        SELECT CAST(o_custkey AS VARCHAR) AS entity, input, CAST(min(step) AS VARCHAR) AS scored_at, CAST(arg_max(coalesce(next_step, -1), step) AS VARCHAR) AS superseded_at, arg_max(coalesce(next_input, '-'), step) AS superseded_input FROM m GROUP BY o_custkey, input""",
}
SQL["score_history"] = f"SELECT entity, input, scored_at, nullif(superseded_at, '-1') AS superseded_at, nullif(superseded_input, '-') AS superseded_input FROM ({SQL['score_history']})"
