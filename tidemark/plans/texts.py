"""Scalar functions over the tables' urls, pages, texts and JSON, and over fixed fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.parsers import anchors, parsed
from ..sources.scratch import small_batches, written
from ..sources.tables import table


def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"))


def html_strip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("md5"), F.length(T.strip_html(F.col("html"))).alias("n"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the pages, counted by target."""
    return anchors(table(spark, folder, "pages"), "page_id", "html").groupBy("href").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))


def text_norm_tokens(spark: SparkSession, folder: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("md5"), F.md5(T.norm(F.col("text"))).alias("norm_md5"))


def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with entities between their lines, decoded once and collapsed."""
    raw = F.regexp_replace("text", "\n", "&amp;lt;&nbsp;\n&eacute;&#8217;&amp;")
    with small_batches(spark):
        return written(table(spark, folder, "documents").select("doc_id", F.md5(T.clean_text(raw)).alias("md5")), "clean-texts")


def canonical_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as canonical JSON: named fields sorted, nulls kept; and the fields of the events' JSON as texts."""
    d = table(spark, folder, "documents").select("doc_id", T.canonical_row("source", "lang", "n_chars", "doc_id").alias("json"))
    e = table(spark, folder, "events").select(F.col("event_id").alias("doc_id"), F.concat_ws("", T.json_texts(F.col("props"))["k"], T.canonical_json(F.concat(F.lit('{"z": [1.50, '), F.coalesce(F.to_json(F.struct("user_id")), F.lit("null")), F.lit('], "a": '), F.coalesce("props", F.lit("null")), F.lit("}")))).alias("json"))
    return d.unionByName(e)


def json_props_extract(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select("event_id", k.alias("k"), T.whole_number(k).alias("k_number"), F.get_json_object("props", "$.absent").alias("absent"))


def keys_and_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Row keys, name-based UUIDs and content hashes of the urls."""
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", T.url_key(url).alias("key"), F.sha2(url, 256).alias("sha"), F.substring_index(url, "/", -1).alias("last_part"), F.substring(url, 1, 20).alias("snippet"))


def uuid5_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", T.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("url")).alias("uuid"))


def freshness_buckets(spark: SparkSession, folder: str) -> DataFrame:
    age = F.datediff(F.lit("1998-06-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, folder, "orders").groupBy(T.freshness(age).alias("bucket")).agg(F.count("*").alias("n"))


def term_highlight(spark: SparkSession, folder: str) -> DataFrame:
    marked = T.highlighted(F.col("p_name"), ["ring", " widget", "ring", "red"])
    return table(spark, folder, "part").select("p_partkey", marked.alias("marked"), T.safe_cell(F.concat(F.when(F.col("p_size") % 2 == 0, "=").otherwise(""), "p_name")).alias("cell"))


def flags_exploded(spark: SparkSession, folder: str) -> DataFrame:
    joined = F.concat_ws(" , ", F.lit(""), "p_brand", F.lit(" "), "p_type", F.lit(""))
    return table(spark, folder, "part").select(F.explode(T.flag_list(joined)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def amounts_shown(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", T.money(F.floor("o_totalprice")).alias("shown"))


def status_classes(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.array(*map(F.lit, (200, 204, 301, 404, 408, 425, 429, 500, 503)))
    return table(spark, folder, "events").select(F.get(codes, (F.col("event_id") % 9).cast("int")).alias("status")).groupBy(T.http_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


def mixed_grain_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Events on or after a mark of either grain: a bare date or an instant."""
    at = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    since = F.when(F.col("event_id") % 3 == 0, "2024-01-15").otherwise("2024-01-15T12:00:00")
    return table(spark, folder, "events").agg(F.count_if(T.on_or_after(at, since)).alias("n"), F.count("*").alias("total"))


def page_search(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets of documents that hold a wanted word, cleaned and cut."""
    d = table(spark, folder, "documents")
    return d.filter(F.lower("text").contains("license")).select("doc_id", F.substring(T.sanitized(F.col("text")), 1, 80).alias("snippet"), F.length(T.sanitized(F.col("text"))).alias("n"))


FIXTURE = [
    ("28-50 hourly", "serving our clients for 30 years. 3+ years of repair experience required.", "Amazon.com", "Posted 30+ Days Ago", "2024-02-31T10:00"),
    ("$40 - $45 per hour", "4+ years of experience required. 9+ years preferred.", "The Boeing Company", "Posted Today", "2024-13-01"),
    ("90-110k annually", "shares vest over a period of 4 years", "Acme Holdings, Inc.", "2024-01-05", "yesterday"),
    ("401(k) plan and $70,000-$88,000", "pay rate is $40 - $45 per hour, 3 years experience", "CRUSOE", "", "1969-12-31"),
    (None, None, None, None, None),
]


def scalar_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Money, years, companies, ages and dates of a small fixture of hard texts."""
    rows = spark.createDataFrame(FIXTURE, "salary string, body string, company string, posted string, day string")
    s, y, d = T.salary_range(F.col("salary")), T.years_required(F.col("body")), T.salary_in_description(F.col("body"))
    return rows.select("salary", s["lo"].alias("lo"), s["hi"].alias("hi"), y["required"].alias("required"), y["preferred"].alias("preferred"), d["lo"].alias("body_lo"), T.canonical_company(F.col("company")).alias("company"), T.posting_age_days(F.col("posted"), F.lit("2024-02-01").cast("date")).alias("age"), T.normalize_date(F.col("day")).alias("day"))


def board_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as a board's payload of a day and parsed back into postings."""
    items = F.struct(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.lit(" "), "user_id").alias("title"), F.struct(F.lit("Remote - US").alias("name")).alias("location"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("first_published"), F.concat(F.lit("https://boards.example.com/jobs/"), "event_id", F.lit("?gh_src=x")).alias("absolute_url"))
    day = table(spark, folder, "events").groupBy(F.to_date("ts").alias("d")).agg(F.to_json(F.struct(F.collect_list(items).alias("jobs"))).alias("payload"))
    good, _ = parsed(day.select(F.lit("greenhouse").alias("source"), F.lit("board").alias("instance"), "payload"), "greenhouse")
    return good.select("native_id", "title", "location", "url", "posted")


QUERIES = {
    f.__name__: f
    for f in (
        clean_texts, canonical_documents, url_normalize, html_strip, page_links, text_norm_tokens, json_props_extract, keys_and_hashes, uuid5_ids, freshness_buckets, term_highlight, flags_exploded, amounts_shown, status_classes,
        mixed_grain_compare, page_search, scalar_fixtures, board_payloads,
    )
}

_DROPPED = "('gclid', 'fbclid', 'mc_cid', 'mc_eid', 'gh_src', 'igshid', '_ga', '_gl', 'trk', 'trackingid', 'ref_src')"
_PLAIN = "html"
for _ in range(2):
    for _name, _char in T.ENTITIES.items():
        _PLAIN = f"replace({_PLAIN}, '{_name}', {chr(39)}{_char.replace(chr(39), chr(39) * 2)}{chr(39)})"
_PLAIN = f"trim(regexp_replace(regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g'), '[\\s ]+', ' ', 'g'))"
_SANE = "replace(replace(text, '<<<JOB_DESCRIPTION_DATA', ' '), 'JOB_DESCRIPTION_DATA>>>', ' ')"
for _from, _to in (("[\\x00-\\x08\\x0b-\\x1f\\x7f\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x{feff}]", "' '"), ("[ \\t]+", "' '"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\s+|\\s+$", "''")):
    _SANE = f"regexp_replace({_SANE}, '{_from}', {_to}, 'g')"

SQL = {
    "clean_texts": r"SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(10), '&lt; ' || chr(10) || 'é’&'), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'), ' ')) AS md5 FROM documents",
    "canonical_documents": """
        SELECT doc_id, json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source)::VARCHAR AS json FROM documents
        UNION ALL SELECT event_id, coalesce(props ->> '$.k', '') || '{"a":' || coalesce(replace(props, ' ', ''), 'null') || ',"z":[1.5,{' || coalesce('"user_id":' || user_id, '') || '}]}' FROM events""",
    "url_normalize": f"""
        WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) AS base, rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS path,
                   list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN {_DROPPED} AND NOT starts_with(lower(x), 'utm_'))) AS q FROM pages)
        SELECT page_id, base || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM p""",
    "html_strip": f"SELECT page_id, md5({_PLAIN}) AS md5, length({_PLAIN}) AS n FROM pages",
    "page_links": r"""
        WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1), 1) - 1 AS pos FROM pages)
        SELECT href, count(*) AS n, min(pos) AS first_pos FROM a GROUP BY 1""",
    "text_norm_tokens": """
        WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)
        SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, md5(coalesce(array_to_string(t, ' '), '')) AS md5, md5(trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' ')) AS norm_md5 FROM t""",
    "json_props_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS BIGINT) AS k_number, json_extract_string(props, '$.absent') AS absent FROM events",
    "keys_and_hashes": "SELECT page_id, rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') AS key, sha256(url) AS sha, string_split(url, '/')[-1] AS last_part, left(url, 20) AS snippet FROM pages",
    "freshness_buckets": "WITH a AS (SELECT greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01')) AS d FROM orders) SELECT CASE WHEN d <= 14 THEN 'fresh' WHEN d <= 45 THEN 'aging' ELSE 'stale' END AS bucket, count(*) AS n FROM a GROUP BY 1",
    "term_highlight": r"SELECT p_partkey, regexp_replace(p_name, '(?i)(widget|ring|red)', '<mark>\1</mark>', 'g') AS marked, CASE WHEN p_size % 2 = 0 THEN '''=' ELSE '' END || p_name AS cell FROM part",
    "flags_exploded": "SELECT flag, count(*) AS n FROM (SELECT p_brand AS flag FROM part UNION ALL SELECT p_type FROM part) GROUP BY 1",
    "amounts_shown": "SELECT o_orderkey, CASE WHEN floor(o_totalprice) >= 1000 THEN '$' || CAST(round(floor(o_totalprice) / 1000) AS BIGINT) || 'k' ELSE '$' || CAST(floor(o_totalprice) AS BIGINT) END AS shown FROM orders",
    "status_classes": "WITH s AS (SELECT [200, 204, 301, 404, 408, 425, 429, 500, 503][event_id % 9 + 1] AS s FROM events) SELECT CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s IN (408, 425, 429) OR s >= 500 THEN 'transient' ELSE 'permanent' END AS class, count(*) AS n FROM s GROUP BY 1",
    "mixed_grain_compare": """
        SELECT count(*) FILTER (CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN CAST(ts AS DATE) >= DATE '2024-01-15' ELSE date_trunc('second', ts) >= TIMESTAMP '2024-01-15 12:00:00' END) AS n, count(*) AS total FROM events""",
    "page_search": f"""
        WITH s AS (SELECT doc_id, {_SANE} AS t FROM documents WHERE contains(lower(text), 'license')), c AS (SELECT doc_id, CASE WHEN length(t) > 6000 THEN rtrim(left(t, 6000), ' ' || chr(10) || chr(9)) || chr(10) || '[description truncated]' ELSE t END AS t FROM s)
        SELECT doc_id, left(t, 80) AS snippet, length(t) AS n FROM c""",
    # by the rules of the functions: 2,080 hours a year, k for thousands, 401(k) no money; company age and dates as written
    "scalar_fixtures": """
        SELECT * FROM (VALUES ('28-50 hourly', 58240, 104000, 3, NULL, NULL, 'amazon', 30, '2024-02-31'), ('$40 - $45 per hour', 83200, 93600, 4, 9, NULL, 'boeing', 0, NULL), ('90-110k annually', 90000, 110000, NULL, NULL, NULL, 'acme', 27, NULL),
        ('401(k) plan and $70,000-$88,000', 70000, 88000, 3, NULL, 83200, 'crusoe', NULL, NULL), (NULL, NULL, NULL, NULL, NULL, NULL, '', NULL, NULL)) t(salary, lo, hi, required, preferred, body_lo, company, age, day)""",
    "board_payloads": "SELECT CAST(event_id AS VARCHAR) AS native_id, event_type || ' ' || user_id AS title, 'Remote - US' AS location, 'https://boards.example.com/jobs/' || event_id AS url, strftime(ts, '%Y-%m-%d') AS posted FROM events",
}
