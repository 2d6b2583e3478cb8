"""Payloads of every kind of source, written from orders and parsed back into postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import markup
from ..sources.parsers import parsed, specs
from ..sources.scratch import written
from ..sources.tables import table

_BASE = "https://b.example"


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page, items): fifty orders a page by their keys, each with k, title, place, day and far (remoteness)."""
    k, o = F.col("o_orderkey"), table(spark, folder, "orders")
    item = F.struct(k.alias("k"), F.concat("o_orderpriority", F.when(k % 3 == 0, " Engineer").otherwise("")).alias("title"), F.col("o_orderstatus").alias("place"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (k % 2 == 0).alias("far"))
    return o.groupBy(F.floor(k / 50).alias("page")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def _seconds(day: Column) -> Column:
    return F.unix_timestamp(F.concat(day, F.lit(" 12:00:00 +0000")), "yyyy-MM-dd HH:mm:ss Z")


def _shapes() -> dict:
    """How each source writes an item."""
    link = lambda x: F.concat(F.lit("https://g.example/"), x["k"].cast("string"))
    text = lambda x: x["k"].cast("string")
    path = lambda x: F.concat(F.lit("/job/"), text(x))
    named = lambda **fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    jibe = lambda x: named(req_id=F.when(x["k"] % 5 > 0, text(x)).otherwise(""), slug=F.concat(F.lit("s"), text(x)), title=x["title"], apply_url=F.when(x["k"] % 4 > 0, link(x)), city=x["place"], state=F.lit("TX"), create_date=x["day"])
    return {
        "greenhouse": lambda x: named(id=x["k"], title=x["title"], first_published=x["day"], location=named(name=x["place"]), absolute_url=link(x)),
        "lever": lambda x: named(id=text(x), text=x["title"], categories=named(location=x["place"]), hostedUrl=link(x), createdAt=_seconds(x["day"]) * 1000, workplaceType=F.when(x["far"], "Remote").otherwise("onsite")),
        "ashby": lambda x: named(id=text(x), title=x["title"], location=x["place"], jobUrl=link(x), publishedAt=x["day"], isRemote=x["far"]),
        "smartrecruiters": lambda x: named(id=text(x), name=x["title"], releasedDate=x["day"], location=named(city=x["place"], country=F.lit("us"), remote=x["far"])),
        "workable": lambda x: named(shortcode=text(x), title=x["title"], url=link(x), city=x["place"], state=F.lit("TX"), telecommuting=x["far"], published_on=x["day"]),
        "recruitee": lambda x: named(id=x["k"], title=x["title"], careers_url=link(x), location=x["place"], published_at=x["day"], remote=x["far"]),
        "workday": lambda x: named(title=x["title"], externalPath=path(x), locationsText=x["place"], postedOn=x["day"], bulletFields=F.array(text(x))),
        "eightfold": lambda x: named(id=x["k"], name=x["title"], positionUrl=F.when(x["k"] % 4 > 0, path(x)), locations=F.array(x["place"], F.lit("b"), F.lit("c")), postedTs=_seconds(x["day"]), workLocationOption=F.when(x["far"], "remote")),
        "amazon": lambda x: named(id_icims=text(x), job_path=path(x), title=x["title"], location=x["place"], posted_date=x["day"]),
        "phenom": lambda x: named(jobId=text(x), title=x["title"], applyUrl=link(x), cityState=x["place"], postedDate=x["day"]),
        "jibe": lambda x: named(data=jibe(x)),
        "jibe-state": jibe,
        "manual": lambda x: named(title=x["title"], url=link(x), location=x["place"], posted=x["day"]),
    }


def feed_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as the payloads of each source, parsed back; every tenth page is broken and goes to quarantine."""
    pages, shapes, known = written(_pages(spark, folder), "pages"), _shapes(), specs()
    found = []
    for source, shape in shapes.items():
        body = F.transform("items", shape)
        for name in reversed(known[source].items.split(".") if known[source].items else []):
            body = F.struct(body.alias(name))
        payload = F.when(F.col("page") % 10 == 9, F.lit("<html>")).otherwise(F.to_json(body))
        good, bad = parsed(pages.select(F.lit(source).alias("source"), F.lit("b.example" if source == "workday" else _BASE if source in ("eightfold", "jibe", "jibe-state") else "b").alias("instance"), payload.alias("payload")), source)
        found += [good.select("source", "native_id", "title", "location", "url", "posted", "remote", F.lit("posting").alias("kind")), bad.groupBy("source").agg(F.count("*").cast("string").alias("native_id")).select("source", "native_id", *[F.lit("").alias(c) for c in ("title", "location", "url", "posted")], F.lit(False).alias("remote"), F.lit("quarantine").alias("kind"))]
    return reduce(DataFrame.unionByName, found)


def startup_boards(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pages that carry their jobs, escaped, in an attribute."""
    job = lambda x: F.struct(F.when(x["k"] % 3 > 0, F.concat(F.lit("/companies/acme-"), x["place"], F.lit("/jobs/"), x["k"].cast("string"))).alias("url"), F.concat(F.lit("/apply/"), x["k"].cast("string")).alias("applyUrl"), F.concat(x["title"], F.lit(' & "more"')).alias("title"), F.when(x["far"], "Remote, US").otherwise(x["place"]).alias("location"), x["k"].alias("id"))
    data = F.to_json(F.struct(F.struct(F.transform("items", job).alias("jobPostings")).alias("props")))
    for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        data = F.replace(data, F.lit(char), F.lit(entity))
    good, _, _ = markup.embedded(_pages(spark, folder).select(F.lit("jobs").alias("instance"), "page", F.concat(F.lit('<html><div id="a" data-page="'), data, F.lit('">')).alias("payload")))
    return good.select("page", F.col("n").cast("int").alias("n"), "title", "company", "location", "url", "req_id", "remote")


def search_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as rows of a search with missing numbers: pay as a range, one amount or none, remoteness as a word or a flag."""
    k = lambda x: x["k"].cast("string")
    row = lambda x: F.concat(F.lit('{"title": "'), x["title"], F.lit('", "job_url": "https://s.example/'), k(x), F.lit('", "min_amount": '), F.when(x["k"] % 4 == 0, "NaN").otherwise(F.concat(k(x), F.lit(".0"))), F.lit(', "max_amount": '), F.when(x["k"] % 3 == 0, "NaN").when(x["k"] % 3 == 1, k(x)).otherwise("900000"), F.lit(', "interval": "yearly", "is_remote": '), F.when(x["k"] % 5 == 0, "NaN").when(x["far"], "true").otherwise('"No"'), F.lit(', "date_posted": "'), x["day"], F.lit('"}'))
    good, _ = markup.searched(_pages(spark, folder).select(F.lit("search").alias("instance"), "page", F.concat(F.lit("["), F.array_join(F.transform("items", row), ", "), F.lit("]")).alias("payload")))
    return good.select("page", F.col("n").cast("int").alias("n"), "title", "url", "salary", "remote", "posted")


def career_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as anchors of a careers page, the place of every second one in the mark-up behind it."""
    one = lambda x: F.concat(F.lit('<li><a class="c" href="https://i.example/jobs/'), x["k"].cast("string"), F.lit('/some-name/job?in=1"><span>Title </span>'), x["title"], F.lit("</a>"), F.when(x["far"], F.concat(F.lit("<b>US-CA-San "), x["place"], F.lit("<"))).otherwise(""), F.repeat(F.lit("."), F.lit(1000)))
    out = markup.anchored(_pages(spark, folder).select(F.lit("careers").alias("instance"), "page", F.array_join(F.transform("items", one), "").alias("payload")), F.lit("Acme"))
    return out.select("page", F.col("n").cast("int").alias("n"), "title", "company", "location", "url", "req_id")


_ITEMS = "SELECT o_orderkey AS k, o_orderkey // 50 AS page, (row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1)::INTEGER AS n, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' Engineer' ELSE '' END AS title, o_orderstatus AS place, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 2 = 0 AS far FROM orders"
_LINK, _JOB = "'https://g.example/' || k", f"'{_BASE}/job/' || k"
_SLUG = f"'{_BASE}/jobs/s' || k"


def _as(source: str, url: str = _LINK, native: str = "'' || k", place: str = "place", remote: str = "far", where: str = "true") -> str:
    return f"SELECT '{source}' AS source, {native} AS native_id, title, {place} AS location, {url} AS url, day AS posted, {remote} AS remote, 'posting' AS kind FROM i WHERE page % 10 <> 9 AND {where} UNION ALL SELECT '{source}', '' || count(DISTINCT page), '', '', '', '', false, 'quarantine' FROM i WHERE page % 10 = 9 HAVING count(*) > 0"


_JIBE = {"native": "CASE WHEN k % 5 > 0 THEN '' ELSE 's' END || k", "place": "place || ', TX'", "remote": "false", "where": "k % 3 = 0"}
_SOURCES = [
    _as("greenhouse", remote="false"), _as("lever"), _as("ashby"), _as("smartrecruiters", "'https://jobs.smartrecruiters.com/b/' || k", place="place || ', us'"), _as("workable", place="place || ', TX'"), _as("recruitee"), _as("workday", _JOB, remote="false"),
    _as("eightfold", f"CASE WHEN k % 4 > 0 THEN {_JOB} ELSE '{_BASE}/careers/job/' || k END", place="place || '; b'"), _as("amazon", "'https://www.amazon.jobs/job/' || k", remote="false"), _as("phenom", remote="false"),
    _as("jibe", _SLUG, **_JIBE), _as("jibe-state", f"CASE WHEN k % 4 > 0 THEN {_LINK} ELSE {_SLUG} END", **_JIBE), _as("manual", native=_LINK, remote="false"),
]

QUERIES = {f.__name__: f for f in (feed_postings, startup_boards, search_rows, career_anchors)}
SQL = {
    "feed_postings": f"WITH i AS ({_ITEMS}) " + " UNION ALL ".join(_SOURCES),
    "startup_boards": f"""WITH i AS ({_ITEMS}) SELECT page, n, title || ' & "more"' AS title, CASE WHEN k % 3 > 0 THEN 'Acme ' || place ELSE 'YC startup' END AS company, CASE WHEN far THEN 'Remote, US' ELSE place END AS location,
        'https://www.ycombinator.com' || CASE WHEN k % 3 > 0 THEN '/companies/acme-' || place || '/jobs/' || k ELSE '/apply/' || k END AS url, '' || k AS req_id, far AS remote FROM i""",
    "search_rows": f"""WITH i AS ({_ITEMS}) SELECT page, n, title, 'https://s.example/' || k AS url, CASE WHEN k % 4 = 0 THEN '' ELSE k || CASE WHEN k % 3 = 2 AND k <> 900000 THEN '-900000' ELSE '' END || ' yearly' END AS salary, k % 5 > 0 AND far AS remote, day AS posted FROM i""",
    "career_anchors": f"""WITH i AS ({_ITEMS}) SELECT page, n, title, 'Acme' AS company, CASE WHEN far THEN 'San ' || place || ', CA' ELSE '' END AS location, 'https://i.example/jobs/' || k || '/some-name/job' AS url, '' || k AS req_id FROM i""",
}
