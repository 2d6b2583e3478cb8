"""Postings from pages that are read by position: where a match stands, what precedes it, and what is around it.

The engine has no function for the places of matches. A text split at a pattern and
the matches of that pattern interleave, so their lengths add up to the places: a
page becomes a row a match with a running sum. What is around a match is cut from
the page then, which joins its matches once. What is only behind a match needs no
places: the pattern looks ahead and takes it along.

Pages are (instance, page, payload), ``page`` being unique. A page that is no page
of its kind goes to quarantine; items without a title or a url are dropped, and the
others of their page stay. Null payloads have no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ENTITIES, collapse, json_value, normalize_date

POSTINGS = ["instance", "page", "n", "title", "company", "location", "url", "req_id", "salary", "remote"]

# How these boards mark up jobs, companies, places and pay, and how far around a job its place or pay stands.
ANCHOR = r'(?s)<a[^>]+href="(https://[^"]+/jobs/(\d+)/[^"]+/job)[^"]*"[^>]*>(.*?)</a>'
PLACE = r"US-([A-Z]{2})-([A-Za-z .\-]+?)[<|&]"
PLACE_WITHIN = 900
CARD = r'<h2[^>]*><a[^>]+href="(/job/[^"]+)"[^>]*>([^<]+)</a>'
COMPANY = r'href="/company/([^"/]+)"'
PAY = r"\$([\d,]+)K?\s*[-–]\s*\$?([\d,]+)K?"
BEFORE, AFTER = 3000, 500
DATA_PAGE = r'data-page="([^"]*)"'
COMPANY_PATH = r"^/companies/([^/]+)/"
CARD_SITE, STARTUP_SITE, NO_COMPANY = "https://builtin.com", "https://www.ycombinator.com", "YC startup"


def found(pages: DataFrame, pattern: str, text: str = "payload", keep: tuple[str, ...] = ("instance", "page")) -> DataFrame:
    """(keep..., n, start, end, hit): each match of a pattern that is never empty, with its place in characters."""
    rows = pages.select(*keep, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("gap")).filter(F.size("hit") > 0)
    rows = rows.withColumn("gap", F.slice("gap", 1, F.size("hit"))).select(*keep, F.posexplode(F.arrays_zip("gap", "hit")).alias("n", "x"))
    by = Window.partitionBy(*keep).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("x.gap") + F.length("x.hit")).over(by)
    return rows.select(*keep, "n", (end - F.length("x.hit")).alias("start"), end.alias("end"), "x.hit")


def _around(matches: DataFrame, pages: DataFrame, start: Column, end: Column, name: str) -> DataFrame:
    """matches with the part of their page from ``start`` to ``end``."""
    low = F.greatest(start, F.lit(0))
    return matches.join(pages.select("instance", "page", "payload"), ["instance", "page"]).withColumn(name, F.substring(F.col("payload"), (low + 1).cast("int"), (end - low).cast("int"))).drop("payload")


def unescaped(c: Column) -> Column:
    """Text with its entities read; the ampersand comes last, so that nothing is read twice."""
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def titled(c: Column) -> Column:
    """Every run of letters with a capital and small letters behind it."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def anchored(pages: DataFrame, company: Column) -> DataFrame:
    """Boards of job anchors: the id is in the link, the place in the mark-up behind it. Anchors without text are no jobs."""
    # Looked ahead for, an anchor comes with what is behind it, and the next one is still found after its end.
    ahead = rf"(?=({ANCHOR}.{{0,{PLACE_WITHIN}}})){ANCHOR}"
    hits = pages.select("instance", "page", F.posexplode(F.regexp_extract_all("payload", F.lit(ahead), F.lit(1))).alias("n", "hit"))
    part = lambda g: F.regexp_extract("hit", ANCHOR, g)
    # In steps, each of which reads what the one before it computes more than once: the page around an anchor is searched for a place once.
    rows = hits.select("instance", "page", "n", part(1).alias("url"), part(2).alias("req_id"), part(3).alias("inner"), F.substring(F.col("hit"), F.length(part(0)) + 1, F.lit(PLACE_WITHIN)).alias("near"))
    rows = rows.withColumn("at", F.when(F.col("near").contains(PLACE.partition("(")[0]), F.regexp_extract("near", PLACE, 0)).otherwise(""))
    rows = rows.withColumn("city", F.trim(F.regexp_extract("at", PLACE, 2)))
    title = F.regexp_replace(collapse(F.regexp_replace("inner", "<[^>]+>", " ")), r"^Title\s+", "")
    place = F.when(F.col("city") != "", F.concat_ws(", ", "city", F.regexp_extract("at", PLACE, 1))).otherwise("")
    out = rows.select("instance", "page", "n", title.alias("title"), company.alias("company"), place.alias("location"), "url", "req_id", F.lit("").alias("salary"), F.lit(False).alias("remote"))
    return out.filter("title <> ''")


def carded(pages: DataFrame, location: str = "", remote: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantined pages) of boards of cards: the company is the nearest one linked before a card, pay and remoteness are in what is around it."""
    is_page = F.lower("payload").contains("<html")
    good = pages.filter(is_page)
    cards = found(good, CARD).withColumn("slug", F.lit(None).cast("string"))
    firms = found(good, COMPANY).withColumn("slug", F.regexp_extract("hit", COMPANY, 1))
    before = Window.partitionBy("instance", "page").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    owned = cards.unionByName(firms).withColumn("owner", F.last("slug", ignorenulls=True).over(before)).filter("slug IS NULL").drop("slug")
    hits = _around(owned, good, F.col("start") - BEFORE, F.col("start") + AFTER, "near")
    at = F.col("near").contains("Remote") & ~F.col("near").contains("Hybrid")
    out = hits.select(
        "instance", "page", "n", collapse(unescaped(F.regexp_extract("hit", CARD, 2))).alias("title"), titled(F.replace(F.coalesce("owner", F.lit("")), F.lit("-"), F.lit(" "))).alias("company"), F.lit(location).alias("location"),
        F.concat(F.lit(CARD_SITE), F.regexp_extract("hit", CARD, 1)).alias("url"), F.lit(None).cast("string").alias("req_id"), F.regexp_extract("near", PAY, 0).alias("salary"), (F.lit(remote) | at).alias("remote"),
    )
    return out.filter("title <> ''"), pages.filter(~F.coalesce(is_page, F.lit(False)))


def embedded(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, further paths, quarantined pages) of boards that carry their data, escaped, in an attribute."""
    text = lambda v, path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    rows = pages.withColumn("data", json_value(unescaped(F.regexp_extract(F.coalesce("payload", F.lit("")), DATA_PAGE, 1))))
    rows = rows.withColumn("jobs", F.try_variant_get("data", "$.props.jobPostings", "array<variant>"))
    site = lambda c: F.when(c.startswith("/"), F.concat(F.lit(STARTUP_SITE), c)).otherwise(c)
    items = rows.select("instance", "page", F.posexplode("jobs").alias("n", "j"))
    own, apply_ = F.trim(text(F.col("j"), "$.url")), F.trim(text(F.col("j"), "$.applyUrl"))
    slug = titled(F.replace(F.regexp_extract(text(F.col("j"), "$.url"), COMPANY_PATH, 1), F.lit("-"), F.lit(" ")))
    out = items.select(
        "instance", "page", "n", text(F.col("j"), "$.title").alias("title"), F.when(F.trim(slug) != "", F.trim(slug)).otherwise(NO_COMPANY).alias("company"), text(F.col("j"), "$.location").alias("location"),
        F.when(own != "", site(own)).otherwise(site(apply_)).alias("url"), F.nullif(text(F.col("j"), "$.id"), F.lit("")).alias("req_id"), F.lit("").alias("salary"), F.lower(text(F.col("j"), "$.location")).contains("remote").alias("remote"),
    )
    facets = lambda name, path: rows.select("instance", "page", F.explode(F.try_variant_get("data", f"$.props.{name}", "array<variant>")).alias("e")).select("instance", "page", F.trim(text(F.col("e"), "$.slug")).alias("slug")).filter("slug <> ''").select("instance", "page", F.concat(F.lit(path), "slug").alias("path"))
    paths = facets("jobRoles", "/jobs/role/").unionByName(facets("jobLocations", "/jobs/location/")).distinct()
    return out.filter("title <> '' AND url <> ''"), paths, rows.filter("jobs IS NULL").select(pages.columns)


def searched(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantined pages) of search results as arrays of flat rows; NaN is missing, a lone upper bound of pay is none."""
    data = json_value(F.regexp_replace("payload", r"(?<=[:\[,\s])(NaN|-?Infinity)(?=\s*[,}\]])", "null"))
    rows = pages.withColumn("rows", F.try_variant_get(data, "$", "array<variant>"))
    items = rows.select("instance", "page", F.posexplode("rows").alias("n", "r")).filter(F.schema_of_variant("r").startswith("OBJECT"))
    text = lambda name: F.coalesce(F.try_variant_get("r", f"$.{name}", "string"), F.lit(""))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("r", f"$.{name}", "variant"))
    amount = lambda name: F.when(kind(name) == "BOOLEAN", "").otherwise(F.regexp_replace(F.trim(text(name)), r"^(-?\d+)\.0+$", "$1"))
    low, high = amount("min_amount"), amount("max_amount")
    pay = F.when(low == "", "").otherwise(F.trim(F.concat_ws(" ", F.when((high != "") & (high != low), F.concat_ws("-", low, high)).otherwise(low), F.trim(text("interval")))))
    remote = F.when(kind("is_remote") == "STRING", F.lower(F.trim(text("is_remote"))).isin("1", "true", "yes", "y", "t")).otherwise(~text("is_remote").isin("", "false", "0"))
    posted = F.trim(text("date_posted"))
    out = items.select(
        "instance", "page", "n", F.trim(text("title")).alias("title"), text("company").alias("company"), text("location").alias("location"), F.trim(text("job_url")).alias("url"), F.lit(None).cast("string").alias("req_id"),
        pay.alias("salary"), remote.alias("remote"), normalize_date(posted).alias("posted"),
    )
    return out.filter("title <> '' AND url <> ''"), rows.filter("rows IS NULL").select(pages.columns)
