"""Pure payload parsers: a bronze table (source, instance, payload) becomes normalised postings.

Each source is a spec: the payload's schema, where its items are, and one Column
per posting field. Items without title or url are dropped; a payload that is no
JSON of the right shape goes to quarantine, so a broken source is seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ENTITIES, collapse, normalize_date, normalize_url, text_or_empty

FIELDS = ["source", "instance", "native_id", "title", "location", "url", "posted", "posted_raw", "remote", "salary"]

def _join(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), lambda p: p != ""), ", ")


def _day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


@dataclass
class Spec:
    item: str
    items: str
    title: Column
    url: Column
    native_id: Column = field(default_factory=lambda: F.col("j.id"))
    location: Column = field(default_factory=lambda: F.lit(""))
    posted: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    remote: Column = field(default_factory=lambda: F.lit(False))
    salary: Column = field(default_factory=lambda: F.lit(""))
    kept: Column = field(default_factory=lambda: F.lit(True))
    raw: Column | None = None  # the posting time as it stands, where ``posted`` is derived from it

    @property
    def schema(self) -> str:
        out = f"ARRAY<{self.item}>"
        for name in reversed(self.items.split(".") if self.items else []):
            out = f"STRUCT<{name}: {out}>"
        return out


# Words that a title of a broad board must have one of, and how the places that come first are marked.
BROAD_TITLES = ["engineer", "technician", "analyst", "program", "technolog", "systems", "support", "developer", "administrator", "network", "data", "security", "operations", "it "]
FIRST_PLACES = [", WA", ", CA"]


def _said(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _names(text: Column) -> Column:
    """A JSON list, or a bare text, as names that are not empty."""
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def _places(names: Column) -> Column:
    """Places of the preferred states, or the first two."""
    first = F.filter(names, lambda x: x.contains(FIRST_PLACES[0]) | x.contains(FIRST_PLACES[1]))
    return F.array_join(F.when(F.size(first) > 0, first).otherwise(F.slice(names, 1, 2)), "; ")


def _eightfold() -> Spec:
    """``instance`` is the address of the board, one for every company."""
    j, base = F.col("j"), F.rtrim(F.col("instance"), F.lit("/"))
    own = F.trim(j["positionUrl"])
    url = F.when(F.coalesce(own, F.lit("")) == "", F.concat(base, F.lit("/careers/job/"), j["id"])).when(own.rlike("^https?://"), own).otherwise(F.concat(base, F.lit("/"), F.ltrim(own, F.lit("/"))))
    places = F.when(F.size(_names(j["standardizedLocations"])) > 0, _names(j["standardizedLocations"])).otherwise(_names(j["locations"]))
    native, seconds = _said(j["displayJobId"], j["id"]), j["postedTs"].try_cast("long")
    item = "STRUCT<id: STRING, displayJobId: STRING, name: STRING, positionUrl: STRING, standardizedLocations: STRING, locations: STRING, postedTs: STRING, workLocationOption: STRING>"
    return Spec(item, "data.positions", j["name"], url, native_id=native, location=_places(places), posted=_day(seconds), raw=j["postedTs"], remote=j["workLocationOption"] == "remote", kept=native.isNotNull())


def _jibe(public_links: bool) -> Spec:
    """Boards of many kinds of jobs, items with or without a wrapper; links to apply are only taken where they are public pages."""
    fields = "req_id: STRING, slug: STRING, title: STRING, apply_url: STRING, canonical_url: STRING, full_location: STRING, city: STRING, state: STRING, posted_date: STRING, create_date: STRING"
    get = lambda name: F.when(F.col("j.data").isNotNull(), F.col(f"j.data.{name}")).otherwise(F.col(f"j.{name}"))
    native = _said(get("req_id"), get("slug"))
    page = F.concat(F.rtrim(F.col("instance"), F.lit("/")), F.lit("/jobs/"), _said(get("slug"), native))
    wanted = F.lower(get("title")).rlike("|".join(BROAD_TITLES))
    url = _said(get("apply_url"), get("canonical_url"), page) if public_links else page
    return Spec(f"STRUCT<data: STRUCT<{fields}>, {fields}>", "jobs", get("title"), url, native_id=native, location=_said(get("full_location"), _join(get("city"), get("state"))), posted=_said(get("posted_date"), get("create_date")), kept=native.isNotNull() & wanted)


def specs() -> dict[str, Spec]:
    J = F.col("j")  # an item
    return {
        "greenhouse": Spec("STRUCT<id: BIGINT, title: STRING, updated_at: STRING, first_published: STRING, location: STRUCT<name: STRING>, absolute_url: STRING>", "jobs", J["title"], J["absolute_url"], location=J["location"]["name"], posted=F.coalesce(J["first_published"], J["updated_at"])),
        "lever": Spec("STRUCT<id: STRING, text: STRING, categories: STRUCT<location: STRING>, hostedUrl: STRING, createdAt: BIGINT, workplaceType: STRING>", "", J["text"], J["hostedUrl"], location=J["categories"]["location"], posted=_day(J["createdAt"] / 1000), remote=F.lower(J["workplaceType"]) == "remote"),
        "ashby": Spec("STRUCT<id: STRING, title: STRING, location: STRING, jobUrl: STRING, publishedAt: STRING, isListed: BOOLEAN, isRemote: BOOLEAN, compensation: STRUCT<compensationTierSummaries: ARRAY<STRUCT<compensationTierSummary: STRING, title: STRING>>>>", "jobs", J["title"], J["jobUrl"], location=J["location"], posted=J["publishedAt"], remote=J["isRemote"], salary=F.get(J["compensation"]["compensationTierSummaries"], 0)["compensationTierSummary"]),
        "smartrecruiters": Spec("STRUCT<id: STRING, name: STRING, refNumber: STRING, releasedDate: STRING, location: STRUCT<city: STRING, region: STRING, country: STRING, remote: BOOLEAN>>", "content", J["name"], F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("instance"), F.lit("/"), J["id"]), location=_join(J["location"]["city"], J["location"]["region"], J["location"]["country"]), posted=J["releasedDate"], remote=J["location"]["remote"]),
        "workable": Spec("STRUCT<shortcode: STRING, title: STRING, url: STRING, city: STRING, state: STRING, country: STRING, telecommuting: BOOLEAN, published_on: STRING>", "jobs", J["title"], J["url"], native_id=J["shortcode"], location=F.coalesce(F.nullif(_join(J["city"], J["state"]), F.lit("")), J["country"]), posted=J["published_on"], remote=J["telecommuting"]),
        "recruitee": Spec("STRUCT<id: BIGINT, title: STRING, careers_url: STRING, location: STRING, published_at: STRING, remote: BOOLEAN>", "offers", J["title"], J["careers_url"], location=J["location"], posted=J["published_at"], remote=J["remote"]),
        "workday": Spec("STRUCT<title: STRING, externalPath: STRING, locationsText: STRING, postedOn: STRING, bulletFields: ARRAY<STRING>>", "jobPostings", J["title"], F.concat(F.lit("https://"), F.col("instance"), J["externalPath"]), native_id=F.coalesce(F.get(J["bulletFields"], 0), J["externalPath"]), location=J["locationsText"], posted=J["postedOn"]),
        "eightfold": _eightfold(),
        "amazon": Spec("STRUCT<id_icims: STRING, job_path: STRING, title: STRING, location: STRING, posted_date: STRING>", "jobs", J["title"], F.concat(F.lit("https://www.amazon.jobs"), J["job_path"]), native_id=F.coalesce(J["id_icims"], J["job_path"]), location=J["location"], posted=J["posted_date"]),
        "phenom": Spec("STRUCT<jobId: STRING, title: STRING, applyUrl: STRING, cityState: STRING, location: STRING, postedDate: STRING>", "jobs", J["title"], J["applyUrl"], native_id=J["jobId"], location=F.coalesce(J["cityState"], J["location"]), posted=J["postedDate"]),
        "jibe": _jibe(public_links=False),
        "jibe-state": _jibe(public_links=True),
        "manual": Spec("STRUCT<title: STRING, url: STRING, location: STRING, posted: STRING, source: STRING>", "", J["title"], J["url"], native_id=J["url"], location=J["location"], posted=J["posted"]),
    }


def parsed(bronze: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantine) of one source's payloads."""
    spec = specs()[source]
    rows, p = bronze.filter(F.col("source") == source), F.from_json("payload", spec.schema, {"mode": "PERMISSIVE"})
    items = p
    for name in spec.items.split(".") if spec.items else []:
        items = items[name]
    posted = F.coalesce(spec.posted.cast("string"), F.lit(""))
    raw = posted if spec.raw is None else F.coalesce(spec.raw, F.lit(""))
    # Exploded as an expression and filtered as it stands: a column that a filter also reads would be parsed, and normalised, again for it.
    wanted = F.coalesce(spec.kept, F.lit(False)) & text_or_empty(spec.title).rlike(r"\S") & (F.trim(text_or_empty(spec.url)) != "")
    out = rows.select("source", "instance", F.explode(items).alias("j")).filter(wanted).select(
        "source", "instance", spec.native_id.cast("string").alias("native_id"), collapse(spec.title).alias("title"), collapse(spec.location).alias("location"), normalize_url(spec.url).alias("url"),
        normalize_date(posted).alias("posted"), raw.alias("posted_raw"), F.coalesce(spec.remote, F.lit(False)).alias("remote"), collapse(spec.salary).alias("salary"),
    )
    return out, rows.filter(items.isNull()).select("source", "instance", "payload")


def ld_json_descriptions(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The description of the first JobPosting block of each page."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="?application/ld\+json"?[^>]*>(.*?)</script>'), F.lit(1))
    rows = pages.select(key, F.posexplode(blocks).alias("pos", "block")).filter(F.get_json_object("block", "$.@type") == "JobPosting")
    return rows.groupBy(key).agg(F.min_by(F.get_json_object("block", "$.description"), "pos").alias("description"))


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Link targets and texts of HTML pages, in order."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("pos", "a"))
    return rows.select(key, "pos", F.regexp_extract("a", r'(?i)href="([^"]*)"', 1).alias("href"), collapse(F.regexp_replace("a", "<[^>]+>", " ")).alias("label"))


def embedded_json(pages: DataFrame, key: str, html: str, attribute: str = "data-page") -> DataFrame:
    """The JSON that pages carry, escaped, in an attribute; pages without it are left out."""
    body = F.regexp_extract(html, f'{attribute}="([^"]*)"', 1)
    for name, char in ENTITIES.items():
        body = F.replace(body, F.lit(name), F.lit(char))
    return pages.select(key, body.alias("body")).filter("body <> ''")


def cards(pages: DataFrame, key: str, html: str, card: str, owner: str) -> DataFrame:
    """Links that match ``card`` with the nearest preceding link of their page that matches ``owner``, each target once."""
    links = anchors(pages, key, html)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = links.withColumn("owner", F.last(F.when(F.col("href").rlike(owner), F.col("href")), ignorenulls=True).over(before)).filter(F.col("href").rlike(card) & (F.col("label") != ""))
    return found.groupBy(key, "href").agg(F.min_by(F.struct("label", "owner"), "pos").alias("c")).select(key, "href", "c.label", "c.owner")


def parsed_lines(bronze: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined lines) of payloads of one JSON object a line; NaN and empty texts are missing."""
    lines = bronze.select("source", "instance", F.explode(F.split("payload", "\n")).alias("line")).filter("trim(line) <> ''")
    rows = lines.withColumn("j", F.from_json("line", item, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})).withColumn("ok", F.try_parse_json(F.regexp_replace("line", r"\bNaN\b", "null")).isNotNull())
    good = rows.filter("ok").select("source", "instance", "j.*")
    kinds = dict(good.dtypes)
    missing = {c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.nullif(F.trim(c), F.lit("")) for c in good.columns[2:] if kinds[c] in ("double", "float", "string")}
    return good.withColumns(missing), rows.filter("NOT ok").select("source", "instance", "line")


def searches(terms: list[str], places: list[str], per_term: int = 1) -> list[dict]:
    """The queries of a search source: each term in each place, page by page; repeated terms count once."""
    wanted = list(dict.fromkeys(t.strip() for t in terms if t.strip()))
    return [{"term": t, "place": p, "page": k} for t in wanted for p in places for k in range(per_term)]
