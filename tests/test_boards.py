import json

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources import parsers

BRONZE = "source string, instance string, payload string"


def postings(spark, source, instance, payload):
    good, bad = parsers.parsed(spark.createDataFrame([(source, instance, payload if isinstance(payload, str) else json.dumps(payload))], BRONZE), source)
    return {x["native_id"]: x for x in good.collect()}, bad.count()


def test_positions_of_company_boards(spark):
    items = [
        {"id": 1, "displayJobId": "D1", "name": "One", "positionUrl": "/p/1", "standardizedLocations": ["Rome, IT", "Kent, WA, US", None, "Napa, CA"], "postedTs": 1704067199, "workLocationOption": "remote"},
        {"id": 2, "displayJobId": "", "name": "Two", "positionUrl": " https://elsewhere.example/2 ", "standardizedLocations": [], "locations": ["a", "b", "c"], "postedTs": "soon"},
        {"id": 3, "name": "Three", "locations": "only one", "workLocationOption": "Remote"},
        {"name": "no id", "positionUrl": "/x"}, {"id": 4, "name": ""}, {"id": 5, "name": None},
    ]
    got, bad = postings(spark, "eightfold", "https://b.example/", {"data": {"positions": items}})
    assert bad == 0 and set(got) == {"D1", "2", "3"}
    assert {n: (x["url"], x["location"], x["posted"], x["posted_raw"], x["remote"]) for n, x in got.items()} == {
        "D1": ("https://b.example/p/1", "Kent, WA, US; Napa, CA", "2023-12-31", "1704067199", True), "2": ("https://elsewhere.example/2", "a; b", None, "soon", False), "3": ("https://b.example/careers/job/3", "only one", None, "", False),
    }
    assert postings(spark, "eightfold", "i", {"data": {"positions": []}}) == ({}, 0)
    for broken in ("<html>", {"data": {}}, {"positions": []}):
        assert postings(spark, "eightfold", "i", broken) == ({}, 1)


def test_broad_boards_keep_wanted_titles_and_public_links(spark):
    items = [
        {"data": {"req_id": "r1", "slug": "s1", "title": "Systems Baker", "apply_url": "https://login.example/1", "full_location": "X, Y", "city": "no", "posted_date": "2024-01-02T03:04:05Z"}},
        {"slug": "s2", "title": "IT Clerk", "city": "Kent", "state": "", "posted_date": "", "create_date": "2024-02-02"},
        {"req_id": "r3", "title": "Data Entry", "apply_url": "", "canonical_url": "https://c.example/3"},
        {"req_id": "r4", "title": "Cashier"}, {"title": "Engineer"}, {"req_id": "r5", "title": "Summit"},
    ]
    got, bad = postings(spark, "jibe", "https://j.example", {"jobs": items})
    assert bad == 0 and set(got) == {"r1", "s2", "r3"}
    assert {n: (x["url"], x["location"], x["posted"]) for n, x in got.items()} == {"r1": ("https://j.example/jobs/s1", "X, Y", "2024-01-02"), "s2": ("https://j.example/jobs/s2", "Kent", "2024-02-02"), "r3": ("https://j.example/jobs/r3", "", None)}
    public, _ = postings(spark, "jibe-state", "https://j.example", {"jobs": items})
    assert {n: x["url"] for n, x in public.items()} == {"r1": "https://login.example/1", "s2": "https://j.example/jobs/s2", "r3": "https://c.example/3"}


def test_texts_are_unescaped_once(spark):
    import html
    import random
    import re

    r = random.Random(3)
    parts = ["&amp;", "&amp;lt;", "&nbsp;", "&#8217;", "&#x1F600;", "&#150;", "&notin;", "&copy", "&", "é", " ", " ", "\n\t", " x ", "&#0;", "&#xD800;", "&eacute;"]
    texts = [None, "", *("".join(r.choice(parts) for _ in range(12)) for _ in range(50))]
    want = [re.sub(r"\s+", " ", html.unescape(t or "").replace(" ", " ")).strip() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    assert [x["c"] for x in df.select("n", T.clean_text("t").alias("c")).orderBy("n").collect()] == want


def test_canonical_json(spark):
    cases = {'{"b": 1, "a": {"d": [1, 2.50, null], "c": "é\\u0041"}}': '{"a":{"c":"éA","d":[1,2.5,null]},"b":1}', " [3, 1] ": "[3,1]", '"x"': '"x"', "{": None, "": None, '{"a": 1} x': None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {x["t"]: x["c"] for x in df.select("t", T.canonical_json("t").alias("c")).collect()} == {**cases, None: None}
    row = spark.createDataFrame([(2, None, "x")], "b int, a string, c string")
    assert row.select(T.canonical_row("b", "a", "c").alias("c")).collect()[0]["c"] == '{"a":null,"b":2,"c":"x"}'
    objects = {'{"a": 1, "b": "x"}': {"a": "1", "b": "x"}, "[1]": {}, "": {}, "{": {}, None: {}, '{"a": null}': {"a": None}}
    df = spark.createDataFrame([(k,) for k in objects], "t string")
    assert {x["t"]: x["m"] for x in df.select("t", T.json_texts("t").alias("m")).collect()} == objects


def test_a_payload_is_parsed_once_and_a_filter_normalises_nothing(spark):
    bronze = spark.range(20).select(F.lit("greenhouse").alias("source"), F.lit("b").alias("instance"), F.concat(F.lit('{"jobs": [{"title": "'), F.col("id").cast("string"), F.lit('"}]}')).alias("payload"))
    good, bad = parsers.parsed(bronze, "greenhouse")
    for df in (good, bad):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1
        assert not any("Filter" in line and "regexp_" in line for line in plan.splitlines())
