"""Positional parsers against Python's match objects on random pages, and boards with embedded or flat data."""

import html
import json
import random
import re

from pyspark.sql import functions as F

from tidemark.sources import markup

PAGES = "instance string, page long, payload string"
TEXT = ["<div>", "</div>", "é", "\n", " some text ", "US-CA-San Jose<", "US-NY-New York|", "US-TX- <", "$120K - $150K", "$90,000–$95,000", "Remote", "Hybrid", "<b>", "&amp;", "x" * 700]


def job(r, k):
    inner = r.choice(['<span class="hidden">Title </span> Engineer {}', "<i></i>", "  Support\n {} ", "<b>Lead</b> {}"]).format(k)
    return f'<a class="c" href="https://b.example/jobs/{k}/name-{k}/job?in=1" id="j">{inner}</a>'


def card(r, k):
    return r.choice([f'<h2 class="t"><a id="x" href="/job/{k}" data-k="1">Engineer &amp; {k}</a></h2>', f'<h2><a href="/job/{k}">  </a>', f'<a href="/company/acme-{k % 3}d-works"><img></a>', '<a href="/company/b/other">'])


def pages_of(r, make, n=60):
    return [("i", p, "<html>" + "".join(r.choice([make(r, k), r.choice(TEXT), r.choice(TEXT)]) for k in range(r.randint(0, 25)))) for p in range(n)]


def test_places_of_matches(spark):
    rows = pages_of(random.Random(1), card) + [("i", 1000, None), ("i", 1001, "")]
    got = markup.found(spark.createDataFrame(rows, PAGES).repartition(4), markup.COMPANY).collect()
    want = [(p, n, m.start(), m.end(), m.group()) for _, p, t in rows for n, m in enumerate(re.finditer(markup.COMPANY, t or ""))]
    assert sorted((x["page"], x["n"], x["start"], x["end"], x["hit"]) for x in got) == want and len(want) > 50


def test_anchored_boards(spark):
    rows, want = pages_of(random.Random(2), job), []
    for _, p, t in rows:
        for n, m in enumerate(re.finditer(markup.ANCHOR.removeprefix("(?s)"), t, re.S)):
            title = re.sub(r"^Title\s+", "", re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", m.group(3))).strip())
            place = re.search(markup.PLACE, t[m.end() : m.end() + markup.PLACE_WITHIN])
            city = place.group(2).strip() if place else ""
            if title:
                want.append((p, n, title, "Co", f"{city}, {place.group(1)}" if city else "", m.group(1), m.group(2)))
    got = markup.anchored(spark.createDataFrame(rows, PAGES), F.lit("Co"))
    assert got.columns == markup.POSTINGS
    assert sorted(tuple(x)[1:8] for x in got.collect()) == want and len({w[4] for w in want}) >= 3


def test_anchored_boards_neither_join_nor_exchange_pages(spark):
    plan = markup.anchored(spark.createDataFrame(pages_of(random.Random(4), job), PAGES), F.lit("Co"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_places_are_found_up_to_a_number_of_characters_behind_an_anchor(spark):
    anchor = job(random.Random(5), 7)
    gaps = [0, 1, markup.PLACE_WITHIN - 12, markup.PLACE_WITHIN - 11, markup.PLACE_WITHIN - 10, markup.PLACE_WITHIN]
    rows = [("i", p, "\n" + anchor + fill * gap + "US-CA-Rome |" + anchor) for p, (fill, gap) in enumerate((f, g) for f in ("x", "\n", "é", "\U0001f600") for g in gaps)]
    want = [(p, 0, bool(re.search(markup.PLACE, t[t.index("</a>") + 4 :][: markup.PLACE_WITHIN]))) for _, p, t in rows] + [(p, 1, False) for _, p, _ in rows]
    got = markup.anchored(spark.createDataFrame(rows, PAGES), F.lit("Co"))
    assert sorted((x["page"], x["n"], x["location"] == "Rome, CA") for x in got.collect()) == sorted(want)
    assert {w[2] for w in want if w[1] == 0} == {True, False}


def test_carded_boards(spark):
    rows, want = pages_of(random.Random(3), card), []
    for _, p, t in rows:
        firms = [(m.start(), m.group(1)) for m in re.finditer(markup.COMPANY, t)]
        for n, m in enumerate(re.finditer(markup.CARD, t)):
            title = re.sub(r"\s+", " ", html.unescape(m.group(2))).strip()
            owner = next((s for at, s in reversed(firms) if at < m.start()), "")
            near = t[max(0, m.start() - markup.BEFORE) : m.start() + markup.AFTER]
            pay = re.search(markup.PAY, near)
            if title:
                want.append((p, n, title, owner.replace("-", " ").title(), "SF", "https://builtin.com" + m.group(1), None, pay.group() if pay else "", "Remote" in near and "Hybrid" not in near))
    bad = [("i", 500, "no page"), ("i", 501, None)]
    good, quarantine = markup.carded(spark.createDataFrame(rows + bad, PAGES), "SF")
    assert sorted(tuple(x)[1:] for x in good.collect()) == want
    assert {w[8] for w in want} == {True, False} and len({w[7] for w in want}) == 3 and "Acme 2D Works" in {w[3] for w in want}
    assert sorted(x["page"] for x in quarantine.collect()) == [500, 501]
    assert all(x["remote"] for x in markup.carded(spark.createDataFrame(rows, PAGES), "SF", True)[0].collect())


def test_embedded_boards(spark):
    jobs = [{"id": 7, "title": "A & B", "url": "/companies/foo-bar/jobs/7", "applyUrl": "https://x.example", "location": "Remote (US)"}, {"title": "C", "url": "", "applyUrl": " /apply "}, {"title": "", "url": "/x"}, {"title": "no url"}, {"id": None, "title": "D", "url": "https://y.example"}, 5]
    page = lambda data: f"<div data-page=\"{html.escape(json.dumps(data))}\">"
    rows = [("i", 1, page({"props": {"jobPostings": jobs, "jobRoles": [{"slug": "ops"}, {"slug": " "}, 3], "jobLocations": [{"slug": "rome"}]}})), ("i", 2, page({"props": {"jobPostings": {}}})), ("i", 3, '<div data-page="{">'), ("i", 4, "none"), ("i", 5, None)]
    good, paths, bad = markup.embedded(spark.createDataFrame(rows, PAGES))
    assert sorted(tuple(x)[3:] for x in good.collect()) == [
        ("A & B", "Foo Bar", "Remote (US)", "https://www.ycombinator.com/companies/foo-bar/jobs/7", "7", "", True), ("C", "YC startup", "", "https://www.ycombinator.com/apply", None, "", False), ("D", "YC startup", "", "https://y.example", None, "", False),
    ]
    assert sorted(x["path"] for x in paths.collect()) == ["/jobs/location/rome", "/jobs/role/ops"]
    assert sorted(x["page"] for x in bad.collect()) == [2, 3, 4, 5]


def test_searched_boards(spark):
    rows = [
        {"title": " A ", "job_url": "u1", "min_amount": 120000.0, "max_amount": 160000, "interval": "yearly", "is_remote": True, "date_posted": "2024-01-02"}, {"title": "B", "job_url": "u2", "min_amount": 30.5, "max_amount": 30.5, "is_remote": float("nan")},
        {"title": "C", "job_url": "u3", "min_amount": float("nan"), "max_amount": 5, "is_remote": "No"}, {"title": "D", "job_url": "u4", "min_amount": 10, "max_amount": None, "interval": None, "is_remote": " Yes "}, {"title": "", "job_url": "u5"}, {"title": "E"}, 7,
    ]
    good, bad = markup.searched(spark.createDataFrame([("s", 1, json.dumps(rows)), ("s", 2, "{}"), ("s", 3, "x"), ("s", 4, "[]")], PAGES))
    assert sorted((x["title"], x["url"], x["salary"], x["remote"], x["posted"]) for x in good.withColumn("posted", F.coalesce("posted", F.lit("-"))).collect()) == [("A", "u1", "120000-160000 yearly", True, "2024-01-02"), ("B", "u2", "30.5", False, "-"), ("C", "u3", "", False, "-"), ("D", "u4", "10", True, "-")]
    assert sorted(x["page"] for x in bad.collect()) == [2, 3]
