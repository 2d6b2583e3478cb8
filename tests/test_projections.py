"""List and detail rows against a twin that looks each field up by hand, over random tables."""

import base64
import json
import random

from tidemark.operators import projections as P
from tests.test_rubric import pay_in

VERSION = "posting string, version string, observed_at string, title string, company string, location string, salary string, salary_min long, salary_max long, posted string, remote boolean, source string, req_id string, first_seen string, also_seen_on string, tier int, odds string, odds_score int, odds_why string, why string, flags string, desc_snippet string, payload string"
SCHEMAS = {
    "versions": VERSION, "scores": "version string, tier int, odds string, odds_score int, rationale string, superseded_at string", "urls": "posting string, url string, at string", "descriptions": "posting string, body string, fetch_status string, at string",
    "postings": "posting string, first_seen_at string", "aliases": "posting string, namespace string", "events": "seen_key string, field string, at string", "new": "posting string",
    "states": "seen_key string, posting string, url string, status string, notes string, follow_up_date string, applied_date string, starred boolean, hidden boolean, contact string, snoozed_until string, applied_via string, updated_at string",
}
SKILLS = ["Okta", " sql ", "", "okta", "Okta", "Jira"]


def world(r):
    t = {name: [] for name in SCHEMAS}
    some = lambda *v: r.choice([None, *v])
    for k in range(60):
        p, url = f"p{k}", f"https://x.example/{k}"
        t["postings"].append((p, f"2024-01-{k % 28 + 1:02}"))
        for j in range(r.randint(0, 2)):
            canonical = json.dumps({"canonical": {"salary": "$50k - $90k", "posted_date": r.choice(["2024-02-02", ""]), "remote": r.choice(["0", "1"])}}) if r.random() < 0.6 else some("junk", "[]")
            t["versions"].append((p, f"v{k}.{j}", f"2024-03-0{j + 1}", f"T{k}", some("C"), some("L"), some("$100k", ""), some(0, 70000), some(80000), some("2024-01-01"), some(True, False), some("a", "b"), some("r1"), some("2023-12-31"), some("z"), some(1, 4), some("o"), some(7), some("ow"), some("w"), some("f1, f2"), some("", "short okta"), canonical))
            if r.random() < 0.6:
                rationale = some("junk", json.dumps({"why": "sw", "flags": ["x", "y"], "odds_why": "so"}), json.dumps({"flags": "x; y"}), "{}")
                t["scores"].append((f"v{k}.{j}", some(2, 5), some("so"), some(3), rationale, None))
                t["scores"].append((f"v{k}.{j}", 1, "old", 0, None, "2024-01-01"))
        if r.random() < 0.8:
            t["urls"] += [(p, url, "2"), (p, url + "/old", "1")]
        if r.random() < 0.7:
            t["descriptions"] += [(p, some("", "Uses SQL and jira. " * 40), r.choice(["available", "failed"]), "2"), (p, "older", "available", "1")]
        t["aliases"] += [(p, ns) for ns in r.sample(["a", "b", "c", ""], r.randint(0, 3))]
        if r.random() < 0.6:
            t["states"].append((f"k{k}", p if r.random() < 0.5 else None, url, some("new", "applied"), some("n"), some("2024-05-05"), None, some(True), some(False), some("me"), None, None, some("u")))
            t["events"] += [(f"k{k}", r.choice(["status", "notes"]), f"2024-04-0{j}") for j in range(1, r.randint(1, 4))]
        if r.random() < 0.3:
            t["new"].append((p,))
    return t


def twin(t):
    names = [c.split()[0] for c in VERSION.split(", ")]
    out = {}
    for p in {x[0] for x in t["versions"]}:
        v = dict(zip(names, max((x for x in t["versions"] if x[0] == p), key=lambda x: x[2]), strict=True))
        score = next((s for s in t["scores"] if s[0] == v["version"] and s[5] is None), None)
        if score:
            try:
                why = json.loads(score[4] or "")
            except ValueError:
                why = {}
            flags = why.get("flags")
            v |= {"tier": score[1], "odds": score[2], "odds_score": score[3], "why": why.get("why"), "odds_why": why.get("odds_why"), "flags": ", ".join(flags) if isinstance(flags, list) else flags}
        url = max(((x[2], x[1]) for x in t["urls"] if x[0] == p), default=(None, ""))[1]
        state = next((s for s in t["states"] if s[1] == p), None) or next((s for s in t["states"] if s[2] == url), None)
        since = max((e[2] for e in t["events"] if state and e[0] == state[0] and e[1] == "status"), default=None)
        desc = max((d for d in t["descriptions"] if d[0] == p), key=lambda d: d[3], default=None)
        body = desc[1] if desc else None
        try:
            canonical = json.loads(v["payload"] or "")
            canonical = canonical.get("canonical", {}) if isinstance(canonical, dict) else {}
        except ValueError:
            canonical = {}
        salary = v["salary"] if v["salary"] is not None else canonical.get("salary")
        lo, hi = (v["salary_min"], v["salary_max"]) if v["salary_min"] is not None or v["salary_max"] is not None else pay_in(salary or "")
        others = ", ".join(sorted({x[1] for x in t["aliases"] if x[0] == p and x[1] and x[1] != v["source"]}))
        snippet = v["desc_snippet"] or (body[:500] if body else v["desc_snippet"])
        hay = f"{body or ''}\n{snippet or ''}".lower()
        out[p] = {
            "url": url, "url_b64": base64.urlsafe_b64encode(url.encode()).decode().rstrip("="), "tier": v["tier"] or 0, "odds": v["odds"], "odds_score": v["odds_score"], "odds_why": v["odds_why"], "is_new": (p,) in t["new"], "title": v["title"],
            "company": v["company"], "location": v["location"], "salary": salary, "salary_min": lo, "salary_max": hi, "posted": v["posted"] if v["posted"] is not None else canonical.get("posted_date") or None,
            "first_seen": v["first_seen"] or next(x[1] for x in t["postings"] if x[0] == p), "remote": v["remote"] if v["remote"] is not None else canonical.get("remote") == "1", "source": v["source"],
            "also_seen_on": v["also_seen_on"] if v["also_seen_on"] is not None else others or None, "req_id": v["req_id"], "why": v["why"], "flags": v["flags"], "desc_snippet": snippet, "has_desc": bool(body) and desc[2] == "available",
            "state": None if state is None or state[3] is None else (state[3], state[4] or "", *state[5:9], state[9] or "", *state[10:12], state[12] or "", since), "full_desc": body,
            "skill_hits": [s for s in ["Okta", " sql ", "okta", "Jira"] if s.strip().lower() in hay],
        }
    return out


def test_light_and_detail_rows(spark):
    t = world(random.Random(5))
    tables = P.Tables(**{name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in t.items()})
    want = twin(t)
    got = {x["posting"]: x.asDict() for x in P.detail(tables, SKILLS).collect()}
    assert set(got) == set(want)
    for p, row in want.items():
        mine = {k: v for k, v in got[p].items() if k != "posting"}
        mine["state"] = mine["state"] and tuple(mine["state"])
        assert mine == row, p
    assert sum(r["state"] is not None for r in want.values()) > 5 and any(r["skill_hits"] for r in want.values())
    assert P.light(tables).count() == len(want)


def test_scorer_rows(spark):
    v = spark.createDataFrame([("v1", None, "C", None, "$5", 0, 7, None, None, "s", None), ("v2", "T", None, "L", None, None, None, "p", True, None, "r")], "version string, title string, company string, location string, salary string, salary_min long, salary_max long, posted string, remote boolean, source string, req_id string")
    assert [tuple(x) for x in P.scorer_rows(v).orderBy("version").collect()] == [("v1", "", "C", "", "$5", "", "7", "", "false", "s", "", ""), ("v2", "T", "", "L", "", "", "", "p", "true", "", "r", "")]


def test_pass_mode():
    assert P.pass_mode(("p", "s"), None) == ("full", ["no_baseline_pass"])
    assert P.pass_mode(("p", "s"), ("p", "s")) == ("incremental", [])
    assert P.pass_mode(("p", "s"), ("q", "t")) == ("full", ["profile_changed", "scorer_changed"])
