"""Fit and odds against a row-at-a-time twin over random postings, their replay, and what is wrong with a vector."""

import datetime
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import rubric
from tidemark.plans.postings import RUBRIC as R

TODAY = "2024-06-30"
DDL = "k long, title string, company string, location string, remote string, source string, salary string, salary_min string, salary_max string, posted string, description string, aggregator boolean"


def pay_in(text):
    """The plausible yearly amounts of a text."""
    t = re.sub(T.RETIREMENT, " ", text.lower().replace(",", ""))
    found, hourly = re.findall(T.AMOUNT, t), re.search(T.HOURLY, t)
    out = []
    for value, k in found:
        x = float(value)
        if k:
            x *= 1000
        elif hourly and x < T.HOURLY_BELOW:
            x *= T.HOURS_A_YEAR
        elif any(m for _, m in found) and T.IN_THOUSANDS[0] <= x <= T.IN_THOUSANDS[1]:
            x *= 1000
        if T.PLAUSIBLE[0] <= x <= T.PLAUSIBLE[1]:
            out.append(x)
    return (math.floor(min(out)), math.floor(max(out))) if out else (None, None)


def pay_told(text):
    t = re.sub(T.RETIREMENT, " ", text, flags=re.I)
    for m in re.finditer(T.CURRENCY, t, re.I):
        lo, hi = pay_in(t[m.start() : m.start() + T.WINDOW_CHARS])
        if lo and lo >= T.LEAST_IN_TEXT:
            return lo, hi
    return None, None


def years_in(text):
    found = {True: [], False: []}
    for s in re.split(T.SENTENCE_END, text.lower()):
        if re.search(T.OF_EXPERIENCE, s) and not re.search(T.OF_THE_COMPANY, s):
            found[bool(re.search(T.PREFERRED, s))] += [int(y) for y in re.findall(T.YEARS, s) if int(y) <= T.MOST_YEARS]
    return max(found[False], default=None), max(found[True], default=None)


def age_of(posted):
    p = (posted or "").strip().lower()
    if any(x in p for x in T.JUST_NOW):
        return 0
    if m := re.search(T.DAYS_AGO, p):
        return int(m.group(1))
    if m := re.search(T.ISO_DAY, p):
        try:
            return (datetime.date.fromisoformat(TODAY) - datetime.date.fromisoformat(m.group())).days
        except ValueError:
            pass
    return None


def number(x):
    try:
        return float(x or 0) or None
    except ValueError:
        return None


def fit(p):
    """tier, blocker, why, flags, features, pay_low, pay_high of a posting."""
    text = p["description"] or ""
    t, d, company, place = ((p[x] or "").lower() for x in ("title", "description", "company", "location"))
    d = d.replace("\\", "")
    any_ = lambda s, ps: any(re.search(x, s) for x in ps)
    lo, hi = number(p["salary_min"]), number(p["salary_max"])

    def out(code, why, flag):
        return 0, code, why, [flag], None, lo, hi

    if any_(place, R.abroad):
        return out("non_us_location", "non-US location", "blocker")
    local = any_(place, R.local) and bool(re.search(R.local_mark, place))
    if not local and (p["remote"] or "").strip().lower() != "true" and not re.search(R.remote_mark, place):
        return out("off_target_location", "not Bay Area or US-remote", "off-target-loc")
    family = next((n for n, ws in R.families.items() if any(w in t for w in ws)), None) or next((n for n, ws in R.families.items() if any(w in d[:1500] for w in ws)), None)
    base = R.family_points.get(family, 1)
    needed, asked, excused = R.clearance
    if any(re.search(needed, s) and re.search(asked, s) and not re.search(excused, s) for s in re.split(r"[.;\n]", d)):
        return out("active_clearance", "requires active clearance", "blocker")
    if any(w in d for w in R.barred_words) or any_(t, R.barred_titles):
        return out("specialist_skill_or_title", "specialist/level blocker", "blocker")
    if re.search(R.managers, re.sub(R.single_contributors, " ", t)):
        return out("people_management", "people-management role", "blocker")
    need, like = years_in(d)
    if need and need >= R.years["blocked_from"]:
        return out("years_required_too_high", f"requires {need}+ years", "blocker")
    senior = bool(re.search(R.senior, t))
    if family == "validation" and senior and any(w in t for w in R.design_words):
        return out("senior_design_verification", "senior design/verification role", "blocker")
    if family is None:
        return out("no_role_family_match", "no role-family match", "skip")
    if family not in R.focus:
        return out("off_focus_role", "off-focus role (tpm/solutions/account-mgmt)", "skip")
    features, flags, why, score = {"function_match": base}, [], [], base

    def add(name, flag=None):
        nonlocal score
        score += R.points[name]
        features[name] = R.points[name]
        if flag:
            flags.append(flag)

    if base == max(R.family_points.values()):
        why.append("core function match")
    if family == "tpm" and senior:
        add("tpm_senior", "too-senior")
    elif family == "tpm" and re.search(R.second_level, t):
        add("tpm_ii_stretch", "tpm-ii-stretch")
    elif senior and (family in ("validation", "techops") or (family == "support" and any(w in company for w in R.large_support))):
        add("stretch_level", "stretch-level")
    if need and R.years["penalty_low"] <= need <= R.years["penalty_high"]:
        add("years_penalty", f"{need}yrs-required")
    elif need and need <= R.years["bonus_to"]:
        add("years_bonus")
        why.append(f"asks {need}yrs")
    if like and like >= R.years["preferred_from"]:
        add("years_pref_penalty", f"{like}yrs-preferred")
    plain = re.sub(rubric.EQUAL_OPPORTUNITY, " ", d)
    shown = lambda ps, n: "domain: " + ",".join([x.replace("\\b", "").replace("\\", "") for x in ps if re.search(x, plain) or re.search(x, t)][:n])
    if any_(plain, R.domains[1]) or any_(t, R.domains[1]):
        add("domain_tier2")
        why.append(shown(R.domains[1], 3))
    elif any_(plain, R.domains[0]) or any_(t, R.domains[0]):
        add("domain_tier1")
        why.append(shown(R.domains[0], 2))
    if any_(company, R.targets):
        add("target_co", "target-co")
        why.append("named-target employer")
    why.append("Bay Area" if local else "US-remote")
    if re.search(R.staff, t):
        features["staff_cap_delta"] = min(score, R.tiers["staff_most"]) - score
        score = min(score, R.tiers["staff_most"])
        flags.append("level-out")
    age = age_of(p["posted"])
    if age is not None and age > R.tiers["stale_after"]:
        add("stale_30d", "30d+")
    low, high = pay_in(p["salary"] or "")
    if not low:
        low, high = lo, hi
    if not low and text:
        low, high = pay_told(text)
        if low:
            flags.append("salary-from-desc")
    if low:
        lo, hi = int(low), int(high or low)
    if low and high and low <= R.pay["band_high"] and high >= R.pay["band_low"]:
        add("comp_in_band")
        why.append("comp in band")
    elif high and high < R.pay["low_below"]:
        add("low_comp", "low-comp")
    if any(w in d for w in R.contract_words):
        add("c2c", "C2C")
    elif any(w in company for w in R.agencies):
        add("staffing_w2", "Staffing/W2")
    if not text:
        flags.append("desc-unavailable")
    if re.search(R.degree[0], d) and R.degree[1] not in d:
        add("degree_gated", "degree-gated")
    features["raw_score"] = score
    tier = max(1, min(5, score))
    if base < R.tiers["function_least"] and tier > R.tiers["function_most"]:
        tier = features["cap_func"] = R.tiers["function_most"]
        flags.append("func-cap")
    if not text and tier > R.tiers["no_text_most"]:
        tier = features["cap_no_desc"] = R.tiers["no_text_most"]
        flags.append("needs-desc")
    if age is not None and age > R.tiers["old_after"]:
        features["cap_stale"] = R.tiers["old_most"]
        tier = min(tier, R.tiers["old_most"])
        flags.append("stale-90d+")
    elif age is None and p["aggregator"] and tier > R.tiers["undated_most"]:
        tier = features["cap_undated_aggregator"] = R.tiers["undated_most"]
        flags.append("undated-aggregator")
    return tier, None, "; ".join(why[:6]), flags, features, lo, hi


def odds(p, flags, high):
    t, d, company = ((p[x] or "").lower() for x in ("title", "description", "company"))
    d, flags = d.replace("\\", ""), ", ".join(flags)
    on, why = [], []

    def add(name, reason):
        on.append(name)
        why.append(reason)

    staff, senior, junior = R.odds_levels
    if re.search(staff, t):
        add("staff_principal", "staff/principal level")
    elif re.search(senior, t):
        add("senior", "senior level")
    elif re.search(junior, t):
        add("junior", "junior/associate level")
    need, _ = years_in(p["description"] or "")
    if need and need <= R.years["odds_low_to"]:
        add("years_low", f"asks {need}yrs")
    elif need and need >= R.years["odds_high_from"]:
        add("years_high", f"asks {need}yrs")
    if any(re.search(x, company) for x in R.crowded):
        add("high_competition", "high-competition employer")
    if "Staffing/W2" in flags:
        add("staffing_w2", "staffing/vendor (lower bar)")
    if len(d) > 400:
        n = sum(bool(re.search(x, d)) for x in R.skills)
        if n >= 6:
            add("skills_strong", f"{n} skills match")
        elif n >= 3:
            add("skills_moderate", f"{n} skills match")
        elif n <= 1:
            add("skills_thin", "thin skills match")
        if all(re.search(x, d) for x in R.stack):
            add("exact_stack", "his exact stack")
    elif d:
        why.append("short JD (skills unscored)")
    high = int(high or 0)
    if high >= R.pay["high_bar"]:
        add("comp_high_bar", "comp implies higher bar")
    elif 0 < high < R.pay["near_below"]:
        add("comp_near_level", "comp near his level")
    if "degree-gated" in flags:
        add("degree_gated", "hard degree gate")
    match = "Level stretch" if "staff_principal" in on else "Strong match" if {"skills_strong", "exact_stack"} & set(on) else "Weak match" if "skills_thin" in on else "Unscored" if len(d) <= 400 else "Moderate match"
    rivals = "High competition" if {"high_competition", "comp_high_bar", "degree_gated"} & set(on) else "Lower bar" if "staffing_w2" in on else "Standard"
    return sum(R.odds_points[x] for x in on), match, rivals, "; ".join(why[:4]), {x: R.odds_points[x] for x in on}


def posting(r, k):
    words = ["Senior", "Staff", "Principal", "Junior", "Support Engineer", "Validation Engineer", "Design", "TPM", "II", "Manager", "Account Manager", "Program Manager", "Technical Operations", "Intern", "Internal Tools", "Azure", "Director"]
    sentences = [
        "We need 3+ years of experience.", "Requires 6 years of experience in support.", "At least 9 years required.", "Preferred: 7 years working with cloud.", "Our company has 40 years of history.", "Must hold an active secret clearance.", "Able to obtain a secret clearance;",
        "Equal opportunity for azure and gender identity.", "Works with azure and active directory.", "You know okta, jamf, slack, python, sql, linux, jira and intune.", "Pay is $95,000 - $130,000.", "401(k) and $55 - 60 per hour", "USD 210k-250k", "corp-to-corp only", "bachelor's degree required",
        "bachelor's degree required or equivalent experience", "Kernel drivers in verilog.", "Knows linux, python and jira.", "Knows linux and slack.", "technical support for customers\n", "a\\\\b", "x " * 220,
    ]
    return {
        "k": k, "title": " ".join(r.sample(words, r.randint(1, 3))), "company": r.choice(["Acme", "Metabase", "meta", "Contoso Staffing", "Bigcloud", None]), "location": r.choice(["San Francisco, CA", "Fremont, NE", "Remote (US)", "London, UK", "Austin, TX", "Oakland, CA | Remote", None]),
        "remote": r.choice(["true", "True", "false", None]), "source": "s", "salary": r.choice([None, "", "$100k - $140k", "$30/hr", "competitive"]), "salary_min": r.choice([None, "", "0", "50000", "junk"]), "salary_max": r.choice([None, "60000", "210000.0", ""]),
        "posted": r.choice([None, "", "2024-06-20", "2024-05-01", "2023-01-01", "Posted 30+ Days Ago", "today", "2024-99-99"]), "description": r.choice([None, "", *[" ".join(r.sample(sentences, r.randint(1, 6))) for _ in range(6)]]), "aggregator": r.choice([True, False, None]),
    }


@pytest.fixture(scope="module")
def both(spark):
    r = random.Random(6)
    rows = [posting(r, k) for k in range(3000)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], DDL).repartition(4)
    out = rubric.odds(rubric.fit(df, R, TODAY), R).withColumn("vector", rubric.stored(F.col("features"), F.col("blocker")))
    return rows, {x["k"]: x for x in out.withColumns({"replayed": rubric.replayed(F.col("vector")), "problems": rubric.problems(F.col("vector"))}).collect()}


def test_fit_equals_the_twin(both):
    rows, got = both
    codes, seen = set(), set()
    for p in rows:
        tier, code, why, flags, features, lo, hi = fit(p)
        x = got[p["k"]]
        assert (x["tier"], x["blocker"], x["why"], x["flags"], x["features"]) == (tier, code, why, flags, features), p
        assert (x["pay_low"], x["pay_high"]) == (None if lo is None else int(lo), None if hi is None else int(hi)), p
        codes.add(code)
        seen |= set(features or ())
    assert codes == {*rubric.BLOCKERS, None}
    assert {"function_match", "staff_cap_delta", "raw_score", *rubric.CAPS, *rubric.FIT_POINTS} - seen <= {"tpm_senior", "tpm_ii_stretch"}


def test_odds_equal_the_twin(both):
    rows, got = both
    seen, labels = set(), set()
    for p in rows:
        x = got[p["k"]]
        score, match, rivals, why, features = odds(p, x["flags"], x["pay_high"])
        o = x["odds"]
        assert (o["score"], o["match"], o["competition"], o["label"], o["why"], o["features"]) == (score, match, rivals, f"{match} / {rivals}", why, features), p
        seen |= set(features)
        labels.add((match, rivals))
    assert seen == set(rubric.ODDS_POINTS)
    assert len(labels) >= 12


def test_every_vector_replays(both):
    _, got = both
    assert all(x["replayed"] == x["tier"] and x["problems"] == [] for x in got.values())


def test_wrong_vectors_are_named(spark):
    good = {"function_match": 3, "years_bonus": 1, "raw_score": 4}
    cases = {
        "{}": ["missing raw_score", "missing function_match"], json.dumps(good): [], json.dumps(good | {"extra": 1}): ["unknown extra"], json.dumps(good | {"years_bonus": True}): ["no number years_bonus"],
        json.dumps(good | {"raw_score": 5}): ["sum is not the total"], json.dumps(good | {"cap_func": "x"}): ["no number cap_func"], '{"blocker": "active_clearance"}': [], '{"blocker": "active_clearance", "raw_score": 1}': ["beside the blocker"],
        '{"blocker": "made_up"}': ["unknown blocker"], '{"blocker": 5}': ["unknown blocker"], "[1]": ["no object"], "junk": ["no object"],
    }
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", rubric.problems(F.col("v")).alias("p")).collect()
    assert {x["v"]: x["p"] for x in rows} == cases


def test_a_rubric_is_checked():
    parts = {f: getattr(R, f) for f in R.__dataclass_fields__}
    with pytest.raises(ValueError, match="missing \\['c2c'\\]"):
        rubric.Rubric(**parts | {"points": {k: v for k, v in R.points.items() if k != "c2c"}})
    with pytest.raises(ValueError, match="unknown \\['shiny'\\]"):
        rubric.Rubric(**parts | {"odds_points": R.odds_points | {"shiny": 1}})
    with pytest.raises(ValueError, match="focus"):
        rubric.Rubric(**parts | {"focus": ["nothing"]})
