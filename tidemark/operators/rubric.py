"""Two orthogonal scores of a posting: how well it fits, and how hard it is to win; the second reads what the first found out.

``fit`` gives a tier from 0 to 5. Nine blockers are tried in order, and the first
that holds ends the matter with tier 0. Else named contributions are added to the
points of the role's family; a staff title clamps the running total in the middle,
and the difference is a contribution of its own; then the total is cut to 1..5 and
four caps follow. A sentence that asks for a clearance counts by itself, so "able
to obtain" in another one does not excuse it; sentences on equal opportunity are
taken out before domains are looked for.

``odds`` gives a score and two labels, one of the match and one of the competition.
It reads the flags and the recovered pay of the fit, so it is a second stage on the
same row.

A rubric is data: patterns, words, limits and points. All of it folds into the plan
as literals. A stored vector of features is closed: ``problems`` names what is
wrong with one, ``replayed`` gives the tier from a vector alone.

Rows have title, company, location, remote, source, salary, salary_min, salary_max,
posted, description and aggregator (boolean); nulls are empty, and an empty
description is none. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_value, posting_age_days, salary_in_description, salary_range, years_required

# Names of stored features, blockers and caps, in the order in which caps apply. The reasons, flags and labels that the
# rules below give are fixed as well, as stored rows hold them and the second stage reads the flags.
FIT_POINTS = [
    "tpm_senior", "tpm_ii_stretch", "stretch_level", "years_penalty", "years_bonus", "years_pref_penalty", "domain_tier2", "domain_tier1", "target_co", "stale_30d", "comp_in_band", "low_comp", "c2c", "staffing_w2",
    "degree_gated",
]
ODDS_POINTS = [
    "staff_principal", "senior", "junior", "years_low", "years_high", "high_competition", "staffing_w2", "skills_strong", "skills_moderate", "skills_thin", "exact_stack", "comp_high_bar", "comp_near_level", "degree_gated",
]
BLOCKERS = [
    "non_us_location", "off_target_location", "active_clearance", "specialist_skill_or_title", "people_management", "years_required_too_high", "senior_design_verification", "no_role_family_match", "off_focus_role",
]
CAPS = ["cap_func", "cap_no_desc", "cap_stale", "cap_undated_aggregator"]
EQUAL_OPPORTUNITY = r"(equal (employment )?opportunity|eeo|gender identity|sexual orientation)[^.]*\."
SKILLS_FROM, STRONG, MODERATE, THIN = 400, 6, 3, 1
FAMILY_WITHIN = 1500


@dataclass(frozen=True)
class Rubric:
    """What is looked for. Patterns are matched in lower-case text, words are contained in it."""

    abroad: list[str]
    local: list[str]
    local_mark: str
    remote_mark: str
    families: dict[str, list[str]]
    family_points: dict[str, int]
    focus: list[str]
    clearance: tuple[str, str, str]
    barred_words: list[str]
    barred_titles: list[str]
    managers: str
    single_contributors: str
    senior: str
    second_level: str
    staff: str
    design_words: list[str]
    large_support: list[str]
    domains: tuple[list[str], list[str]]
    targets: list[str]
    contract_words: list[str]
    agencies: list[str]
    degree: tuple[str, str]
    points: dict[str, int]
    odds_points: dict[str, int]
    odds_levels: tuple[str, str, str]
    crowded: list[str]
    skills: list[str]
    stack: list[str]
    years: dict[str, int] = field(default_factory=lambda: {"blocked_from": 8, "penalty_low": 5, "penalty_high": 7, "bonus_to": 3, "preferred_from": 5, "odds_low_to": 3, "odds_high_from": 6})
    pay: dict[str, int] = field(default_factory=lambda: {"band_low": 90_000, "band_high": 160_000, "low_below": 70_000, "high_bar": 200_000, "near_below": 120_000})
    tiers: dict[str, int] = field(default_factory=lambda: {"staff_most": 2, "stale_after": 30, "function_least": 3, "function_most": 4, "no_text_most": 3, "old_after": 90, "old_most": 3, "undated_most": 3})

    def __post_init__(self):
        for name, have, want in (("points", self.points, FIT_POINTS), ("odds_points", self.odds_points, ODDS_POINTS)):
            if set(have) != set(want):
                raise ValueError(f"{name} must have exactly the fixed names; missing {sorted(set(want) - set(have))}, unknown {sorted(set(have) - set(want))}")
        if set(self.family_points) != set(self.families) or not set(self.focus) <= set(self.families):
            raise ValueError("every family needs points, and the focus is some of them")


def _any(c: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [c.rlike(p) for p in patterns], F.lit(False))


def _holds(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words], F.lit(False))


def _first(c: Column, choices: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(_holds(c, words), name) for name, words in choices.items()], F.lit(None).cast("string"))


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _labels(patterns: list[str], text: Column, title: Column, most: int) -> Column:
    """The first patterns that are found, as readable text."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p) | title.rlike(p), p.replace("\\b", "").replace("\\", "")) for p in patterns], F.lit(None).cast("string")))
    return F.slice(found, 1, most)


def fit(rows: DataFrame, r: Rubric, today: str) -> DataFrame:
    """rows with tier, why, flags, features (name to points), blocker, and pay_low and pay_high as recovered."""
    t, d, company, place = F.col("f_title"), F.col("f_text"), F.col("f_company"), F.col("f_place")
    has_text = F.coalesce("description", F.lit("")) != ""
    out = rows.withColumns({"f_title": _low("title"), "f_text": F.replace(_low("description"), F.lit("\\"), F.lit("")), "f_company": _low("company"), "f_place": _low("location")})
    local = _any(place, r.local) & place.rlike(r.local_mark)
    remote = (F.lower(F.trim(F.coalesce(F.col("remote").cast("string"), F.lit("")))) == "true") | place.rlike(r.remote_mark)
    years = years_required(F.col("f_text"))
    stated = salary_range(F.col("salary"))
    own = F.struct(F.nullif(F.col("salary_min").try_cast("double"), F.lit(0.0)).alias("lo"), F.nullif(F.col("salary_max").try_cast("double"), F.lit(0.0)).alias("hi"))
    out = out.withColumns({
        "f_family": F.coalesce(_first(t, r.families), _first(F.substring(d, 1, FAMILY_WITHIN), r.families)), "f_local": local, "f_remote": remote, "f_years": years, "f_senior": t.rlike(r.senior),
        "f_plain": F.regexp_replace(d, EQUAL_OPPORTUNITY, " "), "f_age": posting_age_days(F.col("posted"), F.lit(today).cast("date")), "f_stated": stated, "f_own": own, "f_told": F.when(has_text, salary_in_description(F.col("description"))),
    })
    family = F.col("f_family")
    points = F.coalesce(*[F.when(family == n, p) for n, p in r.family_points.items()], F.lit(1))
    # pay: what is stated, else the numbers of the row, else what the description says; only the last replaces a lone upper end
    by_row = F.col("f_stated.lo").isNotNull()
    by_own = ~by_row & F.col("f_own.lo").isNotNull()
    by_text = ~by_row & ~by_own & has_text
    lo = F.when(by_row, F.col("f_stated.lo").cast("double")).when(by_own, F.col("f_own.lo")).when(by_text, F.col("f_told.lo").cast("double"))
    hi = F.when(by_row, F.col("f_stated.hi").cast("double")).when(by_text, F.col("f_told.hi").cast("double")).otherwise(F.col("f_own.hi"))
    out = out.withColumns({"f_points": points, "f_lo": lo, "f_hi": hi, "f_from_text": by_text & F.col("f_told.lo").isNotNull()})
    needed, asked, excused = r.clearance
    cleared = F.exists(F.split(d, r"[.;\n]"), lambda s: s.rlike(needed) & s.rlike(asked) & ~s.rlike(excused))
    required, preferred = F.nullif(F.col("f_years.required"), F.lit(0)), F.nullif(F.col("f_years.preferred"), F.lit(0))
    blockers = [
        (_any(place, r.abroad), "non_us_location", F.lit("non-US location"), "blocker"),
        (~(F.col("f_local") | F.col("f_remote")), "off_target_location", F.lit("not Bay Area or US-remote"), "off-target-loc"),
        (cleared, "active_clearance", F.lit("requires active clearance"), "blocker"),
        (_holds(d, r.barred_words) | _any(t, r.barred_titles), "specialist_skill_or_title", F.lit("specialist/level blocker"), "blocker"),
        (F.regexp_replace(t, r.single_contributors, " ").rlike(r.managers), "people_management", F.lit("people-management role"), "blocker"),
        (required >= r.years["blocked_from"], "years_required_too_high", F.concat(F.lit("requires "), required.cast("string"), F.lit("+ years")), "blocker"),
        ((family == "validation") & F.col("f_senior") & _holds(t, r.design_words), "senior_design_verification", F.lit("senior design/verification role"), "blocker"),
        (family.isNull(), "no_role_family_match", F.lit("no role-family match"), "skip"),
        (~family.isin(r.focus), "off_focus_role", F.lit("off-focus role (tpm/solutions/account-mgmt)"), "skip"),
    ]
    first = F.coalesce(*[F.when(_yes(c), F.struct(F.lit(code).alias("code"), why.alias("why"), F.lit(flag).alias("flag"))) for c, code, why, flag in blockers])
    second = _yes(_any(F.col("f_plain"), r.domains[1]) | _any(t, r.domains[1]))
    primary = ~second & _yes(_any(F.col("f_plain"), r.domains[0]) | _any(t, r.domains[0]))
    senior = F.col("f_senior")
    stretch = senior & (family.isin("validation", "techops") | ((family == "support") & _holds(company, r.large_support)))
    penalty = required.between(r.years["penalty_low"], r.years["penalty_high"])
    early = [
        ("tpm_senior", (family == "tpm") & senior, F.lit("too-senior")), ("tpm_ii_stretch", (family == "tpm") & ~senior & t.rlike(r.second_level), F.lit("tpm-ii-stretch")), ("stretch_level", stretch, F.lit("stretch-level")),
        ("years_penalty", penalty, F.concat(required.cast("string"), F.lit("yrs-required"))), ("years_bonus", ~penalty & (required <= r.years["bonus_to"]), None),
        ("years_pref_penalty", preferred >= r.years["preferred_from"], F.concat(preferred.cast("string"), F.lit("yrs-preferred"))), ("domain_tier2", second, None), ("domain_tier1", primary, None), ("target_co", _any(company, r.targets), F.lit("target-co")),
    ]
    in_band = F.col("f_lo").isNotNull() & F.col("f_hi").isNotNull() & (F.col("f_lo") <= r.pay["band_high"]) & (F.col("f_hi") >= r.pay["band_low"])
    contract = _holds(d, r.contract_words)
    late = [
        ("stale_30d", F.col("f_age") > r.tiers["stale_after"], F.lit("30d+")), (None, F.col("f_from_text"), F.lit("salary-from-desc")), ("comp_in_band", in_band, None), ("low_comp", ~in_band & (F.col("f_hi") < r.pay["low_below"]), F.lit("low-comp")),
        ("c2c", contract, F.lit("C2C")), ("staffing_w2", ~contract & _holds(company, r.agencies), F.lit("Staffing/W2")), (None, ~has_text, F.lit("desc-unavailable")), ("degree_gated", d.rlike(r.degree[0]) & ~d.contains(r.degree[1]), F.lit("degree-gated")),
    ]
    names = [n for n, *_ in [*early, *late] if n]
    marks = {n: _yes(c) for n, c, _ in [*early, *late] if n}
    out = out.withColumns({"f_block": first, **{f"f_is_{n}": c for n, c in marks.items()}})
    on = lambda n: F.col(f"f_is_{n}")
    total = lambda some, onto: reduce(lambda a, n: a + F.when(on(n), r.points[n]).otherwise(0), [n for n, *_ in some if n], onto)
    out = out.withColumn("f_early", total(early, F.col("f_points")))
    out = out.withColumn("f_delta", F.when(t.rlike(r.staff), F.least(F.col("f_early"), F.lit(r.tiers["staff_most"])) - F.col("f_early")))
    out = out.withColumn("f_raw", total(late, F.col("f_early") + F.coalesce("f_delta", F.lit(0))))
    tier, caps = F.greatest(F.lit(1), F.least(F.lit(5), F.col("f_raw"))), []
    old = _yes(F.col("f_age") > r.tiers["old_after"])
    for name, when, most, always, flag in (
        ("cap_func", F.col("f_points") < r.tiers["function_least"], r.tiers["function_most"], False, "func-cap"), ("cap_no_desc", ~has_text, r.tiers["no_text_most"], False, "needs-desc"),
        ("cap_stale", old, r.tiers["old_most"], True, "stale-90d+"), ("cap_undated_aggregator", F.col("f_age").isNull() & _yes(F.col("aggregator")), r.tiers["undated_most"], False, "undated-aggregator"),
    ):
        out = out.withColumn(f"f_is_{name}", when if always else when & (tier > most))
        caps.append((name, most, flag))
        tier = F.when(on(name), F.least(tier, F.lit(most))).otherwise(tier)
    blocked = F.col("f_block").isNotNull()
    pairs = [("function_match", F.col("f_points")), *((n, F.when(on(n), r.points[n])) for n in names), ("staff_cap_delta", F.col("f_delta")), ("raw_score", F.col("f_raw")), *((n, F.when(on(n), m)) for n, m, _ in caps)]
    vector = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.cast("int").alias("value")) for n, v in pairs]), lambda e: e["value"].isNotNull()))
    said = [F.when(F.col("f_points") == max(r.family_points.values()), "core function match"), F.when(on("years_bonus"), F.concat(F.lit("asks "), required.cast("string"), F.lit("yrs")))]
    domain = lambda p, most: F.concat(F.lit("domain: "), F.array_join(_labels(p, F.col("f_plain"), t, most), ","))
    said += [F.when(on("domain_tier2"), domain(r.domains[1], 3)).when(on("domain_tier1"), domain(r.domains[0], 2)), F.when(on("target_co"), "named-target employer"), F.when(F.col("f_local"), "Bay Area").otherwise("US-remote"), F.when(on("comp_in_band"), "comp in band")]
    raised = [F.when(on(n) if n else _yes(c), f) for n, c, f in early if f is not None] + [F.when(F.col("f_delta").isNotNull(), "level-out")] + [F.when(on(n) if n else _yes(c), f) for n, c, f in late if f is not None] + [F.when(on(n), f) for n, _, f in caps]
    out = out.withColumns({
        "blocker": F.col("f_block.code"), "tier": F.when(blocked, 0).otherwise(tier), "why": F.when(blocked, F.col("f_block.why")).otherwise(F.array_join(F.slice(F.array_compact(F.array(*said)), 1, 6), "; ")),
        "flags": F.when(blocked, F.array(F.col("f_block.flag"))).otherwise(F.array_compact(F.array(*raised))), "features": F.when(~blocked, vector),
        "pay_low": F.when(blocked, F.col("f_own.lo")).otherwise(F.coalesce(F.floor("f_lo"), F.col("f_own.lo"))).cast("long"), "pay_high": F.when(blocked, F.col("f_own.hi")).otherwise(F.when(F.col("f_lo").isNotNull(), F.floor(F.coalesce("f_hi", "f_lo"))).otherwise(F.col("f_own.hi"))).cast("long"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("f_")])


def odds(rows: DataFrame, r: Rubric) -> DataFrame:
    """Rows of ``fit`` with odds (struct of score, match, competition, label, why, features)."""
    t, d, company = _low("title"), F.replace(_low("description"), F.lit("\\"), F.lit("")), _low("company")
    flags = F.array_join("flags", ", ")
    out = rows.withColumns({"o_title": t, "o_text": d, "o_years": F.nullif(years_required(F.col("description"))["required"], F.lit(0)), "o_flags": flags})
    t, d, years = F.col("o_title"), F.col("o_text"), F.col("o_years")
    hits = lambda patterns: reduce(lambda a, p: a + d.rlike(p).cast("int"), patterns, F.lit(0))
    out = out.withColumns({"o_hits": hits(r.skills), "o_stack": hits(r.stack) == len(r.stack), "o_long": F.length(d) > SKILLS_FROM, "o_pay": F.coalesce("pay_high", F.lit(0).cast("long"))})
    staff, senior, junior = r.odds_levels
    n, long_ = F.col("o_hits"), F.col("o_long")
    is_staff, is_senior = t.rlike(staff), t.rlike(senior)
    low_years = years <= r.years["odds_low_to"]
    high_pay = F.col("o_pay") >= r.pay["high_bar"]
    asks, skills = F.concat(F.lit("asks "), years.cast("string"), F.lit("yrs")), F.concat(n.cast("string"), F.lit(" skills match"))
    rules = [
        ("staff_principal", is_staff, F.lit("staff/principal level")), ("senior", ~is_staff & is_senior, F.lit("senior level")), ("junior", ~is_staff & ~is_senior & t.rlike(junior), F.lit("junior/associate level")),
        ("years_low", low_years, asks), ("years_high", ~low_years & (years >= r.years["odds_high_from"]), asks), ("high_competition", _any(company, r.crowded), F.lit("high-competition employer")),
        ("staffing_w2", F.col("o_flags").contains("Staffing/W2"), F.lit("staffing/vendor (lower bar)")), ("skills_strong", long_ & (n >= STRONG), skills), ("skills_moderate", long_ & (n >= MODERATE) & (n < STRONG), skills),
        ("skills_thin", long_ & (n <= THIN), F.lit("thin skills match")), ("exact_stack", long_ & F.col("o_stack"), F.lit("his exact stack")), (None, ~long_ & (d != ""), F.lit("short JD (skills unscored)")),
        ("comp_high_bar", high_pay, F.lit("comp implies higher bar")), ("comp_near_level", ~high_pay & (F.col("o_pay") > 0) & (F.col("o_pay") < r.pay["near_below"]), F.lit("comp near his level")), ("degree_gated", F.col("o_flags").contains("degree-gated"), F.lit("hard degree gate")),
    ]
    out = out.withColumns({f"o_is_{name}": _yes(c) for name, c, _ in rules if name})
    on = lambda name: F.col(f"o_is_{name}")
    score = reduce(lambda a, name: a + F.when(on(name), r.odds_points[name]).otherwise(0), ODDS_POINTS, F.lit(0))
    match = F.when(on("staff_principal"), "Level stretch").when(on("skills_strong") | on("exact_stack"), "Strong match").when(on("skills_thin"), "Weak match").when(~F.col("o_long"), "Unscored").otherwise("Moderate match")
    rivals = F.when(on("high_competition") | on("comp_high_bar") | on("degree_gated"), "High competition").when(on("staffing_w2"), "Lower bar").otherwise("Standard")
    why = F.array_join(F.slice(F.array_compact(F.array(*[F.when(on(name) if name else _yes(c), w) for name, c, w in rules])), 1, 4), "; ")
    vector = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(x).alias("key"), F.when(on(x), r.odds_points[x]).alias("value")) for x in ODDS_POINTS]), lambda e: e["value"].isNotNull()))
    out = out.withColumn("odds", F.struct(score.alias("score"), match.alias("match"), rivals.alias("competition"), F.concat_ws(" / ", match, rivals).alias("label"), why.alias("why"), vector.alias("features")))
    return out.drop(*[c for c in out.columns if c.startswith("o_")])


def stored(features: Column, blocker: Column) -> Column:
    """A vector as JSON; a blocked row's holds its blocker and nothing else."""
    return F.when(blocker.isNotNull(), F.to_json(F.struct(blocker.alias("blocker")))).otherwise(F.to_json(features))


def replayed(vector: Column) -> Column:
    """The tier from a stored vector alone; null for what is no vector."""
    v = json_value(vector)
    raw = F.try_variant_get(v, "$.raw_score", "int")
    tier = reduce(lambda a, cap: F.least(a, F.coalesce(F.try_variant_get(v, f"$.{cap}", "int"), F.lit(5))), CAPS, F.greatest(F.lit(1), F.least(F.lit(5), raw)))
    return F.when(F.try_variant_get(v, "$.blocker", "variant").isNotNull(), 0).when(raw.isNotNull(), tier)


def problems(vector: Column) -> Column:
    """What is wrong with a stored vector: names outside the vocabulary, a blocker beside others or unknown, missing totals, values that are no numbers, a sum that is not the total. Empty if nothing is."""
    v = json_value(vector)
    fields = F.try_variant_get(v, "$", "map<string, variant>")
    names = F.map_keys(fields)
    known = ["function_match", *FIT_POINTS, "staff_cap_delta", "raw_score", *CAPS]
    blocker = F.try_variant_get(v, "$.blocker", "variant")
    unknown = F.transform(F.array_sort(F.filter(names, lambda k: ~k.isin([*known, "blocker"]))), lambda k: F.concat(F.lit("unknown "), k))
    beside = F.when(F.size(names) > 1, "beside the blocker")
    code = F.when(~_yes(F.schema_of_variant(blocker) == "STRING") | ~_yes(F.try_variant_get(v, "$.blocker", "string").isin(BLOCKERS)), "unknown blocker")
    missing = [F.when(~F.array_contains(names, k), f"missing {k}") for k in ("raw_score", "function_match")]
    number = lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    odd = F.transform(F.filter(F.array_sort(names), lambda k: ~number(F.try_element_at(fields, k))), lambda k: F.concat(F.lit("no number "), k))
    parts = F.map_values(F.map_filter(fields, lambda k, x: k.isin("function_match", "staff_cap_delta", *FIT_POINTS)))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_variant_get(x, "$", "double"), F.lit(0.0)))
    unequal = F.when(F.try_variant_get(v, "$.raw_score", "double") != total, "sum is not the total")
    open_ = F.concat(unknown, F.array_compact(F.array(*missing)), odd, F.array_compact(F.array(unequal)))
    return F.when(fields.isNull(), F.array(F.lit("no object"))).when(blocker.isNotNull(), F.concat(unknown, F.array_compact(F.array(beside, code)))).otherwise(open_)
