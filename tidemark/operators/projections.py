"""Read projections: one row a posting out of a dozen tables, each field from the first place that has it.

``light`` is the row of a list. What a current score says comes before what the
version has, all of its six fields together, null or not; a state is that of the
posting, else that of its url; pay, date, remoteness, first sight and other sources
are recovered where the version has none. A posting without a version has no row.
``detail`` adds the description and the skills that occur in it. ``scorer_rows`` is
what a scorer reads of a version.

Joins are on keys that are unique on the right side after a ``max_by``, so no row
is multiplied, and the widest column, the description's body, is cut to what a list
shows before it is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_value, salary_range, url_key

SNIPPET = 500
STATE = ["status", "notes", "follow_up_date", "applied_date", "starred", "hidden", "contact", "snoozed_until", "applied_via", "updated_at"]


@dataclass(frozen=True)
class Tables:
    """versions (posting, version, observed_at, and the fields of a posting), scores (version, tier, odds, odds_score, rationale, superseded_at), urls (posting, url, at), descriptions (posting, body, fetch_status, at),
    postings (posting, first_seen_at), aliases (posting, namespace), states (seen_key, posting, url, and STATE), events (seen_key, field, at), new (posting)."""

    versions: DataFrame
    scores: DataFrame
    urls: DataFrame
    descriptions: DataFrame
    postings: DataFrame
    aliases: DataFrame
    states: DataFrame
    events: DataFrame
    new: DataFrame


def _latest(df: DataFrame, key: str, fields: list[str], *order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r")).select(key, "r.*")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _flags(v: Column) -> Column:
    """Flags as text: a list joined, a text as it is."""
    return F.coalesce(F.array_join(F.try_variant_get(v, "$.flags", "array<string>"), ", "), _text(v, "$.flags"))


def light(t: Tables) -> DataFrame:
    """(posting, ...) the row of a list; ``state`` is null if there is none with a status."""
    fields = [c for c in t.versions.columns if c != "posting"]
    v = _latest(t.versions, "posting", fields, "observed_at", "version")
    score = t.scores.filter("superseded_at IS NULL").select("version", F.lit(True).alias("scored"), F.col("tier").alias("s_tier"), F.col("odds").alias("s_odds"), F.col("odds_score").alias("s_odds_score"), json_value(F.col("rationale")).alias("s_why"))
    url = _latest(t.urls, "posting", ["url"], "at", "url")
    desc = _latest(t.descriptions, "posting", ["body", "fetch_status"], "at").select("posting", F.substring("body", 1, SNIPPET).alias("d_snippet"), (F.coalesce("body", F.lit("")) != "").alias("d_has"), (F.col("fetch_status") == "available").alias("d_ok"))
    others = t.aliases.filter("namespace <> ''").groupBy("posting").agg(F.array_sort(F.collect_set("namespace")).alias("a_all"))
    since = t.events.filter("field = 'status'").groupBy("seen_key").agg(F.max("at").alias("status_since"))
    state = t.states.join(since, "seen_key", "left")
    whole = F.struct(*STATE, "status_since")
    own = state.filter("posting IS NOT NULL").groupBy("posting").agg(F.max_by(whole, "seen_key").alias("own_state"))
    by_url = state.filter("url IS NOT NULL").groupBy("url").agg(F.max_by(whole, "seen_key").alias("url_state"))
    new = t.new.select("posting", F.lit(True).alias("is_new")).distinct()
    rows = v.join(score, "version", "left").join(url, "posting", "left").withColumn("url", F.coalesce("url", F.lit("")))
    for side, key in ((desc, "posting"), (others, "posting"), (t.postings.select("posting", "first_seen_at"), "posting"), (own, "posting"), (by_url, "url"), (new, "posting")):
        rows = rows.join(side, key, "left")
    canonical = json_value(F.col("payload"))
    said = lambda field: _text(canonical, f"$.canonical.{field}")
    either = lambda scored, plain: F.when(F.col("scored"), scored).otherwise(F.col(plain))
    salary = F.coalesce("salary", said("salary"))
    parsed = salary_range(salary)
    no_pay = F.col("salary_min").isNull() & F.col("salary_max").isNull()
    rest = F.array_join(F.array_remove("a_all", F.coalesce("source", F.lit(""))), ", ")
    found = F.coalesce("own_state", "url_state")
    state_ = F.when(found["status"].isNotNull(), F.struct(found["status"].alias("status"), *[F.coalesce(found[c].cast("string"), F.lit("")).alias(c) if c in ("notes", "contact", "updated_at") else found[c].alias(c) for c in STATE[1:]], found["status_since"].alias("status_since")))
    return rows.select(
        "posting", "url", url_key(F.col("url")).alias("url_b64"), F.coalesce(either(F.col("s_tier"), "tier"), F.lit(0)).alias("tier"), either(F.col("s_odds"), "odds").alias("odds"), either(F.col("s_odds_score"), "odds_score").alias("odds_score"),
        either(_text(F.col("s_why"), "$.odds_why"), "odds_why").alias("odds_why"), F.coalesce("is_new", F.lit(False)).alias("is_new"), "title", "company", "location", salary.alias("salary"),
        F.when(no_pay, parsed["lo"]).otherwise(F.col("salary_min")).alias("salary_min"), F.when(no_pay, parsed["hi"]).otherwise(F.col("salary_max")).alias("salary_max"), F.coalesce("posted", F.nullif(said("posted_date"), F.lit(""))).alias("posted"),
        F.coalesce("first_seen", "first_seen_at").alias("first_seen"), F.coalesce(F.col("remote"), F.coalesce(said("remote") == "1", F.lit(False))).alias("remote"), "source", F.coalesce("also_seen_on", F.nullif(rest, F.lit(""))).alias("also_seen_on"), "req_id",
        either(_text(F.col("s_why"), "$.why"), "why").alias("why"), either(_flags(F.col("s_why")), "flags").alias("flags"), F.coalesce(F.nullif("desc_snippet", F.lit("")), F.when(F.col("d_has"), F.col("d_snippet")), "desc_snippet").alias("desc_snippet"),
        F.coalesce(F.col("d_ok") & F.col("d_has"), F.lit(False)).alias("has_desc"), state_.alias("state"),
    )


def detail(t: Tables, skills: list[str]) -> DataFrame:
    """Rows of ``light`` with the whole description and the skills it or the snippet holds, in their order, each once."""
    body = _latest(t.descriptions, "posting", ["body"], "at").withColumnRenamed("body", "full_desc")
    rows = light(t).join(body, "posting", "left")
    hay = F.lower(F.concat_ws("\n", F.coalesce("full_desc", F.lit("")), F.coalesce("desc_snippet", F.lit(""))))
    wanted = [s for s in dict.fromkeys(skills) if s.strip()]
    hits = F.array_compact(F.array(*[F.when(F.col("hay").contains(s.strip().lower()), s) for s in wanted], F.lit(None).cast("string")))
    return rows.withColumn("hay", hay).withColumn("skill_hits", hits).drop("hay")


def scorer_rows(versions: DataFrame) -> DataFrame:
    """What a scorer reads of each version: texts without nulls, zero pay as none, remoteness as a word, and no flags yet."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    pay = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.col(c).cast("string")).otherwise("").alias(c)
    remote = F.when(F.coalesce(F.col("remote"), F.lit(False)), "true").otherwise("false").alias("remote")
    return versions.select("version", text("title"), text("company"), text("location"), text("salary"), pay("salary_min"), pay("salary_max"), text("posted"), remote, text("source"), text("req_id"), F.lit("").alias("flags"))


def pass_mode(current: tuple[str, str], baseline: tuple[str, str] | None) -> tuple[str, list[str]]:
    """Whether a scoring pass must take everything, and why: without a completed pass before it, or if the profile or the scorer (in that order) is another one."""
    if baseline is None:
        return "full", ["no_baseline_pass"]
    reasons = [why for why, a, b in zip(("profile_changed", "scorer_changed"), current, baseline, strict=True) if a != b]
    return ("full" if reasons else "incremental"), reasons
