"""Backfill of postings from tables that knew urls and role keys only, with every row accounted for.

A lineage is a url with a role's key. Each well-formed one becomes a posting; rows
that cannot be mapped go to an archive with a reason, never away. A url that passed
from lineage to lineage becomes aliases whose times follow one another. States and
events go to the posting of their role if it is the only one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ingest import entity_id

#: What a posting is first seen at if nothing says when.
IMPORTED_AT = "1970-01-01"


@dataclass
class Backfill:
    """postings (posting, url, seen_key, first_seen, last_seen); aliases (url, posting,
    valid_from, valid_to); versions (version, posting, kind, observed_at, tier, odds);
    memberships (run, posting, version, present, first_seen); states and events (their
    columns and posting, null if it is not one); archive (kind, locator, reason);
    candidates (kind, locator, posting): among what an archived row could not decide.
    """

    postings: DataFrame
    aliases: DataFrame
    versions: DataFrame
    memberships: DataFrame
    states: DataFrame
    events: DataFrame
    archive: DataFrame
    candidates: DataFrame


def _formed() -> Column:
    return (F.trim(F.coalesce("url", F.lit(""))) != "") & (F.trim(F.coalesce("seen_key", F.lit(""))) != "")


def _posting() -> Column:
    return entity_id(F.lit("lineage"), F.col("url"), F.col("seen_key"))


def _locator(*columns: str) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def lineages(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """(posting, url, seen_key, first_seen, last_seen): each well-formed lineage with the bounds of when it was observed."""
    seen = history.select("url", "seen_key", F.col("run_date").alias("at")).unionByName(jobs.select("url", "seen_key", F.explode(F.array("first_seen", "latest_run")).alias("at")))
    said = F.when(F.trim("at") != "", F.col("at"))
    by = seen.filter(_formed()).groupBy("url", "seen_key").agg(F.min(said).alias("first_seen"), F.max(said).alias("last_seen"))
    return by.select(_posting().alias("posting"), "url", "seen_key", F.coalesce("first_seen", F.lit(IMPORTED_AT)).alias("first_seen"), F.coalesce("last_seen", F.lit(IMPORTED_AT)).alias("last_seen"))


def backfilled(jobs: DataFrame, history: DataFrame, states: DataFrame, events: DataFrame) -> Backfill:
    """Maps everything.

    jobs (url, seen_key, tier, odds, first_seen, latest_run, present), a row a url;
    history (url, seen_key, run_date, tier, odds, present), a row a url and run; states
    (seen_key, ...), a row a key; events (id, seen_key, ...).
    """
    postings = lineages(jobs, history)
    by_url = Window.partitionBy("url").orderBy("first_seen", "last_seen", "seen_key", "posting")
    aliases = postings.select("url", "posting", F.col("first_seen").alias("valid_from"), F.lead("first_seen").over(by_url).alias("valid_to"))
    latest = postings.groupBy("url").agg(F.max("last_seen").alias("last_seen"))
    tied = postings.join(latest, ["url", "last_seen"]).groupBy("url").count().filter("count > 1")
    tied_among = postings.join(latest, ["url", "last_seen"]).join(tied, "url").select(F.lit("url").alias("kind"), F.col("url").alias("locator"), "posting")

    well = lambda df: df.filter(_formed()).withColumn("posting", _posting())
    current = well(jobs).withColumn("observed_at", F.coalesce(F.nullif("latest_run", F.lit("")), F.nullif("first_seen", F.lit("")))).join(postings.select("posting", "last_seen"), "posting")
    current = current.withColumn("observed_at", F.coalesce("observed_at", "last_seen")).withColumn("version", entity_id(F.lit("current"), F.col("posting"), F.to_json(F.struct(*[c for c in sorted(jobs.columns)]))))
    lines = well(history).withColumn("version", entity_id(F.lit("history"), F.col("posting"), F.to_json(F.struct(*[c for c in sorted(history.columns)]))))
    kept = lambda df, kind, at: df.select("version", "posting", F.lit(kind).alias("kind"), F.col(at).alias("observed_at"), "tier", "odds")
    versions = kept(current, "current", "observed_at").unionByName(kept(lines, "history", "run_date"))

    earliest = lines.groupBy("posting").agg(F.min("run_date").alias("earliest"))
    past = lines.join(earliest, "posting").select(F.col("run_date").alias("run"), "posting", "version", "present", (F.col("run_date") == F.col("earliest")).alias("first_seen"))
    now = current.select(F.col("observed_at").alias("run"), "posting", "version", "present").join(past.select("run", "posting"), ["run", "posting"], "left_anti")
    now = now.join(earliest, "posting", "left").select("run", "posting", "version", "present", F.col("earliest").isNull().alias("first_seen"))

    only = postings.groupBy("seen_key").agg(F.count("*").alias("n"), F.min("posting").alias("one"))

    def owned(rows: DataFrame) -> DataFrame:
        keyed = rows.filter("seen_key IS NOT NULL").join(only, "seen_key", "left").withColumn("posting", F.when(F.col("n") == 1, F.col("one"))).drop("n", "one")
        return keyed.unionByName(rows.filter("seen_key IS NULL").withColumn("posting", F.lit(None).cast("string")))

    mapped_states, mapped_events = owned(states), owned(events)
    lost = "the role's posting is not one"
    put = lambda df, kind, locator, reason: df.select(F.lit(kind).alias("kind"), locator.alias("locator"), F.lit(reason).alias("reason"))
    archive = put(jobs.filter(~_formed()), "jobs", _locator("url"), "malformed lineage").unionByName(put(history.filter(~_formed()), "history", _locator("url", "run_date"), "malformed lineage"))
    archive = archive.unionByName(put(tied, "url", F.col("url"), "lineages share the latest observation")).unionByName(put(mapped_states.filter("posting IS NULL"), "state", _locator("seen_key"), lost))
    archive = archive.unionByName(put(mapped_events.filter("posting IS NULL"), "event", _locator("id"), lost))
    several = postings.join(only.filter("n > 1").select("seen_key"), "seen_key").select("seen_key", "posting")
    among = lambda rows, kind, locator: rows.join(several, "seen_key").select(F.lit(kind).alias("kind"), locator.alias("locator"), "posting")
    candidates = tied_among.unionByName(among(states.select("seen_key"), "state", F.col("seen_key")))
    return Backfill(postings, aliases, versions, past.unionByName(now), mapped_states, mapped_events, archive, candidates)


def accounted(done: Backfill, jobs: DataFrame, history: DataFrame, states: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, received, mapped, archived): every row of every table is mapped or archived exactly once, or the numbers do not add up."""
    filed = done.archive.groupBy("kind").agg(F.count("*").alias("archived"))
    got = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    received = got(jobs, "jobs").unionByName(got(history, "history")).unionByName(got(states, "state")).unionByName(got(events, "event"))
    mapped = got(done.versions.filter("kind = 'current'"), "jobs").unionByName(got(done.versions.filter("kind = 'history'"), "history"))
    mapped = mapped.unionByName(got(done.states.filter("posting IS NOT NULL"), "state")).unionByName(got(done.events.filter("posting IS NOT NULL"), "event"))
    return received.withColumnRenamed("n", "received").join(mapped.withColumnRenamed("n", "mapped"), "kind").join(filed, "kind", "left").select("kind", "received", "mapped", F.coalesce("archived", F.lit(0)).alias("archived"))
