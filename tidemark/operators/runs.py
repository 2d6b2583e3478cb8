"""Ingest of exported runs: the current table, the history of runs, and the states that follow roles through new urls.

The latest run is the one that is present. Its rows replace what is known of their
urls, all other urls are absent, and fetched texts outlive both. A run's history is
replaced as a whole, so a run that is exported again leaves nothing stale behind;
where no run is known yet, the history of all exports is filled in first.

A state belongs to a role (its key), and its url only says where it is shown: a role
that is present takes its own present url, one that is not lets go of a url that
another present role has taken. Picks seed states of present roles that have none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import seen_key, surrogate_url, whole_number
from ..sources.scratch import written

#: Columns of an export, besides the date of its run.
TEXTS = ["odds", "odds_why", "title", "company", "location", "salary", "posted", "first_seen", "source", "also_seen_on", "req_id", "why", "flags", "desc_snippet"]
NUMBERS = ["odds_score", "salary_min", "salary_max"]
COLUMNS = ["url", "tier", "remote", "new", *TEXTS, *NUMBERS]

FIELDS = ["seen_key", "tier", "remote", "is_new", *TEXTS, *NUMBERS, "latest_run"]
JOBS = "url string, seen_key string, tier long, remote boolean, is_new boolean, " + ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} long" for c in NUMBERS)]) + ", latest_run string, present boolean, full_desc string"
HISTORY = "url string, run_date string, seen_key string, tier long, odds string, present boolean"
RUNS = "run_date string, kept long, new_this_run long, report string, source_health string"
STATES = "seen_key string, url string, status string, notes string, starred boolean, updated_at string"
EVENTS = "seen_key string, url string, field string, old_value string, new_value string, at string, source string"


@dataclass
class Book:
    """The tables that runs are ingested into."""

    jobs: DataFrame
    history: DataFrame
    runs: DataFrame
    states: DataFrame
    events: DataFrame

    def written(self) -> Book:
        """The same tables, written. A book is lazy until then: write it before exports change or another run is ingested into it."""
        return Book(*(written(df, "book") for df in (self.jobs, self.history, self.runs, self.states, self.events)))

    @classmethod
    def empty(cls, spark: SparkSession) -> Book:
        return cls(*(spark.createDataFrame([], s) for s in (JOBS, HISTORY, RUNS, STATES, EVENTS)))


def _new() -> Column:
    return F.upper(F.trim("new")) == "NEW"


def rows_of(exports: DataFrame) -> DataFrame:
    """Exported rows with their role's key, an address of their own where they have none, and empty cells as null."""
    key = seen_key(F.col("company"), F.col("title"), F.col("location"))
    rows = exports.withColumn("seen_key", key)
    return rows.select(
        "run_date", "place", surrogate_url(F.col("url"), F.col("seen_key")).alias("url"), "seen_key", F.coalesce(whole_number(F.trim("tier")), F.lit(0)).alias("tier"), (F.lower(F.trim("remote")) == "true").alias("remote"), _new().alias("is_new"),
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in TEXTS], *[whole_number(F.trim(c)).alias(c) for c in NUMBERS], F.col("run_date").alias("latest_run"),
    )


def _healed(states: DataFrame, present: DataFrame) -> DataFrame:
    """States with the urls they are shown at; nothing else of them changes."""
    own = present.groupBy("seen_key").agg(F.min("url").alias("own"))
    taken = present.select(F.col("url").alias("at"), F.lit(True).alias("taken")).distinct()
    rows = states.join(own, "seen_key", "left").withColumn("at", F.coalesce("url", F.concat(F.lit("none of "), "seen_key"))).join(taken, "at", "left")
    url = F.when(F.col("own").isNotNull(), F.col("own")).when(~F.coalesce("taken", F.lit(False)), F.col("url"))
    return rows.select("seen_key", url.alias("url"), "status", "notes", "starred", "updated_at")


def ingested(book: Book, exports: DataFrame, at: str, picks: DataFrame | None = None, descriptions: Callable[[DataFrame], DataFrame] | None = None, report: tuple[str, str] | None = None, health: str | None = None) -> Book:
    """The tables after the latest of the exported runs; without exports they stay as they are.

    exports: ``scans.dated_csv(..., COLUMNS, placed=True)``. Of a url that a run has
    twice the last row counts. picks (url, reason, place): the first one of a role
    counts. ``descriptions`` takes the urls (url) that are present without a text and
    gives (url, desc). ``report`` is (date, JSON) and belongs to the run of its date;
    so does ``health`` when history is filled in, the latest run has it always.
    """
    latest = exports.agg(F.max("run_date")).first()[0]
    if latest is None:
        return book
    rows = rows_of(exports if book.runs.isEmpty() else exports.filter(F.col("run_date") == latest))
    is_latest = F.col("run_date") == latest

    counted = rows.groupBy("run_date").agg(F.count("*").alias("kept"), F.count_if("is_new").alias("new_this_run"))
    reported = F.col("run_date") == (report[0] if report else None)
    counted = counted.select("run_date", "kept", "new_this_run", F.when(reported, F.lit(report[1] if report else None)).alias("report"), F.when(is_latest | reported, F.lit(health)).alias("source_health"))
    runs = book.runs.join(counted, "run_date", "left_anti").unionByName(counted)

    # the last row of a file by its number alone, which needs no sort of whole rows; then the last one of the files, and only that one's fields
    ends = rows.groupBy("url", "run_date", F.col("place.file_path").alias("file_path")).agg(F.max("place.row").alias("row"))
    ends = written(ends.groupBy("url", "run_date").agg(F.max(F.struct("file_path", "row")).alias("place")), "runs-ends")
    tops = exports.join(ends.select("run_date", "place"), ["run_date", "place"], "left_semi")
    tops = written(rows_of(tops).select("url", "run_date", F.struct(*FIELDS).alias("new")), "runs-last")
    lines = tops.select("url", "run_date", "new.seen_key", "new.tier", "new.odds", F.lit(True).alias("present"))
    history = book.history.join(F.broadcast(counted.select("run_date")), "run_date", "left_anti").unionByName(lines)  # a row a run

    last = tops.filter(is_latest).select("url", "new")
    both = book.jobs.select("url", F.struct(*FIELDS).alias("old"), "full_desc").join(last, "url", "full")
    here = F.col("new").isNotNull()
    jobs = both.select("url", F.when(here, F.col("new")).otherwise(F.col("old")).alias("r"), here.alias("present"), "full_desc").select("url", "r.*", "present", "full_desc")
    if descriptions is not None:
        found = descriptions(jobs.filter("present AND full_desc IS NULL").select("url")).select("url", "desc")
        open_ = F.col("present") & F.col("full_desc").isNull()
        jobs = jobs.join(found, "url", "left").withColumn("full_desc", F.when(open_, F.col("desc")).otherwise(F.col("full_desc"))).drop("desc")

    present = last.select("url", "new.seen_key")
    states, events = _healed(book.states, present), book.events
    if picks is not None:
        chosen = picks.select(F.trim("url").alias("url"), F.trim(F.coalesce("reason", F.lit(""))).alias("reason"), "place").join(present, "url").join(states.select("seen_key"), "seen_key", "left_anti")
        first = chosen.groupBy("seen_key").agg(F.min_by(F.struct("url", "reason"), "place").alias("p"))
        notes = F.when(F.col("p.reason") != "", F.concat(F.lit("[pick] "), "p.reason")).otherwise("[pick]")
        seeded = first.select("seen_key", "p.url", F.lit("Interested").alias("status"), notes.alias("notes"), F.lit(True).alias("starred"), F.lit(at).alias("updated_at"))
        changes = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("new_value")) for f, v in (("status", F.col("status")), ("notes", F.col("notes")), ("starred", F.lit("1")))])
        made = seeded.select("seen_key", "url", F.explode(changes).alias("c")).select("seen_key", "url", "c.field", F.lit(None).cast("string").alias("old_value"), "c.new_value", F.lit(at).alias("at"), F.lit("ingest:picks").alias("source"))
        states, events = states.unionByName(seeded), events.unionByName(made)
    return Book(jobs, history, runs, states, events)
