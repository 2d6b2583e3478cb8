"""Snapshots of served queues: what was shown, enriched with what was known then, and the claims that it makes.

A snapshot is a header and items in rank order. A field of an item is the one that
the caller names, else the current score's, else the latest version's. Version and
score of an item never describe different contents: with a named version only its
scores count, without one the winning score brings its own version, and only an
unscored posting falls back to its latest version.

A snapshot with anything wrong in it is refused as a whole, with its reasons; an
empty one is valid, as an empty queue is a fact too. Every item with a version and a
profile makes a claim whose id follows from (posting, profile, version, score), so a
claim is written once, by the snapshot that made it first, and never changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import odds_parts, role_family
from ..sources.ledger import Ledger
from ..sources.scratch import dropped, written

HEADERS = "snapshot string, surface string, at string, profile string, scorer string, queue_size long"
ITEMS = "snapshot string, rank int, posting string, version string, score string, title string, company string, source string, tier int, odds string, odds_score int"
STORED = "snapshot string, rank int, claim string, posting string, version string, score string, tier int, odds string, odds_score int, source string, category string, match_label string, competition_label string, role_family string, title string, company string"
CLAIMS = "claim string, posting string, version string, profile string, score string, at string, body string"

_SCORE = ["score", "version", "tier", "odds", "odds_score", "scorer"]
_VERSION = ["version", "title", "company", "source", "tier", "odds", "odds_score"]


@dataclass
class Known:
    """What snapshots are enriched from.

    postings (posting); versions (version, posting, observed_at, title, company,
    source, tier, odds, odds_score); scores (score, version, posting or null,
    created_at, superseded_at, tier, odds, odds_score, scorer); descriptions
    (description, version, fetched_at, body).
    """

    postings: DataFrame
    versions: DataFrame
    scores: DataFrame
    descriptions: DataFrame


@dataclass
class Capture:
    """The rows to write, the refused snapshots with their reasons, and the table that the rows are read from."""

    snapshots: DataFrame
    items: DataFrame
    claims: DataFrame
    refused: DataFrame
    scratch: DataFrame

    def forget(self) -> None:
        """Deletes the tables behind it, once all that reads it is written."""
        dropped(self.refused)
        dropped(self.scratch)


def _best(df: DataFrame, key: str, fields: list[str], *order: str) -> DataFrame:
    """(key, best): the fields of each key's last row."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("best"))


def refusals(headers: DataFrame, items: DataFrame, known: Known) -> DataFrame:
    """(snapshot, reasons): each snapshot that cannot be written, with all that is wrong in it, sorted."""
    named = items.filter("version IS NOT NULL").select("snapshot", "posting", "version")
    scored = items.filter("score IS NOT NULL").select("snapshot", "score")
    wrong = [
        headers.filter("queue_size < 0").select("snapshot", F.lit("negative queue size").alias("reason")),
        items.join(headers, "snapshot", "left_anti").select("snapshot", F.lit("no header").alias("reason")),
        items.filter("coalesce(posting, '') = ''").select("snapshot", F.lit("no posting").alias("reason")),
        items.filter("rank IS NULL OR rank < 1").select("snapshot", F.lit("rank is not positive").alias("reason")),
        items.filter("rank IS NOT NULL").groupBy("snapshot", "rank").count().filter("count > 1").select("snapshot", F.lit("repeated rank").alias("reason")),
        items.filter("posting <> ''").groupBy("snapshot", "posting").count().filter("count > 1").select("snapshot", F.lit("repeated posting").alias("reason")),
        items.filter("posting <> ''").join(known.postings, "posting", "left_anti").select("snapshot", F.lit("unknown posting").alias("reason")),
        named.join(known.versions.select("posting", "version"), ["posting", "version"], "left_anti").select("snapshot", F.lit("version of another posting").alias("reason")),
        scored.join(known.scores.select("score"), "score", "left_anti").select("snapshot", F.lit("unknown score").alias("reason")),
    ]
    out = wrong[0]
    for one in wrong[1:]:
        out = out.unionByName(one)
    return out.groupBy("snapshot").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def enriched(items: DataFrame, known: Known, categories: dict[str, str], families: dict[str, list[str]]) -> DataFrame:
    """Items with all their fields, and the scorer of the score that won (``scorer``)."""
    current = known.scores.filter("superseded_at IS NULL")
    by_version = _best(current, "version", _SCORE, "created_at", "score").withColumnRenamed("best", "s")
    of_version = current.drop("posting").join(known.versions.select("version", "posting"), "version")
    by_posting = _best(current.unionByName(of_version), "posting", _SCORE, "created_at", "score").withColumnRenamed("best", "s")
    latest = _best(known.versions, "posting", _VERSION, "observed_at", "version").withColumnRenamed("best", "v")
    # two joins, so that items without a version do not meet on a null key
    named = items.filter("version IS NOT NULL").join(by_version, "version", "left")
    free = items.filter("version IS NULL").join(by_posting, "posting", "left")
    rows = named.unionByName(free).join(latest, "posting", "left")
    rows = rows.select(
        "snapshot", "rank", "posting", F.coalesce("version", "s.version", "v.version").alias("version"), F.coalesce("score", "s.score").alias("score"),
        *[F.coalesce(c, f"v.{c}").alias(c) for c in ("title", "company", "source")], *[F.coalesce(c, f"s.{c}", f"v.{c}").alias(c) for c in ("tier", "odds", "odds_score")], F.col("s.scorer").alias("scorer"),
    )
    bodies = _best(known.descriptions, "version", ["body"], "fetched_at", "description").select(F.col("version").alias("of"), F.col("best.body").alias("body"))
    rows = rows.withColumn("of", F.coalesce("version", F.concat(F.lit("no version of "), "posting"))).join(bodies, "of", "left").drop("of")
    match, competition = odds_parts(F.col("odds"))
    kinds = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]) if categories else F.create_map().cast("map<string,string>")
    return rows.withColumns({
        "match_label": match, "competition_label": competition, "category": F.try_element_at(kinds, F.split(F.coalesce("source", F.lit("")), ":")[0]), "role_family": role_family(F.col("title"), F.col("body"), families),
    }).drop("body")


def claim_id(profile: Column) -> Column:
    """The id of an item's claim; null without a version or a profile."""
    parts = F.array(F.lit("queue-recommendation"), F.col("posting"), profile, F.col("version"), F.coalesce("score", F.lit("")))
    return F.when(F.col("version").isNotNull() & profile.isNotNull(), F.sha2(F.to_json(parts), 256))


def captured(headers: DataFrame, items: DataFrame, known: Known, claims: DataFrame, categories: dict[str, str], families: dict[str, list[str]]) -> Capture:
    """A batch of snapshots; ``claims`` are those on file. A header without a scorer gets the one that all its scored items share, without a queue size the number of its items."""
    refused = written(refusals(headers, items, known), "snapshot-refusals")
    heads = headers.join(refused, "snapshot", "left_anti")
    rows = enriched(items.join(refused, "snapshot", "left_anti"), known, categories, families)
    rows = rows.join(heads.select("snapshot", "profile", "at"), "snapshot").withColumn("claim", claim_id(F.col("profile")))
    rows = written(rows, "snapshot-items")
    per = rows.groupBy("snapshot").agg(F.count("*").alias("n"), F.min("scorer").alias("low"), F.max("scorer").alias("high"))
    snapshots = heads.join(per, "snapshot", "left").select(
        "snapshot", "surface", "at", "profile", F.coalesce("scorer", F.when(F.col("low") == F.col("high"), F.col("low"))).alias("scorer"), F.coalesce("queue_size", "n", F.lit(0)).cast("long").alias("queue_size")
    )
    names = [f.split()[0] for f in STORED.split(", ")]
    body = F.to_json(F.struct(*sorted(n for n in names if n not in ("snapshot", "rank", "claim"))), {"ignoreNullFields": "false"})
    first = rows.filter("claim IS NOT NULL").groupBy("claim").agg(F.min_by(F.struct("posting", "version", "profile", "score", "at", body.alias("body")), F.struct("at", "snapshot", "rank")).alias("c"))
    new = first.select("claim", "c.*").join(claims.select("claim"), "claim", "left_anti")
    return Capture(snapshots, rows.select(*names), new, refused, rows)


def stored(ledger: Ledger, batch: str, headers: DataFrame, items: DataFrame, known: Known, categories: dict[str, str], families: dict[str, list[str]]) -> dict | None:
    """Writes a batch of snapshots under one commit; a batch that comes again changes nothing, and None is returned."""
    if "snapshots" in ledger.applied(batch):
        return None
    base = ledger.version()
    c = captured(headers, items, known, ledger.read("claims", CLAIMS, base), categories, families)
    entry = ledger.commit(batch, {"snapshots": {"snapshots": c.snapshots, "items": c.items, "claims": c.claims}}, base)
    c.forget()
    return entry
