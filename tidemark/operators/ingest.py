"""Ingest by identity claims: records become postings, aliases, versions, memberships and conflicts.

A record names itself by claims in order of their rank. Rank 0, a source's own id,
decides alone if there is one; other records take the entity of their first claim
that is known. What is known are the aliases from before, and those that earlier
records of the batch mint: a claim without an alias gets one from the first record
that holds it. So a record may be resolved by a claim that another one of its
batch has just minted, and that one by a third.

None of this needs records one after another. Whether a claim is known to a record
depends on the claim alone: on the aliases before, or on the smallest record that
holds it. So each record either has an entity at once, or points to one earlier
record, whose entity it shares; these pointers form a forest, which is resolved by
doubling them, over the open records only. A claim that leads to another entity
than its record's is a conflict: it is kept as evidence, and nothing is merged.

Content is kept per source: what a namespace last said of an entity is one entry of
the entity's state, and only that namespace moves it. A version is a content once,
however often the state comes back to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.ledger import Ledger
from ..sources.scratch import dropped, written

RECORDS = "record long, namespace string, content string, claims array<struct<rank: int, claim: string>>"
POSTINGS = "posting string, run string, at string"
ALIASES = "claim string, posting string, rank int, confidence double, source_run string, at string"
CONFLICTS = "evidence string, posting string, other string, claim string, rank int, content string, source_run string, at string"
VERSIONS = "version string, posting string, content string, alias string, run string, source_run string, at string"
STATES = "posting string, namespace string, version string, step long"
MEMBERSHIPS = "run string, posting string, version string, content string, source string, source_run string, first_seen boolean, state string, at string, step long"
OUTCOMES = "batch string, received long, accepted long, created long, duplicates long, skipped long, conflicts long, changed long"


def entity_id(*parts: str | Column) -> Column:
    """A deterministic id, so that a repeated batch comes to the same one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def claimed(records: DataFrame) -> DataFrame:
    """(record, claim, rank, at): the claims of a record with their places; empty ones are none."""
    return records.select("record", F.posexplode("claims").alias("at", "c")).select("record", "c.claim", "c.rank", "at").filter("claim <> ''")


@dataclass
class Resolution:
    """places (record, posting, via, basis, conflicts); facts (record, claim, rank, first, posting, other), a row a claim, ``other`` being who has it already. Both have what else was given of records."""

    places: DataFrame
    facts: DataFrame

    def minted(self) -> DataFrame:
        """(claim, posting, rank) of the aliases that the batch makes."""
        return self.facts.filter("other IS NULL").select("claim", "posting", "rank").distinct()

    def conflicts(self) -> DataFrame:
        return self.facts.filter("other <> posting").drop("first")


def _placed(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims, each once a record, with what is known of them (claim, first, owner, minter), the place of their record's first claim (``head``) and of the known one that decides (``best``)."""
    rows = claims.join(known, "claim").repartition("record")  # all that follows is done where a record's claims are
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("record", "claim").orderBy("rank", "at"))).filter("n = 1").drop("n")
    place, hit, by = F.struct("rank", "at", "claim", "first", "owner", "minter"), F.col("owner").isNotNull() | (F.col("first") < F.col("record")), Window.partitionBy("record")
    rows = rows.select("*", F.min(place).over(by).alias("head"), F.min(F.when(hit, place)).over(by).alias("hit"))
    return rows.withColumn("best", F.when((F.col("head.rank") > 0) | (F.col("hit.claim") == F.col("head.claim")), F.col("hit"))).drop("hit")


_IS_HEAD = "rank = head.rank AND at = head.at AND claim = head.claim"


def resolved(claims: DataFrame, aliases: DataFrame, said: DataFrame | None = None) -> Resolution:
    """Entities of a batch's records from their claims (record, claim, rank, at), given the aliases (claim, posting) from before. ``said`` has further columns of records, which go with them.

    Only records that are the first ones of a claim are pointed to, so these are
    resolved first, and of the others each is dealt out by its claims and once more
    by its id.
    """
    known = claims.groupBy("claim").agg(F.min("record").alias("first")).join(aliases.select("claim", F.col("posting").alias("owner")), "claim", "left")
    known = written(known, "claims")
    ahead = known.filter("owner IS NULL").select(F.col("first").alias("record")).distinct()
    minted = F.when(F.col("best").isNull(), entity_id("head.claim"))
    start = _placed(claims.join(ahead, "record", "left_semi"), known.withColumn("minter", F.lit(None).cast("string"))).filter(_IS_HEAD)
    start = start.select("record", F.coalesce(minted, "best.owner").alias("posting"), F.when(F.col("best.owner").isNull(), F.col("best.first")).alias("parent"))
    start = written(start, "claims-start")
    open_ = written(start.filter("posting IS NULL").select("record", "parent"), "claims-open")
    while True:  # a pointer to an open record becomes that one's pointer, until all lead to records with an entity
        up = open_.select(F.col("record").alias("parent"), F.col("parent").alias("next"))
        moved = written(open_.join(up, "parent", "left").select("record", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("went")), "claims-open")
        dropped(open_)
        open_ = moved.drop("went")
        open_.written_to = moved.written_to
        if moved.filter("went").isEmpty():
            break
    ends = start.filter("posting IS NOT NULL").select("record", "posting")
    ends = ends.unionByName(open_.join(ends.withColumnRenamed("record", "parent"), "parent").select("record", "posting"))
    held = known.join(ends.select(F.col("record").alias("first"), F.col("posting").alias("minter")), "first", "left")
    held = written(held.select("claim", "first", "owner", F.when(F.col("owner").isNull(), F.col("minter")).alias("minter")), "claims-held")

    other = F.coalesce("owner", F.when(F.col("first") < F.col("record"), F.col("minter")))
    facts = _placed(claims, held).select("*", F.coalesce(minted, "best.owner", "best.minter").alias("posting"), other.alias("other"))
    facts = facts.withColumn("conflicts", F.count_if(F.col("other") != F.col("posting")).over(Window.partitionBy("record")))
    basis = F.when(F.col("best").isNull(), "minted").when(F.col("best.owner").isNotNull(), "known").otherwise("batch")
    at_head = {"via": F.coalesce("best.claim", "head.claim"), "basis": basis, "conflicts": F.col("conflicts")}  # a record's own are in the row of its first claim
    facts = facts.select("record", "claim", "rank", "first", "posting", "other", *[F.when(F.expr(_IS_HEAD), c).alias(n) for n, c in at_head.items()])
    facts = written(facts if said is None else facts.join(said, "record"), "claims-facts")
    return Resolution(facts.filter("basis IS NOT NULL").drop("claim", "rank", "first", "other"), facts.drop("via", "basis", "conflicts"))


class Writer:
    """Writes batches of records into the tables of a ledger, each batch once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.ledger = spark, Ledger(spark, path)

    def states(self, version: int | None = None) -> DataFrame:
        """(posting, namespace, version): what each namespace said last."""
        return self.ledger.read("states", STATES, version).groupBy("posting", "namespace").agg(F.max_by("version", "step").alias("version"))

    def memberships(self, version: int | None = None) -> DataFrame:
        """A row a run and posting, as of its last delivery."""
        rows = self.ledger.read("memberships", MEMBERSHIPS, version)
        last = rows.groupBy("run", "posting").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("run", "posting"))), "step").alias("m"))
        return last.select("run", "posting", "m.*")

    def write(self, batch: str, records: DataFrame, run: str, source: str, source_run: str, at: str) -> dict | None:
        """Applies a batch (``RECORDS``) that one attempt of a source delivered in a run; None if it was applied before.

        A posting has one membership a run. A second delivery moves its version,
        content, state and time to the last record's; it is attributed to the new
        attempt if the old one was of the same source, else to the old one. Records
        without a claim are skipped.
        """
        base = self.ledger.version()
        if "records" in self.ledger.applied(batch):
            return None
        step, stamp = F.lit(base + 1).cast("long"), F.lit(at)
        records = written(records.select("record", "namespace", "content", "claims"), "ingest-records")
        found = resolved(claimed(records), self.ledger.read("aliases", ALIASES, base), records.drop("claims"))
        created = found.places.filter("basis = 'minted'").select("posting").distinct().join(self.ledger.read("postings", POSTINGS, base), "posting", "left_anti")
        created = written(created, "ingest-created")

        touched = written(found.places.select("posting").distinct(), "ingest-touched")
        before = written(self.states(base).join(touched, "posting", "left_semi"), "ingest-states")
        rows = found.places.drop("basis", "conflicts").join(before.withColumnRenamed("version", "old"), ["posting", "namespace"], "left")
        by = Window.partitionBy("posting", "namespace").orderBy("record")
        version = entity_id("posting", "content")  # contents of a posting are the same if and only if their versions are, so ids are only made of those that are kept
        same = F.when(F.row_number().over(by) == 1, F.col("old").eqNullSafe(version)).otherwise(F.lag("content").over(by).eqNullSafe(F.col("content")))
        rows = rows.withColumns({"moved": ~same, "last": F.row_number().over(by) == F.count("*").over(Window.partitionBy("posting", "namespace"))})
        rows = written(rows.filter("moved OR last").drop("old"), "ingest-rows")

        moved = rows.filter("moved")
        versions = moved.groupBy("posting", "content").agg(F.min(F.struct("record", "via")).alias("v")).withColumn("version", version).join(self.ledger.read("versions", VERSIONS, base).select("version"), "version", "left_anti")
        last = written(rows.filter("last").select("posting", "namespace", "content", "record", version.alias("version")), "ingest-last")
        states = last.select("posting", "namespace", "version").join(before, ["posting", "namespace", "version"], "left_anti")
        whole = before.join(last, ["posting", "namespace"], "left_anti").select("posting", "namespace", "version").unionByName(last.select("posting", "namespace", "version"))
        state = whole.groupBy("posting").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("namespace", "version"))))).alias("state"))

        old = self.memberships(base).filter(F.col("run") == run).join(touched, "posting", "left_semi")
        old = written(old.select("posting", F.col("source").alias("old_source"), F.col("source_run").alias("old_run"), F.col("first_seen").alias("old_first")), "ingest-old")
        now = last.groupBy("posting").agg(F.max_by(F.struct("version", "content"), "record").alias("r")).join(state, "posting").join(old, "posting", "left").join(created.withColumn("new", F.lit(True)), "posting", "left")
        keeps = F.col("old_source").isNotNull() & (F.col("old_source") != source)
        memberships = now.select(
            F.lit(run).alias("run"), "posting", "r.version", "r.content", F.when(keeps, F.col("old_source")).otherwise(F.lit(source)).alias("source"), F.when(keeps, F.col("old_run")).otherwise(F.lit(source_run)).alias("source_run"),
            F.coalesce("old_first", "new", F.lit(False)).alias("first_seen"), "state", stamp.alias("at"), step.alias("step"),
        )

        # counted by what an evidence is made of, so that rows that are alike meet before they are dealt out
        conflicts = written(found.conflicts().groupBy("claim", "posting", "other", "namespace", "content").agg(F.min("rank").alias("rank"), F.count("*").alias("n")), "ingest-conflicts")
        evidence = conflicts.select(entity_id("claim", "posting", "other", "namespace", "content").alias("evidence"), "posting", "other", "claim", "rank", "content", F.lit(source_run).alias("source_run"), stamp.alias("at"))
        evidence = evidence.dropDuplicates(["evidence"]).join(self.ledger.read("conflicts", CONFLICTS, base).select("evidence"), "evidence", "left_anti")

        usable, accepted = found.places.count(), touched.join(old, "posting", "left_anti").count()
        counts = {
            "received": records.count(), "accepted": accepted, "created": created.count(), "duplicates": usable - accepted, "skipped": 0, "conflicts": conflicts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0],
            "changed": moved.select("posting").distinct().count(),
        }
        counts["skipped"] = counts["received"] - usable
        confidence = F.when(F.col("rank") == 0, 1.0).otherwise(0.5)
        tables = {
            "postings": created.select("posting", F.lit(run).alias("run"), stamp.alias("at")),
            "aliases": found.minted().select("claim", "posting", "rank", confidence.alias("confidence"), F.lit(source_run).alias("source_run"), stamp.alias("at")),
            "versions": versions.select("version", "posting", "content", F.col("v.via").alias("alias"), F.lit(run).alias("run"), F.lit(source_run).alias("source_run"), stamp.alias("at")),
            "states": states.withColumn("step", step),
            "memberships": memberships,
            "conflicts": evidence,
            "outcomes": self.spark.createDataFrame([(batch, *counts.values())], OUTCOMES),
        }
        entry = self.ledger.commit(batch, {"records": tables}, base)
        return None if entry is None else counts
