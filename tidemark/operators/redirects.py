"""Redirects accepted one after another, each against what the ones before have made of the graph.

A record asks that ``src`` redirect to where ``dst`` ends. It is

* ``cyclic`` if src or dst lead into a cycle that was there before,
* ``closing`` if dst already ends at src, so the redirect would close a cycle,
* ``conflicting`` if src redirects already and ends elsewhere than dst,
* ``repeated`` if src ends where dst does and the record was there before, with that end,
* ``disputed`` if the record was there before, with another end,
* else ``mapped``.

Only records that find src without a redirect add one, so of each source the first
record that does not close a cycle counts. Which one that is does not need records
one after another: take each source's first record; of every cycle that these form,
the latest record is the one that would have closed it, all its others stand. Its
source stays an end past that time, so what leads to it by older redirects leads to
it at the time of its later records too: of these, all that ask for such a node are
refused at once. Repeat with what is left until there is no cycle.

What a record finds is the graph of its time: paths end at the first redirect that
is as late as the record. Pointers are doubled with the latest redirect on their
way, and a record takes those of its node whose way is older than itself, the
longest first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .resolve import redirect_closure, rings

ALWAYS = -1


def _rooted(forest: DataFrame) -> DataFrame:
    """(dst, src, latest): where each node that has a redirect ends in a graph without cycles, and the latest redirect on its way."""
    open_, done = written(forest.select("src", "dst", F.col("at").alias("latest"), F.lit(True).alias("on")), "redirects-open"), []
    while not open_.isEmpty():
        known = reduce(DataFrame.unionByName, [open_, *done]).select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("latest").alias("further"), F.col("on").alias("goes"))
        moved = open_.join(known, "dst", "left").select("src", F.coalesce("next", "dst").alias("dst"), F.greatest("latest", "further").alias("latest"), F.coalesce("goes", F.lit(False)).alias("on"))
        moved = written(moved, "redirects-moved")
        done.append(moved.filter("NOT on"))
        open_ = moved.filter("on")
    return reduce(DataFrame.unionByName, done or [open_]).select(F.col("src").alias("dst"), F.col("dst").alias("src"), "latest")


def _accepted(records: DataFrame) -> DataFrame:
    """(at, src, dst) of the records that add a redirect, of sources that have none."""
    todo = written(records.filter("src <> dst").groupBy("src", "dst").agg(F.min("at").alias("at")), "redirects-asked")  # what was refused once is refused again
    while True:
        first = written(todo.groupBy("src").agg(F.min_by(F.struct("at", "dst"), "at").alias("r")).select("src", "r.at", "r.dst"), "redirects-first")
        ring = rings(first).join(first, "src")
        ends = written(ring.groupBy("cycle_id").agg(F.max_by("src", "at").alias("src")).select("src"), "redirects-latest")
        if ends.isEmpty():
            return first
        ways = _rooted(first.join(ends, "src", "left_anti")).join(ends, "src", "left_semi")
        refused = todo.join(ways, ["src", "dst"]).filter("latest < at").select("src", "dst")
        todo = written(todo.join(refused, ["src", "dst"], "left_anti"), "redirects-asked")


def _lifted(edges: DataFrame) -> list[DataFrame]:
    """Pointers of 1, 2, 4, ... steps (node, to, latest), ``latest`` being the latest redirect on the way."""
    levels = [written(edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("at").alias("latest")), "redirects-steps")]
    while True:
        low = levels[-1]
        high = low.select(F.col("node").alias("to"), F.col("to").alias("end"), F.col("latest").alias("further"))
        more = written(low.join(high, "to").select("node", F.col("end").alias("to"), F.greatest("latest", "further").alias("latest")), "redirects-steps")
        if more.isEmpty():
            return levels
        levels.append(more)


def _ends(asked: DataFrame, node: str, levels: list[DataFrame]) -> DataFrame:
    """asked with ``node`` led to where it ended at the time of the record."""
    for level in reversed(levels):
        step = level.select(F.col("node").alias(node), F.col("to").alias("_to"), F.col("latest").alias("_latest"))
        asked = asked.join(step, node, "left").withColumn(node, F.when(F.col("_latest") < F.col("at"), F.col("_to")).otherwise(F.col(node))).drop("_to", "_latest")
    return asked


def imported(records: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of records (at, src, dst, content), ``at`` being their order, from 0: (at, outcome, end), and the redirects (src, dst) they add to ``known``.

    ``content`` tells whether two records are the same one. Records with a null
    ``src`` or ``dst`` are ``unresolved``.
    """
    whole = records.filter("src IS NOT NULL AND dst IS NOT NULL")
    before = redirect_closure(known.select("src", "dst")).select("src", "in_cycle")
    bad = written(before.filter("in_cycle").select(F.col("src").alias("node")), "redirects-cyclic")
    cyclic = whole.join(bad.select(F.col("node").alias("src")), "src", "left_semi").select("at").union(whole.join(bad.select(F.col("node").alias("dst")), "dst", "left_semi").select("at")).distinct()
    cyclic = written(cyclic, "redirects-cyclic")
    sound = whole.join(cyclic, "at", "left_anti")

    # redirects from before are part of every path, and their sources take no new one
    good = written(known.select("src", "dst").join(bad.select(F.col("node").alias("src")), "src", "left_anti").withColumn("at", F.lit(ALWAYS).cast("long")), "redirects-known")
    ends = redirect_closure(good, "src", "dst").select(F.col("src").alias("node"), "terminal")
    free = sound.join(good.select("src"), "src", "left_anti").join(ends.withColumnRenamed("node", "dst"), "dst", "left")
    added = _accepted(free.select("at", "src", F.coalesce("terminal", "dst").alias("dst")))
    levels = _lifted(good.select("at", "src", "dst").unionByName(added.select(F.col("at").cast("long").alias("at"), "src", "dst")))

    asked = sound.withColumns({"src_end": F.col("src"), "dst_end": F.col("dst")})
    asked = _ends(_ends(asked, "src_end", levels), "dst_end", levels)
    closing = (F.col("dst_end") == F.col("src")) & (F.col("src") != F.col("dst"))
    bound = F.col("src_end") != F.col("src")
    conflicting = (F.col("src") != F.col("dst_end")) & bound & (F.col("src_end") != F.col("dst_end"))
    asked = asked.withColumn("outcome", F.when(closing, "closing").when(conflicting, "conflicting"))
    asked = written(asked.select("at", "content", "outcome", F.col("dst_end").alias("end")), "redirects-found")
    evident = asked.filter("outcome IS NULL")
    first = evident.groupBy("content").agg(F.min_by("end", "at").alias("owner"), F.min("at").alias("first"))
    fresh = evident.join(first, "content")
    adds = added.select("at", F.lit(True).alias("adds"))
    judged = fresh.join(adds, "at", "left").select("at", F.when(F.col("at") == F.col("first"), "mapped").when(F.col("end") != F.col("owner"), "disputed").when(F.col("adds"), "mapped").otherwise("repeated").alias("outcome"), "end")
    rest = asked.filter("outcome IS NOT NULL").select("at", "outcome", "end")
    out = judged.unionByName(rest).unionByName(cyclic.select("at", F.lit("cyclic").alias("outcome"), F.lit(None).cast(dict(asked.dtypes)["end"]).alias("end")))
    unresolved = records.filter("src IS NULL OR dst IS NULL").select("at", F.lit("unresolved").alias("outcome"), F.lit(None).cast(dict(asked.dtypes)["end"]).alias("end"))
    return out.unionByName(unresolved), added.select("at", "src").join(asked.select("at", F.col("end").alias("dst")), "at").select("src", "dst")
