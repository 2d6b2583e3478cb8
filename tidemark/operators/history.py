"""Score history: each input is scored once, what it replaces is superseded, and an input that comes back revives its own row.

A key is an entity, a profile and a scorer. It has at most one current row; a row's
id follows from the key and the input, so an input that goes A, B, A comes back to
the row that A wrote first, which becomes current again and is no longer superseded
by anything. A pass names the inputs of some keys; full-outer against the current
rows each key is then

* ``reused``: its current row has that input already,
* ``fresh``: it has no row of that input and none that is current,
* ``replaced``: it has a current row, and none of that input yet,
* ``reverted``: it has a superseded row of that input, which is revived,
* ``untouched``: the pass does not name it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ingest import entity_id

KEY = ["entity", "profile", "scorer"]
HISTORY = "row_id string, entity string, profile string, scorer string, input string, scored_at string, superseded_at string, superseded_by string"


@dataclass
class Pass:
    """history after the pass; buckets (entity, profile, scorer, row_id, bucket), a row a key; scores to compute: those that are fresh or replaced."""

    history: DataFrame
    buckets: DataFrame

    def to_score(self) -> DataFrame:
        return self.buckets.filter(F.col("bucket").isin("fresh", "replaced")).drop("bucket")


def merged(history: DataFrame, planned: DataFrame, at: str) -> Pass:
    """Applies a pass (entity, profile, scorer, input) to a history. Of a key that is planned twice the greatest input counts."""
    plan = planned.groupBy(*KEY).agg(F.max("input").alias("input")).withColumn("row_id", entity_id(*KEY, "input"))
    current = history.filter("superseded_at IS NULL").select(*KEY, F.col("row_id").alias("old"))
    on_file = history.select("row_id", F.lit(True).alias("known"))
    both = plan.join(on_file, "row_id", "left").join(current, KEY, "full_outer")
    bucket = (
        F.when(F.col("row_id").isNull(), "untouched").when(F.col("row_id") == F.col("old"), "reused").when(F.col("known"), "reverted").when(F.col("old").isNull(), "fresh").otherwise("replaced")
    )
    both = written(both.withColumn("bucket", bucket), "history-buckets")
    moves = both.filter(F.col("bucket").isin("fresh", "replaced", "reverted"))
    retired = moves.filter("old IS NOT NULL").select(F.col("old").alias("row_id"), F.col("row_id").alias("by"))
    revived = moves.filter("bucket = 'reverted'").select("row_id", F.lit(True).alias("revived"))
    kept = history.join(retired, "row_id", "left").join(revived, "row_id", "left")
    stamp = F.when(F.col("revived"), F.lit(None).cast("string"))
    kept = kept.select(
        "row_id", *KEY, "input", "scored_at", stamp.when(F.col("by").isNotNull(), F.lit(at)).otherwise(F.col("superseded_at")).alias("superseded_at"), stamp.when(F.col("by").isNotNull(), F.col("by")).otherwise(F.col("superseded_by")).alias("superseded_by")
    )
    none = F.lit(None).cast("string")
    new = moves.filter("bucket <> 'reverted'").select("row_id", *KEY, "input", F.lit(at).alias("scored_at"), none.alias("superseded_at"), none.alias("superseded_by"))
    return Pass(written(kept.unionByName(new), "history"), both.select(*KEY, F.coalesce("row_id", "old").alias("row_id"), "bucket"))
