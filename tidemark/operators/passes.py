"""Full or incremental: what licenses a pass to score only what has changed.

A run is measured against its baseline, the newest run before it that succeeded. Its
changes are all that needs scoring only if a pass has completed on that very run,
with the same profile and the same scorer; else everything is scored, and the pass
says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def modes(runs: DataFrame, passes: DataFrame, identity: DataFrame) -> DataFrame:
    """(series, run, baseline, mode, reasons) of each run with an identity.

    runs (series, run, requested_at, succeeded), ``run`` being unique; passes (pass,
    run, profile, scorer, completed, started_at); identity (run, profile, scorer):
    what each run would score with. Of several completed passes on a baseline the
    one started last counts, then the one with the greatest id. Identities that are
    null are equal to null ones.
    """
    before = Window.partitionBy("series").orderBy("requested_at", "run").rowsBetween(Window.unboundedPreceding, -1)
    measured = runs.withColumn("baseline", F.last(F.when(F.col("succeeded"), F.col("run")), ignorenulls=True).over(before)).join(identity, "run")
    done = passes.filter("completed").groupBy(F.col("run").alias("baseline")).agg(F.max_by(F.struct("profile", "scorer"), F.struct("started_at", "pass")).alias("p"))
    without, held = measured.filter("baseline IS NULL"), measured.filter("baseline IS NOT NULL")
    rows = held.join(done, "baseline", "left").unionByName(without.withColumn("p", F.lit(None)), allowMissingColumns=True)
    moved = lambda name: F.when(~F.col(name).eqNullSafe(F.col(f"p.{name}")), F.lit(f"{name}_changed"))
    reasons = F.when(F.col("p").isNull(), F.array(F.lit("no_baseline_pass"))).otherwise(F.array_compact(F.array(moved("profile"), moved("scorer"))))
    return rows.select("series", "run", "baseline", F.when(F.size(reasons) > 0, "full").otherwise("incremental").alias("mode"), reasons.alias("reasons"))


def to_score(mode: DataFrame, entities: DataFrame, changed: DataFrame) -> DataFrame:
    """(run, entity) to score: all entities of a full run's series, the changed ones of an incremental run.

    entities (series, entity); changed (run, entity): each run's difference from its baseline.
    """
    everything = mode.filter("mode = 'full'").select("series", "run").join(entities, "series").select("run", "entity")
    return everything.unionByName(mode.filter("mode = 'incremental'").select("run").join(changed, "run").select("run", "entity")).distinct()
