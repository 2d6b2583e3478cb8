"""What changed between two states: set differences, dirty rows, presence and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compared(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row a key of either side: change (new, gone, changed, same) and the fields that differ, nulls being values."""
    a = old.select(*keys, F.struct(*fields).alias("_old"))
    b = new.select(*keys, F.struct(*fields).alias("_new"))
    both = a.join(b, keys, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in fields]))
    inside = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.size(differ) > 0, "changed").otherwise("same")
    return both.select(*keys, change.alias("change"), F.when(inside, differ).otherwise(F.array().cast("array<string>")).alias("fields"))


def content_hash(*fields: str) -> Column:
    """sha256 of the fields in their order, null as empty, separated by the unit separator."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256))


def changes_as_events(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row a field that really changed: keys, field, old_value, new_value."""
    both = old.select(*keys, F.struct(*fields).alias("_old")).join(new.select(*keys, F.struct(*fields).alias("_new")), keys)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_old.{f}").cast("string").alias("old_value"), F.col(f"_new.{f}").cast("string").alias("new_value")) for f in fields])
    return both.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def presence(owned: DataFrame, seen: DataFrame, licensed: DataFrame, key: str, source: str) -> DataFrame:
    """Owned entities after a run: seen ones are present; unseen ones are absent only where their source was enumerated completely."""
    marks = owned.join(seen.select(key, F.lit(True).alias("_seen")).distinct(), key, "left").join(licensed.select(source, F.lit(True).alias("_licence")).distinct(), source, "left")
    state = F.when(F.col("_seen"), "present").when(F.col("_licence"), "absent").otherwise("unknown")
    return marks.withColumn("presence", state).drop("_seen", "_licence")


def superseded(current: DataFrame, planned: DataFrame, keys: list[str], hash_: str) -> DataFrame:
    """Sorts planned results against the current ones: fresh, reused, replaced; and kept for those without a plan."""
    both = current.select(*keys, F.struct(hash_).alias("_old")).join(planned.select(*keys, F.struct(hash_).alias("_new")), keys, "full_outer")
    outcome = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "fresh").when(F.col("_old").eqNullSafe(F.col("_new")), "reused").otherwise("replaced")
    return both.select(*keys, outcome.alias("outcome"))
